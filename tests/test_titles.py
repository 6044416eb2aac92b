"""Containment of titles against all pairs, and composed letters."""

from __future__ import annotations

import random
import unicodedata

from pyspark.sql import functions as F

from gazette.functions import school, text
from gazette.operators.containment import containment_pairs


def test_containment_equals_all_pairs(spark):
    rng = random.Random(2)
    make = lambda n: ["".join(rng.choice("ab가") for _ in range(rng.randint(0, 12))) for _ in range(n)]
    a, b = [*make(150), None, "aaaa", "aaaa"], [*make(150), None, "xxxxaaaaxxxx", "🙂🙂🙂🙂", "a🙂🙂🙂🙂"]
    a.append("z🙂🙂🙂🙂z")
    left, right = (spark.createDataFrame([(t,) for t in x], "t string") for x in (a, b))
    got = containment_pairs(left, "t", right, "t")
    want = {(x, y) for x in a for y in b if x and y and len(x) >= 4 and len(y) >= 4 and (x in y or y in x)}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    plan = got._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert containment_pairs(left.limit(0), "t", right, "t").count() == 0


def test_composed_subjects(spark):
    df = spark.createDataFrame([(unicodedata.normalize("NFD", "수학Ⅱ"),), (unicodedata.normalize("NFD", "확통"),), ("é",), (None,), ("plain",)], "t string")
    rows = df.select(text.composed("t").alias("c"), school.split_subject(text.composed("t")).alias("s")).collect()
    assert [r["c"] for r in rows] == ["수학Ⅱ", "확통", "é", None, "plain"]
    assert (rows[0]["s"]["base"], rows[0]["s"]["suffix"], rows[1]["s"]["key"]) == ("수학", "II", "확률과통계")
    assert df.select(F.count("t")).first()[0] == 4
