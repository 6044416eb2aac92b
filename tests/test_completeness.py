"""Division by counts and the states of a batch."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from gazette.operators import completeness as C

DAY = datetime.datetime(2026, 1, 1)


def test_division(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",)], "key string")
    needs = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("c", None), ("x", "9"), ("a", "2")], "k string, e string")
    there = spark.createDataFrame([("1",), ("2",), ("2",), ("8",)], "e string")
    got = C.divided(keys, "key", [C.requirement(needs, "card", F.col("k"), F.col("e")), C.requirement(keys, "body", F.col("key"), F.col("key"))], [C.presence(there, "card", F.col("e")), C.presence(keys.where("key <> 'd'"), "body", F.col("key"))])
    assert sorted(tuple(r) for r in got.select("key", "required", "present", "missing", "complete").collect()) == [("a", 3, 3, [], True), ("b", 2, 1, ["card"], False), ("c", 1, 1, [], True), ("d", 1, 0, ["body"], False)]
    assert "Cartesian" not in got._jdf.queryExecution().toString() and got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_no_requirement_is_complete(spark):
    keys = spark.createDataFrame([(1,)], "k int")
    none = keys.where("k > 1")
    assert [tuple(r) for r in C.divided(keys, "k", [C.requirement(none, "x", F.col("k"), F.col("k"))], [C.presence(none, "x", F.col("k"))]).collect()] == [(1, 0, 0, [], True)]


def test_states_of_a_batch(spark):
    day = lambda n: F.lit(DAY + datetime.timedelta(days=n)).cast("timestamp")
    ids = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    none = F.lit(None).cast(C._BATCH)
    begun = C.synced(none, F.lit("vi"), ids("b", " a", "a", ""), day(0))
    moved = C.synced(begun, F.lit("vi"), ids("c"), day(1))
    steps = [
        C.synced(none, F.lit("vi"), ids(), day(0)), begun, C.synced(begun, F.lit("vi"), ids("a", "b"), day(1)), moved, C.synced(begun, F.lit("en"), ids("c"), day(1)),
        C.synced(begun, F.lit("en"), ids(), day(1)), C.synced(begun, F.lit("vi"), ids(), day(2)), C.progressed(begun, ids("b"), day(3)), C.progressed(begun, ids(), day(3)),
        C.synced(C.progressed(begun, ids(), day(3)), F.lit("vi"), ids("b"), day(4)), C.progressed(C.progressed(begun, ids(), day(3)), ids(), day(5)), C.progressed(none, ids(), day(1)),
    ]
    row = spark.range(1).select(*(s.alias(f"s{i}") for i, s in enumerate(steps))).first()
    at = lambda n: DAY + datetime.timedelta(days=n)
    assert [None if s is None else tuple(s) for s in row] == [
        None, ("vi", ["a", "b"], ["a", "b"], "pending", at(0), None), ("vi", ["a", "b"], ["a", "b"], "pending", at(0), None), ("vi", ["c"], ["c"], "pending", at(0), None), ("en", ["c"], ["c"], "pending", at(1), None),
        ("vi", ["a", "b"], ["a", "b"], "pending", at(0), None), ("vi", ["a", "b"], [], "complete", at(0), at(2)), ("vi", ["a", "b"], ["b"], "pending", at(0), None), ("vi", ["a", "b"], [], "complete", at(0), at(3)),
        ("vi", ["b"], ["b"], "pending", at(4), None), ("vi", ["a", "b"], [], "complete", at(0), at(3)), None,
    ]
