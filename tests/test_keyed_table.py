"""The keyed table: versions, batches that come twice, jobs that die, conflicts, and what is rewritten."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gazette.operators.keyed_table import Conflict, KeyedTable

DDL = "k long, g string, v string, at int"


@pytest.fixture
def make(spark, tmp_path):
    def made(name="t", buckets=64):
        return KeyedTable(spark, f"file://{tmp_path}/{name}", spark.createDataFrame([], DDL).schema, ["k"], buckets)

    return made


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def of(spark, data):
    return spark.createDataFrame(data, DDL)


def test_upsert_insert_and_versions(spark, make):
    t = make()
    assert rows(t.read()) == [] and t.upsert(of(spark, [(1, "a", "x", 1), (2, "a", "y", 1), (None, "b", "n", 1)]), "at") == 1
    assert t.upsert(of(spark, [(1, "a", "late", 0), (2, "a", "z", 2), (2, "a", "zz", 3), (3, "b", "w", 2)]), "at") == 2
    assert rows(t.read()) == rows(of(spark, [(1, "a", "x", 1), (2, "a", "zz", 3), (3, "b", "w", 2), (None, "b", "n", 1)]))
    assert t.insert_absent(of(spark, [(1, "q", "q", 9), (4, "c", "m", 1), (4, "c", "n", 2), (None, "q", "q", 9)]), "at") == 3
    assert rows(t.read()) == rows(of(spark, [(1, "a", "x", 1), (2, "a", "zz", 3), (3, "b", "w", 2), (4, "c", "n", 2), (None, "b", "n", 1)]))
    assert rows(t.read(version=1)) == rows(of(spark, [(1, "a", "x", 1), (2, "a", "y", 1), (None, "b", "n", 1)]))
    assert t.upsert(of(spark, []), "at") == 4 and len(rows(t.read())) == 5


def test_range_and_diff(spark, make):
    t = make()
    t.upsert(of(spark, [(1, "a", "x", 1), (2, "a", "y", 5), (3, "b", "z", 5), (4, "b", None, None)]), "at")
    t.replace_range(of(spark, [(9, "c", "new", 5)]), (F.col("at") == 5) & (F.col("g") == "a"))
    assert rows(t.read()) == rows(of(spark, [(1, "a", "x", 1), (3, "b", "z", 5), (4, "b", None, None), (9, "c", "new", 5)]))
    t.diff_replace(of(spark, [(3, "b", "kept", 6), (5, "b", "made", 6)]), ["g"], "at", emptied=of(spark, [(None, "c", None, None)]))
    assert rows(t.read()) == rows(of(spark, [(1, "a", "x", 1), (3, "b", "kept", 6), (5, "b", "made", 6)]))


def test_a_batch_that_comes_twice_is_written_once(spark, make):
    t = make()
    assert [t.upsert(of(spark, [(1, "a", v, n)]), "at", writer="w", batch=b) for v, n, b in (("x", 1, 0), ("y", 2, 1), ("z", 3, 1), ("z", 3, 0))] == [1, 2, 2, 2]
    assert rows(t.read()) == [(1, "a", "y", 2)]
    assert t.upsert(of(spark, [(1, "a", "other", 4)]), "at", writer="w2", batch=0) == 3


def test_few_keys_rewrite_few_buckets(spark, make):
    t = make()
    t.upsert(spark.range(3000).select(F.col("id").alias("k"), F.lit("g").alias("g"), F.lit("v").alias("v"), F.lit(1).alias("at")), "at")
    before = t.manifest()["buckets"]
    t.upsert(of(spark, [(k, "g", "new", 2) for k in (7, 8, 9)]), "at")
    after = t.manifest()["buckets"]
    moved = {b for b in before if before[b] != after[b]}
    assert len(before) == 64 and 1 <= len(moved) <= 3 and after.keys() == before.keys()
    assert t.read().count() == 3000 and t.read().where("v = 'new'").count() == 3
    only = t.read(only=[int(b) for b in moved])
    assert len({f.rsplit("/", 1)[0] for f in only.inputFiles()}) == len(moved)


def test_a_job_that_dies_leaves_the_version_before(spark, make, monkeypatch):
    t = make()
    t.upsert(of(spark, [(1, "a", "x", 1)]), "at")

    def die(_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", lambda self, manifest: die(manifest))
        with pytest.raises(KeyboardInterrupt):
            t.upsert(of(spark, [(1, "a", "lost", 2)]), "at")
    assert rows(t.read()) == [(1, "a", "x", 1)] and len(t._names("data")) == 2
    t.upsert(of(spark, [(1, "a", "again", 3)]), "at")
    assert rows(t.read()) == [(1, "a", "again", 3)]
    assert t.expire(keep=1) == 2 and t.versions() == [2] and rows(t.read()) == [(1, "a", "again", 3)]


def test_of_two_changes_to_one_version_the_second_fails(spark, make, monkeypatch):
    t, other = make(), make()
    t.upsert(of(spark, [(1, "a", "x", 1)]), "at")
    stale = t.manifest()
    other.upsert(of(spark, [(2, "a", "y", 1)]), "at")
    monkeypatch.setattr(t, "manifest", lambda version=None: stale)
    with pytest.raises(Conflict):
        t.upsert(of(spark, [(3, "a", "z", 1)]), "at")
    assert rows(other.read()) == [(1, "a", "x", 1), (2, "a", "y", 1)] and other.versions() == [1, 2]


def test_all_rows_of_a_bucket_may_go(spark, make):
    t = make(buckets=1)
    t.upsert(of(spark, [(1, "a", "x", 1)]), "at")
    t.replace_range(of(spark, []), F.lit(True))
    assert rows(t.read()) == [] and t.manifest()["buckets"] == {}
    t.upsert(of(spark, [(1, "a", "x", 1)]), "at")
    assert rows(t.read()) == [(1, "a", "x", 1)]
