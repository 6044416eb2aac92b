"""Stream state by key against the batch forms: several micro-batches, with a restart between them."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gazette.operators import ingest
from gazette.streaming import keyed_state, marks

START = datetime.datetime(2026, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


@pytest.fixture
def replay(spark, tmp_path):
    """Runs a stream over slices of a table, one file each; the query is stopped and started anew after each call's slices."""
    keyed_state.use_rocksdb(spark)

    def run(df, calls, make):
        n = 0
        for call in calls:
            for part in call:
                df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
                n += 1
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            query = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            query.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    return run


def same(a, b):
    return sorted(map(str, map(tuple, a.collect()))) == sorted(map(str, map(tuple, b.select(*a.columns).collect())))


def slices(*cuts):
    edges = [*map(at, cuts)]
    t = F.col("at")
    return [t < edges[0], *((t >= a) & (t < b) for a, b in zip(edges, edges[1:], strict=False)), t >= edges[-1]]


def attempts(spark, n=400):
    rng = random.Random(4)
    return spark.createDataFrame([(i, rng.choice("aaab") + str(rng.randrange(3)), at(i * 7), rng.random() < 0.2) for i in range(n)] + [(n, None, at(1), True), (n + 1, "a0", None, True)], "id long, who string, at timestamp, ok boolean")


def test_debounce_of_a_stream_equals_batch(spark, replay):
    df = attempts(spark)
    first, second, third, fourth = slices(500, 501, 2000)
    got = replay(df.where("at is not null"), [[first, second], [third], [fourth]], lambda s: keyed_state.debounced(s, "who", "at", 60))
    want = marks.debounce(df, "who", "at", 60)
    assert got.count() > 50 and same(got, want)


def test_lockout_of_a_stream_equals_batch(spark, replay):
    df = attempts(spark)
    first, second, third, fourth = slices(300, 900, 1800)
    got = replay(df.where("at is not null"), [[first], [second, third], [fourth]], lambda s: keyed_state.lockouts(s, "who", "at", "ok", "id", 5, 120))
    assert {r["outcome"] for r in got.collect()} == {"ok", "invalid", "locked"}
    assert same(got, keyed_state.lockouts_batch(df, "who", "at", "ok", "id", 5, 120))


def test_lockout_cases(spark):
    tries = [(0, False), (1, False), (2, False), (3, False), (4, False), (5, True), (903, True), (904, False), (905, True)]
    rows = [(i, "u", at(t), ok) for i, (t, ok) in enumerate(tries)] + [(20 + i, "w", at(t), False) for i, t in enumerate([0, 1, 2, 3, 4, 905, 906])]
    got = keyed_state.lockouts_batch(spark.createDataFrame(rows, "id long, who string, at timestamp, ok boolean"), "who", "at", "ok", "id").orderBy("id").collect()
    assert [r["outcome"] for r in got] == ["invalid"] * 5 + ["locked", "locked", "invalid", "locked"] + ["invalid"] * 5 + ["invalid", "locked"]


def test_marks_of_a_stream_equal_batches(spark, replay):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, rng.choice("xyz"), at(i), rng.choice([None, rng.randrange(i + 5)])) for i in range(300)], "id long, board string, at timestamp, value long")
    parts = slices(100, 200)
    got = replay(df, [parts[:2], parts[2:]], lambda s: keyed_state.above_marks_stream(s, "board", "value"))
    marks_now, want = spark.createDataFrame([], "board string, mark long"), None
    for p in parts:
        kept = ingest.above_marks(df.where(p), marks_now, "board", "value").select(*df.columns)
        want = kept if want is None else want.unionByName(kept)
        marks_now = ingest.advance_marks(df.where(p), marks_now, "board", "value")
    assert 100 < got.count() < 300 and same(got, want)


def test_state_of_a_debounced_key_is_dropped_after_the_gap(spark, replay):
    df = spark.createDataFrame([(i, who, at(t), True) for i, (who, t) in enumerate([("a", 0), ("a", 3), ("b", 7300), ("b", 7301), ("a", 7400), ("c", 20000), ("a", 20001)])], "id long, who string, at timestamp, ok boolean")
    got = replay(df, [slices(7000, 7350, 10000)[:2], slices(7000, 7350, 10000)[2:]], lambda s: keyed_state.debounced(s, "who", "at", 10, delay="1 minute"))
    assert sorted((r["who"], r["at"]) for r in got.collect()) == [("a", at(0)), ("a", at(7400)), ("a", at(20001)), ("b", at(7300)), ("c", at(20000))]


class Store:
    """Stands for a state variable and its handle, and counts what is asked of it."""

    def __init__(self, value=None):
        self.value, self.asked, self.timers = value, [], []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.asked.append("get")
        return self.value

    def update(self, value):
        self.asked.append("update")
        self.value = value

    def clear(self):
        self.asked.append("clear")
        self.value = None

    def registerTimer(self, at):
        self.timers.append(at)


def fed(processor, store, rows):
    processor.init(store)
    return [tuple(r) for r in processor.handleInputRows(("k",), iter(rows), None)]


def test_each_key_takes_rows_and_asks_the_store_once():
    store = Store((5,))
    assert fed(keyed_state.Debounce(10), store, [Row("k", None, 30), Row("k", None, 16), Row("k", None, 15)]) == [("k", 15), ("k", 30)]
    assert store.asked == ["get", "update"] and store.value == (30,) and len(store.timers) == 1
    store = Store((7,))
    assert fed(keyed_state.AboveMark(), store, [Row("k", 7), Row("k", None), Row("k", 9), Row("k", 8)]) == [("k", None), ("k", 9), ("k", 8)]
    assert store.asked == ["get", "update"] and store.value == (9,)
    store = Store()
    assert fed(keyed_state.Lockout(2, 10), store, [Row("k", 3, 1, False), Row("k", 1, 0, True), Row("k", 3, 2, False), Row("k", 4, 3, True)]) == [("k", 1, 0, "ok"), ("k", 3, 1, "invalid"), ("k", 3, 2, "invalid"), ("k", 4, 3, "locked")]
    assert store.asked == ["get", "update"] and store.value == (2, 13)
