"""Approximate nearest neighbours by largest inner product (operator 4), with score-aware quantisation.

A product quantiser of sixteen centres for each pair of dimensions (four bits) is fitted under the anisotropic
loss: of the error x - c, the part parallel to x, which shifts large inner products, weighs ``eta`` times as
much as the part across it. The parallel parts of all sub-vectors add up, so codes are chosen by coordinate
descent over them and centres by weighted least squares.

Search. A block holds ids, codes (half a byte a part), how far each row is from its code, and the vectors themselves.
Queries go out in groups of GROUP_BYTES at most. For a query, tables of two codes each give every row an approximate score.
A share of the rows (one in SHARE, or SAMPLE rows if more, but at most a quarter) is scored both ways first. It sets each query's bar, the
k-th exact score there, which the k-th of all rows cannot be below, and its reach: by how much codes misjudge the rows that
matter, as a multiple of their distance from the code; the worst of the query's own k, and of 99 in 100 queries. The scan of all
rows scores exactly, in double precision, every row whose approximate score and reach come up to the bar, however many they are,
so rows that lie closer together than codes can tell are all compared. The bar rises with the best k seen so far in a task. The
best k of each block are ranked over all.

The quantiser is fitted on at most ``train_rows`` vectors, those with the least hash of id; every row is coded.
``rerank`` rows of a block, best by approximate score, are scored exactly first to raise the bar (4 k if not given).

Defined results: vectors that are null or zero or that hold null or non-finite components take no part; so do
rows with a null id. Vectors of different lengths have no inner product: each length is searched by itself. Equal
rows count once; an id that repeats with different vectors is several candidates, and as a query asks with each. A query never
meets rows of its own id. Ties go to the smaller id; with fewer candidates than k all of them are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.shared import save, tidy

#: Rows that are scanned at once, bytes of their vectors, bytes of vectors of a group of queries, and the rows that set the bar: one in SHARE, or SAMPLE.
BLOCK, BLOCK_BYTES, GROUP_BYTES, SHARE, SAMPLE = 16_384, 4 << 20, 32 << 20, 64, 2_048
CENTRES, WIDTH = 16, 2


@dataclass
class AnisotropicQuantiser:
    """centres: part, centre, component. Vectors are padded with zeros to a whole number of pairs of parts."""

    centres: np.ndarray
    eta: float

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.centres.shape[0] * WIDTH - x.shape[1])))

    def codes(self, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """The code of each part of each row."""
        x = self.padded(x).astype(np.float64)
        return _assign(_parts(x), _parts(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)), self.centres, self.eta, sweeps)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes a byte."""
        return (codes[:, ::2] << 4 | codes[:, 1::2]).astype(np.uint8)

    def off(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far each row is from its code, with what single precision may lose."""
        x = self.padded(x).astype(np.float64)
        coded = self.centres[np.arange(len(self.centres))[None, :], codes].reshape(len(x), -1)
        return (np.linalg.norm(x - coded, axis=1) + 1e-5 * np.linalg.norm(x, axis=1)).astype("<f4")

    def tables(self, query: np.ndarray) -> np.ndarray:
        """For each byte of a packed code its share of the inner product with the query: a row of 256 entries a byte."""
        one = np.einsum("mkw,mw->mk", self.centres, _parts(self.padded(query[None].astype(np.float64)))[:, 0])
        return (one[::2, :, None] + one[1::2, None, :]).reshape(-1, 256).astype(np.float32)


def _parts(x: np.ndarray) -> np.ndarray:
    """part, row, component."""
    return np.ascontiguousarray(x.reshape(len(x), -1, WIDTH).transpose(1, 0, 2))


def _assign(x: np.ndarray, u: np.ndarray, centres: np.ndarray, eta: float, sweeps: int, codes: np.ndarray | None = None) -> np.ndarray:
    """Codes under the loss |r|**2 + (eta - 1) (r . u)**2, part by part; x and u are by part."""
    m, n, _ = x.shape
    if codes is None:
        codes = np.stack([((x[j, :, None] - centres[j][None]) ** 2).sum(2).argmin(1) for j in range(m)], 1) if m else np.zeros((n, 0), np.int64)
    left = x - centres[np.arange(m)[:, None], codes.T]
    along = (left * u).sum(2)  # part, row
    total = along.sum(0)
    for _ in range(sweeps):
        moved = 0
        for j in range(m):
            gap = x[j, :, None] - centres[j][None]
            p = np.einsum("nkw,nw->nk", gap, u[j])
            best = ((gap * gap).sum(2) + (eta - 1) * ((total - along[j])[:, None] + p) ** 2).argmin(1)
            moved += int((best != codes[:, j]).sum())
            codes[:, j] = best
            now = p[np.arange(n), best]
            total += now - along[j]
            along[j] = now
        if not moved:
            break
    return codes


def fit_quantiser(x: np.ndarray, threshold: float = 0.2, rounds: int = 6) -> AnisotropicQuantiser:
    """threshold: inner products of unit vectors above it are those that matter; it sets the weight of the parallel error."""
    d = x.shape[1]
    m = -(-d // WIDTH)
    m += m % 2
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    start = AnisotropicQuantiser(np.zeros((m, CENTRES, WIDTH)), eta)
    x = start.padded(x).astype(np.float64)
    rng = np.random.default_rng(7)
    parts, units = _parts(x), _parts(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30))
    centres = parts[:, rng.choice(len(x), CENTRES, replace=len(x) < CENTRES)] + 1e-9 * rng.standard_normal((m, CENTRES, WIDTH))
    for _ in range(rounds):  # plain centres to start from
        for j in range(m):
            near = ((parts[j, :, None] - centres[j][None]) ** 2).sum(2).argmin(1)
            many = np.bincount(near, minlength=CENTRES)
            sums = np.stack([np.bincount(near, parts[j, :, w], CENTRES) for w in range(WIDTH)], 1)
            centres[j] = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centres[j])
    codes = None
    for _ in range(rounds):
        codes = _assign(parts, units, centres, eta, 1, codes)
        along = ((parts - centres[np.arange(m)[:, None], codes.T]) * units).sum(2)
        total = along.sum(0)
        for j in range(m):
            u, c = units[j], codes[:, j]
            goal = total - along[j] + (parts[j] * u).sum(1)
            gram = np.zeros((CENTRES, WIDTH, WIDTH))
            np.add.at(gram, c, (eta - 1) * u[:, :, None] * u[:, None, :])
            gram += (np.bincount(c, minlength=CENTRES)[:, None, None] + 1e-9) * np.eye(WIDTH)
            side = np.zeros((CENTRES, WIDTH))
            np.add.at(side, c, parts[j] + (eta - 1) * goal[:, None] * u)
            new = np.linalg.solve(gram, side[:, :, None])[:, :, 0]
            centres[j] = np.where(np.bincount(c, minlength=CENTRES)[:, None] > 0, new, centres[j])
            now = ((parts[j] - centres[j][c]) * u).sum(1)
            total += now - along[j]
            along[j] = now
    return AnisotropicQuantiser(centres, eta)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, none null."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _codes(rows: DataFrame, quantiser: AnisotropicQuantiser, width: int) -> DataFrame:
    """Blocks of rows: ids, distances of the rows from their codes, codes (a row of bytes for each two parts), and vectors."""
    held = rows.sparkSession.sparkContext.broadcast(quantiser)  # a fixed number of centres for each dimension
    most = max(64, min(BLOCK, BLOCK_BYTES // (4 * width)))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []

        def block() -> pa.RecordBatch:
            ids, off, codes, vectors = (np.concatenate(z) for z in zip(*waiting, strict=True))
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, off, np.ascontiguousarray(codes.T), vectors)], names=["ids", "off", "codes", "vectors"])

        for batch in batches:
            for lo in range(0, batch.num_rows, most // 8):
                part = batch.slice(lo, most // 8)
                vectors = _matrix(part.column(1))
                codes = held.value.codes(vectors)
                waiting.append((part.column(0).to_numpy().astype("<i8"), held.value.off(vectors, codes), held.value.pack(codes), np.ascontiguousarray(vectors)))
                if sum(len(x[0]) for x in waiting) > most - most // 8:
                    yield block()
        if waiting:
            yield block()

    return rows.select("id", "v").mapInArrow(run, "ids binary, off binary, codes binary, vectors binary")


def scan(queries: np.ndarray, codes: np.ndarray, quantiser: AnisotropicQuantiser) -> Iterator[np.ndarray]:
    """Approximate scores of all coded rows for each query; codes has a row for each byte of a code."""
    for vector in queries:
        tables = quantiser.tables(vector)
        rough = tables[0].take(codes[0])
        for j in range(1, len(codes)):
            rough += tables[j].take(codes[j])
        yield rough


def _exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.einsum("nd,d->n", vectors.astype(np.float64), query)


def _opened(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[np.ndarray, ...]]:
    for ids, off, codes, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        ids = np.frombuffer(ids, "<i8")
        yield ids, np.frombuffer(off, "<f4"), np.frombuffer(codes, np.uint8).reshape(-1, len(ids)), np.frombuffer(vectors, kind).reshape(len(ids), -1)


def _tried(blocks: DataFrame, held, kind: str, k: int) -> DataFrame:
    """query (its place in the group), score, and gap of the k best of each block: by how many of a row's distances from its code the exact score is above the approximate one."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, qids, queries = held.value
        for batch in batches:
            for ids, off, codes, vectors in _opened(batch, kind):
                vectors, out = vectors.astype(np.float64), []
                for i, rough in enumerate(scan(queries, codes, quantiser)):
                    score = _exact(vectors, queries[i])
                    score[ids == qids[i]] = -np.inf
                    some = np.argpartition(-score, k)[:k] if len(score) > k else np.arange(len(score))
                    some = some[score[some] > -np.inf]
                    gap = (score[some] - rough[some]) / np.maximum(off[some] * np.linalg.norm(queries[i]), 1e-300)
                    out.append((np.full(len(some), i, np.int32), score[some], gap))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out, strict=True)], names=["query", "score", "gap"])

    return blocks.mapInArrow(run, "query int, score double, gap double")


def _scanned(blocks: DataFrame, held, kind: str, bars: np.ndarray, reach: np.ndarray, k: int, lead: int) -> DataFrame:
    """query_id, vec_id and exact score of the k best of each block among the rows that may come up to a query's bar."""
    sent = blocks.sparkSession.sparkContext.broadcast((bars, reach))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, qids, queries = held.value
        bars, reach = sent.value
        bars = bars.copy()  # rises with what this task has seen
        for batch in batches:
            for ids, off, codes, vectors in _opened(batch, kind):
                out: list[tuple[np.ndarray, ...]] = []
                for i, rough in enumerate(scan(queries, codes, quantiser)):
                    most = rough + np.float32(reach[i]) * off
                    some = np.flatnonzero(most >= bars[i])
                    some = some[ids[some] != qids[i]]
                    if len(some) > 2 * lead:
                        first = some[np.argpartition(-rough[some], lead)[:lead]]
                        bars[i] = max(bars[i], np.partition(_exact(vectors[first], queries[i]), lead - k)[lead - k])
                        some = some[most[some] >= bars[i]]
                    score = _exact(vectors[some], queries[i])
                    if len(some) > k:
                        bars[i] = max(bars[i], np.partition(score, len(score) - k)[len(score) - k])
                    fit = score >= bars[i]
                    some, score = some[fit], score[fit]
                    best = np.lexsort((ids[some], -score))[:k]
                    out.append((np.full(len(best), qids[i]), ids[some[best]], score[best]))
                    if i % 1024 == 1023 or i == len(queries) - 1:
                        got = [np.concatenate(z) for z in zip(*out, strict=True)]
                        out.clear()
                        yield pa.RecordBatch.from_arrays([pa.array(z) for z in got], names=["query_id", "vec_id", "score"])

    return blocks.mapInArrow(run, "query_id long, vec_id long, score double")


def _search(rows: DataFrame, k: int, train_rows: int, rerank: int | None) -> DataFrame | None:
    """query_id, vec_id, score of the k best of each query that were found in each block; all vectors of rows have one length."""
    spark = rows.sparkSession
    n, n_queries, width = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("v"))).first()
    if not n_queries:
        return None
    kind = "<f4" if rows.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"
    sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id", "v").limit(train_rows).toPandas()  # bounded by train_rows
    quantiser = fit_quantiser(np.stack(sample["v"].tolist()).astype(np.float64))
    blocks = save(_codes(rows, quantiser, width), "codes")
    below = int(max(min(0.25, SAMPLE / n), 1 / SHARE) * 1_000_000)
    few = save(_codes(rows.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000)) < below), quantiser, width), "codes")
    groups = -(-n_queries * width * 8 // GROUP_BYTES)
    asked = rows.where("asks").select("id", "v", F.pmod(F.xxhash64("id", "v", F.lit(2)), F.lit(groups)).alias("part"))
    found = []
    for g in range(groups):
        mine = asked.where(F.col("part") == g).select("id", "v").toPandas()  # about GROUP_BYTES
        if not len(mine):
            continue
        qids, queries = mine["id"].to_numpy(np.int64), np.stack(mine["v"].tolist()).astype(np.float64)
        held = spark.sparkContext.broadcast((quantiser, qids, queries))
        top = _tried(few, held, kind, k).withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("at") <= k)
        got = top.groupBy("query").agg(F.min("score").alias("bar"), F.max("gap").alias("gap"), F.count(F.lit(1)).alias("many")).where(F.col("many") == k).toPandas()  # one row a query
        bars, reach = np.full(len(qids), -np.inf), np.zeros(len(qids))
        if len(got):
            bars[got["query"].to_numpy()] = got["bar"].to_numpy()
            reach[got["query"].to_numpy()] = got["gap"].to_numpy()
            reach = np.maximum(reach, max(0.1, np.quantile(got["gap"].to_numpy(), 0.99))) * np.linalg.norm(queries, axis=1)
        found.append(_scanned(blocks, held, kind, bars, reach, k, max(rerank or 4 * k, k)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", train_rows: int = 8_192, rerank: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest inner product found for each row where is_query holds."""
    spark = vectors.sparkSession
    v = F.col("v")
    kind = vectors.schema[vector_col].dataType.elementType
    kind = kind.simpleString() if kind.simpleString() in ("float", "double") else "double"
    sound = F.aggregate(v, F.lit(True), lambda a, x: a & F.coalesce((x == x) & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(sound)
    rows = save(rows.groupBy("id", "v").agg(F.max("asks").alias("asks")), "vectors")
    lengths = [r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect()]  # one row a length
    found = [x for x in (_search(rows.where(F.size("v") == d), k, train_rows, rerank) for d in sorted(lengths)) if x is not None]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
