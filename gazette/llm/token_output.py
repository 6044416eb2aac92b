"""Token ids as Parquet list columns (operator 1).

``write_tokens`` deals documents by range of doc_id, encodes them with the tokenizers library, and writes
one sorted file for each range: ``ids`` is dictionary-encoded (falling back to delta packing), ``doc_id``
and the offsets are delta-packed, row groups and pages have set sizes, and the page indexes that Parquet
keeps let a reader skip to the pages of a doc_id range or read the lengths without the ids.

``read_tokens`` gives the documents back with ``start``, the number of ids of all documents before each:
the running offset within a file is stored with it, and only one total for each file meets in a window.

Within a worker the ids of a pre-token (a piece that the library's own pattern cuts, so that pieces encode
independently) are kept and the library is asked for pieces not seen yet.

Defined results: a null or empty text has only the end id. Rows with equal doc_id keep an order by text
hash; rows with a null doc_id come first. Columns besides id and text are not written.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.llm.bpe import MISSES, byte_level_spec, pre_tokenizer
from gazette.llm.shared import kept, release_memory

#: Of the written files: bytes of a row group and of a page, and rows of a page at most.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2_000
SCHEMA = "doc_id long, n_tokens int, part int, part_start long, ids array<int>"
ROWS = 128
#: Pre-tokens whose ids a worker keeps at most.
LIBRARY_ENTRIES = 600_000


class LibraryEncoder:
    """Ids by the tokenizers library, kept for each pre-token."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        byte_level_spec(path)  # the pieces below are the library's own only for such a vocabulary
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.cut = pre_tokenizer()
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cache, get, rows, holes = self.cache, self.cache.get, [], []
        for k, t in enumerate(texts):
            if any(s in t for s in self.special):
                rows.append([array("i", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()])
                continue
            pieces = self.cut(t)
            rows.append(found := list(map(get, pieces)))  # each piece is looked up once; those not kept leave a hole
            i = -1
            for _ in range(found.count(None)):
                i = found.index(None, i + 1)
                holes.append((k, i, pieces[i]))
        pieces, extra = list({p for _, _, p in holes}), {}
        for lo in range(0, len(pieces), 1024):
            some = pieces[lo : lo + 1024]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                extra[p] = array("i", e.ids).tobytes()
        for k, i, p in holes:
            rows[k][i] = extra[p]
        if len(cache) >= LIBRARY_ENTRIES and len(holes) > MISSES * max(sum(map(len, rows)), 10_000):
            cache.clear()  # other texts than those that filled it
        room = max(0, LIBRARY_ENTRIES - len(cache))
        cache.update((p, extra[p]) for p in pieces[:room])
        return [b"".join(x) for x in rows]


def _encoder(path: str) -> LibraryEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many workers as there are cores
    return kept(("token ids", path), lambda: LibraryEncoder(path))


def write_tokens(docs: DataFrame, path: str, vocab_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """Write the ids of docs to path, in ascending order of id_col within and across files."""
    spark = docs.sparkSession
    n = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())  # as many as the scan has splits, or more
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<i4").tobytes()
        encoder = _encoder(vocab_path)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                ids = [x + end for x in encoder.encode([t or "" for t in batch.column(1).to_pylist()])]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(np.full(len(ids), part), pa.int32()), pa.array(at + ends - sizes, pa.int64()), lists], names=["doc_id", "n_tokens", "part", "part_start", "ids"])
                at += int(sizes.sum())
        release_memory()

    options = {
        "compression": "zstd", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#part_start": "false", "parquet.enable.dictionary#n_tokens": "false",
    }
    dealt.mapInArrow(run, SCHEMA).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of each document written; columns not asked for are not read."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("base"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def id_digests(tokens: DataFrame, out_col: str = "ids_crc32") -> DataFrame:
    """doc_id, start, n_tokens and the unsigned CRC-32 of each document's ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values, offs = lists.values.to_numpy(), lists.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(values, "<i4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", out_col])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, f"doc_id long, start long, n_tokens long, {out_col} long")
