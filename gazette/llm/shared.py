"""What the operators of this subpackage share: the shared folder, Arrow helpers, word hashing.

Shared folder: intermediate tables go to the folder in ``spark.checkpoint.dir``, which the driver and
all executors see; a lost executor then costs a re-read, not the table. Where the setting is absent, a
temporary folder is set once if the master is local (tests, a laptop); on a cluster that is an error.
The tables of a run are removed by ``drop_saved`` once no result needs them.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_SAVED: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "root" not in _OWN:
        _OWN["root"] = "file://" + tempfile.mkdtemp(prefix="gazette-shared-")
    return _OWN["root"]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there."""
    path = shared_path(df.sparkSession, name)
    _SAVED.add(path.rsplit("/", 1)[-1])
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(*tables: DataFrame) -> None:
    """Remove tables that ``save`` returned; nothing still to be computed may read them."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if folder.rsplit("/", 1)[-1] in _SAVED:
                path = sc._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name followed by underscores, whichever df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def refuse(df: DataFrame, *names: str | None) -> None:
    """Fail if df has a column that is to be added; Spark tells names apart without regard to case."""
    taken = {c.lower() for c in df.columns}
    for name in names:
        if name and name.lower() in taken:
            raise ValueError(f"column {name} exists already; name another")


#: Rows, and bytes, of whole texts that go to a Python worker at once; a row larger than that is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def modest_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in rows and in bytes, unless the session already asks for smaller ones."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b"))
        if now > most or now <= 0:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


_KEPT: dict[object, object] = {}


def kept(key: object, make: Callable[[], Any]) -> Any:
    """What a worker keeps between tasks, such as a vocabulary: one thing at a time, as workers serve one operator after another."""
    if key not in _KEPT:
        _KEPT.clear()
        release_memory()
        _KEPT[key] = make()
    return _KEPT[key]


def release_memory() -> None:
    """Give freed memory back to the machine: workers are used again, and what they hold counts against their executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: drop what another operator left in the worker first, and give memory back at the end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("nothing", int)
        yield from run(batches)
        release_memory()

    return wrapped


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the documents whose labels are never learned from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_labels(labels: DataFrame, label: str, train_rows: int) -> DataFrame:
    """doc_id and y of at most train_rows labelled documents that may be learned from."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)


def held_out_py(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def byte_rows(col: pa.Array) -> Iterator[np.ndarray | None]:
    """UTF-8 bytes of each row of a string or binary array, without a copy; None for null."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1] if bufs[1] else np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    valid = np.ones(len(col), bool) if col.null_count == 0 else col.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(col)):
        yield data[offs[i] : offs[i + 1]] if valid[i] else None


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of the join on shingles: everything but the six ASCII white-space characters.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, 9, 10, 11, 12, 13]] = False
#: Words of decontamination, after lower-casing: digits, a to z and all that is not ASCII.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True

_M = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser, by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and where each maximal run of word bytes starts and ends."""
    low = LOWER[data]
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = kind[low]
    step = np.diff(inside)
    return low, np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its bytes are mixed with their places in it, summed, and mixed again.

    A polynomial modulo 2**64 would be cheaper, but strings that collide under every base are known.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    first, n = int(starts[0]), len(low)
    sums = np.zeros(n - first + 1, np.uint64)
    places = np.arange(n - first) - np.repeat(starts - first, np.diff(starts, append=n))  # from where the last word began
    for lo in range(0, n - first, 1 << 16):  # in pieces that stay in cache
        x = (places[lo : lo + (1 << 16)].astype(np.uint64) << np.uint64(8)) + low[first + lo : first + lo + (1 << 16)] + np.uint64(1)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        sums[lo + 1 : lo + 1 + len(x)] = x
    np.cumsum(sums, out=sums)
    return mix(sums[ends - first] - sums[starts - first] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes, sorted, of all runs of k words; of the whole where there are fewer words."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = min(n, k)
    out = np.full(n - size + 1, (size * 0xA24BAED4963EE407) & _M, np.uint64)
    for i in range(size):
        out += h[i : n - size + 1 + i] * np.uint64(((2 * i + 1) * 0x9FB21C651E98DF25) & _M | 1)
        out = (out << np.uint64(7)) | (out >> np.uint64(57))
    return np.unique(mix(out))
