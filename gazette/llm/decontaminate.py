"""Benchmark decontamination (operator 7): a prefix-filtered join of documents with windows of benchmark items.

A window is ten consecutive words of an item (a shorter item is one window). Containment must be whole, so
the necessary prefix of a window, with its words ordered from rare to frequent over all documents, is its
rarest word: a document without it cannot hold the window. Only there does a document probe the index; the
word's place in the window and the two lengths bound where the window can start, and the item-sized window
is then compared word by word.

Items are collected in blocks of about BLOCK_BYTES of text. A larger benchmark takes a pass over the documents for
each block; in between, the rows are written to the shared folder and the block's index is given up, so one block
at a time is on the driver and in the workers, whatever the benchmark's size. The documents are never shuffled; a hot passage is found in
each document where it stands, and no pair of documents is ever formed.

Defined results: a null or wordless text has no words and no hits; null or wordless items, and items with a
null item_id, have no windows; repeated items count once per item_id. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.shared import ALNUM_WORDS, byte_rows, drop_saved, refuse, save, tidy, word_hashes, words

BLOCK_BYTES = 4 << 20
#: Windows that a text is held against at once.
CANDIDATES = 1 << 18
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType()))])


def _tokens(text: str) -> tuple[np.ndarray, list[bytes]]:
    low, a, b = words(np.frombuffer(text.encode(), np.uint8), ALNUM_WORDS)
    raw = low.tobytes()
    return word_hashes(low, a, b), [raw[i:j] for i, j in zip(a, b, strict=True)]


class WindowIndex:
    """Windows of a block of items, filed under their rarest word."""

    def __init__(self, items: list[tuple[str, str]], size: int) -> None:
        seen: dict[bytes, dict] = {}
        for item, text in items:
            h, w = _tokens(text)
            for i in range(max(1, len(w) - size + 1) if w else 0):
                key = b" ".join(w[i : i + size])
                seen.setdefault(key, {"hash": h[i : i + size], "items": set()})["items"].add(item)
        self.texts = list(seen)
        self.items = [sorted(x["items"]) for x in seen.values()]
        self.lengths = np.array([len(x["hash"]) for x in seen.values()], np.int64)
        self.hashes = np.zeros((len(seen), size), np.uint64)
        for i, x in enumerate(seen.values()):
            self.hashes[i, : len(x["hash"])] = x["hash"]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x["hash"] for x in seen.values())]))

    def order_by_rarity(self, counts: np.ndarray) -> None:
        """counts: of each word of the vocabulary over all documents. Ties go to the smaller hash."""
        rank = np.empty(len(self.vocabulary), np.int64)
        rank[np.lexsort((self.vocabulary, counts))] = np.arange(len(rank))
        at = np.zeros(len(self.texts), np.int64)
        for i, n in enumerate(self.lengths):
            at[i] = np.argmin(rank[np.searchsorted(self.vocabulary, self.hashes[i, :n])])
        anchors = self.hashes[np.arange(len(at)), at]
        order = np.argsort(anchors, kind="stable")
        self.anchors, self.first, self.many = np.unique(anchors[order], return_index=True, return_counts=True)
        self.filed, self.place = order, at[order]
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.anchors >> np.uint64(48)).astype(np.int64)] = True

    def find(self, h: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, window) of each occurrence among words with hashes h."""
        near = np.flatnonzero(self.bits[(h >> np.uint64(48)).astype(np.int64)])
        k = np.searchsorted(self.anchors, h[near])
        good = self.anchors[np.minimum(k, len(self.anchors) - 1)] == h[near]
        near, k = near[good], k[good]
        out: list[tuple[int, int, int]] = []
        upto = np.cumsum(self.many[k])
        lo = 0
        while lo < len(near):  # places whose windows are at most CANDIDATES together, or one place
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CANDIDATES, "right")))
            out += self._verified(near[lo:hi], k[lo:hi], h, low, starts, ends)
            lo = hi
        return out

    def _verified(self, near: np.ndarray, k: np.ndarray, h: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
        """Occurrences of the windows filed under anchors k at the words near."""
        many = self.many[k]
        filed = np.repeat(self.first[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
        start = np.repeat(near, many) - self.place[filed]
        window = self.filed[filed]
        end = start + self.lengths[window]
        inside = (start >= 0) & (end <= len(h))
        start, window, end = start[inside], window[inside], end[inside]
        for i in range(self.hashes.shape[1]):
            if not len(start):
                return []
            same = (self.lengths[window] <= i) | (h[np.minimum(start + i, len(h) - 1)] == self.hashes[window, i])
            start, window, end = start[same], window[same], end[same]
        out = []
        for s, e, w in zip(start.tolist(), end.tolist(), window.tolist(), strict=True):
            if b" ".join(low[starts[i] : ends[i]].tobytes() for i in range(s, e)) == self.texts[w]:
                out.append((s, e, w))
        return out


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _count_words(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of the vocabulary stands in all documents."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << 16, bool)
        bits[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for data in byte_rows(batch.column(0)):
                if data is None:
                    continue
                h = word_hashes(*words(data, ALNUM_WORDS))
                h = h[bits[(h >> np.uint64(48)).astype(np.int64)]]
                k = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                total += np.bincount(k[vocabulary[k] == h], minlength=len(vocabulary))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["word", "n"])

    counts = np.zeros(len(vocabulary), np.int64)
    rows = docs.select(text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = rows.toPandas()  # one row for each word of the block's vocabulary at most
    counts[got["word"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return counts


def _probe(docs: DataFrame, text_col: str, hits_col: str, held: Broadcast[WindowIndex]) -> DataFrame:
    names = docs.columns
    again = hits_col in names
    at = names.index(text_col)
    schema = docs.schema if again else T.StructType([*docs.schema.fields, T.StructField(hits_col, HITS)])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
        for batch in batches:
            old = batch.column(names.index(hits_col)).to_pylist() if again else [None] * batch.num_rows
            out = []
            for data, was in zip(byte_rows(batch.column(at)), old, strict=True):
                was = was or {"n_words": 0, "spans": [], "items": []}
                if data is not None:
                    low, a, b = words(data, ALNUM_WORDS)
                    found = index.find(word_hashes(low, a, b), low, a, b) if len(a) and len(index.texts) else []
                    spans = _merge([(x["start"], x["end"]) for x in was["spans"]] + [(s, e) for s, e, _ in found])
                    items = sorted({*was["items"], *(i for _, _, w in found for i in index.items[w])})
                    was = {"n_words": len(a), "spans": [{"start": s, "end": e} for s, e in spans], "items": items}
                out.append(was)
            kept = [c for n, c in zip(names, batch.columns, strict=True) if n != hits_col]
            cols = dict(zip([n for n in names if n != hits_col], kept, strict=True)) | {hits_col: pa.array(out, kind)}
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema.fields], names=schema.names)

    return docs.mapInArrow(run, schema)


def find_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, hits_col: str = "hits") -> DataFrame:
    """Add hits_col: the number of words, the merged word spans [start, end) under windows, and the items they are of."""
    refuse(docs, hits_col)
    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    out = docs
    for i in range(blocks):
        block = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i)
        index = WindowIndex([(r["item"], r["text"]) for r in block.toLocalIterator()], size)  # about BLOCK_BYTES
        if len(index.vocabulary):
            index.order_by_rarity(_count_words(docs, text_col, index.vocabulary))
        held = docs.sparkSession.sparkContext.broadcast(index)
        before, out = out, _probe(out, text_col, hits_col, held)
        if i < blocks - 1:
            out = save(out, "hits")
            held.unpersist()
            if i:
                drop_saved(before)
    return out
