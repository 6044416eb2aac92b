"""BPE encoding and decoding (operator 5).

A text is cut into pre-tokens by the vocabulary's pattern. Within a pre-token the symbols form a doubly
linked list; a priority queue holds (merge rank, position) of neighbouring pairs. The lowest rank is taken
first; an entry whose symbols have changed since it was queued is stale and skipped. Decoding joins the
vocabulary's byte strings of the ids and reads them as UTF-8.

Defined results: a null or empty text has no ids and decodes to the empty text; ids null decode to the
empty text; an id outside the vocabulary fails. Texts are read whole. Other columns pass through.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gazette.llm.shared import kept, refuse, release_memory

#: How byte-level vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same over characters of Latin-1 that the two regular-expression modules class alike; half as slow.
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r" \t\n\x0b\x0c\r"
_LATIN = f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
#: Pre-tokens whose ids a worker keeps at most. A full cache stays as it is while it answers for most tokens.
CACHE_ENTRIES, WINDOW, MISSES = 200_000, 1_000_000, 0.3


def pre_tokenizer() -> Callable[[str], list[str]]:
    """A function that cuts a text by PATTERN."""
    whole, latin, beyond = regex.compile(PATTERN).findall, re.compile(_LATIN).findall, re.compile("[^\t-\r -~¡-ÿ]").search
    return lambda text: whole(text) if beyond(text) else latin(text)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_spec(path: str) -> dict[str, Any]:
    """A vocabulary file of the tokenizers library; fails unless texts are cut by PATTERN into bytes and merged by rank alone."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    added = not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if spec["normalizer"] or model["type"] != "BPE" or not plain or not added or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    return spec


class BytePairVocabulary:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, path: str) -> None:
        spec = byte_level_spec(path)
        symbols = byte_symbols()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.strings[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.of_byte = [vocab[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.cut = pre_tokenizer()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.cache: dict[str, bytes] = {}
        self.missed = self.asked = 0

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: merge the pair of lowest rank, leftmost first, until none is left."""
        of_byte, merges = self.of_byte, self.merges
        ids = [of_byte[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((new, ids[k])):
                    heapq.heappush(queue, (found[0], i, new, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], new))):
                heapq.heappush(queue, (found[0], h, ids[h], new, found[1]))
        return [x for x in ids if x >= 0]

    def _packed(self, token: str) -> bytes:
        out = np.array(self.merge(token.encode()), "<u4").tobytes()
        self.missed += 1
        if len(self.cache) < CACHE_ENTRIES:
            self.cache[token] = out
        return out

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = [text] if self.split is None or not any(s in text for s in self.special) else self.split(text)
        get, packed, out = self.cache.get, self._packed, []
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                out += [get(t) or packed(t) for t in self.cut(part)]
        self.asked += len(out)
        if self.asked > WINDOW:  # other texts than those that filled the cache
            if self.missed > MISSES * self.asked and len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.missed = self.asked = 0
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def vocabulary(path: str) -> BytePairVocabulary:
    return kept(("bpe", path), lambda: BytePairVocabulary(path))


#: Rows that a worker turns into one Arrow batch.
ROWS = 128


def _more(batch: pa.RecordBatch, names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])


def bpe_encode(df: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "ids", packed: bool = False, decoded_col: str | None = None) -> DataFrame:
    """Add ids_col: the text's ids as array<int>, or, packed, as little-endian unsigned 32-bit integers in binary.

    decoded_col, if named: the text that the ids decode to, in the same pass.
    """
    refuse(df, ids_col, decoded_col)
    names = [ids_col, *([decoded_col] if decoded_col else [])]
    schema = T.StructType([*df.schema.fields, T.StructField(ids_col, T.BinaryType() if packed else T.ArrayType(T.IntegerType())), *(T.StructField(c, T.StringType()) for c in names[1:])])
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab_path)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                ids = [v.encode_packed(t) if t else b"" for t in batch.column(at).to_pylist()]
                back = [pa.array([v.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.string())] if decoded_col else []
                if packed:
                    values = pa.array(ids, pa.binary())
                else:
                    values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield _more(batch, names, [values, *back])
        release_memory()

    return df.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, vocab_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add out_col: the text that ids_col (array<int>, or packed binary) stands for."""
    refuse(df, out_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])
    at, packed = df.columns.index(ids_col), isinstance(df.schema[ids_col].dataType, T.BinaryType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab_path)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                rows = batch.column(at).to_pylist()
                ids = (np.frombuffer(x, "<u4").tolist() for x in (r or b"" for r in rows)) if packed else (r or [] for r in rows)
                yield _more(batch, [out_col], [pa.array([v.decode(x) for x in ids], pa.string())])
        release_memory()

    return df.mapInArrow(run, schema)
