"""Best-fit packing (operator 13): few-document length patterns fitted to the histogram by non-negative least squares.

``write_pieces`` encodes documents with the tokenizers library, appends an end id, cuts what is longer than a
sequence into full pieces, and writes the ids as Parquet. A piece keeps the task that wrote it and its place
among the pieces of its length there, so that a later step can number all pieces of a length without a sort.

``place`` packs pieces. Only the histogram of lengths reaches the driver: one count a length, as many as a
sequence has tokens at most. There

1. lengths are rounded up to units, a 128th of a sequence, and all patterns of one to four units that fill a
   sequence exactly are enumerated;
2. non-negative least squares fits how often each pattern is used to the histogram of units. Lengths of up
   to a quarter of a sequence have a column of their own: they may stay over, as they fill gaps later;
3. the counts are rounded down, then up where documents are left, largest fraction first;
4. what stays over is packed best-fit decreasing, length by length, into the gaps of the patterns and into
   new sequences: items of one length move together, so the work depends on lengths and not on documents.

The result is a list of rules "of length n, from the i-th on, so many pieces go to sequences from s on at
this offset"; it is bounded by the square of a sequence's tokens, and SENT_RULES is looked at before it is
broadcast (beyond it, pieces meet their rules in a join). Each piece finds its rule by its number.

``assemble`` writes out the ids of whole sequences.

Defined results: a null or empty text is a document of the end id alone. Repeated rows, and rows with a null
or repeated doc_id, are documents of their own. Pieces of equal length are interchangeable, and which of
them goes where follows the order of tasks. No rows in, none out. ``place`` passes other columns, whatever
their names, and refuses a column that it is to add. Columns besides id and text are not written as pieces.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.bpe import byte_symbols
from gazette.llm.shared import byte_rows, free_name, kept, refuse, release_memory, save, tidy

#: Units that a sequence is counted in, and documents of a pattern at most.
UNITS, FEW = 128, 4
#: Rules that are broadcast at most; about 50 bytes each.
SENT_RULES = 1_000_000
PIECES = "doc_id long, piece int, start long, length int, part int, nth long, ids binary"
#: Words, and parts of words, whose ids a worker keeps at most; the share of a batch's distinct words not kept that empties a full store of words.
WORDS, PARTS, MISSES = 400_000, 200_000, 0.7
#: Bytes of a row group of the written pieces: a writer holds one in memory.
ROW_GROUP_BYTES = 16 << 20
#: How the word-end vocabulary cleans and cuts a text. All white space goes, so words encode independently.
_CLEAN = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_MARKS, _SPECIAL = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "<|"


class WordEncoder:
    """Ids by the tokenizers library, kept by words between ASCII white space, and by words without the marks around them. Vocabularies that clean or cut texts otherwise get whole texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = (spec["normalizer"] or {}).get("normalizers") == _CLEAN and cut.get("pretokenizers", [{}])[0] == _CUT and not model.get("dropout") and all(t["content"].startswith(_SPECIAL) for t in spec["added_tokens"]) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or len(t["content"].split()) != 1 for t in spec["added_tokens"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.stand_ins = {b: c for c, b in byte_symbols().items()}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts. One of Latin letters alone goes to the library's model at once: cleaning does no more than lower its letters, and nothing is cut."""
        out, others, merge, stand_ins = {}, [], self.tokenizer.model.tokenize, self.stand_ins
        for p in parts:
            if p.isalpha() and max(p) < "\u0180" and "\u0130" not in p:
                out[p] = array("i", [x.id for x in merge(p.lower().encode().decode("latin-1").translate(stand_ins))]).tobytes()
            else:
                others.append(p)
        for lo in range(0, len(others), 1024):
            some = others[lo : lo + 1024]
            out.update(zip(some, self._library(some), strict=True))
        return out

    def _parts(self, word: str) -> list[str]:
        """The word without the ASCII marks before and after it, and these: the cut falls between a letter or digit and a mark.

        Marks before it stay if an apostrophe is their last, as 's and the like are one piece. Words with a special
        token's string stay whole.
        """
        inner = word.strip(_MARKS)
        if not inner or (_SPECIAL in word and any(s in word for s in self.special)):
            return [word]
        if len(inner) == len(word):
            return [inner]
        at = word.index(inner)
        before, after = word[:at], word[at + len(inner) :]
        if before and (before.endswith("'") or not inner[0].isalnum()):
            before, inner = "", before + inner
        if after and not (inner[-1].lower() if inner[-1] > "\x7f" else inner[-1]).isalnum():  # a letter that is lowered to a letter and a mark ends in a mark
            after, inner = "", inner + after
        return [x for x in (before, inner, after) if x]

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        found = list(map(self.words.get, words))
        holes = [i for i, x in enumerate(found) if x is None]
        parts = [self._parts(words[i]) for i in holes]
        unseen = list({p for x in parts for p in x} - self.parts.keys())
        extra = self._ask(unseen)
        if len(self.parts) + len(extra) > PARTS:
            keep = {p: self.parts[p] for x in parts for p in x if p in self.parts}
            self.parts.clear()  # the rare ones fill it anew, the frequent ones are kept as words
            self.parts.update(keep)
        self.parts.update(extra)
        known, whole = self.parts, {}
        for i, x in zip(holes, parts, strict=True):
            found[i] = whole[words[i]] = known[x[0]] if len(x) == 1 else b"".join([known[p] for p in x])
        if len(self.words) >= WORDS and len(holes) > MISSES * max(len(words), 1_000):
            self.words.clear()  # other texts than those that filled it
        if (room := WORDS - len(self.words)) > 0:
            self.words.update(whole if len(whole) <= room else list(whole.items())[:room])
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has. Each distinct word of the batch is looked up once."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            rows = self._library(texts.to_pylist())
            return np.frombuffer(b"".join(rows), "<i4"), np.array([len(r) // 4 for r in rows], np.int64)
        texts = pc.if_else(pc.match_substring(texts, _SPECIAL), texts, pc.ascii_lower(texts))  # letters are lowered anyway, but for special tokens
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        found, at = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        n = sizes[at]
        ends = np.cumsum(n)
        shift = (np.cumsum(sizes) - sizes)[at] - (ends - n)
        values = np.frombuffer(b"".join(found), "<i4")[np.repeat(shift, n) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return values, np.diff(edges)


def _encoder(path: str) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many workers as there are cores
    return kept(("word ids", path), lambda: WordEncoder(path))


def write_pieces(docs: DataFrame, vocab_path: str, end_id: int, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece (from 0), start, length, part, nth and ids (little-endian 32-bit integers) of each piece of each document, written to the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        encoder = _encoder(vocab_path)
        for batch in batches:
            ids, counts = encoder.encode(batch.column(1))
            values = np.full(len(ids) + len(counts), end_id, "<i4")
            values[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
            counts = counts + 1
            pieces = -(-counts // limit)
            doc = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.minimum(limit, counts[doc] - piece * limit)
            order = np.argsort(length, kind="stable")  # pieces of one length are numbered in their order
            first = np.searchsorted(length[order], length[order])
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(doc)) - first + seen[length[order]]
            seen += np.bincount(length, minlength=limit + 1)
            offsets = np.concatenate([[0], 4 * np.cumsum(length)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * limit, pa.int64()), pa.array(length, pa.int32()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(nth, pa.int64()), packed]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "part", "nth", "ids"])
        release_memory()

    return save(rows.mapInArrow(run, PIECES), "pieces", **{"compression": "snappy", "parquet.block.size": str(ROW_GROUP_BYTES)})


def id_checksums(pieces: DataFrame, ids_col: str = "ids", out_col: str = "ids_crc32") -> DataFrame:
    """ids_col replaced by the unsigned CRC-32 of its bytes."""
    at = pieces.columns.index(ids_col)
    schema = T.StructType([*(f for f in pieces.schema.fields if f.name != ids_col), T.StructField(out_col, T.LongType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(x) for x in byte_rows(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(crc, pa.int64())], names=schema.names)

    return pieces.mapInArrow(run, schema)


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """The x >= 0 of least |a x - b|, by active sets: at most as many entries as a has rows are above 0."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(4 * a.shape[0] + 40):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        j = int(slope.argmax()) if n else 0
        if n == 0 or slope[j] <= tolerance * max(1.0, np.abs(b).max()):
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > tolerance).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= tolerance
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            gone = at[low & (x[at] <= tolerance)]
            x[gone], active[gone] = 0.0, False
            if not len(gone):
                break
            if j in gone:
                break
    return np.maximum(x, 0)


def patterns(present: list[int], units: int, few: int) -> list[tuple[int, ...]]:
    """All multisets of one to ``few`` of the units present that sum to ``units``, largest first within each."""
    have, out = set(present), []
    for k in range(1, few + 1):
        for some in combinations_with_replacement(sorted(present, reverse=True), k - 1):
            last = units - sum(some)
            if last in have and last <= (some[-1] if some else units):
                out.append((*some, last))
    return out


@dataclass
class Packing:
    """rules: of each length, from the ``begin``-th piece on ``count`` pieces, ``per`` to a sequence, go to sequences from ``first`` on at ``offset``."""

    length: np.ndarray
    begin: np.ndarray
    count: np.ndarray
    per: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int
    by_patterns: int

    def where(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the nth piece of each length."""
        goal = np.searchsorted(self._keys, length.astype(np.int64) << 44 | nth, side="right") - 1
        i = nth - self.begin[goal]
        return self.first[goal] + i // self.per[goal], self.offset[goal] + i % self.per[goal] * length

    def __post_init__(self) -> None:
        order = np.lexsort((self.begin, self.length))
        for name in ("length", "begin", "count", "per", "first", "offset"):
            setattr(self, name, getattr(self, name)[order])
        self._keys = self.length << 44 | self.begin


def _filled(kind: tuple[int, ...], waiting: dict[int, list[int]], left: dict[int, int], limit: int, unit: int) -> list[int] | None:
    """Lengths of one sequence by a pattern: the longest of each unit, then one before the last so that the last fills the sequence exactly.

    The last may be of a longer unit than the pattern's. Without an exact fill the pattern is not used further.
    """
    lengths: list[int] = []
    for u in kind[:-2]:
        n = next((n for n in waiting[u] if left[n] > lengths.count(n)), 0)
        if not n:
            return None
        lengths.append(n)
    used, space = Counter(lengths), limit - sum(lengths)
    if len(kind) == 1:
        return [limit] if left.get(limit, 0) else None
    for n in waiting[kind[-2]]:
        last = space - n
        if left[n] > used[n] and last > (kind[-1] - 1) * unit and left.get(last, 0) > used[last] + (last == n):
            return [*lengths, n, last]
    return None


def pack_histogram(histogram: dict[int, int], limit: int, units: int = UNITS, few: int = FEW) -> Packing:
    """Rules for all pieces of a histogram of lengths from 1 to limit."""
    unit = -(-limit // min(units, limit))
    full = -(-limit // unit)
    left = dict(sorted(((n, c) for n, c in histogram.items() if c), reverse=True))
    done: dict[int, int] = defaultdict(int)
    rules: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    order: list[int] = []
    opened = 0

    def gap(space: int, first: int, n: int) -> None:
        if space and n:
            if not gaps[space]:
                insort(order, space)
            gaps[space].append((first, n))

    waiting: dict[int, list[int]] = defaultdict(list)  # lengths of each unit, largest first
    for n in left:
        waiting[-(-n // unit)].append(n)
    many = {u: sum(left[n] for n in ns) for u, ns in waiting.items()}
    room = [u for u in many if u * unit <= limit or u == full]
    kinds = [p for p in patterns(room, full, few)] if room else []
    if kinds:
        rows = {u: i for i, u in enumerate(sorted(many))}
        short = [u for u in rows if u <= full // 4]
        a = np.zeros((len(rows), len(kinds) + len(short)))
        for j, p in enumerate(kinds):
            for u in p:
                a[rows[u], j] += 1
        for j, u in enumerate(short):
            a[rows[u], len(kinds) + j] = 1
        fit = nnls(a, np.array([many[u] for u in sorted(many)], float))[: len(kinds)]
        for j, times in [*((j, int(fit[j] + 1e-6)) for j in np.argsort(-fit, kind="stable")), *((j, 1) for j in np.argsort(-(fit % 1), kind="stable") if fit[j] % 1 > 1e-6)]:
            while times > 0:  # as many at once as have the same lengths
                found = _filled(kinds[j], waiting, left, limit, unit)
                if not found:
                    break
                lengths, spent = found, Counter(found)
                k = min(times, *(left[n] // c for n, c in spent.items()))
                offset = 0
                for n in dict.fromkeys(lengths):
                    rules.append((n, done[n], k * spent[n], spent[n], opened, offset))
                    offset += n * spent[n]
                    done[n] += k * spent[n]
                    left[n] -= k * spent[n]
                for u in {-(-n // unit) for n in lengths}:
                    waiting[u] = [n for n in waiting[u] if left[n]]
                    many[u] = sum(left[n] for n in waiting[u])
                gap(limit - offset, opened, k)
                opened += k
                times -= k
    by_patterns = sum(done.values())
    for n, count in left.items():
        while count:
            i = bisect_left(order, n)
            if i == len(order):
                new = -(-count // (limit // n))
                gap(limit, opened, new)
                opened += new
                continue
            space = order[i]
            first, bins = gaps[space].pop()
            if not gaps[space]:
                del order[i]
            per = space // n
            whole = min(count // per, bins)
            put, used = (whole * per, whole) if whole else (count, 1)
            rules.append((n, done[n], put, per, first, limit - space))
            gap(space - (per if whole else count) * n, first, used)
            gap(space, first + used, bins - used)
            done[n] += put
            count -= put
    columns = np.array(rules, np.int64).reshape(-1, 6).T
    return Packing(*columns, sequences=opened, by_patterns=by_patterns)


def place(pieces: DataFrame, limit: int = 4096, sequence_col: str = "sequence_id", offset_col: str = "offset") -> DataFrame:
    """pieces (of write_pieces, with or without ids) without part and nth, with the sequence that each goes to and its offset there."""
    refuse(pieces, sequence_col, offset_col)
    spark = pieces.sparkSession
    counts = save(pieces.groupBy(F.col("part").alias("p"), F.col("length").alias("n")).agg(F.count(F.lit(1)).alias("many")), "piece-counts")
    histogram = {r["n"]: r["many"] for r in counts.groupBy("n").agg(F.sum("many").alias("many")).collect()}  # a row a length, limit at most
    packing = pack_histogram(histogram, limit)
    before = Window.partitionBy("n").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that wrote the length
    base = free_name(pieces, "_base")
    bases = counts.select("p", "n", F.coalesce(F.sum("many").over(before), F.lit(0)).cast("long").alias(base))
    met = pieces.join(bases, (pieces["part"] == bases["p"]) & (pieces["length"] == bases["n"]))
    kept_columns = [c for c in pieces.columns if c not in ("part", "nth")]
    numbered = met.select(*[pieces[c] for c in kept_columns], (pieces["nth"] + bases[base]).alias(base))
    if len(packing.length) > SENT_RULES:
        return _placed_by_join(numbered, packing, base, sequence_col, offset_col)
    held = spark.sparkContext.broadcast(packing)
    at, n_at = numbered.columns.index(base), numbered.columns.index("length")
    schema = T.StructType([*(pieces.schema[c] for c in kept_columns), T.StructField(sequence_col, T.LongType()), T.StructField(offset_col, T.LongType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = held.value.where(batch.column(n_at).to_numpy(), batch.column(at).to_numpy())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=schema.names)

    return numbered.mapInArrow(run, schema)


def _placed_by_join(numbered: DataFrame, packing: Packing, base: str, sequence_col: str, offset_col: str) -> DataFrame:
    """Rules cut at multiples of a step meet the pieces of their length and step."""
    step, rules = 4096, []
    for n, begin, count, per, first, offset in zip(*(getattr(packing, c).tolist() for c in ("length", "begin", "count", "per", "first", "offset")), strict=True):
        rules.append((n, begin, begin + count, per, first, offset))
    table = numbered.sparkSession.createDataFrame(rules, "_n int, _begin long, _end long, _per long, _first long, _offset long")
    table = save(table.withColumn("_step", F.explode(F.sequence(F.floor(F.col("_begin") / step), F.floor((F.col("_end") - 1) / step)))), "packing-rules")
    nth = numbered[base]
    met = numbered.join(table, (numbered["length"] == table["_n"]) & (F.floor(nth / step) == table["_step"]) & (nth >= table["_begin"]) & (nth < table["_end"]))
    i = nth - table["_begin"]
    return met.select(*[numbered[c] for c in numbered.columns if c != base], (table["_first"] + F.floor(i / table["_per"])).cast("long").alias(sequence_col), (table["_offset"] + i % table["_per"] * numbered["length"]).cast("long").alias(offset_col))


def assemble(placed: DataFrame, ids_col: str = "ids", sequence_col: str = "sequence_id", offset_col: str = "offset") -> DataFrame:
    """sequence_id, ids of each whole sequence, packed as those of pieces, and lengths of its pieces in order; a sequence is one group of a few pieces."""
    rows = placed.groupBy(sequence_col).agg(F.array_sort(F.collect_list(F.struct(F.col(offset_col).alias("at"), F.col(ids_col).alias("ids")))).alias("pieces"))
    whole = F.aggregate("pieces", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select(sequence_col, whole.alias("ids"), F.transform("pieces", lambda x: (F.octet_length(x["ids"]) / 4).cast("int")).alias("lengths"))
