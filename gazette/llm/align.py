"""Cross-tokenizer alignment (operator 11) by segment deduplication.

A byte-level vocabulary A encodes a space and the text, a SentencePiece vocabulary B the text, before which it
sets a space itself. Where an A token and a B token end at the same byte, a group ends; a group's A and B tokens
are linked with each other.

A text is cut before white space that follows something else, at characters where no token of B can reach across
(``safe_cuts`` looks through the vocabulary) and where A's pattern always cuts. Segments so cut encode
alone as they do in the text, and their ends are ends of groups, so alignments of segments join into that of the text.

1. ``_coded``: documents go into blocks of about BLOCK_BYTES of text. A block has a list of its segments, each
   once, and each document is a list of places in it.
2. ``_aligned``: the segments of all blocks, each once, are encoded by both libraries and aligned.
3. Alignments are joined back to the blocks' lists, and each block composes its documents: digests, counts of
   groups and links, and the pairs of ids that each document links. A block adds up for each pair how many of its
   documents link it; sums over blocks are the counts of the whole corpus.
4. The counts are joined back to the blocks' pairs, and each block adds them up for its documents.

What is joined is one row for each block and segment or pair, so a segment in every document costs as many rows
as there are blocks. Lists of places are packed (``pack``), as they are most of what is written.

Defined results: texts that are null or empty, or whose token bytes of A or B are not a space and the text (such as
those that hold the stand-in for a space of B), have no tokens: zeros, and '' in place of a digest. The vocabulary's special tokens
inside a text are plain text. A row is a document, so repeated rows and rows with a null or repeated id count
for themselves. A text of any length is one document of one block. No rows in, none out. Columns besides id
and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.bpe import byte_level_spec, byte_symbols
from gazette.llm.shared import drop_saved, kept, release_memory, save, tidy

#: Bytes of text of a block, and distinct segments that are aligned at once.
BLOCK_BYTES, SEGMENTS = 32 << 20, 4_096
#: Fixed value: what B writes for a space.
SPACE = "▁"
#: White space that a text may be cut before.
CUTS = " \n\t"


def pack(x: np.ndarray) -> bytes:
    """Integers from 0 to 2**32 - 1, byte by byte of their places, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class Aligner:
    """Both vocabularies, and segments encoded and aligned by them."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        spec = byte_level_spec(a_path)  # cuts texts by the one pattern that never goes from other characters on to white space
        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        symbols = byte_symbols()
        self.a_sizes = np.zeros(max(spec["model"]["vocab"].values()) + 1, np.int64)
        self.a_bytes = {}
        for token, i in spec["model"]["vocab"].items():
            self.a_bytes[i] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()
            self.a_sizes[i] = len(self.a_bytes[i])
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode())
        self.space = self.b.piece_to_id(SPACE)
        self.cuts = safe_cuts([self.b.id_to_piece(i) for i in range(self.b.get_piece_size()) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))])

    def b_ids(self, segments: list[str]) -> list[list[int]]:
        """B's ids. It sets a space before what it gets: where a segment begins with one, the segment is passed without; else its token goes."""
        rows = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        return [(row or [self.space]) if s[0] == " " else row[1:] for s, row in zip(segments, rows, strict=True)]

    def align(self, segments: list[str]) -> list[str | None]:
        """For each segment its groups as a1,a2|b1;a3|b2, or None where the bytes of A's or B's tokens are not the segment's."""
        out: list[str | None] = []
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        for s, e, b in zip(segments, self.a.encode_batch_fast(segments, add_special_tokens=False), self.b_ids(segments), strict=True):
            a, data = e.ids, s.encode()
            a_parts, b_parts = [a_bytes[i] for i in a], [b_bytes[i] for i in b]
            if b"".join(a_parts) != data or b"".join(b_parts) != data:
                out.append(None)
                continue
            if len(a) == 1 or len(b) == 1:
                out.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
                continue
            groups, i, j, at_a, at_b, from_a, from_b = [], 0, 0, 0, 0, 0, 0
            while i < len(a) or j < len(b):
                if at_a <= at_b and i < len(a):
                    at_a += len(a_parts[i])
                    i += 1
                else:
                    at_b += len(b_parts[j])
                    j += 1
                if at_a == at_b:
                    groups.append(f"{','.join(map(str, a[from_a:i]))}|{','.join(map(str, b[from_b:j]))}")
                    from_a, from_b = i, j
            out.append(";".join(groups))
        return out


def safe_cuts(pieces: list[str]) -> str:
    """The characters of CUTS that no piece of B has after another character, a space after a space aside."""
    return "".join(c for c in CUTS if not any((c if c != " " else SPACE) in p.lstrip(SPACE if c == " " else "")[0 if c == " " else 1 :] for p in pieces))


def cutter(cuts: str) -> re.Pattern[str]:
    """Matches segments: each begins the text or begins with white space of cuts after another character."""
    return re.compile(rf"\s*\S+(?:(?![{cuts}])\s+\S+)*(?:(?![{cuts}])\s+$)?|\s+$") if cuts else re.compile(r"(?s).+")


def _tools(a_path: str, b_path: str) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many workers as there are cores
    return kept(("align", a_path, b_path), lambda: Aligner(a_path, b_path))


def _coded(docs: DataFrame, a_path: str, b_path: str, block_bytes: int) -> DataFrame:
    """block, ids, sizes, places, segments: see the module. A text without tokens by being null or empty has size 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        find = cutter(_tools(a_path, b_path).cuts).findall
        ids: list[int | None] = []
        sizes: list[int] = []
        codes: list[np.ndarray] = []
        places: dict[str, int] = {}
        held = 0

        def block() -> pa.RecordBatch:
            row = [[part << 32 | n], [ids], [pack(np.array(sizes))], [pack(np.concatenate([*codes, np.zeros(0, np.int64)]))], [list(places)]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _CODED_ARROW, strict=True)], schema=_CODED_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = find(" " + text) if text else []
                codes.append(np.fromiter((places.setdefault(s, len(places)) for s in found), np.int64, len(found)))
                ids.append(doc_id)
                sizes.append(len(found))
                held += len(text or "") + 64
                if held >= block_bytes:
                    yield block()
                    n, held, ids, sizes, codes, places = n + 1, 0, [], [], [], {}
        if ids:
            yield block()

    return docs.mapInArrow(tidy(run), "block long, ids array<long>, sizes binary, places binary, segments array<string>")


_CODED_ARROW = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("places", pa.binary()), ("segments", pa.list_(pa.string()))])


def _aligned(segments: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """segment and groups of each distinct segment."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tools(a_path, b_path)
        for whole in batches:
            for lo in range(0, whole.num_rows, SEGMENTS):
                batch = whole.slice(lo, SEGMENTS)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tools.align(batch.column(0).to_pylist()), pa.string())], names=["segment", "groups"])

    return segments.mapInArrow(run, "segment string, groups string")


def links_of(groups: str) -> tuple[int, int, int, int, dict[tuple[int, int], int]]:
    """n_a, n_b, n_groups, n_links, and how often each pair of ids is linked."""
    pairs: dict[tuple[int, int], int] = {}
    n_a = n_b = n_links = 0
    each = groups.split(";")
    for group in each:
        left, _, right = group.partition("|")
        if "," not in group:
            n_a, n_b, n_links = n_a + 1, n_b + 1, n_links + 1
            pair = int(left), int(right)
            pairs[pair] = pairs.get(pair, 0) + 1
            continue
        a, b = left.split(","), right.split(",")
        n_a, n_b, n_links = n_a + len(a), n_b + len(b), n_links + len(a) * len(b)
        a_times, b_times = ({int(x): many.count(x) for x in set(many)} if len(many) > 1 else {int(many[0]): 1} for many in (a, b))
        for x, k in a_times.items():  # by distinct ids: a long run of one character is one pair
            for y, m in b_times.items():
                pairs[x, y] = pairs.get((x, y), 0) + k * m
    return n_a, n_b, len(each), n_links, pairs


_COMPOSED = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), *((c, pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_groups", "n_links")), ("digests", pa.list_(pa.string())), ("pair_sizes", pa.binary()), ("pair_places", pa.binary()), ("pair_times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("documents", pa.list_(pa.int64()))])
_COMPOSED_DDL = "block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, pair_sizes binary, pair_places binary, pair_times binary, pairs array<long>, documents array<long>"


def _compose(coded: pa.Table, met: pa.Table) -> pa.Table:
    """A block's documents from its lists and the alignments of its segments. pairs: a << 32 | b; documents: of the block that link it."""
    kept("nothing", int)
    sizes, places = unpack(coded.column("sizes")[0].as_py()), unpack(coded.column("places")[0].as_py())
    groups: list[str | None] = [None] * met.num_rows
    for at, text in zip(met.column("place").to_pylist(), met.column("groups").to_pylist(), strict=True):
        groups[at] = text
    known: dict[tuple[int, int], int] = {}
    single: dict[str, int] = {}  # the pair of a group of one and one, by the group as written
    counts = np.zeros((len(groups), 4), np.int64)
    flat, times, begin = [], [], [0]
    for k, text in enumerate(groups):
        if text is not None:
            if "," in text:
                *counts[k], pairs = links_of(text)
                flat += [known.setdefault(p, len(known)) for p in pairs]
                times += pairs.values()
            else:
                each = text.split(";")
                counts[k] = len(each)
                for group in each:
                    if (at := single.get(group)) is None:
                        left, _, right = group.partition("|")
                        at = single[group] = known.setdefault((int(left), int(right)), len(known))
                    flat.append(at)
                times += [1] * len(each)
        begin.append(len(flat))
    flat, times, begin = np.array(flat, np.int64), np.array(times, np.int64), np.array(begin)
    bad = np.array([g is None for g in groups] or [False])
    sums, digests, of_docs = np.zeros((len(sizes), 4), np.int64), [], []
    documents = np.zeros(len(known), np.int64)
    at = 0
    for d, n in enumerate(sizes.tolist()):
        mine = places[at : at + n]
        at += n
        if n == 0 or bad[mine].any():
            digests.append("")
            of_docs.append((np.zeros(0, np.int64),) * 2)
            continue
        digests.append(hashlib.sha256(";".join([groups[k] for k in mine.tolist()]).encode()).hexdigest())
        segment, often = np.unique(mine, return_counts=True)
        sums[d] = (counts[segment] * often[:, None]).sum(0)
        lens = begin[segment + 1] - begin[segment]
        where = np.repeat(begin[segment] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        pair, back = np.unique(flat[where], return_inverse=True)
        of_docs.append((pair, np.bincount(back, times[where] * np.repeat(often, lens), len(pair)).astype(np.int64)))
        documents[pair] += 1
    pair_sizes = np.array([len(p) for p, _ in of_docs])
    pair_places, pair_times = (np.concatenate([*(x[k] for x in of_docs), np.zeros(0, np.int64)]) for k in (0, 1))
    pairs = [a << 32 | b for a, b in known]
    row = [[coded.column("block")[0].as_py()], [coded.column("ids")[0].as_py()], *([c] for c in sums.T), [digests], [pack(pair_sizes)], [pack(pair_places)], [pack(pair_times)], [pairs], [documents]]
    out = pa.table([pa.array(x, f.type) for x, f in zip(row, _COMPOSED, strict=True)], schema=_COMPOSED)
    release_memory()
    return out


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(composed: pa.Table, met: pa.Table) -> pa.Table:
    """A block's documents with the corpus-wide counts of their pairs added up."""
    kept("nothing", int)
    count, best = np.zeros(met.num_rows, np.int64), np.zeros(met.num_rows, np.int64)
    at = met.column("place").to_numpy()
    count[at], best[at] = met.column("count").to_numpy(), met.column("best").to_numpy()
    sizes, places, times = (unpack(composed.column(c)[0].as_py()) for c in ("pair_sizes", "pair_places", "pair_times"))
    ends = np.cumsum(sizes)
    sums = [np.concatenate([[0], np.cumsum(x[places] * times)]) for x in (best, count)]
    totals = [s[ends] - s[ends - sizes] for s in sums]
    heads = [composed.column(c)[0].values for c in ("ids", "n_a", "n_b", "n_groups", "n_links")]
    out = pa.table([*heads, *map(pa.array, totals), composed.column("digests")[0].values], names=[x.split()[0] for x in _RESULT.split(", ")])
    release_memory()
    return out


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    n_best: links whose pair has the highest count of its A id; a pair's count is the number of documents that link it.
    """
    coded = save(_coded(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), a_path, b_path, block_bytes), "coded", compression="zstd")
    aligned = save(_aligned(coded.select(F.explode("segments").alias("segment")).distinct(), a_path, b_path), "alignments", compression="zstd")
    met = coded.select("block", F.posexplode("segments").alias("place", "segment")).join(aligned, "segment").select(F.col("block").alias("of"), "place", "groups")
    composed = save(coded.select("block", "ids", "sizes", "places").groupBy("block").cogroup(met.groupBy("of")).applyInArrow(_compose, _COMPOSED_DDL), "composed", compression="zstd")
    drop_saved(coded, aligned)
    counts = composed.select(F.explode(F.arrays_zip(F.col("pairs").alias("pair"), F.col("documents").alias("n"))).alias("x")).groupBy("x.pair").agg(F.sum("x.n").alias("count"))
    counts = save(counts, "pair-counts")
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"))
    rated = counts.join(highest, F.shiftright(counts["pair"], 32) == highest["a"]).select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    found = composed.select("block", F.posexplode("pairs").alias("place", "pair")).join(rated, "pair").select(F.col("block").alias("of"), "place", "count", "best")
    return composed.drop("pairs", "documents").groupBy("block").cogroup(found.groupBy("of")).applyInArrow(_summed, _RESULT)
