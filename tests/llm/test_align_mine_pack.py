"""Alignment, hard negatives and packing: the registered queries against brute force, methods against enumeration, odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gazette.llm import align, bpe, hard_negatives, packing, queries, sharding, toxicity

A, B, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
LONG = "a much longer text, with marks; and numbers 12345 - " * 3000
PARTS = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\r", ";\r", "'s", "12", "é", "é", "中", "　", "\xa0", "▁", "<0x41>", "<s>", "<|endoftext|>", "🙂", ".", "...", "=====", "    ", "    return", "́", "\x00", "\x1c", "\x85", "Hello", "한국어", "();", "İ", "ΟΔΟΣ", "it's", "\"'s", "x,y", " "]


def mixes(seed, n, most=12):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def brute_groups(text, a, b, tools):
    """Groups of a whole text, from both libraries at once; None without tokens."""
    if not text:
        return None
    data = (" " + text).encode()
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_parts, b_parts = [tools.a_bytes[i] for i in a_ids], [tools.b_bytes[i] for i in b_ids]
    if b"".join(a_parts) != data or b"".join(b_parts) != data:
        return None
    a_ends, b_ends = (np.cumsum([len(x) for x in parts]).tolist() for parts in (a_parts, b_parts))
    out, i, j = [], 0, 0
    for end in sorted(set(a_ends) & set(b_ends)):
        k, m = a_ends.index(end) + 1, b_ends.index(end) + 1
        out.append((a_ids[i:k], b_ids[j:m]))
        i, j = k, m
    return out


def written(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def brute_alignment(rows):
    a, b, tools = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), align.Aligner(A, B)
    a.encode_special_tokens = True
    found = [brute_groups(t, a, b, tools) or [] for _, t in rows]
    linked = [Counter((x, y) for xs, ys in g for x in xs for y in ys) for g in found]
    docs = Counter(p for c in linked for p in c)
    best = {}
    for (x, _), n in docs.items():
        best[x] = max(best.get(x, 0), n)
    return [
        (i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), sum(n for p, n in c.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in c.items()), hashlib.sha256(written(g).encode()).hexdigest() if g else "")
        for (i, _), g, c in zip(rows, found, linked, strict=True)
    ]


def test_op11(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    df = queries.op11_align(spark, sf_dir)
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, df.collect())) == sorted(brute_alignment(rows))


def test_segments_align_as_whole_texts():
    a, b, tools = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), align.Aligner(A, B)
    a.encode_special_tokens = True
    find = align.cutter(tools.cuts).findall
    assert set(tools.cuts) == set(" \n\t")
    for text in mixes(5, 4000):
        segments = find(" " + text)
        assert "".join(segments) == " " + text
        parts, whole = tools.align(segments), brute_groups(text, a, b, tools)
        if text:
            assert (None if None in parts else ";".join(parts)) == (None if whole is None else written(whole)), text


def test_cuts_are_withdrawn_where_a_piece_reaches_across():
    assert align.safe_cuts(["ab", "▁a", "▁▁"]) == " \n\t"
    assert align.safe_cuts(["a▁b"]) == "\n\t" and align.safe_cuts(["a\tb"]) == " \n" and align.safe_cuts(["▁\n"]) == " \t"
    assert align.cutter("\n\t").findall(" a b\nc") == [" a b", "\nc"] and align.cutter("").findall(" a\nb") == [" a\nb"]


def test_alignment_of_odd_rows_in_small_blocks(spark):
    texts = [None, "", " ", "x", LONG, " " * 5000 + "y", "a▁b", "no break", "no break", *mixes(6, 200)]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(8, "no break"), (8, "other")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, Block int").repartition(3)
    got = align.align_tokenizers(df, A, B, block_bytes=2_000).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_alignment(rows)))
    assert align.align_tokenizers(df.limit(0), A, B).count() == 0


def test_links_of_groups():
    assert align.links_of("1|2;3,3|4,5;6|7") == (4, 4, 3, 6, {(1, 2): 1, (3, 4): 2, (3, 5): 2, (6, 7): 1})
    x = np.array([0, 5, 2**32 - 1, 70_000])
    assert (align.unpack(align.pack(x)) == x).all() and len(align.unpack(align.pack(x[:0]))) == 0


def brute_negatives(rows, asks, positives=5, negatives=3, low=50, high=95):
    """rows: distinct (id, label, vector)."""
    scaled = [(i, y, tuple(int(np.floor(256.0 * x)) for x in v)) for i, y, v in rows]
    out = []
    for i, y, v in scaled:
        if not asks(i):
            continue
        ranked = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), j, z, w) for j, z, w in scaled if j != i and len(w) == len(v))
        for s, j, z, _ in [x for x in ranked if x[2] == y][:positives]:
            fit = [x for x in ranked if x[2] != y and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(out)


def test_op12(spark, sf_dir):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    df = queries.op12_hard_negatives(spark, sf_dir)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(map(tuple, df.collect()))
    assert got and got == brute_negatives(rows, lambda i: i % 50 == 0)


@pytest.mark.parametrize("block", [4, 64])
def test_negatives_in_small_blocks_with_ties_and_a_hot_label(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", max(2, block // 8))
    monkeypatch.setattr(hard_negatives, "CHUNK", 2)
    rng = random.Random(block)
    rows = [(i, rng.choice([0, 0, 0, *range(40)]), [rng.choice([0.0, 0.01, 0.5, 0.9, -0.3]) for _ in range(5)]) for i in range(120)]
    rows += [(200 + i, i % 2, [0.5] * 3) for i in range(8)]  # of another length
    odd = [(1, None, [1.0] * 5), (None, 1, [1.0] * 5), (2, 1, None), (3, 1, [float("nan")] * 5), (4, 1, [float("inf")] * 5), (5, 1, [None] * 5), rows[7], rows[7]]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, label int, embedding array<double>, Score string")
    got = hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 3 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 3 == 0)


def test_no_negatives_of_nothing(spark):
    df = spark.createDataFrame([(1, 1, [1.0])], "vec_id long, label int, embedding array<double>")
    assert hard_negatives.mine_hard_negatives(df.limit(0), F.col("vec_id") % 1 == 0).count() == 0
    assert hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 2 == 0).count() == 0
    assert hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 2 == 1).count() == 0


def test_tiles_are_exact_beyond_floating_point():
    a = np.array([[2**30 - 1, 3], [5, -7]], np.int32)
    assert hard_negatives.partial_tile(a, a).tolist() == [[sum(int(p) * int(q) for p, q in zip(x, y, strict=True)) for y in a] for x in a]


def test_negatives_of_several_groups_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", 7)
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 16)
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), [float(rng.randrange(-3, 4)) * rng.choice([1, 2**20]) for _ in range(4)]) for i in range(90)]  # some scores beyond 53 bits
    rows += [(300 + i, i % 2, []) for i in range(6)] + [(400 + i, i % 3, [0.5, -0.5]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    got = hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 2 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 2 == 0)


@pytest.mark.parametrize("kind", [np.float32, np.float64, np.int64])
def test_best_of_windows_with_ties(kind):
    rng = np.random.default_rng(5)
    n, m, wishes, keep = 9, 900, 4, 3
    ids, anchor_ids = rng.permutation(np.repeat(np.arange(m // 3), 3)), np.arange(n)
    marks, scores = np.arange(m), rng.integers(-40, 40, (n, m))
    lo, hi = rng.integers(-60, 30, (n, wishes)), rng.integers(-10, 60, (n, wishes))
    best = hard_negatives.Best(lo, hi, keep)
    for j in range(0, m, 300):
        best.offer(0, scores[:4, j : j + 300].astype(kind), anchor_ids[:4], ids[j : j + 300], marks[j : j + 300])
        best.offer(4, scores[4:, j : j + 300].astype(kind), anchor_ids[4:], ids[j : j + 300], marks[j : j + 300])
    got = sorted(r for b in best.batches() for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    want = []
    for a in range(n):
        for w in range(wishes):
            fit = sorted((-scores[a, r], ids[r], marks[r]) for r in range(m) if ids[r] != a and lo[a, w] <= scores[a, r] <= hi[a, w])[:keep]
            want += [(a, w, i, k, -s) for s, i, k in fit]
    assert got == sorted(want)


def test_no_scores_are_shuffled(spark):
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    rng = np.random.default_rng(8)
    rows, dims = 6_000, 8
    df = spark.createDataFrame([(i, i % 5, v) for i, v in enumerate(rng.standard_normal((rows, dims)).tolist())], "vec_id long, label int, embedding array<float>").repartition(4).cache()
    df.count()
    before = shuffled()
    assert hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 4 == 0).count() > 1_000
    # Each anchor meets each row: 9 million scores, of which hardly any leave their task.
    assert shuffled() - before < 0.5 * (rows // 4) * rows
    df.unpersist()


def check_packing(rows, limit):
    """rows: length, sequence, offset."""
    by = {}
    for n, s, o in rows:
        by.setdefault(s, []).append((o, n))
    for some in by.values():
        at = 0
        for o, n in sorted(some):
            assert o == at
            at += n
        assert at <= limit
    return len(by)


def test_op13(spark, sf_dir):
    library = Tokenizer.from_file(WORDS)
    df = queries.op13_pack(spark, sf_dir)
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = df.collect()
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want += [(r["doc_id"], k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    least = -(-sum(w[3] for w in want) // 4096)
    assert check_packing([(r["length"], r["sequence_id"], r["offset"]) for r in got], 4096) <= least + 1


def test_word_encoder_equals_library(monkeypatch):
    library, encoder = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS)
    assert encoder.by_word
    monkeypatch.setattr(packing, "WORDS", 60)
    monkeypatch.setattr(packing, "PARTS", 40)
    texts = [*mixes(9, 3000), LONG, "<|endoftext|>x <|ENDOFTEXT|> <|startoftext|>", "don't 'S ''t \"'s a.'s", "Straße ǅ ﬁ ½ x̸= ≠ a≠"]
    for lo in range(0, len(texts), 128):
        some = [*texts[lo : lo + 128], None]
        ids, counts = encoder.encode(pa.array(some).slice(1))
        for text, mine in zip(some[1:], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert mine.tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_pieces_of_odd_rows_and_whole_sequences(spark, monkeypatch):
    texts = [None, "", "one two", "one two", LONG, "x " * 95, "y " * 31]
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)] + [(3, "one two", 1)], "doc_id long, text string, nth int").repartition(3)
    pieces = packing.write_pieces(df, WORDS, end_id=1, limit=32)
    placed = packing.place(pieces.withColumn("_base", F.lit("kept")), limit=32)
    rows = placed.collect()
    assert {r["_base"] for r in rows} == {"kept"}
    check_packing([(r["length"], r["sequence_id"], r["offset"]) for r in rows], 32)
    library = Tokenizer.from_file(WORDS)
    whole = Counter(tuple([*library.encode(t or "", add_special_tokens=False).ids, 1]) for t in [*texts, "one two"])
    assert sum(len(r["ids"]) // 4 for r in rows) == sum(len(t) * n for t, n in whole.items()) and all(4 * r["length"] == len(r["ids"]) and r["start"] == 32 * r["piece"] for r in rows)
    sequences = {r["sequence_id"]: r for r in packing.assemble(placed).collect()}
    for r in rows:
        assert sequences[r["sequence_id"]]["ids"][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]
    monkeypatch.setattr(packing, "SENT_RULES", 0)
    again = packing.place(pieces, limit=32).select("doc_id", "piece", "length", "sequence_id", "offset").collect()
    assert sorted(map(str, map(tuple, again))) == sorted(str((r["doc_id"], r["piece"], r["length"], r["sequence_id"], r["offset"])) for r in rows)
    assert packing.place(packing.write_pieces(df.limit(0), WORDS, end_id=1)).count() == 0


def test_packing_of_random_histograms_is_whole():
    rng = np.random.default_rng(1)
    for _ in range(150):
        limit = int(rng.integers(1, 300))
        lengths = rng.integers(1, limit + 1, int(rng.integers(0, 200)))
        found, nth, rows = packing.pack_histogram(Counter(lengths.tolist()), limit, units=int(rng.integers(1, 40))), Counter(), []
        for n in lengths.tolist():
            s, o = found.where(np.array([n]), np.array([nth[n]]))
            nth[n] += 1
            rows.append((n, int(s[0]), int(o[0])))
        assert check_packing(rows, limit) == found.sequences


def test_patterns_do_the_work_and_leave_no_more_sequences():
    rng = np.random.default_rng(2)
    lengths = np.minimum(4096, np.maximum(1, rng.lognormal(6.4, 1.0, 60_000).astype(int)))
    found = packing.pack_histogram(Counter(lengths.tolist()), 4096)
    assert found.by_patterns > 0.4 * len(lengths) and found.sequences <= 1.001 * -(-lengths.sum() // 4096)


def test_least_squares_against_all_active_sets():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.integers(0, 3, (4, 6)).astype(float), rng.integers(0, 9, 4).astype(float)
        best = min(np.linalg.norm(a[:, list(c)] @ x - b) if c else np.linalg.norm(b) for k in range(5) for c in itertools.combinations(range(6), k) for x in [np.linalg.lstsq(a[:, list(c)], b, rcond=None)[0] if c else None] if not c or (x >= -1e-9).all())
        x = packing.nnls(a, b)
        assert (x >= 0).all() and abs(np.linalg.norm(a @ x - b) - best) < 1e-6


def test_patterns_are_all_those_that_fill():
    got = packing.patterns([1, 2, 3, 5, 6], 6, 3)
    want = {tuple(sorted(c, reverse=True)) for k in (1, 2, 3) for c in itertools.product([1, 2, 3, 5, 6], repeat=k) if sum(c) == 6}
    assert set(got) == want and len(got) == len(want)


def test_columns_are_refused_in_any_case(spark):
    df = spark.createDataFrame([(1, "a", 5, 5, 5)], "doc_id long, text string, Shard int, Toxicity int, IDS int")
    with pytest.raises(ValueError):
        sharding.assign_shards(df, "doc_id", 8)
    with pytest.raises(ValueError):
        toxicity.score_toxicity(df, None)
    with pytest.raises(ValueError):
        bpe.bpe_encode(df, A)


def test_groups_keep_one_row_whatever_other_columns_hold(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    df = spark.createDataFrame([(1, "same text of some words here", c, c) for c in "ab"], "doc_id long, text string, _id string, _KEY string")
    out = dict(pipeline.STAGES)["jaccard_join"](spark, df, sf_dir)
    assert out.columns == df.columns and out.count() == 1
