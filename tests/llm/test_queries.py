"""The registered queries opN and the pipeline, all columns, against brute force on the small tables; methods against enumeration."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gazette.llm import bpe, decontaminate, html_main, jaccard_join, language_id, nearest, quality_crf, queries, sharding, shared, token_output, toxicity
from tests.llm.test_llm import LONG, ODD, VOCAB, brute_classes, docs_of, jump, main_texts, near_copies, words_of


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_op1(spark, sf_dir, documents):
    library = Tokenizer.from_file(VOCAB)
    rows = {r["doc_id"]: r for r in queries.op1_token_output(spark, sf_dir).collect()}
    assert list(rows) and set(rows) == set(documents)
    start = 0
    for i in sorted(documents):
        ids = [*library.encode(documents[i] or "", add_special_tokens=False).ids, 2]
        assert tuple(rows[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_have_set_encodings_indexes_and_row_groups(spark, monkeypatch):
    monkeypatch.setattr(token_output, "ROW_GROUP_BYTES", 1 << 16)
    monkeypatch.setattr(token_output, "PAGE_ROWS", 100)
    df = docs_of(spark, [" ".join(str((i * 7919 + k * k) % 10007) for k in range(60)) for i in range(3000)])
    path = shared.shared_path(spark, "test-files")
    token_output.write_tokens(df, path, VOCAB, end_id=2, files=1)
    files = [f for f in spark.read.parquet(path).inputFiles() if f.endswith(".parquet")]
    meta = pq.ParquetFile(files[0].removeprefix("file://")).metadata
    assert len(files) == 1 and meta.num_row_groups > 1
    group = meta.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    for name in ("doc_id", "n_tokens", "part_start"):
        assert "DELTA_BINARY_PACKED" in columns[name].encodings and columns[name].has_offset_index and columns[name].has_column_index
    ids = next(c for n, c in columns.items() if n.startswith("ids"))
    assert {"RLE_DICTIONARY", "PLAIN_DICTIONARY"} & set(ids.encodings) and ids.has_offset_index
    starts = [meta.row_group(i).column(0).statistics.min for i in range(meta.num_row_groups)]
    assert starts == sorted(starts)


def test_tokens_are_read_selectively(spark):
    path = shared.shared_path(spark, "test-selective")
    token_output.write_tokens(docs_of(spark, ["a b c", "d", None, "e f"]), path, VOCAB, end_id=2)
    lengths = token_output.read_tokens(spark, path).select("doc_id", "n_tokens").where("doc_id >= 2")
    plan = lengths._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in lengths.collect()) == [(2, 1), (3, 3)]
    scans = re.findall(r"ReadSchema: (\S+)", plan)
    assert scans and not any("ids" in s for s in scans)


def test_token_files_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "x"), (5, "b b"), (5, "a"), (5, "a"), (1, None)], "doc_id long, text string")
    path = shared.shared_path(spark, "test-repeats")
    token_output.write_tokens(df, path, VOCAB, end_id=2)
    rows = sorted((tuple(r) for r in token_output.read_tokens(spark, path).select("start", "doc_id", "n_tokens").collect()), key=lambda r: r[0])
    assert rows[0][1] is None and rows[1][1] == 1 and [r[1] for r in rows[2:]] == [5, 5, 5] and [r[0] for r in rows] == [0, 2, 3, 3 + rows[2][2], 3 + rows[2][2] + rows[3][2]]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.byte_level_spec(public_tokenizers.path("word_bpe_49k.json"))


def test_op2(spark, sf_dir, documents):
    ids = sorted(documents)
    sizes, comp = brute_classes([documents[i] for i in ids])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op2_jaccard_join(spark, sf_dir).collect()}
    assert got == {i: (n, ids[c]) for i, n, c in zip(ids, sizes, comp, strict=True)}


def test_join_beyond_the_ids_that_are_sent(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SENT_IDS", 0)
    texts = [*near_copies(5, 30), LONG, LONG + "end"]
    sizes, comp = brute_classes(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(docs_of(spark, texts)).collect()}
    assert got == {i: (n, c) for i, (n, c) in enumerate(zip(sizes, comp, strict=True))}


def test_word_hashes_do_not_collide_as_polynomials_do():
    """Thue-Morse strings of 2048 letters collide under any polynomial modulo 2**64."""
    s = "a"
    for _ in range(11):
        s += s.translate(str.maketrans("ab", "ba"))
    t = s.translate(str.maketrans("ab", "ba"))
    h = [int(shared.word_hashes(*shared.words(np.frombuffer(x.encode(), np.uint8), shared.SPACE_WORDS))[0]) for x in (s, t)]
    assert h[0] != h[1]


def test_op3(spark, sf_dir, documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    table = model.logp.ravel().tolist()
    rows = queries.op3_toxicity(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(documents)
    for r in rows[::7]:
        text = toxicity.restore((documents[r["doc_id"]] or "").lower(), table)
        assert r["held_out"] == held(r["doc_id"]) and abs(r["score"] - model.scores([text])[0]) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5)


def trigram_table(texts):
    c = toxicity.codes(toxicity.points("  ".join(texts) + "  ")).astype(np.int64)
    counts = np.bincount((c[:-2] * toxicity.V + c[1:-1]) * toxicity.V + c[2:], minlength=toxicity.V**3).reshape((toxicity.V,) * 3)
    return toxicity.character_model(counts.astype(float)).ravel().tolist()


@pytest.mark.parametrize("span", ["1d10t", "s t u p", "st*p1d", "looossser", "i.d.1", "i*d*i", "aabbcc", "wor7h!!", "b0$$", "a  b c"])
def test_viterbi_equals_enumeration(span):
    table = trigram_table(["you stupid idiot", "loser stop it", "the abc of words is worth"] * 20)
    code = {x: i + 1 for i, x in enumerate(toxicity.LETTERS)}

    def cost(path):
        total, a, b = sum(extra for _, extra in path), 0, 0
        for ch in "".join(y for y, _ in path) + " ":
            c = 0 if ch == " " else code.get(ch, toxicity.OTHER)
            total -= table[(a * toxicity.V + b) * toxicity.V + c]
            a, b = b, c
        return total

    paths = list(itertools.product(*toxicity.lattice(span)))
    best = min(map(cost, paths))
    assert toxicity.decode(span, table) in {"".join(y for y, _ in p).rstrip(" ") for p in paths if cost(p) < best + 1e-9}


DISGUISES = {
    "signs": lambda w: w.translate(str.maketrans("oieast", "0134$7")), "spaced": lambda w: " ".join(w), "dots": lambda w: ".".join(w), "stars": lambda w: "*".join(w), "slashes": lambda w: "/".join(w),
    "repeated": lambda w: w.replace(w[2], w[2] * 4), "doubled": lambda w: "".join(c * 2 for c in w),
}


def test_disguised_insults_are_found_by_reading_them(spark):
    """Words that the model takes for toxic, disguised and planted in clean texts: found when spans are read, hardly when not."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    known = docs.join(labels, "doc_id").where("lang = 'en'").toPandas()
    words = sorted({w for t in known[known["toxic"] == 1]["text"] for w in re.findall("[a-z]{5,}", t.lower())})
    score = model.scores(words)
    worst = [words[i] for i in np.argsort(-score)[:6]]
    clean = [t for t in known[known["toxic"] == 0]["text"] if 200 < len(t) < 1500][:40]
    rng, planted = random.Random(1), []
    for text in clean:
        for disguise in DISGUISES.values():
            parts = text.split()
            for _ in range(4):
                parts.insert(rng.randrange(len(parts)), disguise(rng.choice(worst)))
            planted.append(" ".join(parts))
    df = docs_of(spark, planted)
    share = [df.transform(lambda d, r=r: toxicity.score_toxicity(d, model, restoring=r)).where("toxicity >= 0.5").count() / len(planted) for r in (True, False)]
    assert share[0] > 0.9 and share[1] < 0.3, share


def test_op4(spark, sf_dir):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r["embedding"]}
    ids = np.array(sorted(vectors))
    x = np.stack([vectors[i] for i in ids])
    rows = defaultdict(list)
    for r in queries.op4_nearest(spark, sf_dir).collect():
        rows[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(rows) == {int(i) for i in ids if i % 20 == 0}
    found = 0
    for q, got in rows.items():
        got.sort()
        assert [r for r, _, _ in got] == list(range(1, min(20, len(ids) - 1) + 1))
        assert all(abs(s - vectors[v] @ vectors[q]) < 1e-12 and v != q for _, v, s in got)
        score = x @ vectors[q]
        score[ids == q] = -np.inf
        found += len({int(i) for i in ids[np.lexsort((ids, -score))[: len(got)]]} & {v for _, v, _ in got}) / len(got)
    assert found / len(rows) >= 0.9


def test_nearest_searches_each_length_and_double_vectors(spark):
    rows = [(0, [1.0, 0.1]), (20, [0.3]), (1, [2.0, 0.0]), (2, [0.25]), (3, [4.0]), (4, None), (5, [1e-9 + 1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, k=2).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 5), (20, 1, 3), (20, 2, 2)]
    assert got[1][3] == (1e-9 + 1.0) * 1.0 + 0.1 * 0.1 and got[2][3] == 4.0 * 0.3


def test_nearest_in_groups_with_bars(spark, monkeypatch):
    monkeypatch.setattr(nearest, "GROUP_BYTES", 4_000)
    monkeypatch.setattr(nearest, "SAMPLE", 400)
    monkeypatch.setattr(nearest, "SHARE", 4)
    x = np.random.default_rng(3).standard_normal((4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in nearest.nearest(df, F.col("vec_id") % 100 == 0, k=10, rerank=200).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, 4000, 100):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-score)[:10].tolist()))
    assert len(got) == 40 and hits / 400 >= 0.9


def test_op6(spark, sf_dir, documents):
    rows, slots = queries.op6_sharding(spark, sf_dir).collect(), defaultdict(list)
    assert {r["doc_id"] for r in rows} == set(documents)
    for r in rows:
        data = (documents[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "key", jump(r["doc_id"], 8), jump(r["doc_id"], 9))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_of_odd_rows(spark):
    df = spark.createDataFrame([(None, 1), (0, 2), (0, 2)], "k long, _at int")
    rows = sharding.number_slots(sharding.assign_shards(df, "k", 4), "shard", ["k"]).collect()
    assert len({r["shard"] for r in rows}) == 1 and sorted(r["slot"] for r in rows) == [0, 1, 2] and sorted(r["_at"] for r in rows) == [1, 2, 2]
    assert sharding.number_slots(sharding.assign_shards(df.limit(0), "k", 4), "shard", ["k"]).count() == 0


def test_op7(spark, sf_dir, documents):
    pattern, windows = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", defaultdict(set)
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words_of(r["text"], pattern)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(r["item_id"]))
    sizes = sorted({len(w) for w in windows})
    rows = queries.op7_decontaminate(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(documents)
    for r in rows:
        w, hit, items = words_of(documents[r["doc_id"]], pattern), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(items), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def test_decontamination_in_blocks_and_pieces(spark, monkeypatch):
    texts = ["the " * 500, "one two three four five six seven eight nine ten eleven", "clean", None]
    items = [("a", "the " * 12), ("b", "two three four five six seven eight nine ten eleven"), ("c", "short one"), ("d", "five six seven")]
    df, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id string, text string")
    whole = [r["hits"] for r in decontaminate.find_contamination(df, bench).orderBy("doc_id").collect()]
    assert [(h["n_words"], h["items"]) for h in whole] == [(500, ["a"]), (11, ["b", "d"]), (1, []), (0, [])] and whole[0]["spans"][0]["end"] == 500
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20)
    monkeypatch.setattr(decontaminate, "CANDIDATES", 3)
    assert [r["hits"] for r in decontaminate.find_contamination(df, bench).orderBy("doc_id").collect()] == whole
    empty = decontaminate.find_contamination(df, bench.limit(0)).collect()
    assert len(empty) == 4 and not any(r["hits"]["items"] for r in empty)


ATTACKS = {
    "open tags": "<a" * 100_000, "quotes": '<a b="' * 50_000, "odd quotes": '<a b="' * 50_001 + ">", "quoted ends": '<a x=">" ' * 30_000, "signs": "<" * 200_000, "inline": "<b>" * 20_000 + "<p>" * 20_000, "numbers": "&#" + "9" * 9000 + ";" + "&#" + "0" * 9000 + "65;",
    "comments": "<!--" * 50_000, "names": "<div class" + " class " * 50_000 + ">x", "deep": "<div>" * 20_000 + "x", "equals": "<a " + "=" * 100_000, "scripts": "<script>" * 20_000,
}


@pytest.mark.parametrize("name", ATTACKS)
def test_markup_attacks_take_linear_time(name):
    start = time.monotonic()
    html_main.main_text(ATTACKS[name], "http://h/x")
    assert time.monotonic() - start < 8


def test_counts_change_texts(spark):
    """Boilerplate that no rule names goes by counts alone, also on pages that mark their article; without counts it stays."""
    pages = [f"<div><p>Welcome to our site</p></div><article><p>own words of page {i}, more of them than of the welcome</p></article><div><p>Town hall, 1 Main Street</p></div>" for i in range(8)]
    own = [f"own words of page {i}, more of them than of the welcome" for i in range(8)]
    assert main_texts(spark, pages) == own
    keys = defaultdict(int)
    for i, p in enumerate(pages):
        for k in html_main.subtree_keys(p, f"http://h.example/{i}").tolist():
            keys[k] += 1
    took = [0, 0]
    assert html_main.main_text(pages[0], "http://h.example/0", keys, 5, took) == own[0] and took[0] > 0 and took[1] == 0
    salt = int(np.uint64(html_main._salt("http://h.example/0")).view(np.int64))
    assert html_main.main_text(pages[0], "http://h.example/0", {salt: 8}) == f"Welcome to our site {own[0]} Town hall, 1 Main Street"


def test_counts_decide_on_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    took = html_main.extract_main(pages, decided_col="took").agg(F.count_if(F.col("took.by_counts") > 0), F.sum("took.by_counts"), F.sum("took.by_rules")).first()
    assert took[0] > 200 and took[1] > 30_000


def test_pages_with_clashing_columns_and_long_pages(spark, monkeypatch):
    rows = [(i, "http://h/x", f"<p>{'long ' * 250_000}</p>" if i == 0 else f"<div><p>menu of all</p></div><p>the words of page {i} itself</p>", 1, 2, 3) for i in range(7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _page int, _keys int, _n int")
    want = {r["page_id"]: r["text"] for r in html_main.extract_main(df).collect()}
    assert len(want[0]) > 1_000_000 and want[3] == "the words of page 3 itself"
    monkeypatch.setattr(html_main, "SENT_KEYS", 0)
    assert {r["page_id"]: r["text"] for r in html_main.extract_main(df).collect()} == want
    assert html_main.extract_main(df).select("_page", "_keys", "_n").first()[:] == (1, 2, 3)


def test_op9(spark, sf_dir, documents):
    rows = queries.op9_language_id(spark, sf_dir).collect()
    model = language_id.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert {r["doc_id"] for r in rows} == set(documents)
    lang, score = model.predict([documents[r["doc_id"]] for r in rows])
    for r, one, s in zip(rows, lang, score, strict=True):
        assert r["held_out"] == held(r["doc_id"]) and r["lang_pred"] == one and abs(r["score"] - s) < 1e-5 and 0 <= r["score"] <= 1


def test_votes_equal_a_loop(spark):
    texts = {"en": "the words of the house and this is it", "de": "die worte des hauses und das ist es", "nl": "de woorden van het huis en dit is het", "fr": "les mots de la maison et voici", "es": "las palabras de la casa y esto es"}
    df = spark.createDataFrame([(i, f"{t} {i}", lang) for i, (lang, t) in enumerate(list(texts.items()) * 30)], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    asked = [f"{t} {k}" for k, t in enumerate(texts.values())] + ["die woorden of the huis", "la maison de la casa"]
    got, _ = model.predict(asked)
    x, _ = language_id.features(asked)
    for row, one in zip(x, got, strict=True):
        margins = [float(row @ w[:-1] + w[-1]) for w in model.outer]
        name = model.families[int(np.argmax(margins))]
        langs = model.members[name]
        votes = dict.fromkeys(langs, 0.0)
        if len(langs) > 1:
            pairs, weights = model.inner[name]
            for (a, b), w in zip(pairs, weights, strict=True):
                m = float(row @ w[:-1] + w[-1])
                votes[langs[a] if m > 0 else langs[b]] += 1
                votes[langs[a]] += 1e-3 * np.clip(m, -1, 1)
                votes[langs[b]] -= 1e-3 * np.clip(m, -1, 1)
        assert one == max(votes, key=votes.get)
    assert got[:5] == list(texts)
    assert language_id.identify(df.limit(0), model).count() == 0 and language_id.fit(df.limit(0)).families == []


def test_op10(spark, sf_dir, documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = quality_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = queries.op10_quality(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(documents)
    for r in rows[::5]:
        want = quality_crf.quality([documents[r["doc_id"]]], field)[0]
        assert r["held_out"] == held(r["doc_id"]) and abs(r["score"] - want) < 1e-6 and r["predicted"] == int(r["score"] >= 0.3)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    field = quality_crf.LineField(rng.standard_normal((3, quality_crf.K, quality_crf.BINS)), rng.standard_normal((2, 2)))
    text = "A good line of words.\n\nBUY NOW!!! 50% | x | y\n123 456\nAnother line, with more words in it than before.\nend end end end\n"
    bins, owner, _ = quality_crf.line_bins([text, "one line"])
    chains = quality_crf.Chains(owner)
    got, u = field.marginals(bins, chains), field.unary(bins, chains)
    for one in (0, 1):
        at = np.flatnonzero(owner == one)
        total, good = 0.0, np.zeros(len(at))
        for labels in itertools.product((0, 1), repeat=len(at)):
            weight = np.exp(sum(u[i] for i, y in zip(at, labels, strict=True) if y) + sum(field.pair[a, b] for a, b in itertools.pairwise(labels)))
            total += weight
            good += weight * np.array(labels)
        assert np.allclose(got[at], good / total)


@pytest.mark.parametrize("call", [
    lambda d, m: toxicity.score_toxicity(d, m[0], score_col="source"), lambda d, m: toxicity.score_toxicity(d, m[0], restored_col="source"), lambda d, m: quality_crf.score_quality(d, m[1], score_col="source"), lambda d, m: language_id.identify(d, m[2], lang_col="source"),
    lambda d, m: decontaminate.find_contamination(d, d.select(F.col("source").alias("item_id"), "text"), hits_col="source"), lambda d, m: html_main.extract_main(d, "source", "text", "lang"), lambda d, m: sharding.assign_shards(d, "doc_id", 2, "source"),
    lambda d, m: sharding.number_slots(d, "lang", ["doc_id"], "source"), lambda d, m: bpe.bpe_encode(d, VOCAB, ids_col="source"), lambda d, m: bpe.bpe_encode(d, VOCAB, decoded_col="source"), lambda d, m: bpe.bpe_decode(d, VOCAB, "doc_id", "source"),
])
def test_columns_that_exist_are_refused(spark, call):
    field = quality_crf.LineField(np.zeros((3, quality_crf.K, quality_crf.BINS)), np.zeros((2, 2)))
    model = toxicity.ToxicityModel(np.zeros((toxicity.V,) * 3, np.float32), np.full(len(toxicity.LEVELS) << toxicity.BITS, -1, np.int16), np.zeros(1), 0.0)
    with pytest.raises(ValueError):
        call(docs_of(spark, ["a"]), (model, field, language_id.LanguageModel()))


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(RuntimeError):
        shared.shared_root(Session())


def test_saved_tables_can_be_dropped(spark):
    table = shared.save(spark.range(5), "test-drop")
    files = table.inputFiles()
    assert files and table.count() == 5
    shared.drop_saved(table)
    import os

    assert not os.path.exists(files[0].removeprefix("file://"))


def test_stages_on_odd_rows(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    long, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, long, 1), (1, other, 2), (1, other, 2), (2, long + " x", 4), (None, long, 5), (None, long, 6), (3, None, 7), (4, "", 9), (5, other + " x", 10)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, _toxicity int")
    for c in ("_quality", "_kept", "_hits", "_id", "_many", "group_key"):
        odd = odd.withColumn(c, F.lit(1))
    stages = dict(pipeline.STAGES)
    kept = stages["jaccard_join"](spark, odd, sf_dir)
    assert kept.columns == odd.columns
    assert sorted((str(r["doc_id"]), r["_toxicity"]) for r in kept.collect()) == [("1", 1), ("1", 2), ("3", 7), ("4", 9), ("None", 5), ("None", 6)]
    for name in ("toxicity", "decontamination"):
        out = stages[name](spark, odd, sf_dir)
        assert out.columns == odd.columns and out.count() == len(rows), name
    good = stages["quality_classifier"](spark, odd, sf_dir)
    assert good.columns == odd.columns and good.where("text is null or text = ''").count() == 0
    assert all(r["round_trip"] for r in stages["bpe"](spark, odd, sf_dir).collect())


def test_run_of_the_pipeline_equals_its_stages(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in pipeline.STAGES:
        docs = shared.save(stage(spark, docs, sf_dir), f"test-{name}")
    assert sorted(map(tuple, docs.select("doc_id", "n_tokens", "round_trip").collect())) == sorted(map(tuple, pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "round_trip").collect()))
    assert ODD[0] is None
