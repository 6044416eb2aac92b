"""The training-data operators against brute force, round trips and held-out accuracy, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from gazette.llm import bpe, decontaminate, html_main, jaccard_join, language_id, nearest, quality_crf, queries, sharding, token_output, toxicity
from gazette.llm.shared import shared_path

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over the lazy dog " * 4000
ODD = [None, "", "   ", "a", "naïve café 日本語 🙂", "x" * 5000, LONG, "tab\tand\nnewline  double", "<|endoftext|> inside"]


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCAB)
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe_equals_library(spark, library):
    df = docs_of(spark, ODD).withColumn("decoded_by", F.lit("clash"))
    rows = bpe.bpe_decode(bpe.bpe_encode(df, VOCAB), VOCAB).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_bpe_refuses_clashing_column(spark):
    with pytest.raises(ValueError):
        bpe.bpe_encode(docs_of(spark, ["a"]).withColumn("ids", F.lit(1)), VOCAB)


def test_op5_on_table(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op5_bpe(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("texts", [ODD, []])
def test_token_files(spark, library, texts):
    path = shared_path(spark, "test-tokens")
    token_output.write_tokens(docs_of(spark, texts), path, VOCAB, end_id=2)
    rows = sorted(token_output.id_digests(token_output.read_tokens(spark, path)).collect(), key=lambda r: r["doc_id"])
    start = 0
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def words_of(text, pattern):
    return re.findall(pattern, (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_classes(texts):
    sets = []
    for t in texts:
        w = words_of(t, r"[^\x20\x09-\x0D]+")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    comp = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    return [len(s) for s in sets], comp


def near_copies(seed, n=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocabulary, k)) for k in (7, 30, 80, 150)]
    passage = list(rng.choice(vocabulary, 60))
    out = [*ODD[:5], ODD[4]]
    for _ in range(n):
        w = list(base[rng.integers(4)])
        for _ in range(rng.integers(0, max(2, len(w) // 18))):
            w[rng.integers(len(w))] = str(rng.choice(vocabulary))
        out.append(" ".join(w).upper() if rng.integers(2) else "\n".join(w))
    out += [" ".join([*passage, *rng.choice(vocabulary, rng.integers(3, 60))]) for _ in range(n // 2)]
    return out


@pytest.mark.parametrize("seed,small", [(1, 24), (2, 24), (3, 1), (4, 1)])
def test_jaccard_equals_brute_force(spark, monkeypatch, seed, small):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    texts = near_copies(seed)
    sizes, comp = brute_classes(texts)
    rows = jaccard_join.jaccard_classes(docs_of(spark, texts)).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got == {i: (n, c) for i, (n, c) in enumerate(zip(sizes, comp, strict=True))}


def test_jaccard_of_nothing_and_null_ids(spark):
    assert jaccard_join.jaccard_classes(docs_of(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A b c d e f")], "doc_id long, text string")
    assert sorted((str(r[0]), r[2]) for r in jaccard_join.jaccard_classes(df).collect()) == [("3", 3), ("3", 3), ("9", 3), ("None", None)]


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding_equals_jump_hash(spark):
    keys = [0, 1, 7, 12345, -1, -(2**63), 2**63 - 1, *range(100, 160)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 8, 9, 100):
        assert {r["k"]: r["shard"] for r in sharding.assign_shards(df, "k", n).collect()} == {k: jump(k & (2**64 - 1), n) for k in keys}


def test_op6_slots(spark, sf_dir):
    rows = queries.op6_sharding(spark, sf_dir).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_decontamination_equals_brute_force(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = [("a", item), ("b", "short item"), ("c", None), ("d", "..."), ("a", item), (None, item)]
    texts = [*ODD, f"x {item.upper()}; y", "one two three four five six seven eight nine", "a short, item here and short item", f"{item} {item}"]
    rows = decontaminate.find_contamination(docs_of(spark, texts), spark.createDataFrame(items, "item_id string, text string")).collect()
    pattern, windows = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", defaultdict(set)
    for i, t in items:
        w = words_of(t, pattern)
        for k in range(max(1, len(w) - 9) if w and i else 0):
            windows[tuple(w[k : k + 10])].add(i)
    for r in rows:
        w, hit, ids = words_of(r["text"], pattern), set(), set()
        for win, found in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    ids |= found
        assert r["hits"]["n_words"] == len(w) and set(r["hits"]["items"]) == ids
        assert {i for s in r["hits"]["spans"] for i in range(s["start"], s["end"])} == hit


def test_nearest_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 24)).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(10_000, None), (10_001, [0.0] * 24), (10_002, [None] + [1.0] * 23), (10_003, [float("nan")] * 24), (10_004, [float("inf")] * 24), (10_005, [1.0] * 3), (None, [1.0] * 24), rows[20]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in sorted(nearest.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 6000, 20))
    hits, y = 0, x.astype(float)
    for q, found in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(6000), -s))[:20]
        hits += len(set(want) & {i for i, _ in found})
        assert len(found) == 20 and all(abs(s[i] - v) < 1e-9 for i, v in found) and [v for _, v in found] == sorted((v for _, v in found), reverse=True)
    assert hits / (20 * len(got)) >= 0.9


def test_nearest_tells_rows_apart_within_tight_clusters(spark):
    rng = np.random.default_rng(3)
    n = 12_000
    x = (rng.standard_normal((12, 64))[rng.integers(0, 12, n)] + 0.02 * rng.standard_normal((n, 64))).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in nearest.nearest(df, F.col("vec_id") % 100 == 0, k=20).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits, y = 0, x.astype(float)
    for q in range(0, n, 100):
        s = y @ y[q]
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(n), -s))[:20]) & got[q])
    assert hits / (20 * len(got)) >= 0.98


def test_nearest_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0)]
    assert nearest.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body>{nav}<!-- c --><div class='ad'>buy</div>{body}<footer>&copy; f</footer></body></html>"


def page(body, nav="<nav><ul><li><a href='/x'>menu</a></li></ul></nav>"):
    return PAGE.replace("{nav}", nav).replace("{body}", body)


@pytest.mark.parametrize(
    "body,want",
    [
        ("<article><h1>Head &amp; tail</h1><p><b>One<br><p>two&nbsp;\n three</p></article>", "Head & tail One two three"),
        ("<article><p>in<b>li</b>ne</p><aside>no</aside><form><p>no</p></form><div class='comments'><article class='comment'><p>no</p></article></div></article>", "inline"),
        ("<main><p>unclosed <i>tags", "unclosed tags © f"),
        ("<div id='cookie-notice'>no</div><div><p>plain &lt;text&gt;</p><table><tr><td>1<td>2</table></div>", "plain <text> 1 2"),
        ("<article><ul><li>a<li>b</ul>tail</article>", "a b tail"),
        ("", ""),
    ],
)
def test_main_text_of_one_page(body, want):
    got = html_main.main_text(page(body), "http://h/x")
    assert got == want or got + " © f" == want


def test_recurring_subtrees_go_and_articles_stay(spark, monkeypatch):
    banner = "<div><p>Welcome to our site</p></div>"
    rows = [(i, f"http://H.example/p{i}", page(f"{banner}<div><p>unique text number {i} of this page, long enough</p></div>")) for i in range(12)]
    rows += [(100 + i, f"http://h.example/c{i}", page("<article><p>copied article</p></article>")) for i in range(12)]
    rows += [(200, None, None), (201, "http://h.example/", ""), (202, "bad url", "no markup"), (203, "http://other.example/a", page(banner))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"unique text number {i} of this page, long enough" for i in range(12)} | {100 + i: "copied article" for i in range(12)} | {200: "", 201: "", 202: "no markup", 203: "Welcome to our site"}
    assert {r["page_id"]: r["text"] for r in html_main.extract_main(df).collect()} == want
    monkeypatch.setattr(html_main, "SENT_KEYS", 0)  # the join instead of the sent keys
    assert {r["page_id"]: r["text"] for r in html_main.extract_main(df).collect()} == want
    assert html_main.extract_main(df.limit(0)).count() == 0


def main_texts(spark, pages, other_host=()):
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)] + [(len(pages) + i, f"http://g.example/{i}", p) for i, p in enumerate(other_host)], "page_id long, url string, html string")
    return [r["text"] for r in html_main.extract_main(df).orderBy("page_id").collect()]


def test_recurring_notices_in_articles_go_and_copies_stay(spark):
    notice = "<p>Subscribers receive every notice by letter</p><ul><li><a href='/s'>Subscribe here now</a></li></ul>"
    own = [f"own words of article {i} <b>Note well</b> which are longer than the notice that follows below them" for i in range(8)]
    copied = ["the first long paragraph of a copied article", "and another paragraph that is copied with it"]
    pages = [f"<article><h2>Summary</h2><p>{t}</p>{notice}</article>" for t in own]
    pages += [f"<main><p>{copied[0]}</p><p>{copied[1]}</p><p>edit {i}</p></main>" for i in range(6)]
    teasers = [f"<article><p>Read our teaser number {i}</p></article><div><p>{t} at twice the length, {t}</p></div>" for i, t in enumerate(own)]
    plain = [t.replace("<b>", "").replace("</b>", "") for t in own]
    want = [f"Summary {t}" for t in plain] + [f"{copied[0]} {copied[1]} edit {i}" for i in range(6)]
    want += [f"Read our teaser number {i} {t} at twice the length, {t}" for i, t in enumerate(plain)]
    assert main_texts(spark, pages, teasers) == want


@pytest.mark.parametrize("others", [0, 10])
def test_unmarked_copies_in_different_shells_stay(spark, others):
    text = ["first paragraph of the article that is copied", "second paragraph of the article that is copied", "third paragraph of it"]
    article = "".join(f"<p>{t}</p>" for t in text)
    shells = [f"<div><p>menu {i}</p></div><div>{article}</div><div>end {i}</div>" for i in range(6)]
    if others:  # paragraphs shared, but not their container
        shells = [f"<div><p>menu {i}</p>{article}<p>end {i}</p></div>" for i in range(6)]
    rest = [f"<div><p>some other page {i} of the host</p></div>" for i in range(others)]
    want = [f"menu {i} {' '.join(text)} end {i}" for i in range(6)] + [f"some other page {i} of the host" for i in range(others)]
    assert main_texts(spark, shells + rest) == want


def test_op8_on_table(spark, sf_dir):
    import html as H

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op8_html_main(spark, sf_dir).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        want = " ".join(H.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)>", " ", body))).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def area(y, s):
    order = np.argsort(np.argsort(s)) + 1.0
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def held_out_rows(spark, sf_dir, df, label):
    rows = df.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", label).toPandas()
    return rows["score"].to_numpy(), rows["predicted"].to_numpy(), rows[label].to_numpy()


def test_toxicity_held_out(spark):
    score, predicted, y = held_out_rows(spark, "/root/testdata/sf0.1", queries.op3_toxicity(spark, "/root/testdata/sf0.1"), "toxic")
    assert area(y, score) > 0.9 and predicted[y == 0].mean() < 0.02 and (predicted == (score >= 0.5)).all()


def test_toxicity_held_out_by_language(spark):
    sf_dir = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = queries.op3_toxicity(spark, sf_dir).join(known, "doc_id").where("held_out and toxic is not null").select("lang", "predicted", "toxic").toPandas()
    found = rows[rows["toxic"] == 1].groupby("lang")["predicted"].agg(["sum", "count"])
    assert (found["sum"] / found["count"]).min() >= 0.75
    assert rows[rows["toxic"] == 0].groupby("lang")["predicted"].mean().max() < 0.03


def test_toxicity_by_counts_where_presence_says_nothing(spark):
    plain = [f"ein wort steht hier und noch ein satz über haus {'abcdefgh'[i % 8]} garten achlicher" for i in range(80)]
    toxic = [f"{t} achlicher achlicher achlicher" for t in plain]
    docs = docs_of(spark, plain + toxic)
    labels = spark.createDataFrame([(i, int(i >= 80)) for i in range(160)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()
    assert all((r["toxicity"] >= 0.5) == (r["doc_id"] >= 80) for r in rows)


def test_quality_held_out(spark):
    score, predicted, y = held_out_rows(spark, "/root/testdata/sf0.1", queries.op10_quality(spark, "/root/testdata/sf0.1"), "quality")
    assert area(y, score) > 0.95 and predicted[y == 1].mean() > 0.97


def test_disguised_words_are_read():
    texts = ["you stupid idiot go away", "such an idiot and a stupid moron", "pathetic trash and a clown", "good morning to all of you"] * 50
    c = toxicity.codes(toxicity.points("  ".join(texts) + "  ")).astype(np.int64)
    counts = np.bincount((c[:-2] * toxicity.V + c[1:-1]) * toxicity.V + c[2:], minlength=toxicity.V**3).reshape((toxicity.V,) * 3)
    table = toxicity.character_model(counts.astype(float)).ravel().tolist()
    for seen, want in {"1d10t": "idiot", "s t u p i d": "stupid", "m0r0n": "moron", "cl*wn": "clown", "stuuuupid": "stupid", "tr@$h": "trash"}.items():
        assert want in toxicity.restore(f"you {seen} there", table)


def test_long_odd_words_are_read_in_one_pass():
    table = np.zeros(toxicity.V**3).tolist()
    n = 50_000
    start = time.monotonic()
    for text in ("a1b" * n, "ab" * n + " x1y", "a b " * n, "aaab" * n, "1" * n + " a1b", "a1b" + "!" * n + "a", "a" + " " * n + "1a1"):
        assert len(toxicity.restored_batch([text], table)[0]) > 0
    assert time.monotonic() - start < 60


@pytest.mark.parametrize("fit,score", [(toxicity.fit, toxicity.score_toxicity), (quality_crf.fit, quality_crf.score_quality)])
def test_classifiers_on_odd_rows(spark, fit, score):
    df = docs_of(spark, ODD)
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(9)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        rows = score(df, fit(df, given)).collect()
        assert len(rows) == len(ODD) and all(0.0 <= r[-1] <= 1.0 for r in rows)
    assert score(df.limit(0), fit(df.limit(0), labels)).count() == 0


def test_languages(spark, sf_dir):
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.95
    odd = docs_of(spark, [None, "", "123 !!", "words here"])
    found = language_id.identify(odd, language_id.fit(docs_of(spark, ["words of one language"] * 20).unionByName(odd)))
    assert [r["lang_pred"] for r in found.orderBy("doc_id").collect()] == ["und", "und", "und", "en"]
    assert [r["lang_pred"] for r in language_id.identify(odd, language_id.fit(odd.withColumn("lang", F.lit(None).cast("string")))).collect()] == ["und"] * 4


def test_pipeline_stages(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir).cache()
        assert kept.columns == columns and kept.select("doc_id").subtract(docs.select("doc_id")).count() == 0, name
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = {r["doc_id"] for r in kept.collect()}
        if name == "jaccard_join":
            ids = sorted(before)
            comp = brute_classes([before[i] for i in ids])[1]
            assert after == {ids[c] for c in set(comp)}
        if name == "decontamination":
            clean = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("hits.spans") == 0)
            assert after == {r["doc_id"] for r in clean.select("doc_id").collect()}
        docs = kept
    last = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(last) == docs.count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in last)
    empty = spark.createDataFrame([], T.StructType(docs.schema.fields))
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
