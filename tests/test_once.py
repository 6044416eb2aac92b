"""Expressions that are costly for each row stand in a plan once, rows are dealt to all cores, and amounts are compared whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.functions import notices, records, refine, review, school, site_rules
from gazette.functions.text import CUT, SPACE, kept_runs, kept_text, parts, strip, tokens, tokens_of_runs
from gazette.operators import dedup
from gazette.plans.notice_queries import rows


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_amounts_are_compared_as_whole_numbers(spark):
    df = spark.createDataFrame([("12.15.(금) 12,155 원", "6월 8일, 12월 15일 5000원"), ("12.15.(금) 12,155 원", "12월 15일 12155원"), ("5,000원", "참가비 15,000원"), ("5000원", "5,000원")], "said string, source string")
    assert [r[0] for r in df.select(notices.invented_facts("said", "source")).collect()] == [["12,155 원"], [], ["5,000원"], []]


def test_parts_are_those_of_a_split(spark):
    texts = ["a1b22c", "1", "", "no", "12a", f"a1b{CUT}c2", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(parts("t", "[0-9]+").alias("got"), F.split("t", "[0-9]+", -1).alias("want")).collect():
        assert r["got"] == r["want"]


def test_costly_values_are_computed_once(spark):
    df = spark.createDataFrame([("[a](b) [](https://x.kr) ![c](/d)", "<img src='/a.jpg'><img src='/a.jpg'>", 1)], "t string, html string, n int")
    assert _plan(df.select(refine.sound_links("t").alias("x"))).count("regexp_extract_all(") == 1
    assert _plan(df.select(records.page_images("html", F.lit("https://s.kr/")).alias("x"))).count("<img") == 1
    laid = school.with_overrides(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda p: F.struct(p.alias("period"), (p * 60).alias("start_min"), (p * 60 + 50).alias("end_min"))), F.col("n"), F.col("n"), F.col("n"))
    assert _plan(df.select(laid.alias("x"))).count("sequence(1, 3") == 1
    assert df.select(refine.sound_links("t")).first()[0] == "a [](https://x.kr) ![c](/d)"


def test_rows_are_dealt_to_all_cores(spark, sf_dir):
    assert rows(spark, sf_dir, {"n": "o_orderkey % 3"}).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_kept_text_is_what_cutting_all_else_leaves(spark):
    df = spark.createDataFrame([(t,) for t in ["A b-C! 가나 É9", "", "--- !", "x", "\U0001d400aİB", None]], "t string")
    for r in df.select(kept_text("t").alias("got"), F.regexp_replace(F.lower("t"), "[^0-9A-Za-z가-힣]+", "").alias("want"), tokens("t").alias("tokens"), tokens_of_runs(kept_runs("t")).alias("of_runs")).collect():
        assert r["got"] == r["want"] and r["tokens"] == r["of_runs"]
    assert "regexp_replace(" not in _plan(df.select(kept_text("t")))  # a negated class is slow


def test_sources_are_profiled_once_and_never_joined_with_each_other(spark):
    word = " ".join(f"word{i}" for i in range(60))
    rows = [(n, i, "html_body", t, "success") for n in (1, 2) for i, t in enumerate([word, word + " more", "other"])]
    out = dedup.assign_roles(spark.createDataFrame(rows, "notice_id long, order_index int, source_type string, raw_text string, status string"))
    assert _plan(out).count("sha1(") == 1
    assert [(r["source_role"], r["duplicate_of"], r["place"]) for r in out.where("notice_id = 2").orderBy("order_index").collect()] == [("primary", None, 1), ("duplicate", 0, None), ("primary", None, 2)]


def test_texts_are_hashed_once_for_their_groups(spark):
    df = spark.createDataFrame([(5, "A b"), (3, "ab!"), (4, "-"), (2, ""), (6, "c")], "doc_id long, text string")
    out = dedup.fingerprint_groups(df, "doc_id", "text")
    assert "sha1(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["doc_id"], r["primary"], r["copies"]) for r in out.collect()) == [(2, 2, 1), (3, 3, 2), (4, 4, 1), (5, 3, 2), (6, 6, 1)]


def test_a_page_is_put_together_once_for_its_family_and_once_for_its_parser(spark):
    df = spark.createDataFrame([("https://a.cnems.kr/boardCnts/view.do", "boardCnts/list.do goView"), (None, None)], "url string, html string")
    p = df.withColumn("cms", site_rules.detect_family("url", "html", F.array().cast("array<string>")))
    p = p.select("cms.key", F.size("cms.signals").alias("n"), site_rules.parser_family("url", "html", F.col("cms.key")).alias("parser"))
    assert _plan(p).count("concat_ws(") == 2 and "substring(" not in _plan(p)
    assert [tuple(r) for r in p.collect()] == [("cnems_boardcnts", 2, "boardcnts_like"), ("unknown", 0, "generic")]


def test_texts_of_answers_by_the_faster_patterns(spark):
    texts = ["a b", " a  b\t", " a 　b\n c", "  ", "", "a\x1cb \x1f c", "[안내] İK Trip--#1 -", "---", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(review.error_line("t").alias("got"), F.substring(strip(F.regexp_replace("t", SPACE, " ")), 1, 800).alias("want"), review.slug("t", F.lit("-x-")).alias("slug"), F.regexp_replace(F.lower(F.regexp_replace("t", "[^0-9A-Za-z가-힣]+", "-")), "^-+|-+$", "").alias("bare")).collect()
    for r in got:
        assert r["got"] == r["want"] and r["slug"] == (r["bare"] or "x")
    assert _plan(df.select(review.collapsed_tables("t"))).count("split(") <= 6
    assert "[^0-9A-Za-z" not in _plan(df.select(review.slug("t", F.lit("x"))))
