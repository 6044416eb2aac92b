"""State, feeds, streaming and picks on small tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from gazette.functions import urls
from gazette.operators import calendar, dedup, ingest, picks, summary, writes
from gazette.sources import feeds, files
from gazette.streaming import marks


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_watermark_cases(spark):
    posts = spark.createDataFrame([("b1", "100"), ("b1", "9"), ("b2", "5"), ("b1", "x")], "board string, post string")
    posts = posts.withColumn("value", ingest.watermark_value(F.col("post"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    old = spark.createDataFrame([("b1", 99)], "board string, mark long")
    assert pairs(ingest.above_marks(posts, old, "board", "value").select("board", "post")) == [("b1", "100"), ("b1", "x"), ("b2", "5")]
    assert pairs(ingest.advance_marks(posts, old, "board", "value")) == [("b1", 100), ("b2", 5)]
    assert one_value(spark, ingest.watermark_value(F.lit("50"), F.lit("generated"), F.lit(None).cast("string"))) is None


def one_value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_marked_stream_equals_batch(spark, tmp_path):
    spark.createDataFrame([("b1", 100), ("b1", 105), ("b2", 7)], "board string, value long").coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: marks.start_marked_intake(
        spark.readStream.schema("board string, value long").parquet(str(tmp_path / "in")), "board", "value", str(tmp_path / "rows"), str(tmp_path / "marks"), str(tmp_path / "check")
    ).awaitTermination()
    run()
    spark.createDataFrame([("b1", 104), ("b1", 106), ("b3", 1)], "board string, value long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert pairs(spark.read.parquet(str(tmp_path / "rows")).select("board", "value")) == [("b1", 100), ("b1", 105), ("b1", 106), ("b2", 7), ("b3", 1)]
    assert pairs(spark.read.parquet(str(tmp_path / "marks" / "batch=1")).select("board", "mark")) == [("b1", 106), ("b2", 7), ("b3", 1)]


def test_debounce_compares_with_last_accepted(spark):
    at = lambda s: datetime.datetime(2026, 1, 1, 0, 0, s)
    rows = spark.createDataFrame([("a", at(0)), ("a", at(6)), ("a", at(12)), ("a", at(13)), ("b", at(5))], "job string, at timestamp")
    assert pairs(marks.debounce(rows, "job", "at", 10)) == [("a", at(0)), ("a", at(12)), ("b", at(5))]


def test_event_winners(spark):
    rows = [("a", "n", "2026-09-21", "2027-04-30", 0), ("b", "n", "2026-09-28", "2027-04-30", 1), ("c", "n", "2026-10-05", "2026-11-21", 2), ("d", "n", "2026-11-21", None, 3), ("s", None, "2026-01-01", None, 4), ("t", None, "2026-01-01", None, 5)]
    df = spark.createDataFrame(rows, "id string, notice string, start string, `end` string, ord int")
    assert sorted(r["id"] for r in picks.event_winners(df, "notice", "start", "end", "ord").collect()) == ["a", "c", "s", "t"]


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "a", 2), (2, "x", 2), (4, "d", 2)], "k int, v string, at int")
    assert pairs(writes.diff_replace(old, new, ["k"], ["v"])) == sorted([(1, "a", "keep"), (2, "x", "update"), (3, None, "delete"), (4, "d", "insert")], key=lambda r: r[0])
    assert pairs(writes.upsert(old, new, ["k"], "at").select("k", "v")) == [(1, "a"), (2, "x"), (3, "c"), (4, "d")]
    assert pairs(writes.insert_absent(old, new, ["k"]).select("k", "v")) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_summary_of_nothing(spark):
    row = summary.run_summary(spark.range(0), F.lit(True), F.lit(False)).first()
    assert (row["processed"], row["success_rate"], row["alarm"], row["outcome"]) == (0, 1.0, False, "idle")


def test_near_duplicates(spark):
    words = ["word" + "abcdefghij"[i // 10] + "klmnopqrst"[i % 10] for i in range(60)]
    long, half = " ".join(words), " ".join(words[:45])
    rows = [(long, long + " more", True), (long, "other " * 60, False), (half, long + " x" * 9, True), (half + " 마감 12월 31일", long, False), (half + " 4.15", long + " 4월 15일", True), ("a b", "A, B!", True), ("", "", False), ("짧은 글", "다른 글", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").select("want", dedup.profile("a").alias("a"), dedup.profile("b").alias("b"))
    got = df.select(dedup.is_duplicate(F.col("a"), F.col("b")).alias("x"), dedup.is_duplicate(F.col("b"), F.col("a")).alias("y"), "want").collect()
    assert [r["x"] for r in got] == [r["want"] for r in got] == [r["y"] for r in got]


SOURCES = "notice_id string, order_index int, source_type string, raw_text string, status string"


def roles_of(spark, rows):
    got = dedup.assign_roles(spark.createDataFrame(rows, SOURCES)).orderBy("notice_id", "order_index").collect()
    return [(r["source_role"], r["duplicate_of"], r["place"]) for r in got]


def test_roles_of_sources(spark):
    same = "가정통신문 동일 내용 " * 30
    assert roles_of(spark, [("n", 0, "attachment_hwp", same, "success"), ("n", 1, "html_body", same, "success")]) == [("duplicate", 1, None), ("primary", None, 1)]
    body = " ".join(f"낱말{i}" for i in range(50))
    assert roles_of(spark, [("n", 0, "html_body", body, "success"), ("n", 1, "attachment_hwp", body + " 덧붙임" * 40, "success"), ("n", 2, "attachment_pdf", "전혀 다른 글", "success"), ("n", 3, "inline_image", "x", "failed"), ("n", 4, "html_body", " ", "success")]) == [
        ("duplicate", 1, None), ("primary", None, 1), ("primary", None, 2), ("excluded", None, None), ("excluded", None, None)
    ]


def test_groups_are_never_merged(spark):
    """The third source is a duplicate of the second alone, the fourth of the first and third: it joins the first group."""
    a, b = [f"가{i}" for i in range(45)], [f"나{i}" for i in range(45)]
    texts = [" ".join(a), " ".join(b), " ".join(b) + " 끝", " ".join([*a, *b])]
    assert [r[:2] for r in roles_of(spark, [("n", i, "attachment", t, "success") for i, t in enumerate(texts)])] == [("duplicate", 3), ("duplicate", 2), ("primary", None), ("primary", None)]


def test_winners_keep_the_kinds_of_those_that_go(spark):
    rows = [("n", "2026-10-01", "2026-10-10", ["event"], 1), ("n", "2026-10-10", None, ["deadline"], 2), ("n", "2026-10-05", "2026-10-01", ["event"], 3), ("n", "2026-10-05", None, None, 4), (None, "2026-10-10", None, ["event"], 5), (None, "2026-10-10", None, ["event"], 6)]
    got = picks.event_winners(spark.createDataFrame(rows, "n string, s string, e string, k array<string>, i int"), "n", "s", "e", "i", "k").orderBy("i").collect()
    assert [(r["i"], r["k"]) for r in got] == [(1, ["event", "deadline"]), (3, ["event"]), (5, ["event"]), (6, ["event"])]


def test_event_cards(spark):
    d = datetime.date(2026, 9, 1)
    events = spark.createDataFrame([(1, "n", "raw", d, None, ["event"], "gym"), (2, "n", "raw", d, d, ["deadline"], "x"), (3, None, "own", d, None, None, None), (4, "gone", "left", d, None, None, "hall")], "id int, notice_id string, title string, event_date date, end_date date, event_kinds array<string>, location string")
    notices = spark.createDataFrame([("n", "# Notice", None, {"vi": "tóm tắt"})], "id string, title string, summary string, summaries map<string,string>")
    told = spark.createDataFrame([("n", "vi", "", "phòng", None), ("n", "ko", "제목", None, "글"), (None, "vi", "x", "x", "x"), ("gone", "vi", "Tiêu đề", "", "bản")], "notice_id string, target_language string, translated_title string, translated_location string, translated_text string")
    got = calendar.event_cards(events, notices, told, "vi", "?").orderBy("id").select("id", "event_kinds", "display_title", "source_title", "location", "pending").collect()
    assert [tuple(r) for r in got] == [(2, ["deadline", "event"], "tóm tắt", "# Notice", "phòng", True), (3, None, "own", "own", None, False), (4, None, "Tiêu đề", "left", "hall", False)]
    got = calendar.event_cards(events, notices, told, "ko", "?").orderBy("id").select("display_title", "pending").collect()
    assert [tuple(r) for r in got] == [("Notice", False), ("own", False), ("left", False)]


def test_periods(spark):
    rows = [("ok", 1, 540, 580), ("ok", 2, 590, 630), ("bad", 1, 540, 580), ("bad", 2, 570, 620)]
    assert pairs(calendar.period_errors(spark.createDataFrame(rows, "g string, period int, start_min int, end_min int"), "g")) == [("bad", False), ("ok", True)]


def test_feeds(spark):
    rss = "<rss><channel><title>t</title><item><title>one</title><link>http://a/1</link></item><item><title>two</title></item></channel></rss>"
    got = feeds.rss_items(spark.createDataFrame([("f", rss)], "feed string, body string"), "body").select("feed", "title", "link").collect()
    assert [tuple(r) for r in got] == [("f", "one", "http://a/1"), ("f", "two", None)]
    body = '{"items":[{"title":"x","link":"l","description":{"value":"d"}}]}'
    assert tuple(feeds.json_items(spark.createDataFrame([("f", body)], "feed string, body string"), "body").select("title", "description").first()) == ("x", "d")


GYO = "https://school.gyo6.net/gacheon/na/ntt/selectRssFeed.do?mi=119615&bbsId=39051"
ITEM = "<item><title>2학기 안내</title><link>school.gyo6.net/gacheon/gacheon/na/ntt/selectNttInfo.do?nttSn=777&amp;mi=119615</link><pubDate>Mon, 24 Aug 2026 06:13:47 +0900</pubDate><guid isPermaLink='false'>777</guid><file><fileNm>리플릿.pdf</fileNm><dwldUrl>school.gyo6.net/gacheon/common/nttFileDownload.do?fileKey=e3dead</dwldUrl></file><file><fileNm> </fileNm><dwldUrl>/x</dwldUrl></file><file><fileNm>b</fileNm><dwldUrl>https://evil.example.com/a</dwldUrl></file></item>"
OTHERS = "<item><title></title><link>school.gyo6.net/x</link></item><item><title>t</title><link>https://evil.example.com/a</link></item><item><title>by guid</title><guid>/g/1</guid></item>"


def test_posts_of_a_feed(spark):
    rss = f"<?xml version='1.0'?><rss version='2.0'><channel><title>가천초</title>{ITEM}{OTHERS}</channel></rss>"
    df = spark.createDataFrame([(1, GYO, rss), (2, GYO, "<html><body>error</body></html>"), (3, GYO, None)], "n int, feed string, body string")
    got = feeds.rss_posts(df, "body", "feed").orderBy("title").collect()
    assert [(r["n"], r["title"], r["link"], r["guid"], r["published_at"], [tuple(a) for a in r["attachments"]]) for r in got] == [
        (1, "by guid", "https://school.gyo6.net/g/1", "/g/1", None, []),
        (1, "2학기 안내", "https://school.gyo6.net/gacheon/na/ntt/selectNttInfo.do?nttSn=777&mi=119615", "777", "Mon, 24 Aug 2026 06:13:47 +0900", [("리플릿.pdf", "https://school.gyo6.net/gacheon/common/nttFileDownload.do?fileKey=e3dead")]),
    ][::-1]


def test_feed_files_tell_broken_items(spark, tmp_path):
    (tmp_path / "a.xml").write_text(f"<rss><channel>{ITEM}<item><title>cut &am</title><link>/x</link></item>\n{OTHERS}</channel></rss>")
    rows = feeds.rss_file_items(spark, str(tmp_path)).cache()
    assert rows.count() == 5 and rows.where(F.col(feeds.BROKEN).isNotNull()).count() == 1
    got = feeds.posts(rows.where(F.col(feeds.BROKEN).isNull()).drop(feeds.BROKEN), F.lit(GYO))
    assert sorted((r["title"], len(r["attachments"])) for r in got.collect()) == [("2학기 안내", 1), ("by guid", 0)]


def test_envelope(spark):
    good = '{"meals":[{"head":[{"RESULT":{"CODE":"INFO-000","MESSAGE":"ok"}}]},{"row":[{"A":"1"}]}]}'
    rows = [(good, "ok", 1), ('{"RESULT":{"CODE":"ERROR-337","MESSAGE":"q"}}', "quota", None), ('{"RESULT":{"CODE":"INFO-200","MESSAGE":"none"}}', "ok", 0), ('{"RESULT":{"CODE":"ERROR-300","MESSAGE":"x"}}', "error", None)]
    df = feeds.envelope(spark.createDataFrame(rows, "body string, state_want string, n_want int"), "body", "meals")
    for r in df.collect():
        assert r["state"] == r["state_want"] and (None if r["rows"] is None else len(r["rows"])) == r["n_want"]


def test_bytes_of_several_encodings(spark):
    text = "가정통신문 안내"
    rows = [(text.encode("utf-8"), text), (text.encode("cp949"), text), ("똠방각하".encode("cp949"), "똠방각하"), (b"\xff\xfe\xff", None), (None, None)]
    got = [r["t"] for r in spark.createDataFrame(rows, "b binary, want string").select(files.decoded(F.col("b")).alias("t")).collect()]
    assert got[:3] == [w for _, w in rows[:3]] and "\ufffd" in got[3] and got[4] is None


def test_files_by_glob_and_appended_rows(spark, tmp_path):
    for arm, n in (("base", 1), ("new", 2)):
        (tmp_path / arm).mkdir()
        (tmp_path / arm / "n1.json").write_text('{\n"status": "ok", "n": %d}' % n)
    got = files.eval_files(spark, f"{tmp_path}/*/*.json", "status string, n int").orderBy("arm").collect()
    assert [tuple(r) for r in got] == [("ok", 1, "base", "n1"), ("ok", 2, "new", "n1")]
    for k in (1, 2):
        files.append_rows(spark.createDataFrame([(k, "a")], "k int, p string"), f"{tmp_path}/table", ("p",))
    assert sorted(r["k"] for r in spark.read.parquet(f"{tmp_path}/table").collect()) == [1, 2]


def test_links_are_resolved(spark):
    cases = [("https://a.kr/x/y", "z", "https://a.kr/x/z"), ("https://a.kr/x/y", "../z?q#f", "https://a.kr/z?q"), ("https://a.kr", "b", "https://a.kr/b"), ("https://a.kr/x/y?p", "?q", "https://a.kr/x/y?q"), ("https://a.kr/x", "//b.kr/c", "https://b.kr/c"), ("https://a.kr/x/", "./", "https://a.kr/x/"), ("https://a.kr/x", "/../..", "https://a.kr/")]
    rows = spark.createDataFrame(cases, "base string, ref string, want string").select(urls.resolve("base", "ref").alias("got"), "want").collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
