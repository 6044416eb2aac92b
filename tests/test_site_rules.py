"""Families of sites, lists of detail pages, detail pages of posts, and feeds."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from gazette.functions import site_rules as R
from gazette.plans import site_queries
from tests.compare import rows as rows_of


def column(spark, rows, make, schema="a string, b string, c string"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["x"] for r in df.select("i", make(df).alias("x")).orderBy("i").collect()]


def test_families(spark):
    rows = [
        ("https://school.jbedu.kr/k/M010401/", "", ""), ("https://a.gen.ms.kr/x", "<a href='/xboard/board.php?x'>", ""), ("https://b.sen.ms.kr/", "boardCnts/list.do", ""), ("https://c.cnems.kr/", "", "http://x/boardCnts/view.do"),
        ("https://h.kr/M01/", "passni5 selectNttList.do", ""), ("https://h.kr:4520/", "", ""), ("https://h.kr/", None, None), ("https://h.kr/", "schoolbell-e.com", ""),
    ]
    got = column(spark, rows, lambda d: R.detect_family("a", "b", F.array("c")))
    assert [(g["key"], round(g["confidence"], 4), len(g["signals"])) for g in got] == [
        ("jbedu", 0.99, 2), ("gen_xboard", 0.99, 2), ("sen", 0.75, 1), ("cnems_boardcnts", 0.99, 2), ("select_ntt", 0.5417, 1), ("gen_xboard", 0.8333, 1), ("unknown", 0.0, 0), ("schoolbell", 0.2917, 1)
    ]


def test_whole_pages_and_all_links_are_looked_at(spark):
    far, links = "x" * 130_000, " ".join(f"http://x/{i}" for i in range(90))
    rows = [("https://h.kr/", far + "selectNttList.do", ""), ("https://h.kr/", "", links + " http://x/xboard/board.php?a"), ("https://h.kr/", far + "nttInfoBtn", "")]
    assert [g["key"] for g in column(spark, rows, lambda d: R.detect_family("a", "b", F.split("c", " ")))] == ["select_ntt", "gen_xboard", "unknown"]
    assert column(spark, rows, lambda d: R.parser_family("a", "b", F.lit("unknown"))) == ["generic", "generic", "select_ntt_like"]


def test_query_of_families_reads_long_pages_whole(spark, tmp_path):
    page = "<html>" + "<p>long page</p>" * 8_500
    rows = [(i, f"https://h.kr/a/{i}", page) for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    run, sql = site_queries.QUERIES["c12_c13_families"]
    df = run(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows_of(columns, want.fetchall())
    assert {(r["key"], r["parser"]) for r in df.where("page_id in (10, 20)").collect()} == {("select_ntt", "select_ntt_like")}


def test_parser_families(spark):
    rows = [
        ("https://h/c2zHome/x", "", "jbedu", "gen_c2z_home_like"), ("https://h/x", "", "use", "slash_view_like"), ("https://h/M0104/", "", "sen", "slash_view_like"), ("https://h/x", "href=/view/12", "sen", "slash_view_like"), ("https://h/x", "", "dge", "select_ntt_like"),
        ("https://h/x", "", "boardcnts", "boardcnts_like"), ("https://h/x", "", "gen_xboard", "xboard_like"), ("https://h/x", "", "sen", "sen_like"), ("https://h/x", "nttInfoBtn", "unknown", "select_ntt_like"),
        ("https://h/x", "boardCnts goView(", "unknown", "boardcnts_like"), ("https://h/board.php", "mode=view", "unknown", "xboard_like"), ("https://h/subMenu.do", "bbsId", "unknown", "sen_like"), ("https://h/x", None, "unknown", "generic"),
    ]
    assert column(spark, [r[:3] for r in rows], lambda d: R.parser_family("a", "b", F.col("c"))) == [r[3] for r in rows]


def test_lists_of_detail_pages(spark):
    rows = [
        ("https://s.kr/k/M01/view/123", ["https://s.kr/k/M01/", "https://s.kr/k/M01/view/123"]),
        ("https://s.kr/na/selectNttInfo.do;j=1?mi=1&nttSn=9&q=a+b%2A~", ["https://s.kr/na/selectNttList.do;j=1?mi=1&q=a+b%2A~", "https://s.kr/na/selectNttInfo.do;j=1?mi=1&nttSn=9&q=a+b%2A~"]),
        ("https://s.kr/boardCnts/view.do?boardID=1&boardSeq=2", ["https://s.kr/boardCnts/list.do?boardID=1", "https://s.kr/boardCnts/view.do?boardID=1&boardSeq=2"]),
        ("http://s.kr/board.php?Mode=view&tbnum=3&number=4#x", ["http://s.kr/board.php?tbnum=3", "http://s.kr/board.php?Mode=view&tbnum=3&number=4#x"]),
        ("http://s.kr/board.php?tbnum=3", ["http://s.kr/board.php?tbnum=3"]), ("http://s.kr/cms.php?DK_ID=3&a", ["http://s.kr/cms.php?a=", "http://s.kr/cms.php?DK_ID=3&a"]), ("http://s.kr/x", ["http://s.kr/x"]),
    ]
    assert column(spark, [(u, "", "") for u, _ in rows], lambda d: R.list_urls("a")) == [w for _, w in rows]


def test_feeds(spark):
    rows = [
        ("https://school.gyo6.net/gacheon/na/ntt/selectNttList.do?mi=119615&bbsId=39051", "select_ntt_like", "mi=119615|bbsId=39051"), ("https://school.jbedu.kr/kacheon/M010401/index.do", "slash_view_like", "/kacheon/M010401/"),
        ("https://school.use.go.kr/abc/M010401/index.do", "slash_view_like", "/abc/M010401/"), ("https://x.kr/list.do", "boardcnts_like", "k"), ("https://school.gyo6.net/g/selectNttList.do?mi=1", "select_ntt_like", "mi=1|bbsId=None"),
        ("https://x.kr/na/", "select_ntt_like", "bbsId=b c|mi=1"), ("https://school.jbedu.kr/a", "slash_view_like", "/a/b/c/"),
    ]
    got = column(spark, rows, lambda d: R.feed_url("a", F.col("b"), F.col("c")))
    assert [g and tuple(g) for g in got] == [
        ("https://school.gyo6.net/gacheon/na/ntt/selectRssFeed.do?mi=119615&bbsId=39051", "gyo6_rss2"), ("https://school.jbedu.kr/rss/kacheon/M010401.do", "jbedu_json"), None, None, None, ("https://x.kr/na/selectRssFeed.do?mi=1&bbsId=b+c", "gyo6_rss2"), None
    ]


def test_detail_pages_of_posts(spark):
    rows = [("https://s.kr/na/selectNttList.do?mi=1&bbsId=2&page=", "7"), ("https://s.kr/boardCnts/list.do?boardID=5&m=3&s=x", "7"), ("https://s.kr/boardCnts/list.do", "7"), ("https://s.kr/k/M01/", "7"), ("https://s.kr/b?id=1&x=2&id=3", "7")]
    got = column(spark, [(*r, "") for r in rows], lambda d: R.detail_urls("a", "b"))
    assert got == [
        ["https://s.kr/na/selectNttInfo.do?mi=1&bbsId=2&nttSn=7", "https://s.kr/na/view/7", "https://s.kr/na/selectNttList.do?mi=1&bbsId=2&id=7"],
        ["https://s.kr/boardCnts/view.do?boardID=5&viewBoardID=5&boardSeq=7&lev=0&action=view&searchType=null&statusYN=W&page=1&s=x&m=3", "https://s.kr/boardCnts/updateCnt.do?boardID=5&viewBoardID=5&boardSeq=7&lev=0&action=view&searchType=null&srch2=null&statusYN=W&page=1&s=x&m=3", "https://s.kr/boardCnts/view/7", "https://s.kr/boardCnts/list.do?boardID=5&m=3&s=x&id=7"],
        ["https://s.kr/boardCnts/view.do?boardID=&boardSeq=7&lev=0&searchType=null&statusYN=W&page=1", "https://s.kr/boardCnts/updateCnt.do?boardID=&boardSeq=7&lev=0&searchType=null&statusYN=W&page=1&srch2=null", "https://s.kr/boardCnts/list.do/view/7", "https://s.kr/boardCnts/list.do?id=7"],
        ["https://s.kr/k/M01/view/7", "https://s.kr/k/M01/?id=7"], ["https://s.kr/view/7", "https://s.kr/b?id=7&x=2"],
    ]


def test_detail_links(spark):
    rows = {"https://s.kr/b?mode=View&x=1": True, "https://s.kr/b?Mode=view": False, "https://s.kr/b?DK_ID=1": True, "https://s.kr/b?dk_id=": False, "https://s.kr/a/view/12": True, "https://s.kr/a/view/12/": True, "https://s.kr/a/view/1x": False, "https://s.kr/A/SelectNttInfo.do?x": True, "https://s.kr/boardCnts/view.do;j=1": True, "https://s.kr/review/1": False}
    assert column(spark, [(u, "", "") for u in rows], lambda d: R.is_detail_link("a")) == list(rows.values())
