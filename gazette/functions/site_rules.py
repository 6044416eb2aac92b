"""Rules about families of sites as rows of tables: what marks a family, how its detail pages become lists, where its feeds are.

A rule holds if each of its clauses has a term that its field contains; ``matched`` gives the rules that hold, by rank. A new
family is a row here, not code. Rules go into a plan as one literal, as there are some dozens; fields are columns of the caller.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.text import col, once
from gazette.functions.urls import part, resolve


@dataclass(frozen=True)
class Rule:
    """clauses: each a list of (field, term), of which one must hold; a field name that ends in ~ takes the term as a pattern, in = as the whole value."""

    family: str
    score: int
    signal: str
    clauses: tuple[tuple[tuple[str, str], ...], ...] = field(default=())


def _of(where: str, *terms: str) -> tuple[tuple[str, str], ...]:
    return tuple((where, t) for t in terms)


# Signals of families of board software, in their order.
SIGNALS = (
    Rule("jbedu", 100, "도메인 school.jbedu.kr", (_of("host", "school.jbedu.kr"),)),
    Rule("jje", 100, "도메인 school.jje.go.kr", (_of("host", "school.jje.go.kr"),)),
    Rule("busanedu", 100, "도메인 school.busanedu.net", (_of("host", "school.busanedu.net"),)),
    Rule("dge", 100, "도메인 dge.ms.kr", (_of("host", "dge.ms.kr", "dge.es.kr"),)),
    Rule("gen_xboard", 100, "도메인 gen.ms.kr 또는 452 포트", (_of("host", "gen.ms.kr", "gen.es.kr", ":452"),)),
    Rule("use", 100, "도메인 school.use.go.kr", (_of("host", "school.use.go.kr"),)),
    Rule("cbe", 100, "도메인 school.cbe.go.kr", (_of("host", "school.cbe.go.kr"),)),
    Rule("cnems_boardcnts", 100, "도메인 cnems.kr", (_of("host", "cnems.kr"),)),
    Rule("sen", 90, "도메인 sen 학교 CMS", (_of("host", "sen."),)),
    Rule("gen_xboard", 80, "xhomenews/xboard 게시판 패턴", (_of("text", "/xhomenews/board.php", "/xboard/board.php"),)),
    Rule("boardcnts", 70, "boardCnts 게시판 패턴", (_of("text", "boardCnts/list.do", "boardCnts/view.do"),)),
    Rule("cnems_boardcnts", 40, "cnems + boardCnts 조합", (_of("text", "boardCnts/list.do", "boardCnts/view.do"), _of("host", "cnems.kr"))),
    Rule("select_ntt", 65, "selectNtt 게시판 패턴", (_of("text", "selectNttList.do", "selectNttInfo.do"),)),
    Rule("jbedu", 50, "전북 M코드/passni5 패턴", (_of("text", "/M01"), (("text", "passni5"), ("host", "school.jbedu.kr")))),
    Rule("use", 50, "울산 M코드 패턴", (_of("text", "/M01"), _of("host", "school.use.go.kr"))),
    Rule("cbe", 50, "충북 M코드 패턴", (_of("text", "/M01"), _of("host", "school.cbe.go.kr"))),
    Rule("schoolbell", 35, "학교종이 외부 링크 포함", (_of("text", "schoolbell-e.com"),)),
)
# How pages of a board are read, the first rule that holds.
PARSERS = (
    Rule("gen_c2z_home_like", 0, "", ((("url", "/c2zHome"), ("text", "homn_filedown.php")),)),
    Rule("slash_view_like", 0, "", (_of("cms=", "jbedu", "use", "cbe"),)),
    Rule("slash_view_like", 0, "", ((("text~", r"/view/(\d+)"), ("path~", r"/M\d+/?")),)),
    Rule("select_ntt_like", 0, "", (_of("cms=", "select_ntt", "busanedu", "dge", "jje"),)),
    Rule("boardcnts_like", 0, "", (_of("cms=", "boardcnts", "cnems_boardcnts"),)),
    Rule("xboard_like", 0, "", (_of("cms=", "gen_xboard"),)),
    Rule("sen_like", 0, "", (_of("cms=", "sen"),)),
    Rule("slash_view_like", 0, "", ((("host", "school.use.go.kr"), ("host", "school.cbe.go.kr"), ("text~", r"/view/(\d+)")),)),
    Rule("select_ntt_like", 0, "", (_of("text", "selectNttInfo.do", "nttInfoBtn"),)),
    Rule("boardcnts_like", 0, "", (_of("text", "boardCnts"), _of("text", "goView"))),
    Rule("xboard_like", 0, "", (_of("text", "board.php"), _of("text", "mode=view"))),
    Rule("sen_like", 0, "", (_of("text", "subMenu.do"), _of("text", "nttId", "bbsId"))),
)
# The whole score, the most that is given, and signals that are told.
WHOLE, MOST, TOLD = 120, 0.99, 4
# Query keys of detail pages; of boards in PHP also these; values of mode, keys and paths of detail pages among links.
DETAIL_KEYS, PHP_KEYS, ITEM_KEYS = ("nttSn", "nttId", "articleId", "boardSeq", "seq", "number", "num"), ("mode", "queryencode"), ("dk_id",)
DETAIL_MODES = ("downpost", "view", "read", "detail", "viewpost")


@dataclass(frozen=True)
class ListRule:
    """A path that ends in ``ends``: ``to`` takes its place, keys are dropped (lower: whatever their case); only_if_dropped: else the rule gives nothing."""

    ends: str
    to: str
    keys: tuple[str, ...]
    lower: tuple[str, ...] = ()
    only_if_dropped: bool = False


LISTS = (
    ListRule("selectNttInfo.do", "selectNttList.do", DETAIL_KEYS), ListRule("boardCnts/view.do", "boardCnts/list.do", DETAIL_KEYS),
    ListRule("board.php", "board.php", DETAIL_KEYS, PHP_KEYS, True), ListRule("cms.php", "cms.php", (), ITEM_KEYS, True),
)
RSS_HOST, RSS2, JSON_FEED = "school.jbedu.kr", "gyo6_rss2", "jbedu_json"


def matched(rules: Sequence[Rule], fields: dict[str, Column]) -> Column:
    """The rules that hold, in their order: array of struct of rank, family, score and signal. fields: by the name in the clauses, without ~ or =."""

    def holds(term: tuple[str, str]) -> Column:
        where, text = term
        value = fields[where.rstrip("~=")]
        return value.rlike(text) if where.endswith("~") else value == text if where.endswith("=") else value.contains(text)

    def one(rank: int, rule: Rule) -> Column:
        ok = F.lit(True)
        for clause in rule.clauses:
            some = F.lit(False)
            for term in clause:
                some = some | F.coalesce(holds(term), F.lit(False))
            ok = ok & some
        return F.when(ok, F.struct(F.lit(rank).alias("rank"), F.lit(rule.family).alias("family"), F.lit(rule.score).alias("score"), F.lit(rule.signal).alias("signal")))

    return F.filter(F.array(*(one(i, r) for i, r in enumerate(rules))), lambda x: x.isNotNull())


def _host(url: Column) -> Column:
    return F.lower(part(url, 2))


def detect_family(url: Column | str, html: Column | str, links: Column) -> Column:
    """Struct of key, confidence and signals: the family of the greatest sum of scores, the first seen of equal ones; unknown without a signal. The whole page and all links (array of URLs) are looked at."""
    u = col(url)
    text = F.concat_ws(" ", u, F.coalesce(col(html), F.lit("")), F.array_join(links, " "))

    def judged(found: Column) -> Column:
        # Each rule that holds carries its family's sum and first rank; the best of them is of the best family.
        rated = F.transform(found, lambda r: F.struct(F.aggregate(F.filter(found, lambda o: o["family"] == r["family"]), F.lit(0), lambda a, o: a + o["score"]).alias("sum"), (-r["rank"]).alias("early"), r["family"].alias("key")))
        return once(F.array_max(rated), lambda best: told(found, best))

    def told(found: Column, best: Column) -> Column:
        signals = F.slice(F.transform(F.filter(found, lambda r: r["family"] == best["key"]), lambda r: r["signal"]), 1, TOLD)
        none = F.size(found) == 0
        return F.struct(
            F.when(none, "unknown").otherwise(best["key"]).alias("key"), F.when(none, 0.0).otherwise(F.least(best["sum"] / F.lit(float(WHOLE)), F.lit(MOST))).alias("confidence"),
            F.when(none, F.array().cast("array<string>")).otherwise(signals).alias("signals"),
        )

    # The page's text is put together once and each rule tried once, however often they are used.
    return once(F.struct(_host(u).alias("host"), text.alias("text")), lambda x: once(matched(SIGNALS, {"host": x["host"], "text": x["text"]}), judged))


def parser_family(board_url: Column | str, html: Column | str, key: Column) -> Column:
    """How a board is read: the first of PARSERS that holds on the whole page, else generic."""
    u = col(board_url)
    text = F.concat_ws(" ", u, F.coalesce(col(html), F.lit("")))
    fields = F.struct(_host(u).alias("host"), u.alias("url"), part(u, 3).alias("path"), text.alias("text"), key.alias("cms"))
    return once(fields, lambda x: F.coalesce(F.try_element_at(matched(PARSERS, {n: x[n] for n in ("host", "url", "path", "text", "cms")}), F.lit(1))["family"], F.lit("generic")))


def _coded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _plain(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def query_pairs(url: Column | str) -> Column:
    """Array of struct of k and v, decoded; empty pairs are passed over."""
    raw = F.filter(F.split(F.regexp_replace(part(url, 4), r"^\?", ""), "&"), lambda p: p != "")
    return F.transform(raw, lambda p: F.struct(_plain(F.substring_index(p, "=", 1)).alias("k"), F.when(p.contains("="), _plain(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")))


def query_text(pairs: Column) -> Column:
    """The query of some pairs, with its question mark; empty for none."""
    text = F.array_join(F.transform(pairs, lambda p: F.concat(_coded(p["k"]), F.lit("="), _coded(p["v"]))), "&")
    return F.when(text == "", "").otherwise(F.concat(F.lit("?"), text))


def _split_path(url: Column) -> tuple[Column, Column, Column]:
    """Scheme and authority, path, and the parameters of its last part with their semicolon."""
    path = part(url, 3)
    return F.concat(F.lower(part(url, 1)), F.lit("://"), part(url, 2)), F.regexp_replace(path, ";[^/]*$", ""), F.regexp_extract(path, ";[^/]*$", 0)


def list_urls(url: Column | str) -> Column:
    """Lists that a URL may belong to, by LISTS and by /view/, then the URL itself; each once."""
    u = col(url)
    head, path, params = _split_path(u)
    pairs = query_pairs(u)
    viewed = F.when(path.contains("/view/"), F.concat(head, F.regexp_replace(F.substring_index(path, "/view/", 1), "/+$", ""), F.lit("/")))
    made = [viewed]

    def without(rule: ListRule) -> Column:
        return F.filter(pairs, lambda p: ~p["k"].isin(*rule.keys) & ~F.lower(p["k"]).isin(*rule.lower))

    for rule in LISTS:
        left = without(rule)
        whole = F.concat(head, F.replace(path, F.lit(rule.ends), F.lit(rule.to)), params, query_text(left))
        made.append(F.when(path.endswith(rule.ends) & (F.lit(not rule.only_if_dropped) | (F.size(left) < F.size(pairs))), whole))
    return F.array_distinct(F.filter(F.array(*made, u), lambda x: x.isNotNull() & (x != "")))


def feed_url(board_url: Column | str, family: Column, board_key: Column) -> Column:
    """Struct of url and flavor of a board's feed, by its parser family; null where there is none."""
    u = col(board_url)
    head, path, _ = _split_path(u)
    value = lambda k: F.trim(F.coalesce(F.element_at(F.filter(F.split(board_key, r"\|"), lambda x: x.startswith(f"{k}=")), -1), F.lit("")))
    mi, bbs = (F.regexp_replace(value(k), "^[^=]*= *", "") for k in ("mi", "bbsId"))
    feed = F.when(path.contains("selectNttList.do"), F.replace(path, F.lit("selectNttList.do"), F.lit("selectRssFeed.do"))).otherwise(F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/selectRssFeed.do")))
    listed = F.struct(F.concat(head, feed, F.lit("?mi="), _coded(mi), F.lit("&bbsId="), _coded(bbs)).alias("url"), F.lit(RSS2).alias("flavor"))
    steps = F.filter(F.split(board_key, "/"), lambda x: x != "")
    by_host = F.struct(F.concat(F.lit(f"https://{RSS_HOST}/rss/"), F.try_element_at(steps, F.lit(1)), F.lit("/"), F.try_element_at(steps, F.lit(2)), F.lit(".do")).alias("url"), F.lit(JSON_FEED).alias("flavor"))
    bare = F.regexp_replace(F.regexp_replace(_host(u), "^[^@]*@", ""), ":[0-9]*$", "")
    return F.when((family == "select_ntt_like") & ~mi.isin("", "None") & ~bbs.isin("", "None"), listed).when((family == "slash_view_like") & (bare == RSS_HOST) & (F.size(steps) == 2), by_host)


def detail_urls(board_url: Column | str, post_id: Column | str) -> Column:
    """Where a post of a board may be read, by its number: pages of the list's own software, then view/ and the id as a query key; each once."""
    u, post = col(board_url), col(post_id)
    head, path, _ = _split_path(u)
    pairs = F.filter(query_pairs(u), lambda p: p["v"] != "")
    first = lambda k: F.try_element_at(F.filter(pairs, lambda p: p["k"] == k), F.lit(1))["v"]
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    some = lambda *ps: query_text(F.filter(F.array(*ps), lambda p: p["v"].isNotNull()))
    info = F.when(path.endswith("selectNttList.do"), F.concat(head, F.replace(path, F.lit("selectNttList.do"), F.lit("selectNttInfo.do")), some(pair("mi", first("mi")), pair("bbsId", first("bbsId")), pair("nttSn", post))))
    board = F.coalesce(first("boardID"), F.lit(""))
    shown = F.when(board != "", board)  # without a board's id there is no second one, nor an action
    acting = F.when(board != "", "view")
    common = [pair("boardID", board), pair("viewBoardID", shown), pair("boardSeq", post), pair("lev", F.lit("0")), pair("action", acting), pair("searchType", F.lit("null")), pair("statusYN", F.lit("W")), pair("page", F.coalesce(first("page"), F.lit("1"))), pair("s", first("s")), pair("m", first("m"))]
    counted = lambda at: some(*common[:at], pair("srch2", F.lit("null")), *common[at:])
    boards = path.endswith("list.do") & path.contains("boardCnts")
    view = F.when(boards, F.concat(head, F.lit("/boardCnts/view.do"), some(*common)))
    count = F.when(boards, F.concat(head, F.lit("/boardCnts/updateCnt.do"), F.when(board != "", counted(6)).otherwise(counted(8))))
    under = resolve(F.concat(F.regexp_replace(u, "/+$", ""), F.lit("/")), F.concat(F.lit("view/"), post))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    grouped = F.flatten(F.transform(keys, lambda k: F.when(k == "id", F.array(F.struct(k.alias("k"), post.alias("v")))).otherwise(F.filter(pairs, lambda p: p["k"] == k))))
    with_id = F.concat(head, path, query_text(F.when(F.array_contains(keys, "id"), grouped).otherwise(F.concat(grouped, F.array(pair("id", post))))))
    return F.array_distinct(F.filter(F.array(info, view, count, under, with_id), lambda x: x.isNotNull() & (x != "")))


def is_detail_link(url: Column | str) -> Column:
    """True for a whole URL of one post: by its mode, by keys, or by a path that ends in view and a number or in the page of a post."""
    u = col(url)
    pairs, path = F.filter(query_pairs(u), lambda p: p["v"] != ""), F.regexp_replace(part(u, 3), ";[^/]*$", "")
    mode = F.exists(pairs, lambda p: (p["k"] == "mode") & F.lower(p["v"]).isin(*DETAIL_MODES))
    keyed = F.exists(pairs, lambda p: F.lower(p["k"]).isin(*ITEM_KEYS))
    return mode | keyed | path.rlike(r"(?i)(?:^|/)view/+[0-9]+/*$") | F.lower(path).rlike(r"(?:selectnttinfo\.do|boardcnts/view\.do)$")
