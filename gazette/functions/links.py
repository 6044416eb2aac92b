"""Scores and classes of links, pages, rows and clients that a crawl meets. Sums of terms and ordered rules; terms are fixed values."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.html_tree import title_and_snippet
from gazette.functions.text import BLANK, col, collapse, once, strip
from gazette.functions.urls import part

STRONG = ("가정통신문", "가정통신", "학부모통신문", "학교통신문")
WEAK = ("알림마당", "학교소식", "학교공지", "공지사항", "학부모마당", "열린마당", "학교마당", "게시판", "소식")
URL_HINTS = ("bbs", "board", "notice", "ntt", "selectntt", "sub", "menu", "m=")
AGAINST = ("급식", "채용", "입찰", "사진", "영상", "방과후", "도서관", "행정", "민원", "예산")
OFFICE = "교육청"


def names_any(c: Column, terms: Iterable[str]) -> Column:
    return reduce(or_, [c.contains(t) for t in terms])


def hits(c: Column, terms: Iterable[str]) -> Column:
    """How many of the terms stand in c."""
    return reduce(lambda a, b: a + b, [F.when(c.contains(t), 1).otherwise(0) for t in terms])


def first_rule(rules: Iterable[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, holds in rules:
        out = out.when(holds, name)
    return out.otherwise(F.lit(otherwise).cast("string"))


def compact(c: Column) -> Column:
    return F.replace(collapse(c), F.lit(" "), F.lit(""))


def is_notice(c: Column) -> Column:
    t = compact(c)
    return names_any(t, STRONG) | (names_any(t, ("가정", "학부모", "학교")) & t.contains("통신문"))


def is_own_notice(c: Column) -> Column:
    """A notice of the school, not of its office."""
    return is_notice(c) & ~compact(c).contains(OFFICE)


def link_score(text: Column | str, url: Column | str, context: Column | str) -> Column:
    label, near = F.concat_ws(" ", col(text), col(url)), F.concat_ws(" ", col(text), col(context))
    first = F.when(is_own_notice(label), 200).when(is_notice(label), -120).when(is_own_notice(col(context)), 25).otherwise(0)
    strong = F.when(compact(label).contains(OFFICE), 0).otherwise(hits(label, STRONG) * 100)
    return (first + strong + hits(near, WEAK) * 20 + hits(F.lower(label), URL_HINTS) * 5 - hits(near, AGAINST) * 30).cast("int")


def link_tier(text: Column | str, context: Column | str) -> Column:
    """0 is best; 10 is no notice."""
    label, both = collapse(text), F.concat_ws(" ", collapse(text), collapse(context))
    return (
        F.when(label == STRONG[0], 0).when(is_own_notice(label), 1).when(is_notice(label) & ~compact(label).contains(OFFICE), 2).when(is_own_notice(both), 3)
        .when(is_notice(both) & compact(both).contains(OFFICE), 9).when(is_notice(both), 4).otherwise(10)
    )


def feed_link(link: Column | str, feed: Column | str) -> Column:
    """A link of a feed as a whole URL of the feed's host; a first path segment that comes twice counts once; empty if it leads elsewhere."""
    v, scheme, place = strip(link), part(feed, 1), part(feed, 2)
    whole = F.when(v.startswith("//"), F.concat(scheme, F.lit(":"), v)).when(v.startswith("/"), F.concat(scheme, F.lit("://"), place, v)).when(v.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), v).otherwise(F.concat(scheme, F.lit("://"), v))
    host = lambda u: F.regexp_replace(F.lower(part(u, 2)), "^[^@]*@|:[0-9]+$", "")
    path = F.regexp_replace(part(whole, 3), "^/([^/]+)/\\1(?=/|$)", "/$1")
    fixed = F.concat(F.lower(part(whole, 1)), F.lit("://"), part(whole, 2), F.regexp_replace(path, "/+$", ""), F.when(part(whole, 4) == "?", "").otherwise(part(whole, 4)))
    return F.when((v == "") | v.isNull() | (part(whole, 2) == "") | (host(whole) != host(col(feed))), "").otherwise(fixed)


def homepage(c: Column | str) -> Column:
    """A URL with a scheme and no closing slash; empty for blanks and for schemes alone."""
    v = strip(c)
    bare = lambda u: F.regexp_replace(u, "/+$", "")
    known = v.rlike("^https?://")
    return (
        F.when(v.isNull() | v.isin("", "http:", "https:", "http://", "https://"), "").when(known, F.when(v.rlike("^https?://[^/?#]"), bare(v)).otherwise(""))
        .when(v.startswith("//"), bare(F.concat(F.lit("https:"), v))).when(~v.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), bare(F.concat(F.lit("https://"), v))).when(v.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"), bare(v)).otherwise("")
    )


def query_forms(c: Column | str) -> Column:
    """A school's name with its short ending also written out."""
    q = strip(c)
    cut = F.substring(q, F.lit(1), F.greatest(F.char_length(q) - 1, F.lit(0)))
    more = lambda end, full, tail: F.when(q.endswith(end) & ~q.endswith(full), F.array(F.concat(cut, F.lit(full)), F.concat(q, F.lit(tail)))).otherwise(F.array().cast("array<string>"))
    return F.when(q == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(q), more("초", "초등학교", "등학교"), more("중", "중학교", "학교"))))


def titles_meet(feed: Column, seen: Column) -> Column:
    """Whether a title of four characters or more, blanks left out, holds one of the other list or stands in it."""
    other = F.filter(F.transform(seen, compact), lambda x: x != "")
    return F.exists(F.filter(F.transform(feed, compact), lambda t: F.char_length(t) >= 4), lambda t: F.exists(other, lambda s: s.contains(t) | t.contains(s)))


NOTICE_HITS, RAW_HITS, ANNOUNCED, BOARD = STRONG, ("가정(학부모)통신문",), ("공지사항", "학교공지", "학교공지사항"), ("제목", "등록일", "작성자", "첨부파일", "조회수", "게시글", "게시물", "목록")
SEARCH, BROKEN = ("검색",), ("페이지 없음", "권한 없음", "로그인이 필요", "준비중", "오류가 발생", "잘못된 접근", "authReadError")


def page_check(c: Column | str) -> Column:
    """score and ok: whether URL, title and beginning of a page are those of a notice board."""
    t = col(c)
    tight = F.regexp_replace(t, BLANK + "+", "")
    notice, announced, board = hits(tight, NOTICE_HITS) + hits(t, RAW_HITS), hits(tight, ANNOUNCED), hits(t, BOARD)
    score = notice * 20 + announced * 10 + board * 10 + hits(t, SEARCH) * 5 - hits(t, BROKEN) * 20
    return F.struct(score.alias("score"), ((score > 0) & ((notice > 0) | (board >= 2) | ((announced > 0) & (board >= 1)))).alias("ok"))


ERRORS = (
    ("empty_or_unreadable", ("empty_or_unreadable",)), ("budget_exhausted", ("budget_exhausted",)), ("quota_exhausted", ("quota", "429", "resource_exhausted", "rate limit", "rate_limit")), ("permanent_not_found", ("404", "not found", "not_found")),
    ("unsupported_file", ("unsupported_or_spoofed_file", "unsupported_file_type", "unsupported_file", "file_type_check")), ("transient_network", ("timeout", "timed out", "connecterror", "readerror", "network", "content_fetch_failed", "download_failed")),
)


def error_class(c: Column | str) -> Column:
    return first_rule([(name, names_any(F.lower(col(c)), terms)) for name, terms in ERRORS], "internal_error")


# What a page of a log-in alone says, and what a board that anyone may read shows beside it.
LOGIN_ONLY, DATED = "로그인후이용", r"\b20[0-9]{2}[.\-/][0-9]{1,2}[.\-/][0-9]{1,2}\b"
OPEN_BOARD = ("게시판목록", "총", "작성일", "조회수", "등록일", "첨부파일", "selectboardlistajax", "fnview", "selectnttinfo", "boardcnts/view")
LOOKED_AT, LOGIN_LOOKED_AT = 500, 2_000


def access_failure(url: Column | str, status: Column | str, html: Column | str) -> Column:
    """Why a page may not be read, or null. Cues count in the URL, the title and the start of the text; what stands further below bars nothing."""
    u, h = F.lower(col(url)), F.lower(col(html))

    def barred(head: Column) -> Column:
        seen = F.lower(F.concat_ws(" ", u, head["title"], F.substring(head["snippet"], 1, LOOKED_AT)))
        compact = F.lower(F.regexp_replace(head["snippet"], BLANK + "+", ""))
        alone = compact.contains(LOGIN_ONLY) & ~head["snippet"].rlike(DATED) & ~names_any(compact, OPEN_BOARD)
        cues = seen.contains("authreaderror") | names_any(seen, ("게시판 접근 권한", "권한이 없습니다", "로그인이 필요", "비공개 설정된 글", "authorization required"))
        return F.coalesce(u.contains("mode=login") | (h.contains("loginpost.php") & h.contains("fm_xb_login")) | cues | alone, F.lit(False))

    barred = once(title_and_snippet(html, LOGIN_LOOKED_AT), barred)
    return first_rule([("unsupported_forbidden", col(status).isin(401, 403)), ("unsupported_external_dynamic", F.lower(part(url, 2)).contains("schoolbell-e.com")), ("unsupported_login_required", barred)])


def redirect_target(html: Column | str) -> Column:
    """Where a page of hardly any text and no named link sends its reader by script or refresh; null otherwise."""
    h = col(html)
    shown = collapse(F.regexp_replace(F.regexp_replace(h, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " "), "<[^>]*>", " "))
    named = h.rlike(r"(?is)<a\b[^>]*>\s*[^<\s]")
    head = r"(?i)(?:window|document|top|parent)?\.?location"
    found = [F.nullif(F.regexp_extract(h, head + tail, 1), F.lit("")) for tail in (r"(?:\.href)?\s*=\s*['\"]([^'\"]+)['\"]", r"\.replace\(\s*['\"]([^'\"]+)['\"]\s*\)", r"\.assign\(\s*['\"]([^'\"]+)['\"]\s*\)")]
    refresh = F.nullif(F.regexp_extract(h, r"(?i)<meta[^>]*http-equiv\s*=\s*[\"']?refresh[^>]*url\s*=\s*([^;\"'>]+)", 1), F.lit(""))
    return F.when((F.char_length(shown) <= 80) & ~named, strip(F.coalesce(*found, refresh)))


def row_score(text: Column | str, html: Column | str, in_chrome: Column) -> Column:
    """How much a table row looks like a post."""
    t, h = collapse(text), col(html)
    add = lambda holds, points: F.when(holds, points).otherwise(0)
    score = add(h.rlike(r"(?i)<a\b"), 20) + add(t.rlike(r"\b20[0-9]{2}[.\-/][0-9]{1,2}[.\-/][0-9]{1,2}\b"), 20) + add(names_any(t, ("작성자", "등록일", "조회", "첨부")), 15) + add(h.rlike(r"(?i)\sdata-[a-z]"), 10) + add(h.rlike(r"(?i)\sonclick\s*="), 10)
    score = score + add(F.substring(t, 1, 20).rlike("[0-9]"), 5) - add(in_chrome, 30) - add(names_any(t, ("급식", "식단", "갤러리", "사진", "일정", "달력", "로그인", "회원가입")), 10)
    return F.when(t == "", -10).otherwise(score)


BELL_WORDS, NOT_LINKS, SKIPPED = ("일과표", "일과 운영", "일과운영", "시정표", "등하교", "수업시간"), ("일시정지", "재생", "이전", "다음"), r"^(javascript:|#|mailto:|tel:)"


def bell_candidates(links: Column) -> Column:
    """text and url of links (text, href, url) that may lead to a timetable, each pair once; those whose words say so first, else in page order."""
    t = F.transform(links, lambda x: F.struct(collapse(x["text"]).alias("text"), strip(x["href"]).alias("href"), x["url"].alias("url")))
    fit = F.filter(t, lambda x: (x["text"] != "") & (x["href"] != "") & ~x["href"].rlike(SKIPPED) & ~names_any(x["text"], NOT_LINKS) & (F.char_length(x["text"]) <= 40))
    pairs = F.array_distinct(F.transform(fit, lambda x: F.struct(x["text"].alias("text"), x["url"].alias("url"))))
    ranked = F.array_sort(F.transform(pairs, lambda x, i: F.struct(F.when(names_any(x["text"], BELL_WORDS), 0).otherwise(1).alias("r"), i.alias("i"), x["text"].alias("text"), x["url"].alias("url"))))
    return F.transform(ranked, lambda x: F.struct(x["text"].alias("text"), x["url"].alias("url")))


def disposition_name(c: Column | str) -> Column:
    """The file name of a Content-Disposition header: the extended form first; unsafe characters replaced, 200 at most."""
    h = col(c)
    extended = F.regexp_extract(h, r"(?i)filename\*\s*=\s*[A-Za-z0-9\-]*''([^;]+)", 1)
    plain = F.regexp_extract(h, r"(?i)filename\s*=\s*\"?([^\";]+)", 1)
    named = F.when(extended != "", F.try_url_decode(F.replace(strip(extended), F.lit("+"), F.lit("%2B")))).otherwise(strip(plain))
    return F.nullif(F.substring(strip(F.regexp_replace(named, r"[\\/:*?\"<>|\x00-\x1F]", "_")), 1, 200), F.lit(""))


CLIENTS = (("kakaotalk", ("kakaotalk",), True), ("line", (" line/", " line "), True), ("naver", ("naver(inapp", "naver;"), True), ("daum", ("daumapps",), False), ("instagram", ("instagram",), False), ("facebook", ("fban", "fbav", "fb_iab"), False), ("other", ("; wv)",), False))


def in_app_client(c: Column | str) -> Column:
    """name of the app whose built-in browser a user agent is, null for none; and whether it can open another browser."""
    ua = F.lower(col(c))
    rules = [(name, names_any(ua, terms)) for name, terms, _ in CLIENTS]
    name = first_rule(rules)
    return F.struct(name.alias("name"), F.coalesce(name.isin(*[n for n, _, opens in CLIENTS if opens]), F.lit(False)).alias("opens"))


# What shows that a page has attachments, what one mark is worth, and how many characters count at most.
ATTACHMENT_MARKS = ("serverFileObj", "serverFileObjArray", "DEXT5UPLOAD.AddUploadedFile", "atchFileId", "fileSn", "fn_egov_downFile", "downFile.do", "파일첨부", "다운로드")
MARK_WORTH, PLAIN_MOST = 500, 5_000


def richness(html: Column | str, content_type: Column | str) -> Column:
    """How much an answer holds, by marks of attachments and by text; 0 for what is not HTML, null for null."""
    page, kind = col(html), F.lower(F.coalesce(col(content_type), F.lit("")))
    marks = sum((F.floor((F.char_length(page) - F.char_length(F.replace(page, F.lit(m), F.lit("")))) / len(m)) for m in ATTACHMENT_MARKS), F.lit(0))
    return F.when(page.isNull(), None).when(kind.contains("text/html"), marks * MARK_WORTH + F.least(F.char_length(strip(F.regexp_replace(page, "<[^>]+>", " "))), F.lit(PLAIN_MOST))).otherwise(0).cast("long")
