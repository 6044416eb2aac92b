"""Cleaning of extracted notice texts: masks for what must not change, board lines, headings, links, spaces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.text import BLANK, col, lines, once, parts, strip

_S = BLANK
# What is masked, in this order, with the letter of its tokens; tables, lines that begin with a bar, come first.
MASKED = (
    ("E", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
    ("U", r"(?:https?://|www\.)[A-Za-z0-9./:_?=&%#@~+\-]+"),
    ("P", rf"0[0-9]{{1,2}}(?:[-)]|{_S})?[0-9]{{3,4}}(?:-|{_S})?[0-9]{{4}}"),
    ("M", r"[0-9]{1,2}:[0-9]{2}"),
    ("D", rf"[0-9]{{4}}{_S}*년{_S}*[0-9]{{1,2}}{_S}*월{_S}*[0-9]{{1,2}}{_S}*일(?:{_S}*\([월화수목금토일]\))?|[0-9]{{4}}{_S}*년{_S}*[0-9]{{1,2}}{_S}*월"
          rf"|[0-9]{{4}}{_S}*\.{_S}*[0-9]{{1,2}}{_S}*\.{_S}*[0-9]{{1,2}}{_S}*\.?(?:{_S}*\([월화수목금토일]\))?|[0-9]{{4}}[.\-/][0-9]{{1,2}}[.\-/][0-9]{{1,2}}|[0-9]{{1,2}}{_S}*월{_S}*[0-9]{{1,2}}{_S}*일"),
)
TOKEN = "⟦[TUEPMD][0-9]+⟧"
BOARD_LABELS = ("이름", "성명", "작성자", "작성일", "등록일", "게시일", "수정일", "조회수", "조회", "추천", "댓글", "좋아요")
SECTION = rf"^[◉□■▣◆●◇▪]{_S}*[^\s].{{0,38}}$"
SENTENCE_END = (".", "?", "!", "다", "요", "함", "음", "임", "됨", "죠", "까", "오")
BAD_IN_LINK = "→←↔[]<>「」『』※\"'｜|"


def _masked_tables(c: Column) -> Column:
    """text and store after each block of lines that begin with a bar has become one token."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("store"), F.lit(False).alias("inside"))

    def step(s: Column, line: Column) -> Column:
        bar = line.rlike(rf"^{_S}*\|")
        n = F.size(s["store"])
        last = F.get(s["store"], n - 1)
        grown = F.concat(F.slice(s["store"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n"), line)))
        token = F.concat(F.lit("⟦T"), n.cast("string"), F.lit("⟧"))
        return F.struct(
            F.when(bar & s["inside"], s["out"]).when(bar, F.concat(s["out"], F.array(token))).otherwise(F.concat(s["out"], F.array(line))).alias("out"),
            F.when(bar & s["inside"], grown).when(bar, F.concat(s["store"], F.array(line))).otherwise(s["store"]).alias("store"), bar.alias("inside"),
        )

    return F.aggregate(lines(c), start, step, lambda s: F.struct(F.array_join(s["out"], "\n").alias("text"), s["store"].alias("store")))


def _masked_kind(m: Column, kind: str, pattern: str) -> Column:
    """The matches of a pattern become tokens, numbered on from the store's size."""
    found, rest = F.regexp_extract_all(m["text"], F.lit(pattern), F.lit(0)), parts(m["text"], pattern)
    n = F.size(m["store"])
    text = F.array_join(F.transform(rest, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(f"⟦{kind}"), (n + i - 1).cast("string"), F.lit("⟧"), x))), "")
    return F.struct(text.alias("text"), F.concat(m["store"], found).alias("store"))


def _masking(kind: str, pattern: str) -> Callable[[Column], Column]:
    return lambda m: _masked_kind(m, kind, pattern)


def mask(c: Column | str) -> Column:
    """text with tokens for tables, mail addresses, URLs, phone numbers, times and dates; store: what each stands for, by its number."""
    out = _masked_tables(col(c))
    for kind, pattern in MASKED:
        out = once(out, _masking(kind, pattern))
    return once(out, lambda m: F.struct(m["text"].alias("text"), m["store"].alias("store"), F.transform(F.sequence(F.lit(1), F.size(m["store"])), lambda i: F.call_function("regexp_extract", m["text"], F.concat(F.lit("⟦([TUEPMD])"), (i - 1).cast("string"), F.lit("⟧")), F.lit(1))).alias("kinds")))


def unmask(text: Column | str, store: Column, kinds: Column) -> Column:
    """text with the tokens read back; what an edit has dropped is added at the end: tables, then the rest as a list."""
    key = lambda i: F.concat(F.lit("⟦"), F.get(kinds, i), i.cast("string"), F.lit("⟧"))
    every = F.filter(F.transform(store, lambda _, i: i), lambda i: i >= 0)
    back = F.aggregate(every, col(text), lambda t, i: F.replace(t, key(i), F.get(store, i)))
    lost = F.filter(every, lambda i: ~col(text).contains(key(i)))
    values = lambda tables: F.transform(F.filter(lost, lambda i: (F.get(kinds, i) == "T") == F.lit(tables)), lambda i: F.get(store, i))
    tables, rest = values(True), values(False)
    more = F.concat(
        F.when(F.size(tables) > 0, F.concat(F.lit("\n\n"), F.array_join(tables, "\n\n"))).otherwise(""),
        F.when(F.size(rest) > 0, F.concat(F.lit("\n\n## 관련 정보\n"), F.array_join(F.transform(rest, lambda x: F.concat(F.lit("- "), x)), "\n"))).otherwise(""),
    )
    return F.regexp_replace(F.concat(back, more), TOKEN, "")


def light_clean(c: Column | str) -> Column:
    """Image links, captions of image sizes and names, placeholders, page numbers, tokens and runs of blank lines removed."""
    t = col(c)
    for pattern in (r"!\[[^\]]*\]\([^)]*\)", r"원본 그림의 크기[:：][^\n]*?[0-9]+[ \t]*pixel(?:[^\n]*?[0-9]+[ \t]*pixel)?", rf"원본 그림의 이름[:：]{_S}*[^\s]+", r"\*\*==>[^\n]*?<==\*\*", r"(?m)^[ \t]*-[ \t]*[0-9]+[ \t]*-[ \t]*$", TOKEN):
        t = F.regexp_replace(t, pattern, "")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def without_board_lines(c: Column | str) -> Column:
    """Lines that say who posted when and how often it was read, without them; a label alone takes the next line with it."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("skip"))
    labels = "|".join(BOARD_LABELS)

    def step(s: Column, line: Column) -> Column:
        def judged(bare: Column) -> Column:
            meta = (F.char_length(bare) <= 40) & bare.rlike(rf"^{_S}*(?:{labels})(?:{_S}*[:：]|{_S}+){_S}*[^\s]")
            return F.struct((bare.isin(*BOARD_LABELS) & ~s["skip"]).alias("label"), meta.alias("meta"))

        told = once(F.regexp_replace(strip(line), rf"^[-*•·]{_S}+", ""), judged)
        return once(told, lambda x: F.struct(F.when(s["skip"] | x["label"] | x["meta"], s["kept"]).otherwise(F.concat(s["kept"], F.array(line))).alias("kept"), x["label"].alias("skip")))

    return strip(F.regexp_replace(F.aggregate(lines(c), start, step, lambda s: F.array_join(s["kept"], "\n")), "\n{3,}", "\n\n"))


def with_headings(c: Column | str) -> Column:
    """Short lines that begin with a section mark and are no sentence become third-level headings."""

    def one(line: Column) -> Column:
        bare = strip(line)
        sentence = F.lit(False)
        for end in SENTENCE_END:
            sentence = sentence | bare.endswith(end)
        return F.when(bare.rlike(SECTION) & ~sentence, F.concat(F.lit("### "), bare)).otherwise(line)

    return F.array_join(F.transform(lines(c), one), "\n")


def squeezed(c: Column | str) -> Column:
    """Runs of three spaces or more within a line as one; tables and indents stay."""

    def one(line: Column) -> Column:
        bare = F.ltrim(line)
        indent = F.substring(line, F.lit(1), F.char_length(line) - F.char_length(bare))
        return F.when(line.rlike(rf"^{_S}*\|"), line).when(bare == "", "").otherwise(F.regexp_replace(F.concat(indent, F.regexp_replace(bare, " {3,}", " ")), rf"{_S}+$", ""))

    return F.array_join(F.transform(lines(c), one), "\n")


_LINK = r"\[([^\]]*?)\]\(\s*([^)]*?)\s*\)"


def sound_links(c: Column | str) -> Column:
    """Markdown links whose target cannot be one are undone: the label stays, or the target where the label is blank."""
    t = col(c)

    def fixed(link: Column) -> Column:
        return once(F.struct(link.alias("link"), F.regexp_extract(link, _LINK, 1).alias("label"), F.regexp_extract(link, _LINK, 2).alias("url")), lambda x: sound(x["link"], x["label"], x["url"]))

    def sound(link: Column, label: Column, url: Column) -> Column:
        starts = F.lit(False)
        for head in ("http://", "https://", "mailto:", "tel:", "www.", "/", "#"):
            starts = starts | url.startswith(head)
        bad = url.rlike(r"[\s가-힣㄰-㆏]") | (F.translate(url, BAD_IN_LINK, "") != url) | (F.char_length(url) > 2000)
        good = starts & ~bad & ~label.contains("\n") & ~label.contains("[")
        clean = strip(F.regexp_replace(F.regexp_replace(label, r"\s+", " "), r"\s*#{1,6}\s*", " "))
        return F.when(good, link).otherwise(once(clean, lambda c: F.when(c != "", c).otherwise(url)))

    found = F.transform(F.regexp_extract_all(t, F.lit(_LINK), F.lit(0)), fixed)
    return once(found, lambda f: F.array_join(F.transform(parts(t, _LINK), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.get(f, i - 1), x))), ""))


def links_of(c: Column | str) -> Column:
    """URLs and mail addresses of a source, those written together apart, closing signs and field names of the word processor cut off."""
    runs = F.flatten(F.transform(F.regexp_extract_all(col(c), F.lit(MASKED[1][1]), F.lit(0)), lambda x: F.when(F.locate("http", x, 2) > 0, F.split(x, "(?=https?://)")).otherwise(F.array(x))))
    urls = F.transform(runs, lambda x: F.regexp_replace(F.regexp_replace(x, "(?s)HWP[A-Z_]{4,}.*", ""), r"[.,)】\] ]+$", ""))
    mails = F.transform(F.regexp_extract_all(col(c), F.lit(MASKED[0][1]), F.lit(0)), lambda x: F.regexp_replace(F.regexp_replace(x, ".*HWP[A-Z_]{4,}", ""), r"[.,)】\] ]+$", ""))
    return F.array_distinct(F.concat(F.filter(urls, lambda x: (F.char_length(x) > 7) & x.rlike(r"^(?:https?://|www\.)")), F.filter(mails, lambda x: x.contains("@") & (F.char_length(x) > 5))))


def with_links(out: Column | str, source: Column | str) -> Column:
    """out, with the links of source that it lacks listed at the end."""
    lost = F.array_sort(F.filter(links_of(source), lambda x: ~col(out).contains(x)))
    return F.concat(col(out), once(lost, lambda x: F.when(F.size(x) > 0, F.concat(F.lit("\n\n## 관련 링크\n"), F.array_join(F.transform(x, lambda y: F.concat(F.lit("- "), y)), "\n"))).otherwise("")))
