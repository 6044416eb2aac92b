"""Judgements on single values in their context: dates of administration, forbidden things, foreign texts; repair of model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.links import first_rule, names_any
from gazette.functions.notices import yearless_dates
from gazette.functions.text import BLANK, KEPT, col, lines, once, spaced, strip

_S = BLANK
# Words about a date that say that it is one of administration, or one of a schedule; who signs; what may not be brought.
ADMIN = ("작성일", "등록일", "등록일시", "게시일", "게시일시", "게시기간", "수정일", "수정일시", "최종수정일", "배부일", "공지일", "발행일", "업로드일", "업로드일시", "조회수", "댓글", "문의일자", "문서번호", "첨부일", "첨부일자")
SCHEDULE = ("행사", "실시", "운영", "참여", "검사", "시험", "등교", "하교", "방문", "체험학습", "수학여행", "캠프", "설문", "조사", "신청", "제출", "마감", "납부", "회신", "대회", "설명회", "훈련", "공연", "발표")
SIGNERS = ("학교장", "교장", "원장")
MEAL, FEES = ("식단", "급식", "알레르기", "메뉴"), ("납부", "수납", "스쿨뱅킹", "계좌", "회비", "참가비")
CONSENT, URGENT = ("동의서", "서명", "신청서", "제출", "회신"), ("긴급", "즉시", "안전", "주의", "폭염", "감염")
FORBIDDEN = ("금지물품", "반입금지", "소지금지", "소지불가", "지참금지", "가져오지마세요", "소지또는사용할수없는물품", "사용할수없는물품", "소지하여서는안된다", "위험물품")


def tight(c: Column) -> Column:
    return F.regexp_replace(c, _S + "+", "")


def date_spellings(c: Column, year: int) -> Column:
    """A date as given, and if it can be read, in the other ways in which a text may write it; white space left out."""
    exact = c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    iso = F.when(exact, F.array(c)).otherwise(yearless_dates(c, year))
    number = lambda x, k: F.split(x, "-")[k].cast("int").cast("string")
    ways = lambda x: F.array(x, F.concat(F.translate(x, "-", "."), F.lit(".")), F.concat(number(x, 0), F.lit("."), number(x, 1), F.lit("."), number(x, 2), F.lit(".")), F.concat(number(x, 0), F.lit("년"), number(x, 1), F.lit("월"), number(x, 2), F.lit("일")))
    return F.filter(F.array_distinct(F.concat(F.array(tight(c)), F.flatten(F.transform(iso, ways)))), lambda x: x != "")


def is_admin_date(value: Column | str, source: Column | str, year: int) -> Column:
    """Whether each place where a text has the date is one of administration or before a signature, and there is one.

    A place counts only if no digit touches it. About it 40 characters each way are looked at, 24 for who signs; white
    space is left out. A place between words of a schedule is none of administration.
    """

    def places(t: Column, token: Column) -> Column:
        rest = F.call_function("split", t, F.concat(F.lit("\\Q"), token, F.lit("\\E")), F.lit(-1))
        near = F.transform(F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0))), lambda before, i: F.struct(before.alias("before"), F.call_function("array_join", F.slice(rest, i + 2, F.size(rest)), token).alias("after")))
        # what stands before a place is all parts up to it
        whole = F.transform(near, lambda x, i: F.struct(F.call_function("array_join", F.slice(rest, F.lit(1), i + 1), token).alias("before"), x["after"].alias("after")))
        return F.filter(whole, lambda x: ~x["before"].rlike("[0-9]$") & ~x["after"].rlike("^[0-9]"))

    def admin(x: Column, token: Column) -> Column:
        about = F.concat(F.substring(x["before"], F.greatest(F.char_length(x["before"]) - 39, F.lit(1)), F.lit(40)), token, F.substring(x["after"], 1, 40))
        return names_any(F.substring(x["after"], 1, 24), SIGNERS) | (names_any(about, ADMIN) & ~names_any(about, SCHEDULE))

    judged = lambda t: F.flatten(F.transform(date_spellings(col(value), year), lambda token: F.transform(places(t, token), lambda x: admin(x, token))))
    return once(tight(col(source)), lambda t: once(judged(t), lambda all_: (F.size(all_) > 0) & F.forall(all_, lambda x: x)))


def is_forbidden(value: Column | str, source: Column | str) -> Column:
    """Whether the first place of a thing in a text, white space left out, has words within 60 characters that forbid it."""
    v, t = tight(col(value)), tight(col(source))
    at = F.call_function("instr", t, v)
    about = F.substring(t, F.greatest(at - 60, F.lit(1)), F.char_length(v) + F.least(at - 1, F.lit(60)) + 60)
    return F.coalesce((v != "") & (at > 0) & names_any(about, FORBIDDEN), F.lit(False))


def is_foreign(c: Column | str) -> Column:
    """Latin letters and no Hangul, where neither a URL nor a bare number, date or sum."""
    t = strip(c)
    neutral = t.rlike(rf"^(?:[0-9:/~.,()\-+%#]|{_S})+$") | t.rlike(r"^(?:https?://|www\.)")
    return F.coalesce((t != "") & ~t.rlike("[가-힣]") & ~neutral & t.rlike("[A-Za-z]"), F.lit(False))


def repaired_json(c: Column | str) -> Column:
    """The object within a model's answer with lone backslashes doubled; null if there are no braces."""
    inner = F.nullif(F.regexp_extract(col(c), r"(?s)\{.*\}", 0), F.lit(""))
    return F.regexp_replace(inner, r"(?<!\\)((?:\\\\)*)\\(?!u[0-9a-fA-F]{4}|[\"\\/bfnrt])", r"$1\\\\")


def _parsed(text: Column, control_characters: bool) -> Column:
    """VARIANT of a text that is one JSON value and nothing else, or null: as the only element of an array."""
    array = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "variant", {"allowUnquotedControlChars": str(control_characters).lower()})
    return F.when(F.try_variant_get(array, "$[1]", "variant").isNull(), F.try_variant_get(array, "$[0]", "variant"))


def answer_object(c: Column | str) -> Column:
    """The object of a model's answer as compact JSON, keys by name: the answer as it is, else what its outer braces hold, else that with lone backslashes doubled. Null where that is no object."""
    inner = F.nullif(F.regexp_extract(col(c), r"(?s)\{.*\}", 0), F.lit(""))
    found = F.coalesce(_parsed(col(c), False), _parsed(inner, True), _parsed(repaired_json(c), True))
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), F.to_json(found))


def corpus_tags(c: Column | str) -> Column:
    """kind, length, facts, tone, time and sensitivity of a text for a corpus."""
    t, n = col(c), F.char_length(col(c))
    kind = first_rule([("meal-menu", names_any(t, MEAL)), ("event-consent-form", names_any(t, CONSENT)), ("safety-notice", names_any(t, URGENT))], "general-notice")
    facts = first_rule([("meal-heavy", names_any(t, MEAL)), ("date-and-fee-heavy", names_any(t, FEES)), ("action-heavy", names_any(t, CONSENT))], "low")
    return F.struct(
        kind.alias("kind"), F.when(n < 600, "short").when(n < 1600, "medium").otherwise("long").alias("length"), facts.alias("fact_density"), F.when(names_any(t, URGENT), "urgent").otherwise("routine").alias("tone"),
        F.when(t.rlike(rf"[0-9]{{1,2}}{_S}*월{_S}*[0-9]{{1,2}}{_S}*일"), "absolute-dates").otherwise("no-deadline").alias("time_reference"), F.when(t.contains("알레르기"), "critical-allergen").otherwise("neutral").alias("cultural_sensitivity"),
    )


def slug(title: Column | str, fallback: Column, cut: int = 32) -> Column:
    bare = F.lower(F.array_join(F.regexp_extract_all(F.coalesce(col(title), F.lit("")), F.lit(KEPT), F.lit(0)), "-"))
    return F.regexp_replace(F.coalesce(F.nullif(F.substring(bare, 1, cut), F.lit("")), fallback), "^-+|-+$", "")


def error_line(c: Column | str, cut: int = 800) -> Column:
    """An error's text on one line."""
    return F.substring(strip(spaced(c)), 1, cut)


def clean_lines(c: Column | str, noise: tuple[str, ...]) -> Column:
    """Lines with white space collapsed, without blank ones and those of noise (in lower case)."""
    each = F.transform(lines(F.translate(col(c), "\r", "\n")), lambda x: strip(F.regexp_replace(x, _S + "+", " ")))
    return F.array_join(F.filter(each, lambda x: (x != "") & ~F.lower(x).isin(*noise)), "\n")


def collapsed_tables(c: Column | str) -> Column:
    """Tables that only lay text out (no row of more than two filled cells, and two cells in five blank or one filled at most) as lines of text and a blank one."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("block"))

    def cells(line: Column) -> Column:
        return F.transform(F.split(F.regexp_replace(strip(line), r"^\|+|\|+$", ""), r"\|"), strip)

    def ended(s: Column) -> Column:
        rows = F.filter(s["block"], lambda x: ~(x.rlike(rf"^{_S}*\|[-|:\s]+\|{_S}*$") & x.contains("-")))
        read = once(F.transform(rows, cells), lambda all_: F.struct(F.aggregate(all_, F.lit(0), lambda a, x: a + F.size(x)).alias("total"), F.transform(all_, lambda x: F.filter(x, lambda y: y != "")).alias("filled")))
        return F.when(F.size(s["block"]) == 0, s["out"]).otherwise(once(read, lambda r: F.concat(s["out"], laid(s["block"], r["total"], r["filled"]))))

    def laid(block: Column, total: Column, filled: Column) -> Column:
        full = F.aggregate(filled, F.lit(0), lambda a, x: a + F.size(x))
        widest = F.coalesce(F.array_max(F.transform(filled, F.size)), F.lit(0))
        layout = (widest <= 2) & (((total - full) * 5 >= F.greatest(total, F.lit(1)) * 2) | (widest <= 1))
        flat = F.concat(F.transform(F.filter(filled, lambda x: F.size(x) > 0), lambda x: F.array_join(x, " ")), F.array(F.lit("")))
        return F.when(layout, flat).otherwise(block)

    def step(s: Column, line: Column) -> Column:
        bar = line.rlike(rf"^{_S}*\|")
        return F.struct(F.when(bar, s["out"]).otherwise(F.concat(ended(s), F.array(line))).alias("out"), F.when(bar, F.concat(s["block"], F.array(line))).otherwise(F.array().cast("array<string>")).alias("block"))

    return F.aggregate(lines(c), start, step, lambda s: F.array_join(ended(s), "\n"))
