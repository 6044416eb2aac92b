"""Facts of a notice in a form that can be compared: dates, times, fees, contacts, URLs, grades; and their difference.

A fact is what its first filled field says (normalized, value, raw_text, text). Each function takes an array of
such texts and returns the distinct comparable values. What only a reader could compare (relative dates,
durations, names of offices, class labels) is left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.text import BLANK, col, strip

# Words and phrases that say that nothing is to be paid.
FREE = ("free", "free of charge", "no charge", "no cost", "0", "0 krw", "0krw", "0 won", "krw 0", "무료", "бесплатно", "бесплатный", "مجانا", "مجاني", "مجانية", "مجّانًا")
NO_COST = ("fully supported", "fully funded", "fully covered", "free of charge", "전액 지원", "전액지원", "무상")
#: Fields in the order of report; a value that only the output has counts in NEW_MATTERS.
FIELDS = ("dates", "times", "fees", "contacts", "urls", "grade_class_targets")
NEW_MATTERS = ("dates", "times", "fees", "contacts", "urls")
_W = "0-9A-Za-z_가-힣"
_S = BLANK
_GRADE_LISTS = (
    rf"grade:{_S}*([0-9]+)",
    rf"((?:[0-9]+{_S}*(?:st|nd|rd|th){_S}*[,/&]{_S}*|and{_S}*)*[0-9]+{_S}*(?:st|nd|rd|th)){_S}*grades?",
    rf"grades?{_S}*((?:[0-9]+{_S}*[,/&]{_S}*|and{_S}*|[0-9]+{_S}*)+)",
    rf"((?:[0-9]+{_S}*[,/&·]{_S}*)*[0-9]+){_S}*학년",
)


def fact_texts(facts: Column) -> Column:
    """The texts of an array of structs: of each the first field that is not null."""
    return F.transform(facts, lambda x: F.coalesce(x["normalized"], x["value"], x["raw_text"], x["text"], F.lit("")))


def normal(x: Column) -> Column:
    """Lower case, white space collapsed, wide colons and dashes made plain."""
    return F.translate(F.regexp_replace(F.lower(strip(x)), _S + "+", " "), "：–—", ":--")


def _distinct(values: Column, one: callable) -> Column:
    return F.array_distinct(F.flatten(F.transform(values, one)))


def _all(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def dates(values: Column) -> Column:
    """Whole calendar dates only."""
    return _distinct(values, lambda x: _all(x, rf"(?<![{_W}])[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?![{_W}])"))


def times(values: Column) -> Column:
    """Times of day as HH:MM."""
    found = lambda x: _all(x, rf"(?<![{_W}])[0-9]{{1,2}}:[0-9]{{2}}(?![{_W}])")
    good = lambda x: F.filter(found(x), lambda t: (F.split(t, ":")[0].cast("int") <= 23) & (F.split(t, ":")[1].cast("int") <= 59))
    return _distinct(values, lambda x: F.transform(good(x), lambda t: F.lpad(t, 5, "0")))


def url_list(x: Column) -> Column:
    """URLs with scheme and authority in lower case, without closing stops and slashes."""
    found = F.filter(F.transform(_all(x, r"https?://[^\s)>\]\"']+"), lambda u: F.regexp_replace(u, "[.,;]+$", "")), lambda u: u.rlike("^https?://[^/]+"))
    return F.transform(found, lambda u: F.concat(F.lower(F.regexp_extract(u, "^https?://[^/]+", 0)), F.regexp_replace(F.regexp_replace(u, "^https?://[^/]+", ""), "/+$", "")))


def phone_key(digits: Column) -> Column:
    """The national form of a number given with the country code 82."""
    rest = F.substring(digits, 3, 99)
    return F.when(digits.startswith("82"), F.when(rest.startswith("0"), rest).otherwise(F.concat(F.lit("0"), rest))).otherwise(digits)


def contacts(values: Column) -> Column:
    """Mail addresses, URLs and numbers of eight digits or more; names are not compared."""

    def one(x: Column) -> Column:
        mails = F.transform(_all(normal(x), r"[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}"), lambda m: F.concat(F.lit("email:"), m))
        digits = F.transform(_all(x, r"\+?[0-9][0-9\-\s().]{7,}[0-9]"), lambda p: F.regexp_replace(p, "[^0-9]", ""))
        return F.concat(mails, url_list(x), F.transform(F.filter(digits, lambda d: F.char_length(d) >= 8), lambda d: F.concat(F.lit("phone:"), phone_key(d))))

    return _distinct(values, one)


def urls(values: Column) -> Column:
    return _distinct(values, lambda x: F.when(F.size(url_list(x)) > 0, url_list(x)).when(normal(x) != "", F.array(normal(x))).otherwise(F.array().cast("array<string>")))


def fee(x: Column) -> Column:
    """free, amount:<number>, or the text where there is neither."""
    n = normal(x)
    digits = F.regexp_replace(n, "[^0-9]", "")
    bare = F.regexp_replace(digits, "^0+", "")
    no_cost = F.lit(False)
    for phrase in NO_COST:
        no_cost = no_cost | n.contains(phrase)
    return F.when(n.isin(*FREE) | no_cost | ((digits != "") & (bare == "")), "free").when(digits != "", F.concat(F.lit("amount:"), bare)).otherwise(n)


def fees(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, fee), lambda x: x != ""))


def grades(values: Column) -> Column:
    """grade:<n> for each grade named, in lists too; class labels are not grades."""

    def one(x: Column) -> Column:
        n = normal(x)
        named = F.flatten(F.array(*[F.flatten(F.transform(_all(n, p, 1), lambda y: _all(y, "[0-9]+"))) for p in _GRADE_LISTS]))
        found = F.when(F.size(named) > 0, named).when(n.rlike("^[0-9]+$"), F.array(n)).otherwise(F.array().cast("array<string>"))
        return F.transform(found, lambda g: F.concat(F.lit("grade:"), g))

    return _distinct(values, one)


NORMALIZERS = {"dates": dates, "times": times, "fees": fees, "contacts": contacts, "urls": urls, "grade_class_targets": grades}


def comparable(facts: Column) -> Column:
    """The comparable values of a struct of arrays of texts; deadlines count as dates, as either side may file a day under both."""
    pooled = {"dates": F.concat(F.coalesce(facts["dates"], F.array().cast("array<string>")), F.coalesce(facts["deadlines"], F.array().cast("array<string>")))}
    given = lambda f: pooled.get(f, F.coalesce(facts[f], F.array().cast("array<string>")))
    return F.struct(*[NORMALIZERS[f](given(f)).alias(f) for f in FIELDS])


def fact_issues(source: Column, out: Column, needs_mapping: Column | None = None, mapped: Column | None = None) -> Column:
    """Issues (field, issue, values) of two comparable structs in the order of FIELDS: missing, and new where that matters."""
    kind = "array<struct<field:string,issue:string,values:array<string>>>"
    parts = []
    for f in FIELDS:
        for issue, a, b in (("missing", source, out), ("new", out, source)):
            if issue == "missing" or f in NEW_MATTERS:
                gone = F.array_sort(F.array_except(a[f], b[f]))
                parts.append(F.when(F.size(gone) > 0, F.struct(F.lit(f).alias("field"), F.lit(issue).alias("issue"), gone.alias("values"))))
    if needs_mapping is not None:
        unmapped = needs_mapping & ~F.coalesce(mapped, F.lit(False))
        parts.append(F.when(unmapped, F.struct(F.lit("meal_and_allergy").alias("field"), F.lit("unmapped").alias("issue"), F.array().cast("array<string>").alias("values"))))
    return F.array_compact(F.array(*parts)).cast(kind)


def fact_verdict(issues: Column) -> Column:
    return F.when(F.size(issues) == 0, F.struct(F.lit("PASS").alias("verdict"), F.lit("none").alias("severity"))).otherwise(F.struct(F.lit("FAIL").alias("verdict"), F.lit("high").alias("severity")))


def merged_verdict(*verdicts: Column | str) -> Column:
    """FAIL if any of several checks fails."""
    return F.when(F.array_contains(F.array(*[col(v) for v in verdicts]), "FAIL"), "FAIL").otherwise("PASS")
