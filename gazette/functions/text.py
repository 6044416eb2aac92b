"""Text functions: columns in, columns out. Character classes are spelled out, as engines differ on \\s and \\d."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and terms that scores depend on. BLANK is all that counts as white space, WHITE the same as characters.
BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WHITE = "".join(chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
HANGUL = "[가-힣]"
KEPT = "[0-9A-Za-z가-힣]+"
TOKEN = "[0-9A-Za-z가-힣]{2,}"
DATE = rf"(?:20[0-9]{{2}}[.\-/년]{BLANK}*[0-9]{{1,2}}[.\-/월]{BLANK}*[0-9]{{1,2}}|(?:[0-9]{{1,2}}[./][0-9]{{1,2}}))"
PHONE = r"(?:0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}|1[0-9]{2}|117)"
MONEY = rf"[0-9][0-9,]*{BLANK}*원"
ACTION = "제출|신청|동의|납부|참여|작성|회신|응답|지참"
DOMAIN = "가정통신문|안내|학부모|학생"
SPACE = BLANK + "+"
NUMBER = "[0-9]{1,3}(?:[,.\u00a0 ][0-9]{3})+|[0-9]+"
#: Every digit of every script, superscripts and the like included, and the ASCII digit of its value.
FOREIGN_DIGITS = "".join(c for c in map(chr, range(128, 0x110000)) if c.isdigit())
ASCII_DIGITS = "".join(str(unicodedata.digit(c)) for c in FOREIGN_DIGITS)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def composed(c: Column | str) -> Column:
    """Text in Unicode's form NFC: letters with marks, and Hangul, as one code point each. Texts go to workers in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    return run(col(c))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed a single time however often it is used."""
    return F.transform(F.array(value), use)[0]


#: A private character that stands for a match while a text is cut.
CUT = "\ue000"


def parts(c: Column | str, pattern: str) -> Column:
    """What lies between the matches of a pattern, empty ends included.

    Spark compiles the pattern of a split for every text and that of a replacement once, so matches become one
    character at which the text is split; a text that holds this character is split by the pattern itself.
    """
    t = col(c)
    return F.when(t.contains(CUT), F.split(t, pattern, -1)).otherwise(F.split(F.regexp_replace(t, pattern, CUT), CUT, -1))


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITE))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def first_non_blank(*cs: Column | str) -> Column:
    """The first that holds more than white space, trimmed."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def spaced(c: Column | str) -> Column:
    """Runs of white space as one space. Texts of ASCII alone are read by a class of ASCII alone, which is far faster."""
    t = col(c)
    return F.when(F.octet_length(t) == F.char_length(t), F.regexp_replace(t, r"[\x09-\x0D\x1C-\x20]+", " ")).otherwise(F.regexp_replace(t, SPACE, " "))


def collapse(c: Column | str) -> Column:
    """Runs of white space, no-break spaces included, as one space; trimmed."""
    return F.trim(F.regexp_replace(col(c), SPACE, " "))


def round_half_up(c: Column, digits: int) -> Column:
    scale = F.lit(float(10**digits))
    return F.floor(c * scale + F.lit(0.5)).cast("double") / scale


def kept_runs(c: Column | str) -> Column:
    """The runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(KEPT), F.lit(0))


def kept_text(c: Column | str) -> Column:
    """The letters and digits. Runs are joined, as cutting out all else by a negated class takes several times as long."""
    return F.array_join(kept_runs(c), "")


def hashed(kept: Column) -> Column:
    """Twenty hex digits of the SHA-1 of a kept text; empty if that is."""
    return once(kept, lambda k: F.when(k == "", "").otherwise(F.substring(F.sha1(k.cast("binary")), 1, 20)))


def fingerprint(c: Column | str) -> Column:
    """Twenty hex digits of the SHA-1 of the letters and digits; empty where there are none."""
    return hashed(kept_text(c))


def tokens(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit(TOKEN), F.lit(0)))


def tokens_of_runs(runs: Column) -> Column:
    """The tokens of a text by its ``kept_runs``."""
    return F.filter(F.array_distinct(runs), lambda x: F.char_length(x) >= 2)


def _letters(t: Column, whole: Column, script: str) -> Column:
    """How many characters of t are of a class: of a small one by translation, else by cutting out the runs of all others."""
    members = [chr(c) for c in range(0x250) if re.match(script, chr(c))]
    if members and not re.match(script, "가"):
        return whole - F.char_length(F.translate(t, "".join(members), ""))
    return F.char_length(F.regexp_replace(t, f"[^{script[1:-1]}]+", ""))


def text_quality(c: Column | str, scripts: dict[str, str], confidence: Column | None = None) -> Column:
    """For each named class of letters a struct of score and low.

    score, 0 to 100: length, share of the script, dates, phones, money, action and domain terms, less broken
    characters. low: hardly any text, or a score under 12. The text is read once for each pattern.
    """
    bonus = lambda found, points: F.when(found, points).otherwise(0.0)
    names_one = lambda t, terms: reduce(or_, [t.contains(x) for x in terms.split("|")])

    def measured(t: Column) -> Column:
        terms = bonus(t.rlike(DATE), 8.0) + bonus(t.rlike(PHONE), 6.0) + bonus(t.rlike(MONEY), 6.0) + bonus(names_one(t, ACTION), 10.0) + bonus(names_one(t, DOMAIN), 10.0)
        whole = F.char_length(t)
        broken = whole - F.char_length(F.replace(t, F.lit("\ufffd"), F.lit("")))
        letters = [_letters(t, whole, script).alias(name) for name, script in scripts.items()]
        return F.struct(whole.cast("double").alias("n"), terms.alias("terms"), broken.cast("double").alias("broken"), *letters)

    def scored(m: Column, name: str) -> Column:
        n, safe = m["n"], F.greatest(m["n"], F.lit(1.0))
        score = F.least(n / 2000.0, F.lit(1.0)) * 30.0 + F.least(m[name].cast("double") / safe / 0.45, F.lit(1.0)) * 25.0 + m["terms"]
        if confidence is not None:
            score = score + F.greatest(F.lit(0.0), F.least(confidence, F.lit(1.0))) * 10.0
        score = score - F.least(m["broken"] / safe / 0.03, F.lit(1.0)) * 20.0
        whole = F.when(n == 0, 0.0).otherwise(round_half_up(F.greatest(F.lit(0.0), F.least(score, F.lit(100.0))), 2))
        return once(whole, lambda x: F.struct(x.alias("score"), ((n < 20) | ((m[name] < 10) & (n < 200)) | (x < 12)).alias("low")))

    return once(strip(c), lambda t: once(measured(t), lambda m: F.struct(*[scored(m, name).alias(name) for name in scripts])))


def quality_score(c: Column | str, script: str = HANGUL, confidence: Column | None = None) -> Column:
    return text_quality(c, {"q": script}, confidence)["q"]["score"]


def is_low_quality(c: Column | str, script: str = HANGUL) -> Column:
    return text_quality(c, {"q": script})["q"]["low"]


def ascii_digits(c: Column | str) -> Column:
    return F.translate(col(c), FOREIGN_DIGITS, ASCII_DIGITS)


def significant_numbers(c: Column | str) -> Column:
    """Distinct numbers of four digits or more, separators of thousands and leading zeros removed."""
    raw = F.regexp_extract_all(ascii_digits(c), F.lit(NUMBER), F.lit(0))
    digits = F.transform(raw, lambda x: F.regexp_replace(x, "[^0-9]", ""))
    long = F.filter(digits, lambda x: F.char_length(x) >= 4)
    return F.array_distinct(F.transform(long, lambda x: F.when(x.rlike("^0+$"), "0").otherwise(F.regexp_replace(x, "^0+", ""))))


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n")


def _bare(x: Column) -> Column:
    """A trimmed line under 12 characters that neither starts as a list item nor ends as a sentence."""
    return (F.char_length(x) < 12) & ~x.rlike(r"^[#\-|*※☎○•□>]") & ~x.rlike(r"[.!?:)）」』\]]$")


def fragment_ratio(c: Column | str) -> Column:
    """Share of bare lines among those that are not blank."""
    filled = F.filter(F.transform(lines(c), strip), lambda x: x != "")
    return once(filled, lambda f: F.when(F.size(f) == 0, 0.0).otherwise(F.size(F.filter(f, _bare)).cast("double") / F.size(f).cast("double")))


def quality_gate(c: Column | str, script: str = HANGUL, limit: float = 0.40) -> Column:
    """Whether the source file is needed, and why: a flattened dump, a nested table, or low quality; with the signals.

    A heading is a line that begins with #, a table a line of nothing but bars, dashes and colons.
    """
    divider = lambda x: x.rlike(r"^\|[-|: \t]+\|$") & x.contains("-")
    filled = F.filter(F.transform(lines(c), strip), lambda x: x != "")

    def signals(f: Column) -> Column:
        return F.struct(
            F.size(F.filter(f, lambda x: x.startswith("#"))).alias("headings"), F.size(F.filter(f, divider)).alias("tables"),
            round_half_up(F.size(F.filter(f, _bare)).cast("double") / F.greatest(F.size(f), F.lit(1)).cast("double"), 3).alias("fragment_ratio"),
            F.exists(f, lambda x: x.startswith("|") & ~divider(x) & x.rlike(r"\|[ \t]*:?-{3,}:?[ \t]*\|")).alias("nested_table"), is_low_quality(c, script).alias("low_quality"),
        )

    def judged(g: Column) -> Column:
        flat = (g["headings"] == 0) & (g["tables"] == 0) & (g["fragment_ratio"] > limit)
        reasons = F.array_compact(F.array(F.when(flat, "flattened"), F.when(g["nested_table"], "nested_table"), F.when(g["low_quality"], "low_quality")))
        return F.struct((flat | g["nested_table"] | g["low_quality"]).alias("needs_file"), reasons.alias("reasons"), *[g[x].alias(x) for x in ("headings", "tables", "fragment_ratio", "nested_table", "low_quality")])

    return once(filled, lambda f: once(signals(f), judged))


# Fixed value: one cell that comes four times or more in a row.
REPEATED_CELL = r"(\|[^|\n]*[가-힣A-Za-z0-9]{2,}[^|\n]*)\1{3,}"


def gate_signals(c: Column | str, tag: Column | str) -> Column:
    """What a gate tells besides its reasons: the tag, whether that is a fallback, characters, the share of empty cells in rows of tables, and whether cells repeat. None of them asks for the source file by itself."""
    t = col(c)
    rows = F.filter(F.transform(lines(t), strip), lambda x: x.startswith("|") & ~(x.rlike(r"^\|[-|: \t]+\|$") & x.contains("-")))
    cells = F.flatten(F.transform(rows, lambda x: F.split(F.btrim(x, F.lit("|")), r"\|")))
    share = lambda z: F.when(F.size(z) == 0, 0.0).otherwise(round_half_up(F.size(F.filter(z, lambda x: strip(x) == "")).cast("double") / F.size(z).cast("double"), 3))
    return F.struct(col(tag).alias("tag"), (col(tag) == "FALLBACK").alias("fallback"), F.char_length(t).alias("chars"), once(cells, share).alias("table_empty_ratio"), t.rlike(REPEATED_CELL).alias("repeat_junk"))


def degenerate(out: Column | str, source: Column | str) -> Column:
    """Runs of 30 spaces, or far longer than the source."""
    n = F.char_length(col(source)).cast("double")
    return col(out).rlike(" {30,}") | (F.char_length(col(out)).cast("double") > n * F.when(n > 4000, 1.6).otherwise(2.6) + 400.0)


def redact(c: Column | str) -> Column:
    """Keys and bearer tokens masked; 400 characters at most."""
    t = F.regexp_replace(col(c), r"(?i)(key|token|authorization)=[^&\s]+", "$1=***")
    return F.substring(F.regexp_replace(t, r"(?i)bearer [A-Za-z0-9._\-]+", "bearer ***"), 1, 400)


def first_line_title(c: Column | str, cut: int = 120) -> Column:
    """The first line that is not blank, without list and heading marks."""
    bare = F.transform(lines(c), lambda x: F.regexp_replace(x, r"^[#*\-•> \t]+|[#*\-•> \t\r]+$", ""))
    return F.substring(F.try_element_at(F.filter(bare, lambda x: x != ""), F.lit(1)), 1, cut)


def bucket31(c: Column | str, modulus: int = 1 << 32) -> Column:
    """h * 31 + code point, modulo 2**32, over the characters."""
    points = F.transform(F.filter(F.split(col(c), ""), lambda x: x != ""), F.ascii)
    return F.aggregate(points, F.lit(0).cast("long"), lambda h, x: F.pmod(h * 31 + x, F.lit(modulus)))
