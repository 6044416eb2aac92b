"""Bells, meals and subjects: texts of school services as arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.dates import bell_periods
from gazette.functions.text import BLANK, col, once, strip

_S = BLANK
_TIME, _DASH = rf"([0-9]{{1,2}}){_S}*[:：]{_S}*([0-9]{{2}})", rf"{_S}*[~\-–—]{_S}*"
# How rows of a bell table are written; minutes after the last lesson, and between lessons that are not in the table.
PIPE_ROW = rf"(?m)^{_S}*([0-9]{{1,2}}){_S}*\|{_S}*{_TIME}{_S}*\|{_S}*{_TIME}{_S}*$"
NAMED_ROW = rf"([0-9]{{1,2}}){_S}*교시[^0-9]{{0,6}}{_TIME}{_DASH}{_TIME}"
HOMEROOM, EXTRA_GAP, LUNCH_AFTER = 10, 10, 4


def level_bells(name: Column | str) -> Column:
    """The usual periods of a school by what its name says of its level; elementary if it says nothing."""
    return F.when(col(name).contains("고등"), bell_periods("high")).when(col(name).contains("중학"), bell_periods("middle")).otherwise(bell_periods("elementary"))


def shifted(periods: Column, minutes: Column) -> Column:
    return F.transform(periods, lambda p: F.struct(p["period"].alias("period"), (p["start_min"] + minutes).alias("start_min"), (p["end_min"] + minutes).alias("end_min")))


def with_overrides(periods: Column, offset: Column, pause: Column, lunch: Column) -> Column:
    """Periods begun offset later, with other breaks and another lunch where these are not null; lessons keep their length."""
    return once(periods, lambda p: _overridden(p, offset, pause, lunch))


def _overridden(periods: Column, offset: Column, pause: Column, lunch: Column) -> Column:
    at = F.array_position(F.transform(periods, lambda p: p["period"]), LUNCH_AFTER).cast("int")
    lunch_at = F.when((at > 0) & (at < F.size(periods)), at).otherwise(-1)

    def step(done: Column, i: Column) -> Column:
        now, before = F.element_at(periods, i), F.element_at(periods, F.greatest(i - 1, F.lit(1)))
        gap = F.coalesce(F.when(lunch_at == i - 1, lunch).otherwise(pause), now["start_min"] - before["end_min"])
        start = F.when(i == 1, now["start_min"] + offset).otherwise(F.coalesce(F.element_at(done, -1)["end_min"], F.lit(0)) + gap)
        return F.concat(done, F.array(F.struct(now["period"].alias("period"), start.cast("int").alias("start_min"), (start + now["end_min"] - now["start_min"]).cast("int").alias("end_min"))))

    none = F.array().cast("array<struct<period:int,start_min:int,end_min:int>>")
    start = F.array(F.struct(F.lit(0).alias("period"), F.lit(0).alias("start_min"), F.lit(0).alias("end_min"))).cast("array<struct<period:int,start_min:int,end_min:int>>")
    laid = F.aggregate(F.sequence(F.lit(1), F.size(periods)), start, step, lambda d: F.slice(d, 2, 99))
    return F.when(F.size(periods) == 0, none).when(pause.isNull() & lunch.isNull(), shifted(periods, offset)).otherwise(laid)


def extended(periods: Column, last: Column) -> Column:
    """Periods up to last: those that the table lacks are as long as its last one, ten minutes apart."""
    return once(periods, lambda p: _extended(p, last))


def _extended(periods: Column, last: Column) -> Column:
    tail = F.element_at(periods, -1)
    long = tail["end_min"] - tail["start_min"]
    more = F.transform(F.sequence(F.lit(1), last - tail["period"]), lambda k: F.struct((tail["period"] + k).alias("period"), (tail["end_min"] + k * EXTRA_GAP + (k - 1) * long).alias("start_min"), (tail["end_min"] + k * (EXTRA_GAP + long)).alias("end_min")))
    return F.when((F.size(periods) == 0) | (last <= tail["period"]), periods).otherwise(F.concat(periods, more))


def dismissal(periods: Column, last: Column, offset: Column) -> Column:
    """Minutes of the day when school is out after period last; null if the table lacks it."""
    return F.get(F.filter(periods, lambda p: p["period"] == last), F.lit(0))["end_min"] + offset + HOMEROOM


def parsed_bells(c: Column | str) -> Column:
    """period, start, end of a text, in order of periods; rows with bars first, then those that name lessons; the first of a period counts."""
    fields = lambda p: [F.regexp_extract_all(col(c), F.lit(p), F.lit(k)) for k in range(1, 6)]
    two = lambda h, m: F.format_string("%02d:%s", h.cast("int"), m)
    rows = lambda f, back: F.transform(f[0], lambda x, i: F.struct(x.cast("int").alias("period"), (i + back).alias("at"), two(F.get(f[1], i), F.get(f[2], i)).alias("start"), two(F.get(f[3], i), F.get(f[4], i)).alias("end")))
    every = F.array_sort(F.concat(rows(fields(PIPE_ROW), F.lit(0)), rows(fields(NAMED_ROW), F.lit(10_000))))
    first = once(every, lambda e: F.filter(e, lambda x, i: (i == 0) | (F.get(e, i - 1)["period"] != x["period"])))
    return F.transform(first, lambda x: F.struct(x["period"].alias("period"), x["start"].alias("start"), x["end"].alias("end")))


def _br_lines(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(c), r"<br\s*/?>"), strip), lambda x: x != "")


def _codes(x: Column) -> Column:
    return F.transform(F.filter(F.split(x, r"\."), lambda y: y.rlike("^[0-9]+")), lambda y: F.regexp_extract(y, "^[0-9]+", 0).cast("int"))


def dishes(c: Column | str) -> Column:
    """name and allergens of each dish of a menu: `name (1.2.3)`, `name 1.2.` or `name*1.2.3`."""
    none = F.array().cast("array<int>")

    def one(x: Column) -> Column:
        pattern = rf"^(.+?){_S}*\(?([0-9.]+)\)?{_S}*$"
        name, codes = F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)
        star = F.split(x, r"\*")
        return F.when(codes.contains("."), F.struct(strip(name).alias("name"), _codes(codes).alias("allergens"))).when(
            F.size(star) == 2, F.struct(strip(star[0]).alias("name"), _codes(star[1]).alias("allergens"))
        ).otherwise(F.struct(x.alias("name"), none.alias("allergens")))

    return F.transform(_br_lines(c), one)


def labelled_lines(c: Column | str) -> Column:
    """label and value of lines `label: value` or `label - value`; the value is empty where there is none."""
    pattern = rf"^(.+?){_S}*[:\-]{_S}*(.+)$"
    return F.transform(_br_lines(c), lambda x: F.when(x.rlike(pattern), F.struct(strip(F.regexp_extract(x, pattern, 1)).alias("label"), strip(F.regexp_extract(x, pattern, 2)).alias("value"))).otherwise(F.struct(x.alias("label"), F.lit("").alias("value"))))


# Allergen codes and words of dishes that a diet forbids.
DIETS = {
    "halal": ((10,), "돼지|돈육|돈까스|돈가스|제육|햄|베이컨|소시지|소세지|순대|족발|보쌈|탕수육|라드|알코올|와인"),
    "no_pork": ((10,), "돼지|돈육|돈까스|돈가스|제육|햄|베이컨|소시지|소세지|순대|족발|보쌈|탕수육|라드"),
    "no_beef": ((16,), "소고기|쇠고기|牛|한우|우육|불고기|갈비|스테이크|비프|사골|육개장|설렁탕"),
    "vegetarian": ((7, 8, 9, 10, 15, 16, 17, 18), "고기|돼지|돈육|소고기|쇠고기|한우|우육|닭|치킨|오리|햄|베이컨|소시지|소세지|생선|고등어|명태|오징어|낙지|주꾸미|새우|게|조개|해물|어묵|떡갈비|탕수육|불고기|갈비"),
    "kosher": ((8, 9, 10, 18), "돼지|돈육|햄|베이컨|소시지|소세지|새우|게|조개|굴|홍합|전복|해물|갑각|오징어|낙지|주꾸미|알코올|와인"),
}


def diet_warnings(name: Column, allergens: Column, diets: Column) -> Column:
    """diet and by (allergen, or keyword) for each of the chosen diets that a dish goes against."""
    kinds = []
    for diet, (codes, words) in DIETS.items():
        by = F.when(F.arrays_overlap(allergens, F.array(*[F.lit(x) for x in codes])), "allergen").when(name.rlike(words), "keyword")
        kinds.append(F.struct(F.lit(diet).alias("diet"), by.alias("by")))
    found = F.array(*kinds)
    return F.filter(F.transform(diets, lambda d: F.get(F.filter(found, lambda x: x["diet"] == d), F.lit(0))), lambda x: x["by"].isNotNull())


# Short names of subjects, and level numerals.
SHORT_SUBJECTS = {"창체": "창의적 체험활동", "기가": "기술·가정", "물리": "물리학", "사문": "사회·문화", "생윤": "생활과 윤리", "확통": "확률과 통계", "중식": "점심", "자율학습": "자습", "진로와 직업": "진로"}
NUMERALS, PLAIN_NUMERALS = "ⅠⅡⅢⅣⅤ", ("I", "II", "III", "IV", "V")


def subject_key(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s·・∙ㆍ]", "")


def split_subject(c: Column | str) -> Column:
    """base and suffix (level) of a subject, and key: the full name of a short one, without separators. Precomposed letters are taken for granted."""
    t = strip(c)
    pattern = rf"^(.*?){_S}*([{NUMERALS}1-5])$"
    base, level = strip(F.regexp_extract(t, pattern, 1)), F.regexp_extract(t, pattern, 2)
    plain = F.coalesce(F.create_map(*[F.lit(x) for kv in zip(NUMERALS, PLAIN_NUMERALS, strict=True) for x in kv])[level], level)
    parts = F.when(base != "", F.struct(base.alias("base"), plain.alias("suffix"))).otherwise(F.struct(t.alias("base"), F.lit("").alias("suffix")))
    full = F.create_map(*[x for k, v in SHORT_SUBJECTS.items() for x in (subject_key(F.lit(k)), subject_key(F.lit(v)))])
    return once(parts, lambda p: F.struct(p["base"].alias("base"), p["suffix"].alias("suffix"), F.coalesce(full[subject_key(p["base"])], subject_key(p["base"])).alias("key")))
