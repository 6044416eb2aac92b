"""Records that come from people, scripts and models: read, checked, bounded; what does not pass is left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.review import is_admin_date, is_foreign, is_forbidden
from gazette.functions.text import BLANK, blank_to_null, col, once, strip
from gazette.functions.urls import resolve

_S = BLANK
# Colours of personal schedules, bounds of what a cookie may hold.
COLOURS, MAX_SCHEDULES, MAX_HIDDEN = ("blue", "green", "orange", "purple", "pink"), 30, 60
_SCHEDULE = "array<struct<id:string,title:string,dayOfWeek:double,startTime:string,endTime:string,location:string,memo:string,color:string>>"


def script_arguments(c: Column | str) -> Column:
    """Arguments of a call in a script: quoted ones as they are, others trimmed, without null, undefined and empty ones."""
    inner = F.regexp_extract(col(c), r"(?s)\((.*)\)", 1)
    tokens = F.regexp_extract_all(inner, F.lit(r"('[^']*'|\"[^\"]*\"|[^,'\"]+)"), F.lit(1))
    read = F.transform(tokens, lambda t: F.when(t.rlike("^['\"]"), F.struct(F.substring(t, F.lit(2), F.char_length(t) - 2).alias("v"), F.lit(True).alias("q"))).otherwise(F.struct(strip(t).alias("v"), F.lit(False).alias("q"))))
    return F.transform(F.filter(read, lambda x: x["q"] | ~x["v"].isin("", "null", "undefined")), lambda x: x["v"])


def source_text(explicit: Column, original: Column, title: Column, chunks: Column) -> Column:
    """The text to be translated: what is given, else the notice's own, else its title and distinct chunks; null if there is none."""
    parts = F.array_distinct(F.filter(F.transform(chunks, strip), lambda x: x != ""))
    found = F.filter(F.concat(F.array(F.concat(F.lit("제목: "), blank_to_null(title))), parts), lambda x: x.isNotNull())
    return F.coalesce(blank_to_null(explicit), blank_to_null(original), F.when(F.size(found) > 1, F.array_join(found, "\n\n")))


def card_items(c: Column | str) -> Column:
    """text and hint of the items of a section in JSON: strings, or objects with a text."""
    items = F.from_json(col(c), "struct<items:array<string>>")["items"]

    def one(x: Column) -> Column:
        is_object = x.startswith("{")
        text = F.when(is_object, F.get_json_object(x, "$.text")).otherwise(x)
        return F.struct(blank_to_null(text).alias("text"), F.when(is_object, blank_to_null(F.get_json_object(x, "$.hint"))).alias("hint"))

    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), one), lambda x: x["text"].isNotNull())


def schedules(c: Column | str) -> Column:
    """Personal schedules in JSON that are whole and in bounds, the first thirty, by day and start."""
    given = F.coalesce(F.from_json(col(c), _SCHEDULE), F.array().cast(_SCHEDULE))
    clock = r"^(?:[01][0-9]|2[0-3]):[0-5][0-9]$"

    def good(x: Column) -> Column:
        title = F.char_length(strip(x["title"]))
        return F.coalesce(
            F.char_length(x["id"]).between(1, 64) & title.between(1, 60) & x["startTime"].rlike(clock) & x["endTime"].rlike(clock) & (x["startTime"] < x["endTime"]) & (x["dayOfWeek"] == F.floor(x["dayOfWeek"])) & x["dayOfWeek"].between(0, 6), F.lit(False)
        )

    def kept(x: Column, i: Column) -> Column:
        colour = F.when(x["color"].isin(*COLOURS), x["color"]).otherwise("blue")
        cut = lambda v, n: F.substring(blank_to_null(v), 1, n)
        return F.struct(x["dayOfWeek"].cast("int").alias("day"), x["startTime"].alias("start"), i.alias("i"), x["endTime"].alias("end"), x["id"].alias("id"), strip(x["title"]).alias("title"), cut(x["location"], 60).alias("location"), cut(x["memo"], 120).alias("memo"), colour.alias("color"))

    return F.array_sort(F.transform(F.slice(F.filter(given, good), 1, MAX_SCHEDULES), kept))


def hidden_ids(c: Column | str) -> Column:
    given = F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>"))
    return F.slice(F.filter(given, lambda x: F.coalesce(x.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))), 1, MAX_HIDDEN)


def sanitized(facts: dict[str, Column], source: Column, year: int) -> Column:
    """Facts (arrays of texts) without dates of administration, forbidden materials, and foreign submissions and actions; refresh tells if dates, deadlines or materials lost any."""
    rules = {"dates": lambda x: is_admin_date(x, source, year), "deadlines": lambda x: is_admin_date(x, source, year), "materials": lambda x: is_forbidden(x, source), "submissions": is_foreign, "actions_required": is_foreign}
    kept = {name: _without(values, rules[name]) for name, values in facts.items()}
    lost = F.lit(False)
    for name in ("dates", "deadlines", "materials"):
        if name in facts:
            lost = lost | (F.size(kept[name]) < F.size(facts[name]))
    return F.struct(*[v.alias(k) for k, v in kept.items()], lost.alias("refresh"))


def _without(values: Column, rule: Callable[[Column], Column]) -> Column:
    return F.filter(values, lambda x: ~rule(x))


def backfill_entries(dates: Column, due: Column, fallback: Column) -> Column:
    """event_date and kind of a notice's own whole dates, else of its cards'; the due date is a deadline and is added if missing."""
    own = F.array_distinct(F.filter(F.transform(dates, strip), lambda x: x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")))
    chosen = F.when(F.size(own) > 0, own).otherwise(fallback)
    rows = F.transform(chosen, lambda x: F.struct(x.alias("event_date"), F.when(F.coalesce(x == due, F.lit(False)), "deadline").otherwise("event").alias("kind")))
    return F.when(due.isNotNull() & (due != "") & ~F.array_contains(chosen, due), F.concat(rows, F.array(F.struct(due.alias("event_date"), F.lit("deadline").alias("kind"))))).otherwise(rows)


DECORATION, IMAGE, HINTS = "logo|icon|btn|bullet|banner|common|blank|sns|menuimg|s_visual|subimg", r"\.(?:png|jpe?g|webp|bmp|gif)(?:\?|$)", "일과|시정|등하교|수업시간"


def page_images(html: Column | str, url: Column | str) -> Column:
    """url and alt of the distinct pictures of a page, whole, in page order, without data, decoration and other files; those that promise a timetable first."""
    tags = F.regexp_extract_all(col(html), F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))
    attribute = lambda t, n: F.regexp_extract(t, rf"(?is)\s{n}\s*=\s*[\"']([^\"']*)[\"']", 1)
    found = F.transform(tags, lambda t: F.struct(strip(F.coalesce(F.nullif(attribute(t, "src"), F.lit("")), attribute(t, "data-src"))).alias("src"), strip(attribute(t, "alt")).alias("alt")))
    whole = F.transform(F.filter(found, lambda x: (x["src"] != "") & ~x["src"].startswith("data:")), lambda x: F.struct(resolve(url, x["src"]).alias("url"), x["alt"].alias("alt")))
    fit = F.filter(whole, lambda x: F.lower(x["url"]).rlike(IMAGE) & ~F.lower(x["url"]).rlike(DECORATION))
    first = once(fit, lambda f: F.filter(f, lambda x, i: ~F.array_contains(F.transform(F.slice(f, F.lit(1), i), lambda y: y["url"]), x["url"])))
    ranked = F.array_sort(F.transform(first, lambda x, i: F.struct(F.when(F.concat(x["alt"], F.lit(" "), x["url"]).rlike(HINTS), 0).otherwise(1).alias("r"), i.alias("i"), x["url"].alias("url"), x["alt"].alias("alt"))))
    return F.transform(ranked, lambda x: F.struct(x["url"].alias("url"), x["alt"].alias("alt")))


def title_key(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), _S + "+", ""), r"[()\[\]{}<>]", "")


def span_label(start: Column, end: Column) -> Column:
    """MM/DD, or two of them for a span; an end before the start is none."""
    short = lambda d: F.concat(F.substring(d, 6, 2), F.lit("/"), F.substring(d, 9, 2))
    return F.when(F.coalesce(end > start, F.lit(False)), F.concat(short(start), F.lit("–"), short(end))).otherwise(short(start))


def merged_batch(locale: Column, ids: Column, now_locale: Column, now_ids: Column, now_pending: Column, now_phase: Column) -> Column:
    """ids, pending and phase of a batch of translations after more are asked for: a new batch for another locale or after a complete one."""
    wanted = F.array_distinct(F.filter(ids, lambda x: x != ""))
    fresh = now_locale.isNull() | (now_locale != locale) | (now_phase == "complete")
    merged = F.array_distinct(F.concat(F.coalesce(now_ids, F.array().cast("array<string>")), wanted))
    new = F.struct(wanted.alias("ids"), wanted.alias("pending"), F.lit("pending").alias("phase"))
    same = F.struct(now_ids.alias("ids"), now_pending.alias("pending"), now_phase.alias("phase"))
    grown = F.struct(merged.alias("ids"), F.array_distinct(F.concat(F.coalesce(now_pending, F.array().cast("array<string>")), wanted)).alias("pending"), F.lit("pending").alias("phase"))
    return F.when(F.size(wanted) == 0, same).when(fresh, new).when(F.size(merged) == F.size(now_ids), same).otherwise(grown)
