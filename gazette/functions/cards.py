"""Cards, files and the full body of a notice from the JSON of its extraction, whose shape varies: read as VARIANT.

Only values of the kind that is asked for count (a number in place of a file name is no file name), and what is no
object is passed over. Folds run within a notice's row: it has a few sources.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.notices import body_has_content
from gazette.functions.text import col, once, strip

# Sources that are part of the body, kinds of files that a reader can be shown, the place of a source without one, and headings of attachments.
BODY_TYPES, SHOWN, LAST = ("html_body", "inline_image"), ("pdf", "image"), 999
HEADING, UNNAMED, NO_NAME = "## 첨부: ", "첨부", "attachment"
_CARD = "struct<kind:string,filename:string,content:string,needs_file:boolean,previewable:boolean,public_url:string>"


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("")), "^[A-Z]+", 0)


def text_at(v: Column, path: str) -> Column:
    """The string at a path, or null where there is none or something else."""
    return once(F.try_variant_get(v, path, "variant"), lambda x: F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string")))


def _number_at(v: Column, path: str) -> Column:
    return once(F.try_variant_get(v, path, "variant"), lambda x: F.when(_kind(x).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(x, "$", "double")))


def sources(extracted: Column | str) -> Column:
    """The objects in the list of sources, in order; empty without a list."""
    return F.filter(F.coalesce(F.try_variant_get(col(extracted), "$.sources", "array<variant>"), F.array().cast("array<variant>")), lambda s: _kind(s) == "OBJECT")


def _filled(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def _route(notice: Column, source: Column) -> Column:
    code = lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("/api/notices/"), code(notice), F.lit("/attachments/"), code(source))


def _shown(s: Column) -> Column:
    return F.coalesce(text_at(s, "$.metadata.file_type").isin(*SHOWN), F.lit(False))


def source_cards(extracted: Column | str, locale: str, translated_body: Column | str, notice_id: Column | str) -> Column:
    """Cards of the refined sources: those of the body first, each kind by order_index; a body is shown in its translation, another source in the locale's, else as it is.

    A translated body that no source carries is a card of its own before the rest; so it is without an extraction (null).
    """
    x, body, notice = col(extracted), F.nullif(col(translated_body), F.lit("")), col(notice_id)

    def row(s: Column, i: Column) -> Column:
        refined, of_body = text_at(s, "$.refined_text"), F.coalesce(text_at(s, "$.source_type").isin(*BODY_TYPES), F.lit(False))
        local = text_at(s, f"$.translations.{locale}")
        content = F.coalesce(F.when(of_body, body), F.when(strip(local) != "", local), refined)
        url = F.when(_filled(text_at(s, "$.storage_path")).isNotNull(), _route(notice, _filled(text_at(s, "$.source_id"))))
        card = F.struct(F.when(of_body, "body").otherwise("attachment").alias("kind"), F.coalesce(text_at(s, "$.filename"), F.lit("")).alias("filename"), content.alias("content"), F.coalesce(F.try_variant_get(s, "$.needs_file", "boolean") & (_kind(F.try_variant_get(s, "$.needs_file", "variant")) == "BOOLEAN"), F.lit(False)).alias("needs_file"), _shown(s).alias("previewable"), url.alias("public_url"))
        return F.when(refined.isNotNull() & (~of_body | F.coalesce(body_has_content(refined), F.lit(False))), F.struct((~of_body).alias("late"), F.coalesce(_number_at(s, "$.metadata.order_index"), F.lit(float(LAST))).alias("at"), i.alias("i"), card.cast(_CARD).alias("card")))

    alone = F.struct(F.lit("body").alias("kind"), F.lit("").alias("filename"), body.alias("content"), F.lit(False).alias("needs_file"), F.lit(False).alias("previewable"), F.lit(None).cast("string").alias("public_url")).cast(_CARD)
    made = F.array_sort(F.filter(F.transform(sources(x), row), lambda r: r.isNotNull()), lambda a, b: F.when(a["late"] != b["late"], F.when(b["late"], -1).otherwise(1)).when(a["at"] != b["at"], F.when(a["at"] < b["at"], -1).otherwise(1)).otherwise(F.when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)))
    with_body = lambda rows: F.concat(F.when(body.isNotNull() & ~F.exists(rows, lambda r: ~r["late"]), F.array(alone)).otherwise(F.array().cast(f"array<{_CARD}>")), F.transform(rows, lambda r: r["card"]))
    return once(made, with_body)


def attachment_files(extracted: Column | str, notice_id: Column | str) -> Column:
    """filename, public_url and previewable of each stored source, the first of each source_id."""
    found = F.transform(sources(extracted), lambda s: F.struct(_filled(text_at(s, "$.source_id")).alias("id"), F.coalesce(_filled(text_at(s, "$.filename")), F.lit(NO_NAME)).alias("filename"), _route(col(notice_id), _filled(text_at(s, "$.source_id"))).alias("public_url"), _shown(s).alias("previewable"), _filled(text_at(s, "$.storage_path")).isNotNull().alias("stored")))
    kept = lambda rows: F.filter(rows, lambda r, i: r["stored"] & r["id"].isNotNull() & ~F.exists(F.slice(rows, F.lit(1), i), lambda o: o["stored"] & (o["id"] == r["id"])))
    return F.transform(once(found, kept), lambda r: F.struct(r["filename"].alias("filename"), r["public_url"].alias("public_url"), r["previewable"].alias("previewable")))


def full_body(extracted: Column | str) -> Column:
    """Text of the carrier of the body, then of each other included source under a heading with its name.

    extracted holds included_source_ids and sources, whose refined_text counts. The carrier is the first source of
    the body by order_index that is a page's text, else the first of the body, else the first included one.
    """
    def assemble(x: Column) -> Column:
        all_, ids = sources(x), F.coalesce(F.try_variant_get(x, "$.included_source_ids", "array<string>"), F.array().cast("array<string>"))
        brief = F.transform(all_, lambda s: F.struct(text_at(s, "$.source_id").alias("id"), text_at(s, "$.source_type").alias("type"), F.coalesce(text_at(s, "$.filename"), F.lit("")).alias("name"), text_at(s, "$.refined_text").alias("text"), F.coalesce(_number_at(s, "$.metadata.order_index"), F.lit(float(LAST))).alias("at")))

        def known(rows: Column) -> Column:
            of = lambda i: F.element_at(F.filter(rows, lambda r: r["id"] == i), -1)
            picked = F.transform(F.filter(ids, lambda i: F.exists(rows, lambda r: r["id"] == i)), lambda i, n: F.struct(of(i)["at"].alias("at"), n.alias("n"), of(i)["id"].alias("id"), of(i)["type"].alias("type"), of(i)["name"].alias("name"), of(i)["text"].alias("text")))

            def joined(some: Column) -> Column:
                body = F.array_sort(F.filter(some, lambda r: r["type"].isin(*BODY_TYPES)))
                carrier = F.coalesce(F.try_element_at(F.filter(body, lambda r: r["type"] == "html_body"), F.lit(1))["id"], F.try_element_at(body, F.lit(1))["id"], F.try_element_at(ids, F.lit(1)))
                first = F.transform(F.slice(F.filter(some, lambda r: r["id"] == carrier), 1, 1), lambda r: strip(r["text"]))
                rest = F.filter(some, lambda r: (r["id"] != carrier) & ~F.coalesce(r["type"].isin(*BODY_TYPES), F.lit(False)))
                under = F.transform(rest, lambda r: F.when(strip(r["text"]) != "", F.concat(F.lit(HEADING), F.coalesce(_filled(r["name"]), F.lit(UNNAMED)), F.lit("\n\n"), strip(r["text"]))))
                return strip(F.array_join(F.filter(F.concat(first, under), lambda p: p.isNotNull() & (p != "")), "\n\n"))

            return once(picked, joined)

        return once(brief, known)

    return once(col(extracted), assemble)
