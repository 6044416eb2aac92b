"""Queries on extractions whose JSON is made of two given tables: turns of a conversation are sources, a page of its number has the translated body."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import cards
from gazette.plans.base import Query, table


def _extractions(spark: SparkSession, d: str) -> DataFrame:
    """Sources as objects with keys left out, or of another kind, by the turn's number."""
    t = F.col("turn")
    kind = F.element_at(F.array(*map(F.lit, ("html_body", "attachment_pdf", "inline_image", "attachment_hwp"))), (t % 4 + 1).cast("int"))
    meta = F.when(t % 3 != 2, F.struct((20 - t).alias("order_index"), F.when(t % 2 == 1, "pdf").alias("file_type")))
    source = F.struct(
        F.concat(F.lit("s"), t.cast("string")).alias("source_id"), kind.alias("source_type"), F.when(t % 5 != 3, F.col("text")).alias("refined_text"), F.when(t % 2 == 0, F.lit(" files/x ")).alias("storage_path"),
        F.when(t % 4 != 2, F.concat(F.lit("f"), t.cast("string"), F.lit(".pdf"))).alias("filename"), meta.alias("metadata"), F.when(F.col("role") == "assistant", F.struct(F.when(t % 7 == 3, "  ").otherwise(F.concat(F.lit("vi: "), F.col("text"))).alias("vi"))).alias("translations"),
    )
    rows = table(spark, d, "conversations").where("text is not null").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("role"), F.to_json(source).alias("j")))), lambda r: r["j"]).alias("js"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda r: F.concat(F.lit('"s'), r["turn"].cast("string"), F.lit('"'))).alias("ids"))
    odd = F.array(F.lit("7"), F.lit('"text"'), F.lit("[1]"), F.lit('{"source_id": 5, "refined_text": {"a": 1}}'))
    text = F.concat(F.lit('{"sources": ['), F.array_join(F.concat("js", odd), ", "), F.lit('], "included_source_ids": ['), F.array_join("ids", ", "), F.lit("]}"))
    bodies = table(spark, d, "pages").where("page_id % 3 = 0").select(F.col("page_id").alias("conv_id"), F.col("url").alias("body"))
    return rows.select("conv_id", F.try_parse_json(text).alias("x")).join(bodies, "conv_id", "left")


def c57_cards(spark: SparkSession, d: str) -> DataFrame:
    c = _extractions(spark, d).select("conv_id", F.posexplode(cards.source_cards("x", "vi", "body", F.col("conv_id").cast("string"))).alias("at", "c"))
    return c.select("conv_id", "at", "c.kind", "c.filename", "c.content", "c.previewable", "c.public_url")


def c54_full_bodies(spark: SparkSession, d: str) -> DataFrame:
    return _extractions(spark, d).select("conv_id", cards.full_body("x").alias("body"), F.size(cards.attachment_files("x", F.col("conv_id").cast("string"))).alias("n_files"))


_S = """select conv_id, turn, role, text, turn % 4 in (0, 2) as of_body, case when turn % 3 <> 2 then 20 - turn else 999 end as ord, turn % 5 <> 3 as refined, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as t from conversations where text is not null"""
QUERIES: dict[str, Query] = {
    "c57_cards": (c57_cards, f"""with s as ({_S}), b as (select page_id as conv_id, url as body from pages where page_id % 3 = 0), k as (select s.*, body from s left join b using (conv_id) where refined and (not of_body or t <> '')),
      a as (select conv_id, -1 as ord, -1 as turn, 'body' as kind, '' as filename, body as content, false as previewable, null as public_url from (select distinct conv_id from s) join b using (conv_id) where conv_id not in (select conv_id from k where of_body)
        union all select conv_id, ord, turn, case when of_body then 'body' else 'attachment' end, case when turn % 4 <> 2 then 'f' || turn || '.pdf' else '' end, case when of_body and body is not null then body when role = 'assistant' and turn % 7 <> 3 then 'vi: ' || text else text end, turn % 3 <> 2 and turn % 2 = 1, case when turn % 2 = 0 then '/api/notices/' || conv_id || '/attachments/s' || turn end from k)
      select conv_id, (row_number() over (partition by conv_id order by kind = 'attachment', ord, turn) - 1)::int as at, kind, filename, content, previewable, public_url from a"""),
    "c54_full_bodies": (c54_full_bodies, f"""with s as ({_S}), c as (select conv_id, coalesce(arg_min(turn, ord * 1000 + turn) filter (where turn % 4 = 0), arg_min(turn, ord * 1000 + turn) filter (where turn % 4 = 2), min(turn)) as carrier, count(*) filter (where turn % 2 = 0) as n_files from s group by 1),
      p as (select s.conv_id, case when turn = carrier then -1 else turn end as pos, case when turn = carrier then t else '## 첨부: f' || turn || '.pdf' || chr(10) || chr(10) || t end as part from s join c using (conv_id) where refined and t <> '' and (turn = carrier or not of_body))
      select conv_id, coalesce(string_agg(part, chr(10) || chr(10) order by pos), '') as body, n_files::int as n_files from c left join p using (conv_id) group by conv_id, n_files"""),
}
