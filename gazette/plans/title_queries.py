"""Queries on titles: which hold one another, and letters composed to one form."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import school, text as X
from gazette.operators.containment import containment_pairs
from gazette.plans.base import Query, table

_TIGHT = "lower(regexp_replace({0}, '[^0-9A-Za-zÀ-ÿ]+', ''))"


def j11_containment(spark: SparkSession, d: str) -> DataFrame:
    """Titles of pages and names in menus, both without blanks and marks, of which one holds the other."""
    pages = table(spark, d, "pages").select("page_id", "html")
    titles = pages.select(F.expr(_TIGHT.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")).alias("t"))
    names = pages.select(F.explode(F.regexp_extract_all("html", F.lit("<li><a href=\"[^\"]*\">([^<]*)</a>"), F.lit(1))).alias("n")).select(F.expr(_TIGHT.format("n")).alias("n"))
    return containment_pairs(titles, "t", names, "n")


# Letters as one code point and as a letter with marks, or Hangul as its parts.
_APART = [(c, unicodedata.normalize("NFD", c)) for c in "éèêçñüöäß수학Ⅱ" if unicodedata.normalize("NFD", c) != c]
_DECOMPOSED = "text"
for _one, _parts in _APART:
    _DECOMPOSED = f"replace({_DECOMPOSED}, '{_one}', '{_parts}')"
_SUBJECT = "case p_partkey % 4 when 0 then '" + unicodedata.normalize("NFD", "수학") + "Ⅱ' when 1 then '" + unicodedata.normalize("NFD", "국어") + " 1' when 2 then '수학Ⅱ' else p_name end"


def c38_composed(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with letters taken apart and put together again."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", X.composed(F.expr(_DECOMPOSED)).alias("t"))
    return docs.select("doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("sha"), F.char_length("t").cast("long").alias("n"))


def c38_subjects(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").select("p_partkey", school.split_subject(X.composed(F.expr(_SUBJECT))).alias("s"))
    return s.select("p_partkey", "s.base", "s.key")


QUERIES: dict[str, Query] = {
    "j11_containment": (j11_containment, f"""with p as (select html from pages), a as (select distinct {_TIGHT.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)").replace("+', '')", "+', '', 'g')")} as l from p), n as (select unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) as x from p),
      b as (select distinct {_TIGHT.format("x").replace("+', '')", "+', '', 'g')")} as r from n) select l as "left", r as "right" from a join b on contains(l, r) or contains(r, l) where length(l) >= 4 and length(r) >= 4"""),
    "c38_composed": (c38_composed, f"select doc_id, sha256(t) as sha, length(t) as n from (select doc_id, nfc_normalize({_DECOMPOSED}) as t from documents where text is not null)"),
    "c38_subjects": (c38_subjects, "select p_partkey, case p_partkey % 4 when 0 then '수학' when 1 then '국어' when 2 then '수학' else p_name end as base, case p_partkey % 4 when 0 then '수학' when 1 then '국어' when 2 then '수학' else regexp_replace(p_name, '[^0-9A-Za-z가-힣]+', '', 'g') end as key from part"),
}
