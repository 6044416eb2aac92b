"""The flagship query: the best-scored document of each source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions.text import once, text_quality
from gazette.operators.picks import first_by
from gazette.plans.base import spread, table

#: Scores of texts in Latin letters: the script class is a parameter.
LATIN = "[A-Za-zÀ-ÖØ-öø-ÿ]"


def best_document_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partial pass for scores, then a ranked window per source whose limit is applied before the shuffle. Low quality ranks last."""
    docs = spread(table(spark, sf_dir, "documents").where(F.col("text").isNotNull()))
    score = once(text_quality("text", {"latin": LATIN})["latin"], lambda q: F.when(~q["low"], q["score"]))
    ranked = first_by(docs.select("source", "doc_id", "lang", score.alias("score")), ["source"], [F.desc_nulls_last("score"), F.asc("doc_id")])
    return ranked.where("score is not null").select("source", "doc_id", "lang", "score")
