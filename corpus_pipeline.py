"""From raw documents to token ids: five stages, each over all that the one before it kept.

``run`` applies them to the documents of a folder of tables. Every stage but the last returns the columns of
documents. A stage writes nothing here; the caller may write its rows and read them back in between.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import bpe, decontaminate, jaccard_join, quality_crf, toxicity
from gazette.llm.shared import free_name, modest_batches, save

TOXIC, GOOD = 0.5, 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below TOXIC.

    Null and empty texts have no grams; they stay unless most labelled rows are toxic. Rows with a null doc_id are
    scored as others, and repeated rows alike. Other columns pass, whatever their names. No rows in, none out.
    """
    modest_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "_toxicity")
    return toxicity.score_toxicity(docs, model, score_col=score).where(F.col(score) < TOXIC).drop(score)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is GOOD at least.

    Null, empty and blank texts have quality 0.0 and go. Rows with a null doc_id are scored as others, and repeated
    rows alike. Other columns pass, whatever their names. No rows in, none out.
    """
    modest_batches(spark)
    field = quality_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "_quality")
    return quality_crf.score_quality(docs, field, score_col=score).where(F.col(score) >= GOOD).drop(score)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies.

    Texts without words are in no group: one row of each (doc_id, text) stays. So it is with rows that repeat a
    doc_id: each text stands for itself, and of texts of a group under the least doc_id the one of least xxhash64
    stays. Rows with a null doc_id all stay. Other columns pass; of equal rows of (doc_id, text) any one's are kept.
    """
    modest_batches(spark)
    rows = save(jaccard_join.jaccard_groups(docs), "groups").where("doc_id is not null").groupBy("doc_id", "text_key", "group_key").agg(F.count(F.lit(1)).alias("many"))
    chosen = rows.where("group_key is not null").groupBy("group_key").agg(F.min(F.struct("doc_id", "text_key", "many")).alias("least")).select("least.*")
    chosen = chosen.unionByName(rows.where("group_key is null").drop("group_key"))
    id_, key, many = (free_name(docs, c) for c in ("_id", "_key", "_many"))
    met = docs.join(chosen.toDF(id_, key, many), (docs["doc_id"] == F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(key)))
    once = met.where(F.col(many) == 1).select(*docs.columns)
    several = met.where(F.col(many) > 1).dropDuplicates([id_, key]).select(*docs.columns)
    return once.unionByName(several).unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Null and wordless texts hold none and stay, as do all rows where the benchmark is empty. Repeated rows are
    treated alike. Other columns pass, whatever their names. No rows in, none out.
    """
    modest_batches(spark)
    found = free_name(docs, "_hits")
    hits = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), hits_col=found)
    return hits.where(F.size(F.col(found)["spans"]) == 0).drop(found)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether the ids decode to the text; the columns besides doc_id and text end here.

    Null and empty texts have no ids and count as decoded. Rows come out as they came in, repeated ones and those
    with a null doc_id too.
    """
    modest_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.bpe_encode(docs.select("doc_id", "text"), path, decoded_col="decoded")
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality_classifier", keep_good),
    ("jaccard_join", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL can express neither the learned stages nor BPE; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
