"""The queries opN_<name> of this subpackage: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import align, bpe, decontaminate, hard_negatives, html_main, jaccard_join, language_id, nearest, packing, quality_crf, sharding, token_output, toxicity
from gazette.llm.shared import held_out, modest_batches, shared_path

BYTE_BPE = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written in doc_id order and read back from the files."""
    path = shared_path(spark, "tokens")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    token_output.write_tokens(docs, path, public_tokenizers.path(BYTE_BPE), end_id=2)
    return token_output.id_digests(token_output.read_tokens(spark, path))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by five-word shingles at a Jaccard similarity of 0.8 or more."""
    return jaccard_join.jaccard_classes(_read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty vectors of largest inner product with each twentieth vector."""
    return nearest.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text that they decode to, as digests."""
    path = public_tokenizers.path(BYTE_BPE)
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe.bpe_encode(docs, path, packed=True, decoded_col="decoded")
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards by jump hash of doc_id, and where a ninth would take the row."""
    docs = _read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = sharding.assign_shards(sharding.assign_shards(rows, "doc_id", 8), "doc_id", 9, "grown_shard")
    slots = sharding.number_slots(rows, "shard", ["doc_id", "text_crc32", "size"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a ten-word window of a benchmark item."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.find_contamination(docs, _read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    ids = F.array_join(F.array_sort("hits.items"), ",")
    return hits.select("doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op8_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_main.extract_main(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_crf.score_quality(docs, quality_crf.fit(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two vocabularies lie against each other in every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = align.align_tokenizers(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each fiftieth vector and its nearest of the same label, the nearest of other labels that score a little lower."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(_read(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.id_checksums(packing.write_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))
    placed = packing.place(pieces)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_nearest": op4_nearest,
    "op5_bpe": op5_bpe,
    "op6_sharding": op6_sharding,
    "op7_decontaminate": op7_decontaminate,
    "op8_html_main": op8_html_main,
    "op9_language_id": op9_language_id,
    "op10_quality": op10_quality,
    "op11_align": op11_align,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_pack": op13_pack,
}

ORACLE_SQL: dict[str, str] = {}
