"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.llm import alignment, decontaminate, html_text, jaccard_join, katz, line_dedup, mixing, pii, sharding, spotsigs, toxicity, url_filter, whitening
from tidewater.llm.sql import ORACLES

SHARDS = 40


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_term", "degree", "n_entity")


def op2_html_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    text = html_text.extract(F.col("html"))
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("bigint"))


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is good if the label row of its number says quality 1 and toxic 0."""
    labels = _read(spark, sf_dir, "labels")
    outcome = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    out = url_filter.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), labels.select(F.col("doc_id").alias("id"), outcome.alias("good")))
    # sums of doubles may differ in the last digits from run to run
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("good_rate", 9).alias("good_rate"), F.round("good_upper", 9).alias("good_upper"))


def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item, with each such item."""
    return decontaminate.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(_read(spark, sf_dir, "documents"))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edit_likeness(_read(spark, sf_dir, "documents"))


def op7_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(toxicity.remainder(F.col("doc_id"), 3) != 1))
    held_out = F.coalesce(toxicity.remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    out = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op8_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.shard(rows, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_fair_queue_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_read(spark, sf_dir, "documents"))


def op10_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(_read(spark, sf_dir, "documents"), toxicity.remainder(F.col("doc_id"), 7) == 2)


def op11_merge_path_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.scores(_read(spark, sf_dir, "documents"), alignment.tokenizers())


def op12_polarisation_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


def op13_bloom_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_disclosure": op1_pii_disclosure,
        "op2_html_tree_scoring": op2_html_tree_scoring,
        "op3_host_reputation": op3_host_reputation,
        "op4_string_tiling": op4_string_tiling,
        "op5_signature_tree_join": op5_signature_tree_join,
        "op6_spotsigs": op6_spotsigs,
        "op7_kneser_ney_toxicity": op7_kneser_ney_toxicity,
        "op8_feistel_sharding": op8_feistel_sharding,
        "op9_fair_queue_mixing": op9_fair_queue_mixing,
        "op10_katz_backoff": op10_katz_backoff,
        "op11_merge_path_alignment": op11_merge_path_alignment,
        "op12_polarisation_whitening": op12_polarisation_whitening,
        "op13_bloom_line_dedup": op13_bloom_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
