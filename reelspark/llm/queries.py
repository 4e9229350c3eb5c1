"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import decontam, fim, language, licenses, lm_score, near_dup, nnls_packing, packing, quality, search, suffix_dedup, url_filter, warc
from reelspark.llm.oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.page_round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_rules(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(3) == 1)
    out = language.identify(docs, docs.where("NOT held_out"))
    return out.select(F.col("id").alias("doc_id"), (F.crc32(F.col("id").cast("string")) % 3 == 1).alias("held_out"), "lang_pred", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.score_texts(table(spark, sf_dir, "documents").withColumn("trained", fold(5) != 1))
    return out.select(F.col("id").alias("doc_id"), (F.crc32(F.col("id").cast("string")) % 5 == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge_urls(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op11_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nnls_packing.packed(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_warc, op3_quality, op4_language, op5_packing, op6_lm_score, op7_decontamination, op8_licenses, op9_url_filter, op10_near_dup, op11_nnls_packing, op12_fill_in_middle, op13_lexical_search)
}
