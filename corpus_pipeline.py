"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and is written as Parquet before the next
one reads it. All stages but the last return the columns of ``documents``. Ids may be
null or repeated: rows of the same id and text count once, other rows are documents of
their own. Null and empty texts fail the quality rules. Long texts go through whole. An
empty table gives an empty one at every stage. Columns besides ``doc_id``, ``text``,
``source`` and ``n_chars`` pass unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import decontam, near_dup, packing, quality, suffix_dedup
from reelspark.llm._rows import has_repeats, row_key
from reelspark.llm._scratch import Scratch
from reelspark.llm.queries import table, tokenizer_path

#: The packing and the hashes have no SQL form; the tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def free(docs: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def keyed(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a unique key, the id where ids are unique, and its name; of rows of the same id and text one is left."""
    key = free(docs, "_key")
    if not has_repeats(docs, "doc_id"):
        return docs.withColumn(key, F.col("doc_id")), key
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = F.min(F.struct(*rest)) if rest else F.lit(None)
    once = docs.withColumn(key, row_key("doc_id", "text")).groupBy(key).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), least.alias("_rest"))
    once = once.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c) for c in docs.columns], key)
    return Scratch(spark, "keyed").stage(once, "docs"), key


def with_text(docs: DataFrame, new: Column, changed: Column) -> DataFrame:
    """``docs`` with the text ``new`` and its length where ``changed``; a column ``n_chars`` need not be there."""
    values = {"text": F.when(changed, new).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(changed, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return docs.withColumns(values)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't depleted, without the lines that are frequent on their host."""
    columns, (docs, key) = docs.columns, keyed(spark, docs)
    lines = free(docs, "_lines")
    found = quality.document_rules(docs, key, frequent_lines=True).where("kept").select(F.col("id").alias(key), F.col("frequent_lines").alias(lines))
    return with_text(docs.join(found, key), quality.without_lines(F.col("text"), F.col(lines)), F.col(lines).isNotNull()).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    columns, repeats, (docs, key) = docs.columns, has_repeats(docs, "doc_id"), keyed(spark, docs)
    kept = near_dup.near_duplicates(docs.select(key, "text"), key)
    if repeats:  # keys aren't in the order of ids then
        groups = kept.select(F.col("id").alias(key), "component_id").join(docs.select(key, "doc_id"), key)
        kept = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key))[key].alias(key))
    else:
        kept = kept.where("kept").select(F.col("id").alias(key))
    return docs.join(kept, key, "left_semi").select(*columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that occur elsewhere too; a text that loses all of itself goes."""
    columns, (docs, key) = docs.columns, keyed(spark, docs)
    new = free(docs, "_new")
    cut = suffix_dedup.repeated_passages(docs, key).where("n_removed = 0 OR kept_text <> ''")
    cut = cut.select(F.col("id").alias(key), F.when(F.col("n_removed") > 0, F.col("kept_text")).alias(new))
    return with_text(docs.join(cut, key), F.col(new), F.col(new).isNotNull()).select(*columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    columns, (docs, key) = docs.columns, keyed(spark, docs)
    clean = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), key).where("NOT contaminated").select(F.col("id").alias(key))
    return docs.join(clean, key, "left_semi").select(*columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed into sequences of 4096 tokens."""
    if not has_repeats(docs, "doc_id"):
        return packing.packed(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")
    docs, key = keyed(spark, docs.select("doc_id", "text"))
    out = packing.packed(docs, tokenizer_path(), key)
    return out.withColumnRenamed("id", key).join(docs.select(key, "doc_id"), key).select(*["doc_id" if c == "id" else c for c in out.columns])


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_duplicates),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; each but the last is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.stage(docs, f"stage{k}")
    return docs
