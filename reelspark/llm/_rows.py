"""Keys for rows whose ids are missing or repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether an id is null or stands in more than one row."""
    n = docs.select(F.col(id_col).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return not n.where("n > 1 OR id IS NULL").isEmpty()


def row_key(*columns: str) -> Column:
    """A key shared only by rows that are equal in ``columns``, nulls included, but for collisions of 64 bits."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.md5(F.coalesce(F.col(c).cast("string"), F.lit(""))))]
    return F.xxhash64(*parts)


def each_row(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``judge(docs)`` where the column ``id`` is null or repeated.

    ``judge`` gets rows with a unique integer ``id`` and returns rows with that ``id``.
    Rows equal in all columns are judged once and get the same result each; other
    rows of one id are judged for themselves.
    """
    if not has_repeats(docs, "id"):
        return judge(docs)
    keyed = docs.withColumn("_key", row_key(*docs.columns))
    rest = [c for c in docs.columns if c != "id"]
    once = keyed.groupBy(F.col("_key").alias("id")).agg(*[F.first(c).alias(c) for c in rest])
    out = judge(once)
    return keyed.select("_key", F.col("id").alias("_own")).join(out.withColumnRenamed("id", "_key"), "_key").select(F.col("_own").alias("id"), *[c for c in out.columns if c != "id"])
