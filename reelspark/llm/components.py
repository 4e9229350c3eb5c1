"""Connected components of a table of links, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm._scratch import Scratch


def connected(links: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """``node, root`` (the least node that can be reached) for each node of ``links`` (``a, b``).

    Alternates linking larger neighbours to the least one and smaller neighbours to
    the least one. Hubs only meet partial minima and joins, never one task.
    """
    edges = scratch.stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}_0")
    step = 0
    while _unsettled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        step += 1
        edges = scratch.stage(small.distinct(), f"{label}_{step}")
        scratch.drop(f"{label}_{step - 1}")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has two lesser ones, or one that isn't the least of all: then ``edges`` isn't a set of stars yet."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    bad = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1")
    return bad.agg(F.count("*")).first()[0] > 0
