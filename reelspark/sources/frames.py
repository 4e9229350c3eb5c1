"""The frame schema, and tables that stand in for decoded streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Scalars of a frame; planes are arrays in columns of their own. Times are integer ticks.
FRAME = "stream_id long, frame_id long, pts long, duration long, frame_type string, luma double"


def in_stream() -> Window:
    """The order of frames in their stream."""
    return Window.partitionBy("stream_id").orderBy("frame_id")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as frames: a user is a stream, microseconds are ticks, and a frame lasts until the next one of its stream (the last: 0)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    pts = F.unix_micros(F.col("ts").cast("timestamp"))
    frames = events.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("frame_id"), pts.alias("pts"), F.col("event_type").alias("frame_type"), F.col("value").alias("luma"))
    gap = F.lead("pts").over(in_stream()) - F.col("pts")
    return frames.withColumn("duration", F.coalesce(gap, F.lit(0).cast("long"))).select("stream_id", "frame_id", "pts", "duration", "frame_type", "luma")


def block_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as frames of one 8x8 luma block: a label is a stream, samples are 0 to 255."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    sample = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 255 + 128))).cast("int")
    return rows.select(F.col("label").cast("long").alias("stream_id"), F.col("vec_id").alias("frame_id"), F.transform("embedding", sample).alias("plane"))
