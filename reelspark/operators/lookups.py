"""Side tables looked up by frame number or time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelspark.sources.frames import in_stream

#: Side tables up to this many rows are sent to every task; larger ones are joined by buckets of time.
BROADCAST_ROWS = 100_000
#: Widths of cells by level.
_WIDTHS = [16**k for k in range(1, 14)]


def _in_ranges(left: DataFrame, at: str, ranges: DataFrame, start: str, end: str, inclusive: bool) -> DataFrame:
    """Interval join: the ranges that hold each distinct place ``at`` of ``left``. Both sides meet in cells of time; those of a checked small table are broadcast.

    A range lies in one cell or two of the level whose cells, 16 to the power of the level
    plus 1 wide, are the first that are as wide as the range. A place looks into its cell of
    each level that has ranges, of which there are 14 at most. Ranges longer than the widest
    cells, open ones among them, meet all places.
    """
    low, high = F.col(at) >= F.col(start), (F.col(at) <= F.col(end)) if inclusive else (F.col(at) < F.col(end))
    small = ranges.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    left = left.select(at).where(F.col(at).isNotNull()).distinct()
    length = F.greatest(F.col(end) - F.col(start), F.lit(0))
    level = F.lit(len(_WIDTHS))
    for k in reversed(range(len(_WIDTHS))):
        level = F.when(length <= _WIDTHS[k], F.lit(k)).otherwise(level)
    placed = ranges.withColumn("_level", level)
    hits = None
    for k in sorted(r[0] for r in placed.select("_level").distinct().collect()):
        cell = lambda c: F.floor(F.col(c) / _WIDTHS[k]).cast("long") if k < len(_WIDTHS) else F.lit(0).cast("long")  # noqa: B023, E731
        cells = placed.where(F.col("_level") == k).withColumn("_cell", F.explode(F.array_distinct(F.array(cell(start), cell(end))))).drop("_level")
        met = left.withColumn("_at", cell(at)).join(F.broadcast(cells) if small else cells, (F.col("_at") == F.col("_cell")) & low & high).drop("_at", "_cell")
        hits = met if hits is None else hits.unionByName(met)
    return left.join(ranges, F.lit(False)) if hits is None else hits


def dynamic_rate_control(frames: DataFrame, ranges: DataFrame) -> DataFrame:
    """Frames with the settings of the last range, in order of (start, end as given), that holds their id; both ends included.

    ``ranges``: ``start, end, mode, bitrate, quality``; an end of 0 or less is open. Frames outside all have nulls.
    """
    opened = F.when(F.col("end") <= 0, F.lit(2**62)).otherwise(F.col("end").cast("long"))
    side = ranges.select(F.col("start").alias("_s"), opened.alias("_e"), F.col("end").alias("_given"), "mode", "bitrate", "quality")
    hits = _in_ranges(frames, "frame_id", side, "_s", "_e", True)
    best = F.max_by(F.struct("mode", "bitrate", "quality"), F.struct("_s", "_given", "mode", "bitrate")).alias("x")
    return frames.join(hits.groupBy("frame_id").agg(best), "frame_id", "left").select(*frames.columns, "x.mode", "x.bitrate", "x.quality")


def film_grain(frames: DataFrame, table: DataFrame) -> DataFrame:
    """Frames with the seed and parameters of the interval ``start <= pts < end``; ``off`` and a null seed where there is none. Of intervals that overlap the one that ends first counts, then the one that starts first."""
    side = table.select(F.col("start").alias("_s"), F.col("end").alias("_e"), "seed", "params")
    hits = _in_ranges(frames, "pts", side, "_s", "_e", False)
    best = F.min_by(F.struct("seed", "params"), F.struct("_e", "_s", "seed", "params")).alias("x")
    return frames.join(hits.groupBy("pts").agg(best), "pts", "left").select(*frames.columns, "x.seed", F.coalesce("x.params", F.lit("off")).alias("params"))


def forced_keyframes(frames: DataFrame, key_frames: DataFrame) -> DataFrame:
    """Adds ``is_key``: whether the frame's id is in the list."""
    keys = key_frames.select("frame_id", F.lit(True).alias("is_key")).distinct()
    return frames.join(keys, "frame_id", "left").select(*frames.columns, F.coalesce("is_key", F.lit(False)).alias("is_key"))


def as_of(frames: DataFrame, packets: DataFrame, value: str) -> DataFrame:
    """Frames with ``value`` of the newest packet of their stream at or before their pts (the one with the greatest value on ties), else null.

    A union and one window over each stream: no pair of rows is made.
    """
    left = frames.select("*", F.lit(None).cast(packets.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("stream_id", "pts") else F.col(f.name) for f in frames.schema]
    right = packets.select(*nothing, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy("stream_id").orderBy("pts", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*frames.columns, value)


def overlay(base: DataFrame, over: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs the frames of two streams by place, not by time; base frames beyond the overlay's end have nulls."""
    number = lambda df: df.withColumn("_n", F.row_number().over(in_stream()))
    right = number(over).select("stream_id", "_n", *[F.col(c).alias(f"over_{c}") for c in columns])
    return number(base).join(right, ["stream_id", "_n"], "left").drop("_n")


def find_packet(times: DataFrame, packets: DataFrame) -> DataFrame:
    """The packet with the pts asked for, else the one before it: ``as_of`` on the packet's ``poc``."""
    return as_of(times, packets, "poc")
