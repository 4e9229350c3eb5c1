"""Durations, numbering and status of packets and frames in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelspark.sources.frames import in_stream

def _by_pts() -> Window:
    return Window.partitionBy("stream_id").orderBy("pts", "frame_id")


def packet_durations(packets: DataFrame) -> DataFrame:
    """The gap to the next pts where that is positive; otherwise, and for the last packet, the packet's own duration stays."""
    gap = F.lead("pts").over(_by_pts()) - F.col("pts")
    return packets.withColumn("duration", F.when(gap > 0, gap).otherwise(F.col("duration")))


def reorder(packets: DataFrame, key: str | None = None) -> DataFrame:
    """Adds ``poc``: the place in order of pts, from 0. Packets of an equal pts after the first, and those without one, have null.

    ``key`` names a boolean column; packets before the first key packet's pts are then dropped.
    """
    if key:
        first_key = F.min(F.when(F.col(key), F.col("pts"))).over(Window.partitionBy("stream_id"))
        packets = packets.withColumn("_first", first_key).where("_first IS NULL OR pts IS NULL OR pts >= _first").drop("_first")
    again = F.col("pts").isNull() | F.coalesce(F.lag("pts").over(_by_pts()) == F.col("pts"), F.lit(False))
    marked = packets.withColumn("_new", F.when(again, 0).otherwise(1))
    place = F.sum("_new").over(_by_pts().rowsBetween(Window.unboundedPreceding, 0)) - 1
    return marked.withColumn("poc", F.when(F.col("_new") == 1, place)).drop("_new")


def stream_status(packets: DataFrame, key: str, field: str | None = None) -> DataFrame:
    """Per stream: packets, missing and repeated pts, missing pts of key packets, the most frequent duration, and a class.

    Classes: ``all_invalid`` (no pts), ``half_invalid`` (half or more missing),
    ``nonkey_invalid`` (only key packets have one), ``sometimes_invalid``, ``duplicate``
    (half or more repeat the pts before them), ``normal``. Ties between durations go to the least.
    """
    gone = F.col("pts").isNull()
    repeat = F.coalesce(F.lag("pts").over(in_stream()) == F.col("pts"), F.lit(False))
    rows = packets.withColumn("_repeat", repeat)
    count = lambda c: F.count(F.when(c, 1))
    fields = count(F.col(field)) if field else F.lit(0).cast("long")
    status = rows.groupBy("stream_id").agg(
        F.count("*").alias("packets"), count(gone).alias("no_pts"), count(gone & F.col(key)).alias("no_pts_key"), count(~F.col(key)).alias("nonkey"), count(F.col("_repeat")).alias("repeats"), fields.alias("fields"),
    )
    durations = rows.groupBy("stream_id", "duration").agg(F.count("*").alias("n")).groupBy("stream_id").agg(F.max_by("duration", F.struct("n", -F.col("duration"))).alias("usual_duration"))
    n, lost = F.col("packets"), F.col("no_pts")
    kind = (
        F.when(lost == n, "all_invalid").when((lost > 0) & (F.col("no_pts_key") == 0) & (lost == F.col("nonkey")), "nonkey_invalid").when(2 * lost >= n, "half_invalid")
        .when(lost > 0, "sometimes_invalid").when((F.col("repeats") > 0) & (2 * F.col("repeats") >= n), "duplicate").otherwise("normal")
    )
    return status.join(durations, "stream_id").select("stream_id", "packets", "no_pts", "no_pts_key", "repeats", "fields", "usual_duration", kind.alias("status"))


def gap_histogram(frames: DataFrame, width: int = 1) -> DataFrame:
    """``stream_id, gap, n``: how often frames follow each other at a gap of ``gap`` to ``gap + width - 1`` ticks."""
    gaps = frames.select("stream_id", (F.lead("pts").over(_by_pts()) - F.col("pts")).alias("gap")).where("gap IS NOT NULL")
    return gaps.select("stream_id", (F.floor(F.col("gap") / width).cast("long") * width).alias("gap")).groupBy("stream_id", "gap").agg(F.count("*").alias("n"))


def resolve_output_pts(encoded: DataFrame, known: DataFrame) -> DataFrame:
    """Encoder output placed in time: a known pts has its duration; an unknown one, or one that repeats the place just before, is put half the remaining duration later.

    ``encoded``: ``stream_id, frame_id, pts`` in output order; ``known``: ``stream_id, pts, duration``.
    Frames placed so in a row halve what is left again and again. Of a pts given many
    times in a row every other one is a repeat, as the repeat before it has moved on;
    each return to the pts finds half its duration. Unknown frames before the first
    known one have nulls.
    """
    found = encoded.select("stream_id", "frame_id", "pts").join(known.select("stream_id", "pts", "duration").dropDuplicates(["stream_id", "pts"]), ["stream_id", "pts"], "left")
    sofar = in_stream().rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("fresh", ~F.col("pts").eqNullSafe(F.lag("pts").over(in_stream())) | (F.row_number().over(in_stream()) == 1))
    found = found.withColumn("run", F.count(F.when(F.col("fresh"), 1)).over(sofar))
    found = found.withColumn("turn", F.row_number().over(Window.partitionBy("stream_id", "run").orderBy("frame_id")) - 1)
    found = found.withColumn("ok", F.col("duration").isNotNull() & (F.col("turn") % 2 == 0)).withColumn("left", F.expr("shiftright(duration, cast(least(turn div 2, 62) AS int))"))
    found = found.withColumn("group", F.count(F.when(F.col("ok"), 1)).over(sofar))
    last = F.last(F.when(F.col("ok"), F.struct("pts", F.col("left").alias("duration"))), ignorenulls=True).over(sofar)
    found = found.withColumn("last", last).withColumn("k", F.row_number().over(Window.partitionBy("stream_id", "group").orderBy("frame_id")) - 1)
    rest = F.expr("shiftright(last.duration + shiftleft(1L, cast(least(k, 62) AS int)) - 1, cast(least(k, 62) AS int))")  # rounded up
    return found.select("stream_id", "frame_id", F.when(F.col("ok"), F.col("pts")).otherwise(F.col("last.pts") + F.col("last.duration") - rest).alias("pts"), rest.alias("duration"))


def repeat_fields(frames: DataFrame) -> DataFrame:
    """The times that ``folds.RepeatFields`` gives, by windows alone: ``stream_id, frame_id, part, pts, duration, top_first``.

    A field is pending after an odd number of repeating frames, and what follows comes
    a third of the last one's duration early; a repeating frame that finds one gives
    two frames. Frames need a pts; a null ``repeats`` counts as false.
    """
    cut = lambda x, a, b: F.expr(f"({x}) * {a} div {b}")
    rows = frames.select("stream_id", "frame_id", "pts", F.coalesce("duration", F.lit(0)).cast("long").alias("d"), F.coalesce("repeats", F.lit(False)).alias("rep"), F.coalesce("top_first", F.lit(False)).alias("top"))
    gap = F.col("pts") - F.lag("pts").over(in_stream())
    rows = rows.withColumns({"_gap": gap, "_rep": F.coalesce(F.lag("rep").over(in_stream()), F.lit(False))})
    rows = rows.withColumn("_gap", F.when(F.col("rep"), cut("_gap", 3, 2)).otherwise(F.col("_gap")))
    rows = rows.withColumn("_gap", F.when(F.col("_rep"), cut("_gap", 2, 3)).otherwise(F.col("_gap")))
    rows = rows.withColumn("d", F.when((F.col("d") <= 0) & F.col("_gap").isNotNull(), F.col("_gap")).otherwise(F.col("d")))
    before = in_stream().rowsBetween(Window.unboundedPreceding, -1)
    pending = F.count(F.when(F.col("rep"), 1)).over(before) % 2 == 1
    early = F.last(F.when(F.col("rep"), cut("d", 1, 3)), ignorenulls=True).over(before)
    rows = rows.withColumns({"_pending": pending, "_early": F.when(pending, early).otherwise(0)})
    both, lasts = F.col("_pending") & F.col("rep"), cut("d", 2, 3)
    start, whole = F.col("pts") - F.col("_early"), F.col("d") + F.when(both, F.col("_early")).otherwise(0)
    length = F.when(both, lasts).when(F.col("rep"), F.col("d") - cut("d", 1, 3)).otherwise(F.col("d"))
    part = lambda k, at, long: F.struct(F.lit(k).alias("part"), at.alias("pts"), long.alias("duration"))
    parts = F.when(both, F.array(part(0, start, length), part(1, start + lasts, whole - lasts))).otherwise(F.array(part(0, start, length)))
    return rows.withColumn("_p", F.explode(parts)).select("stream_id", "frame_id", "_p.part", "_p.pts", "_p.duration", (F.col("top") != F.col("_pending")).alias("top_first"))
