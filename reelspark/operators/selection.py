"""Which frames stay: trimming, one of every few, dropping the most redundant of a cycle, tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelspark.sources.frames import in_stream


def number_in_stream(frames: DataFrame, name: str = "n") -> DataFrame:
    """Adds a frame's place in its stream, from 0."""
    return frames.withColumn(name, (F.row_number().over(in_stream()) - 1).cast("long"))


def _block(frame: Column, ranges: list[tuple[int, int]]) -> tuple[Column, Column]:
    """The first range that ends at or after the frame (their number, if none), and whether it holds the frame."""
    block, inside = F.lit(len(ranges)), F.lit(False)
    for k, (start, fin) in reversed(list(enumerate(ranges))):
        block = F.when(frame <= fin, k).otherwise(block)
        inside = F.when(frame <= fin, frame >= start).otherwise(inside)
    return block, inside


def trim(frames: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Frames whose id lies in a range (both ends included), with the time between blocks closed.

    An empty list keeps all; negative ids are rejected. The time of frames dropped
    after the first block is taken off the pts of later blocks; what is dropped
    before the first block is not. Ranges are a parameter of the job, not a table.
    """
    if not ranges:
        return frames.where("frame_id >= 0")
    block, inside = _block(F.col("frame_id"), ranges)
    rows = frames.withColumns({"_block": block, "_in": inside & (F.col("frame_id") >= 0)})
    w = in_stream()
    cut = F.when((F.col("_block") > 0) & ~F.lag("_in").over(w), F.col("pts") - F.lag("pts").over(w))
    rows = rows.withColumn("_cut", F.coalesce(cut, F.lit(0)))
    closed = F.col("pts") - F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("pts", closed).where("_in").drop("_block", "_in", "_cut")


def seek(frames: DataFrame, limit: int, margin: int = 0, key: str | None = None) -> DataFrame:
    """Frames less than ``limit + margin`` ticks after the first one of their stream; a limit of 0 or less keeps all.

    With ``key``, a boolean column, time counts from the first key frame, and frames
    before it stay, as do those of a stream without one.
    """
    if limit <= 0:
        return frames
    whole = in_stream().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if key is None:
        first = F.first("pts", ignorenulls=True).over(whole)
        return frames.withColumn("_first", first).where(F.col("pts") - F.col("_first") < limit + margin).drop("_first")
    first = F.first(F.when(F.col(key), F.struct("frame_id", "pts")), ignorenulls=True).over(whole)
    early = F.col("_first").isNull() | (F.col("frame_id") < F.col("_first.frame_id"))
    return frames.withColumn("_first", first).where(early | (F.col("pts") - F.col("_first.pts") < limit + margin)).drop("_first")


def select_every(frames: DataFrame, step: int, offset: int = 0) -> DataFrame:
    """One frame of every ``step``: that at ``offset`` in its group, with the group's first pts and summed duration.

    A last group of ``r`` frames stays only if ``2 * r >= step``, as integers halve, and it
    lasts; its duration is scaled to a full group, and if it has no frame at ``offset`` the
    one chosen before it stands in.
    """
    rows = number_in_stream(frames).withColumn("g", F.floor(F.col("n") / step).cast("long"))
    rows = rows.withColumn("k", F.col("n") % step)
    content = F.struct(*[c for c in frames.columns if c not in ("stream_id", "pts", "duration")])
    groups = rows.groupBy("stream_id", "g").agg(
        F.max(F.when(F.col("k") == offset, content)).alias("c"), F.min_by("pts", "n").alias("pts"), F.sum("duration").alias("duration"), F.count("*").alias("r")
    )
    w = Window.partitionBy("stream_id").orderBy("g")
    groups = groups.withColumn("c", F.coalesce("c", F.lag("c").over(w)))
    whole = F.col("r") == step
    tail = (F.col("r") != step - 1) & (F.col("r") >= step // 2) & (F.col("duration") > 0)
    duration = F.when(whole, F.col("duration")).otherwise(F.expr(f"duration * {step} div r"))
    return groups.where(whole | tail).select("stream_id", "c.*", "pts", duration.alias("duration")).select(*frames.columns)


def decimate(frames: DataFrame, cycle: int = 5, scene_threshold: float = float("inf"), duplicate_threshold: float = 0.0, block_diff: str = "block_diff", total_diff: str = "total_diff", drop: int = 1) -> DataFrame:
    """Drops ``drop`` frames of each ``cycle`` and spreads their time over the others.

    The differences are to the frame before; the first frame of a stream counts as
    infinitely different. Of the frames left the least block difference goes, the first
    on ties; but if it isn't below the duplicate threshold and some frame's total
    difference exceeds the scene threshold, the last such frame goes. In a short last
    cycle, drop ``k`` (from 0) and those after it are left out unless the cycle has
    ``cycle - k`` frames or the drop before the cycle lies more than that back from the end.
    """
    rows = number_in_stream(frames).withColumn("g", F.floor(F.col("n") / cycle).cast("long"))
    inf = F.lit(float("inf"))
    rows = rows.withColumns({"_b": F.when(F.col("n") == 0, inf).otherwise(F.col(block_diff)), "_t": F.when(F.col("n") == 0, inf).otherwise(F.col(total_diff)), "_next": F.lead("pts").over(in_stream())})
    cycles = rows.groupBy("stream_id", "g").agg(F.collect_list(F.struct("_b", "n", "_t")).alias("left"), F.count("*").alias("size"), F.min("pts").alias("front"), F.max("pts").alias("back"))
    for k in range(drop):
        low, scene = F.array_min("left"), F.array_max(F.transform(F.filter("left", lambda x: x["_t"] > scene_threshold), lambda x: x["n"]))
        cycles = cycles.withColumn(f"pick{k}", F.when(scene.isNotNull() & ~(low["_b"] < duplicate_threshold), scene).otherwise(low["n"]))
        cycles = cycles.withColumn("left", F.filter("left", lambda x: x["n"] != F.col(f"pick{k}")))
    picks = [F.col(f"pick{k}") for k in range(drop)]
    before = F.lag(F.array_max(F.array(*picks))).over(Window.partitionBy("stream_id").orderBy("g"))
    cycles = cycles.withColumn("before", F.coalesce(before, F.lit(-1)))
    goes, gone = F.col("size") > 0, []
    for k, pick in enumerate(picks):
        goes = goes & ((F.col("size") == cycle) | (F.col("size") == cycle - k) | (F.col("before") + (cycle - k) < F.col("g") * cycle + F.col("size")))
        gone.append(F.when(goes, pick))
    cycles = cycles.select("stream_id", "g", F.array_compact(F.array(*gone)).alias("gone"), "size", "front", "back")
    rows = rows.join(cycles, ["stream_id", "g"])
    extra = F.when(F.col("size") > 1, F.expr("back + (back - front) * size div (size - 1)")).otherwise(F.col("back"))
    dropped = F.array_contains("gone", F.col("n"))
    lost = F.sum(F.when(dropped, F.coalesce("_next", extra) - F.col("pts"))).over(Window.partitionBy("stream_id", "g"))
    off = (F.col("n") - F.col("g") * cycle) * drop - F.size(F.filter("gone", lambda x: x < F.col("n"))) * cycle
    shifted = rows.withColumns({"_lost": F.coalesce(lost, F.lit(0)), "_off": off}).where(~dropped)
    return shifted.withColumn("pts", F.expr(f"pts + _off * _lost div {drop * (cycle - drop)}")).select(*frames.columns)


def select_tracks(streams: DataFrame, languages: list[str] | None = None, exclude: list[str] | None = None, lang_col: str = "lang") -> DataFrame:
    """Tracks of the languages given (all, if none are) but not of those excluded; a null language is never named."""
    lang = F.lower(F.col(lang_col))
    if languages:
        streams = streams.where(lang.isin([x.lower() for x in languages]))
    if exclude:
        streams = streams.where(~F.coalesce(lang.isin([x.lower() for x in exclude]), F.lit(False)))
    return streams


def select_channels(audio: DataFrame, channels: list[int], samples: str = "samples") -> DataFrame:
    """Splits or merges channels: sample arrays in the order named, silence (null) for channels that aren't there."""
    return audio.withColumn(samples, F.transform(F.array(*[F.lit(c) for c in channels]), lambda c: F.get(F.col(samples), c)))
