"""Interlaced frames made progressive, one per frame or one per field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions import spatial
from reelspark.operators.fold import Fold
from reelspark.sources.frames import in_stream


def field_times(frames: DataFrame, usual_duration: int = 0) -> DataFrame:
    """Each frame twice, as ``field`` 0 and 1, with its duration halved (the odd tick goes to the first).

    A frame without a duration lasts as long as the gap to the frame before it, the
    first one of a stream ``usual_duration`` ticks.
    """
    gap = F.coalesce(F.col("pts") - F.lag("pts").over(in_stream()), F.lit(usual_duration)).cast("long")
    whole = frames.withColumn("_whole", F.when(F.coalesce(F.col("duration"), F.lit(0)) == 0, gap).otherwise(F.col("duration")))
    first = F.expr("(_whole + 1) div 2")
    both = whole.withColumn("field", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_first", first)
    later = F.col("field") == 1
    return both.withColumns({"pts": F.col("pts") + F.when(later, F.col("_first")).otherwise(0), "duration": F.when(later, F.col("_whole") - F.col("_first")).otherwise(F.col("_first"))}).drop("_whole", "_first")


def deinterlace(frames: DataFrame, width: int, height: int, method: str = "yadif", top_first: bool | str = True, per_field: bool = False, plane: str = "plane", usual_duration: int = 0, **options) -> DataFrame:
    """Frames with ``plane`` deinterlaced by ``yadif`` or ``bwdif``; ``per_field`` gives two per frame, with ``field`` and their times.

    ``top_first`` is the order of all frames' fields or the column that has each frame's
    (null: the top one first). The frames before the first and after the last one of a
    stream are these themselves. Other columns stay.
    """
    make = {"yadif": spatial.yadif, "bwdif": spatial.bwdif}[method]
    now, w = F.col(plane), in_stream()
    rows = frames.withColumns({"_before": F.coalesce(F.lag(plane).over(w), now), "_after": F.coalesce(F.lead(plane).over(w), now)})

    def field(second: bool):
        of = lambda top: make(F.col("_before"), now, F.col("_after"), width, height, bottom=top != second, second=second, **options)
        return F.when(F.coalesce(F.col(top_first), F.lit(True)), of(True)).otherwise(of(False)) if isinstance(top_first, str) else of(top_first)

    if not per_field:
        return rows.withColumn(plane, field(False)).drop("_before", "_after")
    made = F.when(F.col("field") == 0, field(False)).otherwise(field(True))
    return field_times(rows, usual_duration).withColumn(plane, made).drop("_before", "_after")


def multiply_frames(frames: DataFrame, times: int = 2) -> DataFrame:
    """Each frame but the first with ``times - 1`` frames in between before it: ``part`` counts them from 1, the frame itself is ``times``; ``position`` is the way from the frame before.

    Frames in between lie at even parts of the way, rounded down, and all last the whole
    part; where time doesn't move on they have the time before and the frame's duration.
    The first frame of a stream stays as it is.
    """
    before = F.lag("pts").over(in_stream())
    rows = frames.withColumns({"_before": before, "_span": F.col("pts") - before})
    rows = rows.withColumn("part", F.explode(F.when(F.col("_before").isNull(), F.array(F.lit(times))).otherwise(F.sequence(F.lit(1), F.lit(times)))))
    moves, own = F.col("_span") > 0, F.col("part") == times
    between = F.col("_before") + F.when(moves, F.expr(f"_span * part div {times}")).otherwise(0)
    return rows.withColumns({"pts": F.when(own, F.col("pts")).otherwise(between), "duration": F.when(moves, F.expr(f"_span div {times}")).otherwise(F.col("duration")), "position": F.col("part") / times}).drop("_before", "_span")


class RateConversion(Fold):
    """Frames at an even distance of ``ticks`` (a fraction) from one another, or one between each two (``ticks`` None).

    A place within an eighth of the distance of a frame takes that frame as it is; the next
    places count from there. ``position`` is the way from the frame before to this one; a
    row lasts as long as the way from the row before, the first one its own duration.
    """

    reads = ("pts", "duration")
    gives = "frame_id long, part int, pts long, duration long, position double, copied boolean"

    def __init__(self, ticks: tuple[int, int] | None = None):
        self.ticks, self.last, self.before = ticks, None, None

    def push(self, row):
        now, out = row["pts"], []
        give = lambda part, at, lasts, copied: {"frame_id": row["frame_id"], "part": part, "pts": at, "duration": lasts, "position": 1.0 if copied else (at - self.before) / (now - self.before), "copied": copied}
        if self.last is None:
            self.last = self.before = now
            return [give(0, now, row["duration"], True)]
        base = self.last
        for k in range(1, 1 << 40):
            if self.ticks is None:
                way = k * (now - base)
                at, near = base + (abs(way) // 2 if way >= 0 else -(abs(way) // 2)), k == 2
            else:
                a, b = self.ticks
                at = base + (2 * k * a + b) // (2 * b)
                near = abs(at - now) <= max((2 * a + 8 * b) // (16 * b), 1)
            if not near and at > now:
                break
            out.append(give(k, at, at - self.last, near))
            self.last = at
            if near:
                break
        self.before = now
        return out
