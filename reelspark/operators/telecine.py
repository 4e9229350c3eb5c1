"""Inverse telecine: the field pairing of each frame, and the frame of each cycle that goes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelspark.operators.fold import Fold
from reelspark.operators.folds import CadenceTracker
from reelspark.sources.frames import in_stream

PAIRINGS = "cpn"
#: A block's width and height for scores.
BLOCK = (32, 8)
# Mean combed samples of a block from which a frame is beyond repair by pairing, from which a cleaner pairing is looked
# for, what it must gain, the spread within which pairings count as equal, how near the last pairing must be to stay, and how many
# times cleaner the frame must be with its field order turned.
COMBED, RESCUE, GAIN, PLATEAU, NEAR, CLEARLY = 65, 40, 8, 10, 6, 3
# The least, usual and greatest share of the possible difference that makes a scene change, and its growth over the frame before.
SCENE_LEAST, SCENE_USUAL, SCENE_MOST, SCENE_GROWTH = 0.12, 0.15, 0.30, 1.5


def weave(before: np.ndarray, now: np.ndarray, after: np.ndarray, pairing: str, top_first: bool = True) -> np.ndarray:
    """The frame (rows of samples) of a pairing: ``c`` as it is, ``p`` with the second field of the frame before, ``n`` with the first field of the frame after."""
    first = 0 if top_first else 1
    if pairing == "c":
        return now
    out = now.copy()
    if pairing == "p":
        out[1 - first :: 2] = before[1 - first :: 2]
    else:
        out[first::2] = after[first::2]
    return out


def _by_block(values: np.ndarray) -> np.ndarray:
    across, down = BLOCK
    return np.add.reduceat(np.add.reduceat(values, np.arange(0, values.shape[0], down), 0), np.arange(0, values.shape[1], across), 1)


def combing(frame: np.ndarray, top_first: bool, noise: int, threshold: int, combed_samples: int) -> tuple[int, int, int, int]:
    """``(combed blocks, most combed samples in a block, combed, difference)`` of a woven frame.

    Rows of the first field are set against the rows between them. The last two are
    means over the blocks above four times the noise, 0 if there is but one.
    """
    first = 0 if top_first else 1
    v = frame.astype(np.int64)
    rows = np.arange(first, v.shape[0] - 4, 2)
    gap, comb = np.zeros_like(v), np.zeros_like(v)
    a, b, c, d, e = (v[rows + k] for k in range(5))
    diff = np.abs(b - (a + c + 1 >> 1)) + np.abs(d - (c + e + 1 >> 1))
    gap[rows] = np.where(diff > noise, diff, 0)
    comb[rows] = (np.abs(b - a) > threshold) & (np.abs(b - c) > threshold) & ((b < a) == (b < c))
    gap, comb = _by_block(gap), _by_block(comb)
    least = max(4, 4 * noise)
    mean = lambda x: int(x[x > least].sum() // n) if (n := int((x > least).sum())) > 1 else 0
    return int((comb >= combed_samples).sum()), int(comb.max(initial=0)), mean(comb), mean(gap)


class FieldMatch(Fold):
    """The best of three field pairings per frame, the frame woven from it, and its difference to the woven frame before.

    Pairings are ranked by combed blocks, the most combed block, combing, and difference.
    Where all three comb about alike, combing comes first and the last pairing stays if it is near;
    a pairing that combs in few blocks yields to one that combs clearly less. ``guide`` 1
    follows the 3:2 cadence: a predicted pairing wins if its difference lies within
    ``tolerance`` percent; 2 alternates ``c`` and ``n``; 0 does neither. At a scene change,
    by a share ``scene`` of the possible difference (0: adapts), the pairing is ``c`` and
    the cadence starts again. ``width`` is that of ``plane``; ``top_first`` may be null for
    the usual order. The first and last frame stand in for their missing neighbours.
    """

    reads = ("plane", "pts", "top_first")
    gives = "frame_id long, pts long, pairing string, scene_change boolean, diff long, plane array<int>"

    def __init__(self, width: int, guide: int = 1, tolerance: int = 10, noise: int = 10, threshold: int = 4, combed_samples: int = 8, scene: float = 0.0, bitdepth: int = 8, top_first: bool = True):
        self.width, self.guide, self.tolerance, self.scene, self.usual = width, guide, tolerance, scene, top_first
        self.peak = (1 << bitdepth) - 1
        scaled = lambda x: max(1, self.peak * max(0, x) // 255)
        self.limits = scaled(noise), scaled(threshold), max(1, combed_samples)
        self.cadence = CadenceTracker(1)
        self.frames: list[tuple[dict, np.ndarray]] = []  # the frame before and the one that waits
        self.count, self.last, self.last_sad, self.woven = 0, None, 0, None

    def push(self, row):
        plane = np.asarray(row["plane"], np.int32).reshape(-1, self.width)
        out = self._settle(plane) if self.frames else []
        self.frames = [*self.frames[-1:], (row, plane)]
        return out

    def finish(self):
        return self._settle(self.frames[-1][1]) if self.frames else []

    def _settle(self, after: np.ndarray) -> list[dict]:
        row, now = self.frames[-1]
        before = self.frames[0][1]
        top_first = self.usual if row["top_first"] is None else bool(row["top_first"])
        sad, changed = 0, False
        if len(self.frames) > 1:
            sad = int(np.abs(now.astype(np.int64) - before).sum())
            possible = now.size * self.peak
            share = self.scene
            if share <= 0:
                share = min(max(self.last_sad / possible * SCENE_GROWTH, SCENE_LEAST), SCENE_MOST) if self.last_sad > 1 else SCENE_USUAL
            changed = sad > int(possible * share)
        if changed:
            self.cadence, pairing = CadenceTracker(1), "c"
        elif self.guide == 2:
            pairing = "n" if self.count % 2 else "c"
        else:
            pairing = self._choose(before, now, after, top_first)
        self.count, self.last, self.last_sad = self.count + 1, pairing, sad
        made = weave(before, now, after, pairing, top_first)
        diff = None if self.woven is None else int(np.abs(made.astype(np.int64) - self.woven).sum())
        self.woven = made
        return [{"frame_id": row["frame_id"], "pts": row["pts"], "pairing": pairing, "scene_change": changed, "diff": diff, "plane": made.ravel()}]

    def _choose(self, before, now, after, top_first) -> str:
        read = lambda p, first: combing(weave(before, now, after, p, first), first, *self.limits)
        scores = [read(p, first) for first in (top_first, not top_first) for p in PAIRINGS]  # behind the three as they are those with the fields' order turned
        best, last = min(range(3), key=scores.__getitem__), PAIRINGS.index(self.last) if self.last else None
        combed = [s[2] for s in scores]
        least = min(combed[:3])
        if max(combed[:3]) - least <= PLATEAU and least < COMBED:
            best = min(range(3), key=lambda k: (combed[k], *scores[k][:2], scores[k][3]))
            if last is not None and combed[last] <= least + NEAR:
                best = last
        pick, first = best, min(range(6), key=scores.__getitem__)
        if first == 3 and combed[best] >= COMBED and (combed[3] == 0 or combed[3] * CLEARLY < combed[best]):
            pick = 3  # the frame as it is, which turning doesn't change
        if combed[best] >= RESCUE and scores[pick][0] > 0 and combed[pick] < COMBED:
            cleaner = min([pick, *range(6)], key=lambda k: scores[k][:3])
            if cleaner < 3 and (scores[cleaner][0] == 0 or combed[cleaner] + GAIN < combed[pick]):
                pick = cleaner
        if self.guide != 1:
            return PAIRINGS[pick % 3]
        if self.last == "n" and pick == 1:
            pick = 0 if scores[0] < scores[2] else 2
        pick %= 3
        predicted = self.cadence.push({"frame_id": None, "match": PAIRINGS[pick]})[0]["predicted"]
        if predicted and self.tolerance > 0:
            k = PAIRINGS.index(predicted.lower())
            asked = scores[k][3]
            if asked == 0 or abs(asked - scores[pick][3]) * 100 < asked * min(self.tolerance, 100):
                pick = k
        return PAIRINGS[pick]


def drop_of_cycle(frames: DataFrame, cycle: int = 5, rate: tuple[int, int] = (24000, 1001), ticks: int = 1_000_000, diff: str = "diff") -> DataFrame:
    """One frame of each whole cycle goes, the one least unlike the frame before it, and the rest get even times at ``rate``.

    ``synthetic``, if there is such a column, marks frames that go before others. Ties go
    to the first; a null ``diff`` is the greatest. Times count from the stream's first pts, or
    0 where a frame of the first cycle has none, and are rounded to the nearest tick, so
    that cycles of any length in time follow on each other without drift.
    """
    number = F.row_number().over(in_stream()) - 1
    made = F.col("synthetic") if "synthetic" in frames.columns else F.lit(False)
    w = Window.partitionBy("stream_id", "_g")
    rows = frames.withColumn("_n", number.cast("long")).withColumn("_g", F.expr(f"_n div {cycle}"))
    order = F.struct(~F.coalesce(made, F.lit(False)), F.coalesce(F.col(diff).cast("long"), F.lit(2**63 - 1)), "_n")
    rows = rows.withColumns({"_size": F.count("*").over(w), "_out": F.min(order).over(w)["_n"], "_gone": F.sum(F.col("pts").isNull().cast("long")).over(w)})
    whole = F.col("_size") == cycle
    stream = Window.partitionBy("stream_id")
    seed = F.when(F.max(F.when(F.col("_n") == 0, F.col("_gone"))).over(stream) > 0, 0).otherwise(F.max(F.when(F.col("_n") == 0, F.col("pts"))).over(stream))
    rows = rows.withColumns({"_seed": seed, "_k": F.col("_n") - F.col("_g") - F.when(whole & (F.col("_n") > F.col("_out")), 1).otherwise(0)})
    a, b = rate[1] * ticks, rate[0]
    at = lambda k: F.expr(f"(2 * ({k}) * {a} + {b}) div {2 * b}")
    kept = rows.where(~(whole & (F.col("_n") == F.col("_out"))))
    lasts = F.greatest(at("_k + 1") - at("_k"), F.lit(1))
    return kept.withColumns({"pts": F.col("_seed") + at("_k"), "duration": lasts}).drop("_n", "_g", "_size", "_out", "_gone", "_seed", "_k")


class FieldShift(Fold):
    """Times of frames whose fields were shifted, in quarters of a frame, and which frames go.

    ``status`` has the bits SHIFT0 to SHIFT2 (1, 2, 4), DROP (16; with PROGRESSIVE: repeated
    field), SMOOTHING (32), FORCE24 (64) and PROGRESSIVE (128); ``pts`` has four ticks a frame.
    A frame is moved by its own and the last shift; it goes if it comes to lie before the frame
    it follows, or by the rule of five that makes 24 frames of 30. Its duration is the way
    to the next frame that stays, up to three on, so rows come three frames late. Behind
    the end time goes on at the mean duration with the last status.
    """

    reads = ("status", "pts")
    gives = "frame_id long, pts long, duration long, dropped boolean"
    # The bits.
    SHIFT0, SHIFT1, SHIFT2, DROP, SMOOTHING, FORCE24, PROGRESSIVE = 1, 2, 4, 16, 32, 64, 128
    AHEAD = 3

    def __init__(self):
        self.count = self.before = self.jitter = self.extra = self.smooth = self.position = 0
        self.phase, self.held, self.row = 4, [], None

    def _repeated(self, status: int) -> bool:
        return bool(status & self.PROGRESSIVE and status & self.DROP)

    def _late_second(self, status: int) -> bool:
        return not status & self.SHIFT0 and bool(status & self.SHIFT1 and status & self.SHIFT2)

    def _begin(self, status: int) -> None:
        self.before = status
        if self._late_second(status):
            self.phase = 0
        if status & self.FORCE24:
            self.position += 1
        else:
            self.phase, self.position = self.phase - self.position - 1, 0

    def _place(self, status: int, pts: int) -> int | None:
        """Where the frame comes to lie; None if it goes."""
        n, self.count = self.count, self.count + 1
        if n == 0:
            self._begin(status)
            return pts
        progressive, forced, smoothing, last = bool(status & self.PROGRESSIVE), bool(status & self.FORCE24), bool(status & self.SMOOTHING), self.before
        smooth = 0
        if (forced or smoothing) and not self.smooth:
            smooth = -1 if self._repeated(last) else 1 if last & self.PROGRESSIVE and self._repeated(status) else 0
        by_field, by_rule = False, n <= 2 and not progressive  # the rule's phase is set anew by the two frames behind the first
        if progressive:
            move, self.extra = smooth, 0
        else:
            move = -2 if status & self.SHIFT0 else (-1 if smoothing else -2) if last & self.SHIFT0 else 0
            move += self.extra if smoothing or self.extra != -1 else -2
            move += smooth
            self.position += smooth
            by_field = bool(status & self.DROP) and not (last | status) & self.SHIFT0 and bool(status & self.SHIFT1)
            self.extra = -1 if by_field else 0
            by_rule = by_rule or self._late_second(status)
        if by_rule:
            self.phase = (self.position + 100) % 5
        fifth = self.position >= self.phase and self.phase in ((self.position + 100) % 5, (self.position + 99) % 5)
        if fifth:
            self.position -= 5
        if forced:
            by_field = fifth
            if progressive:
                move += self.position
            else:
                move, self.position = self.position, self.position + 1
        elif not progressive:
            self.phase, self.position = self.phase - self.position - 1, 0
        lenient = not status & self.DROP or not progressive and self._repeated(last)
        goes = move - self.jitter < (-3 if lenient else 0) or by_field
        self.smooth, self.before = smooth, status
        if goes:
            self.jitter -= 4
            return None
        self.jitter = move
        return pts + move

    def _first(self) -> dict:
        frame, at = self.held.pop(0)
        later = [p for _, p in self.held[: self.AHEAD] if p is not None and p >= 0]
        lasts = later[0] - at if at is not None and at >= 0 and later else 0
        stays = lasts > 0
        return {"frame_id": frame, "pts": at if stays else None, "duration": lasts if stays else None, "dropped": not stays}

    def push(self, row):
        self.row = row
        self.held.append((row["frame_id"], self._place(row["status"], row["pts"])))
        return [self._first()] if len(self.held) > self.AHEAD else []

    def finish(self):
        if self.row is None:
            return []
        n, out = self.count, []
        mean = (self.row["pts"] + n // 2) // n
        for k in range(1, self.AHEAD + 1):
            self.held.append((None, self._place(self.row["status"], self.row["pts"] + k * mean)))
            if len(self.held) > self.AHEAD:
                out.append(self._first())
        while self.held and self.held[0][0] is not None:
            out.append(self._first())
        return out
