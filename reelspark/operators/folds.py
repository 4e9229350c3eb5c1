"""The order-dependent operators, each as the state of one stream."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence
from fractions import Fraction

import numpy as np

from reelspark.operators.fold import Fold


def _cut(a: int, b: int) -> int:
    """Integer division that truncates toward zero."""
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


class RegularizeTimestamps(Fold):
    """Timestamps that rise from 0: as they are (``vfr``) or on a regular grid (``forcecfr``).

    ``nominal`` is a frame's usual duration ``D``. A missing pts continues from the
    frame before. ``forcecfr`` drops frames that come 7/8 ``D`` early, inserts repeats
    where 7/8 ``D`` or more is missing, and moves its origin across gaps of 18000
    ``D``. A time that doesn't rise is moved or, by ``forcecfr``, dropped; one 1024
    ``D`` behind moves the origin. ``field_aware`` is for streams with repeated fields.
    """

    reads = ("pts", "duration")
    gives = "frame_id long, pts long, duration long, inserted boolean"
    LONGEST_GAP, LONGEST_STEP_BACK, FIELD_GAP = 18_000, 1_024, 32

    def __init__(self, nominal: int, mode: str = "vfr", field_aware: bool = False):
        if mode not in ("vfr", "forcecfr"):
            raise ValueError(f"unknown mode {mode}")
        self.d, self.mode, self.field_aware = nominal, mode, field_aware
        self.origin: int | None = None
        self.expected, self.before = 0, -1

    def push(self, row):
        d, pts = self.d, row["pts"]
        duration = row["duration"] if (row["duration"] or 0) > 0 else d
        if self.origin is None:
            self.origin = pts or 0
        ts = pts - self.origin if pts is not None else (self.before + d if self.before >= 0 else 0)
        far, out = max(1, 7 * d // 8), []
        if self.mode == "vfr" and self.field_aware:
            if abs(ts - self.expected) >= self.FIELD_GAP * d:
                self.origin += ts - self.expected
                ts = self.expected
            if ts - self.expected <= -far:
                return []
            self.expected = ts
        if self.mode == "forcecfr":
            if abs(ts - self.expected) >= self.LONGEST_GAP * d:
                self.origin += ts - self.expected
                ts = self.expected
            if ts - self.expected <= -far:
                return []
            while ts - self.expected >= far:
                out.append({"frame_id": row["frame_id"], "pts": self.expected, "duration": d, "inserted": True})
                self.before = self.expected
                self.expected += d
            ts, duration = self.expected, d
        if self.before >= ts:
            if self.before - ts >= self.LONGEST_STEP_BACK * d:
                forward = max(self.expected, self.before + d)
                self.origin += ts - forward
                ts = self.expected = forward
            elif self.mode == "forcecfr":
                return out
            else:
                ts = self.before + max(1, d // 4)
        self.expected += duration
        self.before = ts
        return [*out, {"frame_id": row["frame_id"], "pts": ts, "duration": duration, "inserted": False}]


class DropRepeats(Fold):
    """Drops frames like the last kept one, by 8x8 blocks of ``plane`` (rows of ``width`` samples), or of all ``planes`` (their columns with the widths).

    A frame is alike if no block's absolute difference exceeds ``high`` and at most
    ``share`` of the blocks exceed ``low``. ``keep`` alike frames in a row stay before
    dropping begins; ``most`` > 0 bounds a run of drops, ``most`` < 0 keeps at least
    ``-most`` frames between drops. First and last frame always stay.
    """

    reads = ("plane",)
    gives = "frame_id long, dropped boolean"

    def __init__(self, width: int = 8, high: int = 768, low: int = 320, share: float = 0.33, keep: int = 0, most: int = 0, bitdepth: int = 8, planes: dict[str, int] | None = None):
        self.planes = planes or {"plane": width}
        self.reads = tuple(self.planes)
        self.high, self.low = high << (bitdepth - 8), low << (bitdepth - 8)
        self.share, self.keep, self.most = share, keep, most
        self.kept = self.waiting = None
        self.run, self.drops = 0, 0

    def _blocks(self, row) -> list[np.ndarray]:
        made = [np.asarray(row[name], np.int64).reshape(-1, width) for name, width in self.planes.items()]
        return [np.pad(p, [(0, -n % 8) for n in p.shape]) for p in made]

    def alike(self, planes) -> bool:
        gaps = [np.abs(a - b) for a, b in zip(planes, self.kept)]
        sums = np.concatenate([g.reshape(g.shape[0] // 8, 8, -1, 8).sum((1, 3)).ravel() for g in gaps])
        return bool((sums <= self.high).all() and (sums > self.low).sum() <= int(sums.size * self.share + 0.5))

    def _settle(self, last: bool) -> dict:
        frame, plane = self.waiting
        bounded = (self.most > 0 and self.drops >= self.most) or (self.most < 0 and self.drops - 1 > self.most)
        alike = not bounded and self.alike(plane)
        drop = alike and (self.keep <= 0 or self.run >= self.keep) and not last
        self.run = self.run + 1 if alike else 0
        if drop:
            self.drops = max(1, self.drops + 1)
        else:
            self.drops = min(-1, self.drops - 1)
            self.kept = plane
        return {"frame_id": frame, "dropped": drop}

    def push(self, row):
        plane = self._blocks(row)
        if self.kept is None:
            self.kept = plane
            return [{"frame_id": row["frame_id"], "dropped": False}]
        out = [self._settle(False)] if self.waiting else []
        self.waiting = row["frame_id"], plane
        return out

    def finish(self):
        return [self._settle(True)] if self.waiting else []


class Deflicker(Fold):
    """Gain and offset that draw a frame's mean and deviation of luma to those of the last ``window`` frames.

    A frame whose mean jumps by over ``scene`` deviations of the window and a tenth of
    the range starts a new window and passes as it is. ``damping`` mixes in the
    correction before, also one from before such a start.
    """

    reads = ("mean", "sigma")
    gives = "frame_id long, gain double, offset double, scene_change boolean"

    def __init__(self, window: int = 30, scene: float = 4.0, damping: float = 0.0, bitdepth: int = 8):
        self.scene, self.damping, self.eps, self.peak = scene, damping, 0.5 * (1 << (bitdepth - 8)), (1 << bitdepth) - 1
        self.means: deque = deque(maxlen=window)
        self.sigmas: deque = deque(maxlen=window)
        self.before = None

    def push(self, row):
        mean, sigma = row["mean"], row["sigma"]
        if len(self.means) >= 5:
            centre, spread = float(np.mean(self.means)), float(np.std(self.means))
            jump = abs(mean - centre)
            if spread > 0 and jump > self.scene * spread and jump > 0.10 * self.peak:
                self.means.clear()
                self.sigmas.clear()
                self.means.append(mean)
                self.sigmas.append(sigma)
                return [{"frame_id": row["frame_id"], "gain": 1.0, "offset": 0.0, "scene_change": True}]
        self.means.append(mean)
        self.sigmas.append(sigma)
        gain = math.sqrt(float(np.mean(self.sigmas)) / max(sigma, self.eps))
        offset = float(np.mean(self.means)) - gain * mean
        if self.before and self.damping:
            gain, offset = (self.damping * b + (1 - self.damping) * x for b, x in zip(self.before, (gain, offset)))
        self.before = gain, offset
        return [{"frame_id": row["frame_id"], "gain": gain, "offset": offset, "scene_change": False}]


class SmoothShift(Fold):
    """A damped average of measured shifts that skips those whose normalised trust is below ``threshold``."""

    reads = ("dx", "dy", "trust")
    gives = "frame_id long, x double, y double, accepted boolean"

    def __init__(self, damping: float = 0.9, threshold: float = 0.1, max_shift: float = 64.0):
        self.damping, self.threshold, self.max_shift = damping, threshold, max_shift
        self.at = None

    def push(self, row):
        trusted = row["trust"] / (row["trust"] + 100) >= self.threshold
        if trusted:
            raw = [max(-self.max_shift, min(self.max_shift, row[c])) for c in ("dx", "dy")]
            self.at = raw if self.at is None else [self.damping * a + (1 - self.damping) * r for a, r in zip(self.at, raw)]
        x, y = self.at or (0.0, 0.0)
        return [{"frame_id": row["frame_id"], "x": float(x), "y": float(y), "accepted": trusted}]


class TemporalLowPass(Fold):
    """Every sample drawn toward its last output, by a weight that falls with their difference."""

    reads = ("plane",)
    gives = "frame_id long, plane array<double>"

    def __init__(self, strength: float = 6.0, peak: int = 255):
        self.gamma, self.peak = math.log(0.25) / math.log(1 - min(strength, 252.0) / 255 - 0.00001), peak
        self.before = None

    def push(self, row):
        now = np.asarray(row["plane"], np.float64)
        if self.before is not None:
            gap = self.before - now
            now = now + np.power(np.maximum(0.0, 1 - np.abs(gap) / self.peak), self.gamma) * gap
        self.before = now
        return [{"frame_id": row["frame_id"], "plane": now.tolist()}]


class ChapterKeys(Fold):
    """Key frames at chapters: each frame takes the first chapter left that starts at or before it, one a frame.

    ``chapters``: starts as ticks of ``chapter_base`` seconds; frames tick in
    ``frame_base``. Times are compared exactly.
    """

    reads = ("pts",)
    gives = "frame_id long, chapter int"

    def __init__(self, chapters: Sequence[int], chapter_base: tuple[int, int] = (1, 1000), frame_base: tuple[int, int] = (1, 1_000_000)):
        ratio = Fraction(*chapter_base) / Fraction(*frame_base)
        self.left = [(k, start * ratio) for k, start in enumerate(chapters)]

    def push(self, row):
        for place, (k, start) in enumerate(self.left):
            if row["pts"] is not None and start <= row["pts"]:
                del self.left[place]
                return [{"frame_id": row["frame_id"], "chapter": k}]
        return []


class GrainWindow(Fold):
    """Least-squares coefficients over the statistics of the last ``window`` frames.

    ``lhs`` (row-major, square) and ``rhs`` are a frame's normal equations. A frame that
    isn't reliable empties the window and has no coefficients.
    """

    reads = ("lhs", "rhs", "reliable")
    gives = "frame_id long, used int, coefficients array<double>"

    def __init__(self, window: int = 8, ridge: float = 1e-9):
        self.frames: deque = deque(maxlen=window)
        self.ridge = ridge

    def push(self, row):
        if not row["reliable"]:
            self.frames.clear()
            return [{"frame_id": row["frame_id"], "used": 0, "coefficients": None}]
        n = len(row["rhs"])
        self.frames.append((np.asarray(row["lhs"], float).reshape(n, n), np.asarray(row["rhs"], float)))
        lhs, rhs = sum(x for x, _ in self.frames), sum(y for _, y in self.frames)
        lhs = lhs + np.eye(n) * self.ridge * max(1.0, float(np.trace(lhs)) / n)
        return [{"frame_id": row["frame_id"], "used": len(self.frames), "coefficients": np.linalg.solve(lhs, rhs).tolist()}]


class RepeatFields(Fold):
    """Times of frames whose fields are repeated; at most one field is pending between frames.

    A missing duration is the gap to the pts before, times 3/2 if this frame repeats
    a field and 2/3 if the one before did. ``top_first`` of the output is the input's,
    turned while a field is pending.
    """

    reads = ("pts", "duration", "repeats", "top_first")
    gives = "frame_id long, part int, pts long, duration long, top_first boolean"

    def __init__(self):
        self.pending, self.offset = False, 0
        self.pts, self.repeated = None, False

    def push(self, row):
        pts, duration, repeats = row["pts"], row["duration"] or 0, bool(row["repeats"])
        if duration <= 0 and self.pts is not None:
            duration = pts - self.pts
            if repeats:
                duration = _cut(duration * 3, 2)
            if self.repeated:
                duration = _cut(duration * 2, 3)
        self.pts, self.repeated = pts, repeats
        order = bool(row["top_first"]) != self.pending
        give = lambda part, at, lasts, top: {"frame_id": row["frame_id"], "part": part, "pts": at, "duration": lasts, "top_first": top}
        if not self.pending:
            if repeats:
                self.pending, self.offset = True, -_cut(duration, 3)
            return [give(0, pts, duration + self.offset, order)]
        first = pts + self.offset
        if repeats:
            lasts = _cut(duration * 2, 3)
            rest = duration - self.offset - lasts
            self.pending, self.offset = False, 0
            return [give(0, first, lasts, order), give(1, first + lasts, rest, order)]
        return [give(0, first, duration, order)]


class ChromaGuard(Fold):
    """Which frames an automatic colour correction measures, and their mean chroma so far.

    After ``warm_up`` accepted frames one is skipped if its luma variance is above
    ``threshold`` times the accepted mean or below a tenth of it over ``threshold``;
    above 20 times the mean, the mean starts again from that frame.
    """

    reads = ("variance", "u", "v")
    gives = "frame_id long, accepted boolean, mean_u double, mean_v double"

    def __init__(self, threshold: float = 3.0, warm_up: int = 60, bitdepth: int = 8):
        self.threshold, self.warm_up, self.floor = threshold, warm_up, float(100 << (2 * (bitdepth - 8)))
        self.count, self.variance, self.measured = 0, 0.0, 0
        self.u = self.v = 0.0

    def push(self, row):
        ok, v = True, row["variance"]
        if self.count >= self.warm_up:
            mean = max(self.floor, self.variance / self.count)
            if v > self.threshold * mean or v < 0.1 * mean / self.threshold:
                ok = False
                if v > 20 * mean:
                    self.count, self.variance = 1, v
        if ok:
            self.count, self.variance, self.measured = self.count + 1, self.variance + v, self.measured + 1
            self.u, self.v = self.u + row["u"], self.v + row["v"]
        n = self.measured
        return [{"frame_id": row["frame_id"], "accepted": ok, "mean_u": self.u / n if n else None, "mean_v": self.v / n if n else None}]


class CadenceTracker(Fold):
    """Locks on to the cadence of field matches (``c`` or ``n`` per frame) and predicts the next one.

    The last five matches are set against each rotation of the pattern; the best count
    wins, the first on ties. Four or more locks, and a new or other phase lifts the
    confidence to 4 at least; with fewer, lock and phase hold while confidence (2 up for
    a right prediction, 1 down for a wrong one) is 4 or more.
    """

    reads = ("match",)
    gives = "frame_id long, phase int, locked boolean, confidence int, predicted string"
    # The cadences by guide.
    PATTERNS = {1: "CCCNN", 2: "CN"}

    def __init__(self, guide: int = 1):
        self.pattern = self.PATTERNS[guide]
        self.last: deque = deque(maxlen=5)
        self.phase, self.locked, self.confidence, self.predicted = -1, False, 0, None

    def push(self, row):
        symbol, n = row["match"].upper(), len(self.pattern)
        if self.predicted is not None:
            self.confidence = min(255, self.confidence + 2) if symbol == self.predicted else max(0, self.confidence - 1)
        self.last.append(symbol)
        if len(self.last) == 5:
            counts = [sum(s == self.pattern[(i + r) % n] for i, s in enumerate(self.last)) for r in range(n)]
            best = max(counts)
            if best >= 4:
                phase = counts.index(best)
                if not self.locked or phase != self.phase:
                    self.confidence = max(self.confidence, 4)
                self.locked, self.phase = True, phase
            elif self.confidence < 4:
                self.locked = False
        self.predicted = self.pattern[(4 + self.phase + 1) % n] if self.locked else None
        return [{"frame_id": row["frame_id"], "phase": self.phase if self.locked else None, "locked": self.locked, "confidence": self.confidence, "predicted": self.predicted}]


class ReorderByPts(Fold):
    """Puts packets in order of pts with a buffer of ``depth``; ``poc`` numbers them, repeats of a pts have none."""

    reads = ("pts",)
    gives = "frame_id long, pts long, poc long"

    def __init__(self, depth: int = 16):
        self.depth, self.held, self.count, self.before = depth, [], 0, None

    def _out(self, pts, frame) -> dict:
        fresh = pts is not None and pts != self.before
        self.before = pts if pts is not None else self.before
        self.count += fresh
        return {"frame_id": frame, "pts": pts, "poc": self.count - 1 if fresh else None}

    def push(self, row):
        if row["pts"] is None:
            return [self._out(None, row["frame_id"])]
        self.held = sorted([*self.held, (row["pts"], row["frame_id"])])
        return [self._out(*self.held.pop(0))] if len(self.held) > self.depth + 1 else []

    def finish(self):
        return [self._out(*x) for x in self.held]
