"""A logo that fades in and out: how strong it is in each frame, found from the picture, smoothed, and taken off."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import planes
from reelspark.operators.plane_map import map_planes
from reelspark.sources.frames import in_stream

# A logo at its full strength, the strengths that are tried in its sixteenths, and the greatest that is taken.
FULL, TRIED, MOST = 256.0, 33, 1.15
# Strengths below and above which a run of frames counts as gone or full, what such frames are drawn by, and how near to its neighbours a frame stays as it is.
GONE, THERE, DRAW, NEAR = 0.1 * FULL, 0.85 * FULL, 0.7, 0.03
#: A logo goes to every task, so its samples are bounded.
MOST_SAMPLES = 1 << 22


def prewitt(plane: np.ndarray, reach: int) -> np.ndarray:
    """The size of the slope from sums over ``reach`` rows and columns on each side; edges of the plane repeat outwards."""
    padded = np.pad(plane.astype(float), reach, "edge")
    height, width = plane.shape

    def total(a: np.ndarray, axis: int, weights) -> np.ndarray:
        n = height if axis == 0 else width
        return sum(w * np.take(a, np.arange(k, k + n), axis) for k, w in enumerate(weights) if w)

    flat, slope = [1] * (2 * reach + 1), [-1] * reach + [0] + [1] * reach
    return np.hypot(total(total(padded, 1, slope), 0, flat), total(total(padded, 1, flat), 0, slope))


def parabola(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``c0 + c1 x + c2 x^2`` nearest to the points; a line through two and a level through one."""
    out = np.zeros(3)
    n = min(len(x), 3)
    out[:n] = np.polynomial.polynomial.polyfit(x, y, n - 1)
    return out


def _lowest(c: np.ndarray) -> float:
    """Where a parabola is least; of one that bends down the lower of both ends."""
    value = np.polynomial.polynomial.polyval
    if c[2] <= 1e-12:
        return 0.0 if value(0.0, c) < value(FULL, c) else FULL
    return -0.5 * c[1] / c[2]


def least_point(x: np.ndarray, y: np.ndarray) -> float:
    """Where the measure is least: by a parabola on each side of the least point, their lowest places, and where they cross."""
    value = np.polynomial.polynomial.polyval
    k = int(y.argmin())
    if k in (0, len(x) - 1):
        return _lowest(parabola(x, y))
    left, right = parabola(x[:k], y[:k]), parabola(x[k:], y[k:])
    a, b = _lowest(left), _lowest(right)
    found = []
    if x[0] <= a <= x[k]:
        found.append((value(a, left), a))
    if x[k] <= b <= x[-1]:
        found.append((value(b, right), b))
    if len(found) == 1:
        found.append((value(x[k], right if found[0][1] == a else left), float(x[k])))
    best = min(found, default=(np.inf, float(x[k])))
    roots = np.polynomial.polynomial.polyroots(np.trim_zeros(right - left, "b")) if np.any(right - left) else np.zeros(0)
    for r in sorted(v.real for v in np.atleast_1d(roots) if abs(v.imag) < 1e-12):
        if x[0] <= r <= x[-1] and (value(r, right) < best[0] or x[k - 1] < r < x[k + 1]):
            best = (value(r, right), r)
    return float(best[1])


def strength(plane: np.ndarray, logo: np.ndarray, depth: np.ndarray, mask: np.ndarray, peak: int = 255) -> float:
    """How strong the logo is, 0 to 256 and a little more: taken off at that strength it leaves the least edges where it has its own (``mask``)."""
    x = FULL * np.arange(TRIED) / 16
    y = np.empty(TRIED)
    for k, tried in enumerate(x):
        d = np.minimum(depth * tried / FULL, 0.99)
        y[k] = prewitt(np.clip((plane - logo * d) / (1 - d), 0, peak), 2)[mask].sum()
    return float(np.clip(least_point(x, y), 0, MOST * FULL))


def logo_strengths(frames: DataFrame, width: int, logo: np.ndarray, depth: np.ndarray, edge: float = 8.0, plane: str = "plane", peak: int = 255) -> DataFrame:
    """``stream_id, frame_id, plane, strength`` of a logo (rows of samples, and their depths of 0 to 1) that is as large as the planes.

    Only places where the blended logo itself is steeper than ``edge`` are looked at.
    """
    logo, depth = np.asarray(logo, float).reshape(-1, width), np.asarray(depth, float).reshape(-1, width)
    if logo.size > MOST_SAMPLES:
        raise ValueError(f"a logo has {MOST_SAMPLES} samples at most")
    mask = prewitt(logo * depth, 1) > edge
    return map_planes(frames, [plane], lambda p: {"plane": p, "strength": strength(p, logo, depth, mask, peak)}, "plane array<int>, strength double", width)


def _near(column: str, k: int) -> Column:
    """The value ``k`` frames away, or that of the last frame on the way there."""
    side = F.lag if k < 0 else F.lead
    return F.coalesce(*[side(column, j).over(in_stream()) for j in range(abs(k), 0, -1)], F.col(column))


def smooth_strengths(frames: DataFrame, column: str = "strength") -> DataFrame:
    """``frames`` with single frames' strengths drawn to those around.

    Where the logo is gone or full for a while, strengths are drawn towards 0 or 256. Others
    stay if they are within three hundredths of the mean of three frames on one side; else the mean of the
    middle three of five frames decides, downwards only if it is much lower.
    """
    near = {f"_{column}{k}": _near(column, k) for k in (-3, -2, -1, 1, 2, 3)}
    rows = frames.withColumns(near)
    v, at = F.col(column), lambda k: F.col(f"_{column}{k}") if k else F.col(column)
    mean = lambda *ks: sum((at(k) for k in ks[1:]), at(ks[0])) / 3
    past, next_, now = mean(-3, -2, -1), mean(1, 2, 3), mean(-1, 0, 1)
    five = [at(k) for k in range(-2, 3)]
    middle = (sum(five[1:], five[0]) - F.greatest(F.lit(0.0), *five) - F.least(*five)) / 3
    up, close = v + (FULL - v) * DRAW, F.least(F.abs(v - past), F.abs(v - next_)) / v <= NEAR
    lower = F.when(middle >= FULL, FULL).when(middle > THERE, up).when(v < middle * 0.98, middle).otherwise(v)
    above_full = F.when(middle < FULL, FULL).when(v > middle * 1.03, middle).otherwise(v)
    higher = F.when(v >= FULL, above_full).when(middle > THERE, up).when((v < 0.8 * FULL) & (v > middle * 1.15), middle).otherwise(v)
    drawn = F.when(v < middle, lower).when(v > middle, higher).otherwise(v)
    gone, there = F.least(past, next_, now) < GONE, F.greatest(past, next_, now) > THERE
    smooth = F.when(v < GONE, F.when(gone, v * (1 - DRAW)).otherwise(drawn)).when(v > THERE, F.when(there, up).otherwise(drawn)).otherwise(F.when(close, v).otherwise(drawn))
    return rows.withColumn(column, smooth).drop(*near)


def take_off(frames: DataFrame, width: int, logo: np.ndarray, depth: np.ndarray, edge: float = 8.0, plane: str = "plane", peak: int = 255) -> DataFrame:
    """``stream_id, frame_id, strength, plane`` without the logo, at the smoothed strength of each frame."""
    rows = smooth_strengths(logo_strengths(frames, width, logo, depth, edge, plane, peak))
    literal = lambda a: F.split(F.lit(",".join(map(repr, np.asarray(a, float).ravel().tolist()))), ",").cast("array<double>")
    depths = F.transform(literal(depth), lambda d: d * F.col("strength") / FULL)
    return rows.select("stream_id", "frame_id", "strength", planes.denoise_logo(F.col("plane"), literal(logo), depths, peak).alias("plane"))
