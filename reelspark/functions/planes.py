"""Pixel operations on planes (arrays of samples, row by row) as column expressions that stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _code(x: Column, peak: int) -> Column:
    """Rounded to the nearest sample value, halves up, within 0 to ``peak``."""
    return F.greatest(F.lit(0), F.least(F.lit(peak), F.floor(x + 0.5))).cast("int")


def tweak(plane: Column, brightness: float = 0.0, contrast: float = 1.0, gamma: float = 1.0, peak: int = 255) -> Column:
    """Contrast about the middle, then brightness as a part of the range, then gamma."""
    half = (peak + 1) / 2

    def one(x: Column) -> Column:
        y = (x - half) * contrast + half + brightness * peak
        if gamma != 1.0:
            y = F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), y / peak)), F.lit(1 / gamma)) * peak
        return _code(y, peak)

    return F.transform(plane, one)


def curve_table(points: Sequence[tuple[float, float]], peak: int = 255, monotone: bool = False, hold_last: bool = True) -> list[int]:
    """The output code of each input code for cubics through ``points`` (0 to 1 both ways), flat beyond the ends and rounded down.

    A point at 1 lies a code beyond ``peak``. As in the reference, ``peak`` takes that
    point's value nevertheless; without ``hold_last`` it takes the cubic's.

    The cubics are splines with straight ends whose bends are a sixth of a natural
    spline's, so slopes may break at the points; with ``monotone`` they are Hermite
    pieces whose slopes are weighted harmonic means (none at a turning point), which
    never overshoot.
    """
    x, y = np.array(sorted(points), float).T
    h = np.diff(x)
    slope = np.diff(y) / h
    if monotone:
        turns = slope[:-1] * slope[1:] <= 0
        near, far = h[:-1] + 2 * h[1:], 2 * h[:-1] + h[1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            inner = np.where(turns, 0.0, (near + far) / (near / slope[:-1] + far / slope[1:]))
        tangent = np.concatenate([slope[:1], inner, slope[-1:]])
        first, second, third = tangent[:-1], (3 * slope - 2 * tangent[:-1] - tangent[1:]) / h, (tangent[:-1] + tangent[1:] - 2 * slope) / h**2
    else:
        bend = np.zeros(len(x))
        if len(x) > 2:
            bend[1:-1] = np.linalg.solve(np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1), np.diff(slope))
        first, second, third = slope - h * bend[:-1] / 2 - h * np.diff(bend) / 6, bend[:-1] / 2, np.diff(bend) / (6 * h)
    codes = lambda v: np.clip(np.trunc(v * (peak + 1)), 0, peak).astype(int)
    at = codes(x)
    table = np.full(peak + 1, codes(y[0]))
    for k, (low, high) in enumerate(zip(at, at[1:])):
        u = np.arange(high - low + 1) / (peak + 1)
        table[low : high + 1] = codes(y[k] + u * (first[k] + u * (second[k] + u * third[k])))
    table[at[-1] + (not hold_last) :] = codes(y[-1])
    return table.tolist()


def curves(plane: Column, points: Sequence[tuple[float, float]], peak: int = 255, monotone: bool = False, hold_last: bool = True) -> Column:
    """Samples sent through ``curve_table``."""
    table = F.split(F.lit(",".join(map(str, curve_table(points, peak, monotone, hold_last)))), ",").cast("array<int>")  # folded to one literal
    return F.transform(plane, lambda v: F.get(table, v.cast("int")))


def _at(plane: Column, width: int, height: int, x: Column, y: Column) -> Column:
    """A sample, with the edges repeated outwards."""
    clamp = lambda v, most: F.greatest(F.lit(0), F.least(F.lit(most), v))
    return F.get(plane, clamp(y, height - 1) * width + clamp(x, width - 1))


def _each(count: int, use) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), use)


def pad(plane: Column, width: int, height: int, left: int, top: int, right: int, bottom: int, value: int = 0) -> Column:
    """A border of ``value`` around the plane."""
    wide = width + left + right
    inside = lambda x, y: (x >= 0) & (x < width) & (y >= 0) & (y < height)

    def one(i: Column) -> Column:
        x, y = i % wide - left, F.floor(i / wide).cast("int") - top
        return F.when(inside(x, y), F.get(plane, y * width + x)).otherwise(F.lit(value))

    return _each(wide * (height + top + bottom), one)


def crop(plane: Column, width: int, height: int, left: int, top: int, right: int, bottom: int) -> Column:
    kept = width - left - right
    return _each(kept * (height - top - bottom), lambda i: F.get(plane, (F.floor(i / kept).cast("int") + top) * width + i % kept + left))


def turn(plane: Column, width: int, height: int, flip_x: bool = False, flip_y: bool = False, transpose: bool = False) -> Column:
    """Flips, then transposes if asked; the transposed plane is ``height`` wide."""
    wide = height if transpose else width

    def one(i: Column) -> Column:
        x, y = i % wide, F.floor(i / wide).cast("int")
        if transpose:
            x, y = y, x
        x, y = (width - 1 - x if flip_x else x), (height - 1 - y if flip_y else y)
        return F.get(plane, y * width + x)

    return _each(width * height, one)


def convolve(plane: Column, width: int, height: int, kernel: Sequence[Sequence[float]], peak: int = 255) -> Column:
    """An odd square kernel applied to every sample, edges repeated."""
    r = len(kernel) // 2

    def one(i: Column) -> Column:
        x, y = i % width, F.floor(i / width).cast("int")
        total = F.lit(0.0)
        for dy, row in enumerate(kernel):
            for dx, weight in enumerate(row):
                total = total + _at(plane, width, height, x + (dx - r), y + (dy - r)) * float(weight)
        return _code(total, peak)

    return _each(width * height, one)


def gauss_kernel(size: int, sigma: float | None = None) -> list[list[float]]:
    sigma = sigma or 0.3 * ((size - 1) / 2 - 1) + 0.8
    line = [math.exp(-((k - size // 2) ** 2) / (2 * sigma**2)) for k in range(size)]
    total = sum(line) ** 2
    return [[a * b / total for a in line] for b in line]


def gauss(plane: Column, width: int, height: int, size: int = 3, peak: int = 255) -> Column:
    return convolve(plane, width, height, gauss_kernel(size), peak)


def unsharp(plane: Column, width: int, height: int, radius: int = 1, weight: float = 0.5, threshold: float = 10.0, peak: int = 255) -> Column:
    """Adds ``weight`` times the difference to the blurred plane where that exceeds ``threshold``."""
    blurred = convolve(plane, width, height, gauss_kernel(2 * radius + 1), peak)
    return F.zip_with(plane, blurred, lambda a, b: F.when(F.abs(a - b) > threshold, _code(a + (a - b) * weight, peak)).otherwise(a))


def temporal_convolve(before: Column, now: Column, after: Column, weights: tuple[float, float, float] = (0.25, 0.5, 0.25), threshold: int = 255, peak: int = 255) -> Column:
    """A weighted mean with the frames on both sides; neighbours that differ by more than ``threshold`` count as the sample itself."""
    zipped = F.zip_with(F.zip_with(before, now, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), after, lambda s, c: F.struct(s["a"].alias("a"), s["b"].alias("b"), c.alias("c")))
    near = lambda x, b: F.when(F.abs(x - b) > threshold, b).otherwise(F.coalesce(x, b))
    return F.transform(zipped, lambda s: _code(near(s["a"], s["b"]) * weights[0] + s["b"] * weights[1] + near(s["c"], s["b"]) * weights[2], peak))


def _soft(a: Column, b: Column, formula: str) -> Column:
    """Soft light of ``a`` under ``b``, both 0 to 1: the formulas of common image editors by name."""
    if formula == "pegtop":
        return (1 - 2 * b) * a * a + 2 * b * a
    if formula == "illusionshu":
        return F.pow(a, F.pow(F.lit(2.0), 1 - 2 * b))
    if formula == "w3c":
        curve = F.when(a <= 0.25, ((16 * a - 12) * a + 4) * a).otherwise(F.sqrt(a))
        return F.when(b <= 0.5, a - (1 - 2 * b) * a * (1 - a)).otherwise(a + (2 * b - 1) * (curve - a))
    raise ValueError(f"unknown formula {formula}")


def soft_light(plane: Column, formula: str = "pegtop", skip_black: bool = False, peak: int = 255) -> Column:
    """Takes a colour plane's cast away: soft light under one less its mean, which with ``skip_black`` leaves samples of 0 out."""
    counted = F.size(F.filter(plane, lambda v: v != 0)) if skip_black else F.size(plane)
    total = F.aggregate(plane, F.lit(0).cast("long"), lambda s, v: s + v)
    blend = 1 - F.when(counted > 0, total / counted / float(peak)).otherwise(F.lit(0.0))
    # Bound in an array of one, so that the mean is taken once a plane and not once a sample.
    return F.get(F.transform(F.array(blend), lambda b: F.transform(plane, lambda v: _code(_soft(v / float(peak), b, formula) * peak, peak))), F.lit(0))


def soft_light_boost(plane: Column, formula: str = "pegtop", peak: int = 255) -> Column:
    """Soft light of every sample under itself, which raises contrast."""
    return F.transform(plane, lambda v: _code(_soft(v / float(peak), v / float(peak), formula) * peak, peak))


def denoise_logo(plane: Column, logo: Column, depth: Column, peak: int = 255) -> Column:
    """Takes a known logo off: undoes its blending at a depth of 0 to 1 per sample; a depth of 1 or more leaves the sample."""
    both = F.zip_with(logo, depth, lambda c, d: F.struct(c.alias("c"), d.alias("d")))
    return F.zip_with(plane, both, lambda x, l: F.when((l["d"] <= 0) | (l["d"] >= 1), x).otherwise(_code((x - l["c"] * l["d"]) / (1 - l["d"]), peak)))
