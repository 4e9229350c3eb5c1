"""Colour conversions as a short list of steps that are folded before they become one expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from reelspark.functions.spatial import bound

# Luma weights of red and blue by matrix name.
LUMA = {"bt601": (0.299, 0.114), "bt709": (0.2126, 0.0722), "bt2020nc": (0.2627, 0.0593)}
# Chromaticities of red, green, blue and white by name.
PRIMARIES = {
    "bt601": ((0.630, 0.340), (0.310, 0.595), (0.155, 0.070), (0.3127, 0.3290)),
    "bt709": ((0.640, 0.330), (0.300, 0.600), (0.150, 0.060), (0.3127, 0.3290)),
    "bt2020nc": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046), (0.3127, 0.3290)),
}


@dataclass(frozen=True)
class Matrix:
    """Three channels times a matrix, plus an offset."""

    m: tuple[tuple[float, ...], ...]
    offset: tuple[float, ...] = (0.0, 0.0, 0.0)


@dataclass(frozen=True)
class PerChannel:
    """A function of each channel for itself."""

    name: str
    of: Callable[[Column], Column]


def rgb_to_yuv(name: str) -> Matrix:
    r, b = LUMA[name]
    g = 1 - r - b
    return Matrix(((r, g, b), (-r / (2 * (1 - b)), -g / (2 * (1 - b)), 0.5), (0.5, -g / (2 * (1 - r)), -b / (2 * (1 - r)))))


def inverse(step: Matrix) -> Matrix:
    m = np.linalg.inv(np.array(step.m))
    return Matrix(tuple(map(tuple, m)), tuple(-(m @ np.array(step.offset))))


def rgb_to_xyz(name: str) -> Matrix:
    *rgb, white = PRIMARIES[name]
    cols = np.array([[x / y, 1.0, (1 - x - y) / y] for x, y in rgb]).T
    w = np.array([white[0] / white[1], 1.0, (1 - white[0] - white[1]) / white[1]])
    return Matrix(tuple(map(tuple, cols * np.linalg.solve(cols, w))))


def power(exponent: float) -> PerChannel:
    return PerChannel(f"power {exponent}", lambda x: F.signum(x) * F.pow(F.abs(x), F.lit(exponent)))


def hable(peak: float = 4.0) -> PerChannel:
    """Filmic tone curve with its published constants, scaled so that ``peak`` becomes 1."""
    curve = lambda x: (x * (0.22 * x + 0.03) + 0.002) / (x * (0.22 * x + 0.3) + 0.06) - 1 / 30
    return PerChannel("hable", lambda x: curve(F.greatest(x, F.lit(0.0))) / curve(peak))


def reinhard(peak: float = 4.0, contrast: float = 0.5) -> PerChannel:
    k = (1 - contrast) / contrast
    return PerChannel("reinhard", lambda x: F.greatest(x, F.lit(0.0)) / (F.greatest(x, F.lit(0.0)) + k) * ((peak + k) / peak))


def fold(steps: list[Matrix | PerChannel]) -> list[Matrix | PerChannel]:
    """Neighbouring matrices as one, and none that changes nothing."""
    out: list[Matrix | PerChannel] = []
    for step in steps:
        if isinstance(step, Matrix) and out and isinstance(out[-1], Matrix):
            a, b = out.pop(), step
            m = np.array(b.m) @ np.array(a.m)
            step = Matrix(tuple(map(tuple, m)), tuple(np.array(b.m) @ np.array(a.offset) + np.array(b.offset)))
        out.append(step)
    return [s for s in out if not (isinstance(s, Matrix) and np.allclose(s.m, np.eye(3), atol=1e-12) and np.allclose(s.offset, 0, atol=1e-12))]


def conversion(source: str, target: str, gamma: float = 2.4, tone: PerChannel | None = None) -> list[Matrix | PerChannel]:
    """Steps from ``source`` to ``target`` YUV; through linear light only if primaries or tones change."""
    steps: list[Matrix | PerChannel] = [inverse(rgb_to_yuv(source))]
    if source != target or tone:
        steps += [power(gamma), rgb_to_xyz(source), inverse(rgb_to_xyz(target))]
        steps += [tone] if tone else []
        steps += [power(1 / gamma)]
    return fold([*steps, rgb_to_yuv(target)])


def apply(pixels: Column, steps: list[Matrix | PerChannel]) -> Column:
    """Sends an array of ``struct<a, b, c>`` (doubles) through the steps in one pass over the array."""

    def one(p: Column, left: list[Matrix | PerChannel]) -> Column:
        if not left:
            return p
        step, c = left[0], [p["a"], p["b"], p["c"]]
        if isinstance(step, Matrix):
            c = [sum((c[k] * row[k] for k in range(3)), F.lit(0.0)) + off for row, off in zip(step.m, step.offset)]
        else:
            c = [step.of(x) for x in c]
        made = F.struct(c[0].alias("a"), c[1].alias("b"), c[2].alias("c"))
        return bound(made, lambda q: one(q, left[1:])) if left[1:] else made  # each step is worked out once, however often the next one mentions it

    return F.transform(pixels, lambda p: one(p, steps))
