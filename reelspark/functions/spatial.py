"""Pixel operations that look around a sample: resampling, denoisers, sharpeners, comb removal, field interpolation.

All are column expressions on planes (arrays of samples, row by row) that stay in
the JVM. Edges repeat outwards unless stated. Results that the rules round down get
1e-6 first, so that a flat plane stays as it is in spite of inexact sums.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from reelspark.functions.planes import _at, _each

GUARD = 1e-6
# Vertical interpolation weights of a published field interpolator, in 1/8192.
LOW = (4309, 213)
HIGH = (5570, 3801, 1016)
SPATIAL = (5077, 981)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once and not at each mention."""
    return F.get(F.transform(F.array(value), use), 0)


def _places(width: int, height: int, use: Callable[[Column, Column], Column]) -> Column:
    return _each(width * height, lambda i: use(i % width, F.floor(i / width).cast("int")))


def _down(x: Column, low: float, high: float) -> Column:
    """Rounded down within bounds."""
    return F.floor(F.greatest(F.lit(low), F.least(F.lit(high), x)) + GUARD).cast("int")


def _numbers(values: Sequence[float], kind: str) -> Column:
    """A long list of numbers as one literal, folded once a query."""
    return F.split(F.lit(",".join(map(repr, np.asarray(values).tolist()))), ",").cast(f"array<{kind}>")


def _spline(radius: int) -> Callable[[np.ndarray], np.ndarray]:
    """Weight by distance of a natural cubic spline through ``2 * radius`` samples, taken in its middle piece."""
    n = 2 * radius
    slopes = np.zeros((n, n))  # second derivatives of the spline of each unit sample
    inner = np.diag(np.full(n - 2, 4.0)) + np.diag(np.ones(n - 3), 1) + np.diag(np.ones(n - 3), -1)
    slopes[:, 1:-1] = np.linalg.solve(inner, 6 * np.diff(np.eye(n), 2).T).T
    left = radius - 1

    def weight(x: np.ndarray) -> np.ndarray:
        x = np.abs(x)
        piece = np.minimum(np.floor(x).astype(int), radius - 1)
        t = x - piece  # how far into the middle piece the place lies, seen from a sample on its left
        unit = left - piece
        a, b = slopes[unit, left], slopes[unit, left + 1]
        line = np.where(piece == 0, 1 - t, 0.0)
        bend = ((1 - t) ** 3 - (1 - t)) * a / 6 + (t**3 - t) * b / 6
        return np.where(x < radius, line + bend, 0.0)

    return weight


def _cubic(b: float, c: float) -> Callable[[np.ndarray], np.ndarray]:
    """The two-parameter cubics of Mitchell and Netravali."""

    def weight(x: np.ndarray) -> np.ndarray:
        x = np.abs(x)
        near = np.polyval([12 - 9 * b - 6 * c, -18 + 12 * b + 6 * c, 0, 6 - 2 * b], x)
        far = np.polyval([-b - 6 * c, 6 * b + 30 * c, -12 * b - 48 * c, 8 * b + 24 * c], x)
        return np.where(x <= 1, near, np.where(x < 2, far, 0.0)) / 6

    return weight


def kernel(name: str, b: float = 0.0, c: float = 0.6) -> tuple[int, Callable[[np.ndarray], np.ndarray]]:
    """Radius and weight by distance: bilinear, bicubic (``b``, ``c``), mitchell, catmull_rom, hermite, lanczos2 to lanczos8, spline16, spline36, spline64."""
    if name == "bilinear":
        return 1, lambda x: np.maximum(0.0, 1 - np.abs(x))
    cubics = {"bicubic": (b, c), "mitchell": (1 / 3, 1 / 3), "catmull_rom": (0.0, 0.5), "hermite": (0.0, 0.0)}
    if name in cubics:
        return 2, _cubic(*cubics[name])
    if name.startswith("lanczos") and name[7:] in list("2345678"):
        r = int(name[7:])
        return r, lambda x: np.where(np.abs(x) < r, np.sinc(x) * np.sinc(x / r), 0.0)
    splines = {"spline16": 2, "spline36": 3, "spline64": 4}
    if name in splines:
        return splines[name], _spline(splines[name])
    raise ValueError(f"unknown kernel {name}")


def resize_weights(size: int, target: int, name: str = "spline36", **shape: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``target`` places the first of its samples and their weights, which sum to 1; samples beyond the ends have none."""
    radius, weigh = kernel(name, **shape)
    ratio = target / size
    narrow = min(ratio, 1.0)
    at = (np.arange(target) + 0.5) / ratio
    first, last = np.floor(at - radius / narrow).astype(int), np.ceil(at + radius / narrow).astype(int)
    index = first[:, None] + np.arange((last - first).max() + 1)
    inside = (index >= 0) & (index < size) & (index <= last[:, None])
    weights = np.where(inside, weigh((index + 0.5 - at[:, None]) * narrow), 0.0)
    return first, weights / weights.sum(1, keepdims=True)


def resize(plane: Column, width: int, height: int, to_width: int, to_height: int, name: str = "spline36", peak: int = 255, **shape: float) -> Column:
    """The plane at another size by a separable kernel, first along rows, then along columns; rounded down."""

    def line(samples: Column, first: np.ndarray, weights: np.ndarray, at: Column, size: int, place: Callable[[Column], Column]) -> Column:
        starts, table, taps = _numbers(first, "int"), _numbers(weights.ravel(), "double"), weights.shape[1]
        sample = lambda k: F.get(samples, place(F.greatest(F.lit(0), F.least(F.lit(size - 1), F.get(starts, at) + k))))
        return F.aggregate(F.sequence(F.lit(0), F.lit(taps - 1)), F.lit(0.0), lambda s, k: s + sample(k) * F.get(table, at * taps + k))

    across, down = resize_weights(width, to_width, name, **shape), resize_weights(height, to_height, name, **shape)
    rows = _places(to_width, height, lambda x, y: line(plane, *across, x, width, lambda i: y * width + i))
    return bound(rows, lambda r: _places(to_width, to_height, lambda x, y: _down(line(r, *down, y, height, lambda i: i * to_width + x), 0.0, peak + 0.9)))


def edge_level(plane: Column, width: int, height: int, strength: float = 5.0, threshold: float = 20.0, black: float = 0.0, white: float = 0.0, peak: int = 255) -> Column:
    """Pushes samples at an edge away from its middle, within the edge's own range widened by ``black`` and ``white``.

    The edge is the wider of the ranges of five samples across and five down. Strength
    counts in sixteenths, the threshold in 128ths and the others in 256ths of the range.
    """

    def one(x: Column, y: Column) -> Column:
        across = F.array(*[_at(plane, width, height, x + d, y) for d in range(-2, 3)])
        down = F.array(*[_at(plane, width, height, x, y + d) for d in range(-2, 3)])
        ranges = F.struct(*[f(line).alias(n) for n, line, f in (("al", across, F.array_min), ("ah", across, F.array_max), ("dl", down, F.array_min), ("dh", down, F.array_max))], _at(plane, width, height, x, y).alias("v"))

        def pushed(s: Column) -> Column:
            steep = s["ah"] - s["al"] < s["dh"] - s["dl"]
            low, high, v = F.when(steep, s["dl"]).otherwise(s["al"]), F.when(steep, s["dh"]).otherwise(s["ah"]), s["v"]
            floor = low - F.when(v == low, 2).otherwise(1) * (black * peak / 256)
            ceiling = high + F.when(v == high, 2).otherwise(1) * (white * peak / 256)
            moved = F.least(F.greatest(v + (v - (low + high) * 0.5) * (strength / 16), floor), ceiling)
            return _down(F.when(high - low > threshold * peak / 128, moved).otherwise(v), 0.0, peak * (1 - 1e-6))

        return bound(ranges, pushed)

    return _places(width, height, one)


def diffuse(plane: Column, width: int, height: int, strength: float = 100.0, threshold: float = 100.0, times: int = 2, exponential: bool = True, depth: int = 8) -> Column:
    """Modified anisotropic diffusion: neighbours pull a sample the more, the less the blurred plane differs between them."""
    pull, scale = strength / 400, 2 ** (threshold / 10 - (12 - depth) * 2)
    weights = [1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16]
    around = ((0, -1), (0, 1), (-1, 0), (1, 0))

    def blurred(x: Column, y: Column) -> Column:
        total = F.lit(0.0)
        for j, wy in enumerate(weights):
            for i, wx in enumerate(weights):
                total = total + _at(plane, width, height, x + (i - 2), y + (j - 2)) * (wx * wy)
        return F.floor(total + 0.5).cast("int")

    def step(now: Column, soft: Column) -> Column:
        def one(x: Column, y: Column) -> Column:
            total = _at(now, width, height, x, y).cast("double")
            for dx, dy in around:
                gap = _at(soft, width, height, x + dx, y + dy) - _at(soft, width, height, x, y)
                weight = F.exp(-gap * gap / scale) if exponential else 1 / (1 + gap * gap / scale)
                total = total + (_at(now, width, height, x + dx, y + dy) - _at(now, width, height, x, y)) * (pull * weight)
            return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(2.0**depth - 0.1), total + 0.5))).cast("int")

        return _places(width, height, one)

    def run(soft: Column, now: Column, left: int) -> Column:
        return now if left == 0 else bound(step(now, soft), lambda n: run(soft, n, left - 1))

    return bound(_places(width, height, blurred), lambda soft: run(soft, plane, times))


def knn(planes: Sequence[Column], width: int, height: int, radius: int = 3, strength: float = 0.08, blend: float = 0.2, weight_threshold: float = 0.01, blend_threshold: float = 0.8, depth: int = 8) -> Column:
    """Mean of the samples around, weighted by likeness and nearness, mixed with the sample itself.

    ``planes`` are an odd number of planes in order of time, the middle one is denoised.
    Where the share of like samples exceeds ``blend_threshold`` the sample counts with
    ``blend``, elsewhere with one less that.
    """
    reach, side = len(planes) // 2, 2 * radius + 1
    full = float(2**depth)

    def one(x: Column, y: Column) -> Column:
        centre = _at(planes[reach], width, height, x, y) / full

        def weighed(c: Column) -> Column:
            def taps(t: int) -> Column:
                apart = (t - reach) ** 2 / len(planes) ** 2

                def tap(k: Column) -> Column:
                    dx, dy = k % side - radius, F.floor(k / side).cast("int") - radius
                    far = (dx * dx + dy * dy) / float(side**2) + apart
                    return bound(_at(planes[t], width, height, x + dx, y + dy) / full, lambda v: F.struct(v.alias("v"), F.exp(-((c - v) * (c - v) / strength**2 + far)).alias("w")))

                return F.transform(F.sequence(F.lit(0), F.lit(side**2 - 1)), tap)

            zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w"), F.lit(0).alias("n"))
            near = lambda s: F.when(s["w"] > weight_threshold, 1).otherwise(0)
            total = F.aggregate(F.concat(*map(taps, range(len(planes)))), zero, lambda a, s: F.struct((a["v"] + s["v"] * s["w"]).alias("v"), (a["w"] + s["w"]).alias("w"), (a["n"] + near(s)).alias("n")))

            def mixed(s: Column) -> Column:
                own = F.when(s["n"] / float(side**2 * len(planes)) > blend_threshold, blend).otherwise(1 - blend)
                mean = s["v"] / s["w"]
                return _down((mean + (c - mean) * own) * full, 0.0, full - 1)

            return bound(total, mixed)

        return bound(centre, weighed)

    return _places(width, height, one)


def _nine(plane: Column, width: int, height: int, x: Column, y: Column) -> Column:
    """The sum of a sample and its eight neighbours."""
    total = F.lit(0)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            total = total + _at(plane, width, height, x + dx, y + dy)
    return total


def _steepness(plane: Column, width: int, height: int, highq: bool, use: Callable[[Callable[[Column, Column], tuple[Column, Column]]], Column]) -> Column:
    """``use`` of a function that gives a place's sum of nine and its greatest difference to those one place down left and right (``highq``: straight down and right too)."""
    wide, sides = width + 2, [(1, 1), (-1, 1)] + ([(0, 1), (1, 0)] if highq else [])

    def with_sums(sums: Column) -> Column:
        def at(x: Column, y: Column) -> tuple[Column, Column]:
            total = lambda dx, dy: F.get(sums, (y + (1 + dy)) * wide + x + (1 + dx))
            return total(0, 0), F.greatest(*[F.abs(total(0, 0) - total(*s)) for s in sides], F.lit(0))

        return use(at)

    return bound(_places(wide, height + 2, lambda x, y: _nine(plane, width, height, x - 1, y - 1)), with_sums)


def edge_sharpen(plane: Column, width: int, height: int, strength: float = 1.0, threshold: float = 15.0, slope: float = 0.0, highq: bool = True, mask: bool = False, luma_limit: float = 0.0, peak: int = 255) -> Column:
    """Sharpens where the mean of nine samples differs by ``threshold`` or more from that one place down, to the side or diagonally.

    ``highq`` looks straight down and to the right too; a ``slope`` makes the step at
    the threshold smooth; ``luma_limit`` weakens the effect below that sample value;
    ``mask`` gives the strength instead of the picture.
    """

    def picture(facts: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
        def one(x: Column, y: Column) -> Column:
            nine, steep = facts(x, y)

            def made(s: Column) -> Column:
                if slope > 0:
                    arg = F.greatest(F.lit(-32.0), F.least(F.lit(32.0), (s["steep"] / 9.0 - threshold) / float(peak) * slope))
                    on = 1 / (1 + F.exp(-arg))
                else:
                    on = F.when(s["steep"] >= threshold * 9, 1.0).otherwise(0.0)
                if mask:
                    return _down(on * peak, 0.0, peak * (1 - 1e-6))
                sharp = F.greatest(F.lit(0.0), F.least(F.lit(float(peak)), s["v"] * 4 - s["nine"] / 3.0))
                weight = on * strength * (F.least(s["v"] / luma_limit, F.lit(1.0)) if luma_limit > 0 else 1.0)
                return _down(s["v"] + weight * (sharp - s["v"]), 0.0, peak * (1 - 1e-6))

            return bound(F.struct(steep.alias("steep"), _at(plane, width, height, x, y).alias("v"), nine.alias("nine")), made)

        return _places(width, height, one)

    return _steepness(plane, width, height, highq, picture)


def smooth_flat(plane: Column, width: int, height: int, times: int = 3, threshold: float = 15.0, highq: bool = True) -> Column:
    """Samples away from edges become the rounded mean of themselves and of their neighbours above, below and beside that are away from edges, ``times`` over.

    Edges are those of ``edge_sharpen`` and the outermost samples.
    """
    inside = lambda x, y: (x > 0) & (x < width - 1) & (y > 0) & (y < height - 1)
    flat = lambda facts: _places(width, height, lambda x, y: inside(x, y) & (facts(x, y)[1] < threshold * 9))

    def step(now: Column, flat: Column) -> Column:
        def one(x: Column, y: Column) -> Column:
            i = y * width + x
            places = F.filter(F.array(i, i - width, i + width, i - 1, i + 1), lambda k: F.get(flat, k))
            total = lambda k: F.aggregate(k, F.lit(0), lambda s, p: s + F.get(now, p))
            mean = bound(places, lambda k: F.floor((total(k) + F.floor(F.size(k) / 2)) / F.size(k)).cast("int"))
            return F.when(F.get(flat, i), mean).otherwise(F.get(now, i))

        return _places(width, height, one)

    def run(flat: Column, now: Column, left: int) -> Column:
        return now if left == 0 else bound(step(now, flat), lambda n: run(flat, n, left - 1))

    return bound(_steepness(plane, width, height, highq, flat), lambda f: run(f, plane, times))


def sharpen_adaptive(plane: Column, width: int, height: int, sharpness: float = 0.4, squared: bool = True, peak: int = 255) -> Column:
    """Sharpens each sample against the four beside it, the less, the nearer they come to black or white; ``squared`` works on squared samples."""
    slope = -1 / (8 - 3 * min(max(sharpness, 0.0), 1.0))

    def one(x: Column, y: Column) -> Column:
        def value(dx: int, dy: int) -> Column:
            v = _at(plane, width, height, x + dx, y + dy) / float(peak)
            return v * v if squared else v

        around = F.array(value(0, 0), value(0, -1), value(-1, 0), value(1, 0), value(0, 1))

        def made(a: Column) -> Column:
            room = F.least(F.array_min(a), 1 - F.array_max(a)) / F.greatest(F.array_max(a), F.lit(1e-6))
            weight = F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), room))) * slope
            beside = F.get(a, 1) + F.get(a, 2) + F.get(a, 3) + F.get(a, 4)
            sharp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (beside * weight + F.get(a, 0)) / (1 + weight * 4)))
            return _down((F.sqrt(sharp) if squared else sharp) * peak, 0.0, peak * (1 - 1e-6))

        return bound(around, made)

    return _places(width, height, one)


def lens(plane: Column, width: int, height: int, k1: float = 0.0, k2: float = 0.0, cx: float = 0.5, cy: float = 0.5, fill: int = 0, peak: int = 255) -> Column:
    """Undoes radial distortion: each sample comes from a place farther out by ``1 + k1 r^2 + k2 r^4``, r in half diagonals, between four samples; ``fill`` beyond the edges."""
    half = (width**2 + height**2) ** 0.5 / 2

    def one(x: Column, y: Column) -> Column:
        dx, dy = x - cx * width, y - cy * height
        r2 = (dx * dx + dy * dy) / half**2

        def between(p: Column) -> Column:
            x0, y0 = F.floor(p["x"]).cast("int"), F.floor(p["y"]).cast("int")
            fx, fy = p["x"] - x0, p["y"] - y0

            def sample(i: int, j: int) -> Column:
                inside = (x0 + i >= 0) & (x0 + i < width) & (y0 + j >= 0) & (y0 + j < height)
                return F.when(inside, F.get(plane, (y0 + j) * width + x0 + i)).otherwise(F.lit(fill))

            top, low = sample(0, 0) * (1 - fx) + sample(1, 0) * fx, sample(0, 1) * (1 - fx) + sample(1, 1) * fx
            return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(peak)), top * (1 - fy) + low * fy + 0.5)) + GUARD).cast("int")

        out = r2 * k1 + r2 * r2 * k2 + 1
        return bound(F.struct((dx * out + cx * width).alias("x"), (dy * out + cy * height).alias("y")), between)

    return _places(width, height, one)


def uncomb(plane: Column, width: int, height: int, strength: float = 2.7, most: int = 255, scale: float = 0.25, threshold: int = 0, peak: int = 255) -> Column:
    """Takes combing that deinterlacing left off: what a vertical blur removes stays only as far as a second blur explains it.

    Rows beyond the top and bottom are mirrored; planes have at least four rows.
    """
    mirrored = lambda y: F.when(y < 0, -y).when(y >= height, 2 * (height - 1) - y).otherwise(y)

    def soft(samples: Column, weights: Sequence[int], shift: int) -> Column:
        r = len(weights) // 2
        # A second row beyond the edge is the second row inside it, counted from the sample.
        row = lambda y, d: mirrored(y + d) if abs(d) < 2 else F.when((y + d < 0) | (y + d >= height), y - d).otherwise(y + d)
        total = lambda x, y: sum((F.get(samples, row(y, d - r) * width + x) * w for d, w in enumerate(weights)), F.lit(1 << (shift - 1)))
        return _places(width, height, lambda x, y: F.shiftright(total(x, y), shift))

    def combed(first: Column) -> Column:
        rows = F.zip_with(F.zip_with(plane, first, lambda s, a: F.struct(s.alias("s"), a.alias("a"))), soft(first, (1, 4, 6, 4, 1), 4), lambda p, b: F.struct(p["s"].alias("s"), p["a"].alias("a"), b.alias("b")))

        def one(p: Column) -> Column:
            gone, explained = p["s"] - p["a"], (p["a"] - p["b"]) * float(strength)
            least = F.when(F.abs(gone) < F.abs(explained), gone).otherwise(explained)
            added = (p["a"] + F.when(gone * explained < 0, least * scale).otherwise(least).cast("int")).cast("int")  # towards 0
            kept = F.greatest(p["s"] - most, F.least(p["s"] + most, added))
            return F.greatest(F.lit(0), F.least(F.lit(peak), F.when(F.abs(gone) < threshold, p["s"]).otherwise(kept))).cast("int")

        return F.transform(rows, one)

    return bound(soft(plane, (1, 2, 1), 2), combed)


def _half(x: Column) -> Column:
    return F.shiftright(x, 1)


def yadif(before: Column, now: Column, after: Column, width: int, height: int, bottom: bool, second: bool, peak: int = 255) -> Column:
    """A field of ``now`` made a frame: the rows of the other field (the bottom one's, if ``bottom``) follow edges, within what the frames around show.

    ``second`` says that the field kept is the later of its frame.
    """
    early, late = (now, after) if second else (before, now)

    def one(x: Column, y: Column) -> Column:
        p = lambda plane, dx, dy: _at(plane, width, height, x + dx, y + dy)
        score = lambda d: sum((F.abs(p(now, k + d, -1) - p(now, k - d, 1)) for k in (-1, 0, 1)), F.lit(0))
        scores = F.struct(*[score(d).alias(n) for n, d in (("s", 0), ("l", -1), ("ll", -2), ("r", 1), ("rr", 2))])

        def lean(s: Column) -> Column:
            # A steeper lean counts only where the slighter one has helped.
            left = F.when(s["l"] < s["s"], F.when(s["ll"] < s["l"], -2).otherwise(-1)).otherwise(0)
            best = F.when(s["l"] < s["s"], F.least(s["l"], s["ll"])).otherwise(s["s"])
            return F.when(s["r"] < best, F.when(s["rr"] < s["r"], 2).otherwise(1)).otherwise(left)

        mean = lambda dy: _half(p(early, 0, dy) + p(late, 0, dy))
        moved = lambda other: _half(F.abs(p(other, 0, -1) - p(now, 0, -1)) + F.abs(p(other, 0, 1) - p(now, 0, 1)))
        facts = F.struct(
            bound(bound(scores, lean), lambda d: _half(_at(now, width, height, x + d, y - 1) + _at(now, width, height, x - d, y + 1))).alias("spatial"),
            mean(0).alias("t"), p(now, 0, -1).alias("up"), p(now, 0, 1).alias("down"), (mean(-2) - p(now, 0, -1)).alias("far_up"), (mean(2) - p(now, 0, 1)).alias("far_down"),
            F.greatest(F.abs(p(early, 0, 0) - p(late, 0, 0)), moved(before), moved(after)).alias("diff"),
        )

        def within(f: Column) -> Column:
            down, up = f["t"] - f["down"], f["t"] - f["up"]
            spread = F.greatest(f["diff"], -F.greatest(down, up, F.least(f["far_up"], f["far_down"])), F.least(down, up, F.greatest(f["far_up"], f["far_down"])))
            return F.greatest(F.lit(0), F.least(F.lit(peak), F.greatest(F.least(f["spatial"], f["t"] + spread), f["t"] - spread)))

        return F.when(y % 2 != int(bottom), p(now, 0, 0)).otherwise(bound(facts, within)).cast("int")

    return _places(width, height, one)


def bwdif(before: Column, now: Column, after: Column, width: int, height: int, bottom: bool, second: bool, threshold: float = 0.0, peak: int = 255) -> Column:
    """As ``yadif``, with cubic interpolation over rows and time; where motion is at most ``threshold`` percent of the range the frames around are averaged."""
    early, late = (now, after) if second else (before, now)
    still = int(threshold * peak / 100 + 0.5)

    def one(x: Column, y: Column) -> Column:
        p = lambda plane, dy: _at(plane, width, height, x, y + dy)
        pair = lambda dy: p(early, dy) + p(late, dy)
        moved = lambda other: _half(F.abs(p(other, -1) - p(now, -1)) + F.abs(p(other, 1) - p(now, 1)))
        facts = F.struct(
            p(now, -1).alias("up"), p(now, 1).alias("down"), (p(now, -3) + p(now, 3)).alias("outer"), _half(pair(0)).alias("t"), pair(0).alias("pair"),
            _half(pair(-2)).alias("far_up"), _half(pair(2)).alias("far_down"), (pair(-2) + pair(2)).alias("pairs2"), (pair(-4) + pair(4)).alias("pairs4"),
            F.abs(p(early, 0) - p(late, 0)).alias("change"), moved(before).alias("m0"), moved(after).alias("m1"),
        )

        def made(f: Column) -> Column:
            motion = F.greatest(_half(f["change"]), f["m0"], f["m1"])
            up, down, far_up, far_down = f["t"] - f["up"], f["t"] - f["down"], f["far_up"] - f["up"], f["far_down"] - f["down"]
            spread = F.greatest(motion, F.least(down, up, F.greatest(far_up, far_down)), -F.greatest(down, up, F.least(far_up, far_down)))
            spread = F.when((y >= 2) & (y < height - 2), spread).otherwise(motion)
            near = f["up"] + f["down"]
            high = F.shiftright(f["pair"] * HIGH[0] - f["pairs2"] * HIGH[1] + f["pairs4"] * HIGH[2], 2)
            full = F.when(F.abs(f["up"] - f["down"]) > f["change"], F.shiftright(high + near * LOW[0] - f["outer"] * LOW[1], 13)).otherwise(F.shiftright(near * SPATIAL[0] - f["outer"] * SPATIAL[1], 13))
            raw = F.when((y >= 4) & (y < height - 4), full).otherwise(_half(near))
            kept = F.greatest(f["t"] - spread, F.least(f["t"] + spread, raw))
            return F.greatest(F.lit(0), F.least(F.lit(peak), F.when(motion <= still, f["t"]).otherwise(kept)))

        return F.when(y % 2 != int(bottom), p(now, 0)).otherwise(bound(facts, made)).cast("int")

    return _places(width, height, one)
