"""Operations on edges of whole planes as numpy arrays: sharpening, halos, block edges, chroma places.

Edges of the plane repeat outwards. Results that the rules round down get 1e-6 first, as
in ``spatial``.
"""

from __future__ import annotations

import numpy as np

from reelspark.functions.spatial import GUARD

# The thresholds of a published video standard's deblocking by quantiser, 0 to 51.
ALPHA = [
    0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
    4, 4, 5, 6, 7, 8, 9, 10, 12, 13, 15, 17, 20, 22, 25, 28,
    32, 36, 40, 45, 50, 56, 63, 71, 80, 90, 101, 113, 127, 144, 162, 182,
    203, 226, 255, 255,
]
BETA = [
    0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
    2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 6, 6, 7, 7, 8, 8,
    9, 9, 10, 10, 11, 11, 12, 12, 13, 13, 14, 14, 15, 15, 16, 16,
    17, 17, 18, 18,
]
LIMIT = [
    0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
    0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
    0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2,
    2, 2, 3, 3,
]
# How far the search for the luma's edges goes from a place.
CHROMA_REACH = 4


def _at(plane: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """The plane as seen from samples ``dx`` to the right and ``dy`` below."""
    height, width = plane.shape
    return plane[np.clip(np.arange(height) + dy, 0, height - 1)][:, np.clip(np.arange(width) + dx, 0, width - 1)]


def between(plane: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Samples at places between four of the plane."""
    height, width = plane.shape
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - x0, y - y0
    take = lambda j, i: plane[np.clip(y0 + j, 0, height - 1), np.clip(x0 + i, 0, width - 1)].astype(float)
    return (take(0, 0) * (1 - fx) + take(0, 1) * fx) * (1 - fy) + (take(1, 0) * (1 - fx) + take(1, 1) * fx) * fy


def _down(values: np.ndarray, peak: int) -> np.ndarray:
    return np.floor(np.clip(values, 0, peak * (1 - 1e-6)) + GUARD).astype(np.int32)


def edge_mask(plane: np.ndarray, threshold: float = 128.0, peak: int = 255) -> np.ndarray:
    """How steep the plane is at each sample, steepened in turn and cut at ``threshold`` (on an 8-bit scale)."""
    p = plane.astype(np.int64)
    mean = lambda a, b: a + b + 1 >> 1
    side = lambda middle, one, two: mean(middle, mean(one, two))
    up, down = (side(_at(p, 0, k), _at(p, -1, k), _at(p, 1, k)) for k in (-1, 1))
    left, right = (side(_at(p, k, 0), _at(p, k, -1), _at(p, k, 1)) for k in (-1, 1))
    v, h = np.abs(up - down), np.abs(left - right)
    steep = np.minimum(np.minimum(v + h, peak) + np.maximum(v, h), peak)
    steep = np.minimum(np.minimum(steep * 2, peak) + steep, peak)
    return np.minimum(np.minimum(steep * 2, peak), int(threshold * (peak + 1) / 256 + 0.5))


def _mask_blur(mask: np.ndarray, wide: bool, peak: int) -> np.ndarray:
    taps = (0.375, 0.09375, 0.09375, 0.03125, 0.03125, 0.03125, 0.03125) if wide else (0.5, 0.1875, 0.0625)
    out = mask.astype(float)
    for dx, dy in ((1, 0), (0, 1)):
        out = out * taps[0] + sum(w * (_at(out, dx * k, dy * k) + _at(out, -dx * k, -dy * k)) for k, w in enumerate(taps) if k)
    return np.clip(np.floor(out + 0.5), 0, peak).astype(np.int64)


def warp_sharpen(plane: np.ndarray, threshold: float = 128.0, blur: int = 2, wide: bool = True, depth: float = 16.0, least_depth: float | None = None, edge: float = 192.0, gamma: float = 1.0, peak: int = 255) -> np.ndarray:
    """Samples drawn towards edges: each comes from a place away by the slope of the blurred edge mask, times ``depth``.

    With ``least_depth`` the depth rises from it to ``depth`` as the mask rises to ``edge``,
    by the power ``gamma``.
    """
    mask = edge_mask(plane, threshold, peak)
    for _ in range(blur):
        mask = _mask_blur(mask, wide, peak)
    low = depth if least_depth is None else least_depth
    rise = np.clip(mask / peak / (edge / 255), 0, 1) ** gamma if edge > 0 else np.ones(mask.shape)
    scale = (low + (depth - low) * rise) / (peak + 1)
    height, width = plane.shape
    x, y = np.arange(width)[None, :] + (_at(mask, -1, 0) - _at(mask, 1, 0)) * scale, np.arange(height)[:, None] + (_at(mask, 0, -1) - _at(mask, 0, 1)) * scale
    return _down(between(plane, x, y), peak)


def detail_sharpen(plane: np.ndarray, zero: float = 4.0, strength: float = 1.5, power: float = 4.0, damping: float = 1.0, binomial: bool = False, median: bool = False, peak: int = 255) -> np.ndarray:
    """Differences to a blur lifted to a power, so that small ones grow most; ``zero`` is the difference that keeps its size, ``median`` takes the blur's median of nine."""
    p = plane.astype(float)
    nine = lambda a: [_at(a, dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    weights = [w / 16 for w in (1, 2, 1, 2, 4, 2, 1, 2, 1)] if binomial else [1 / 9] * 9
    soft = np.floor(sum(w * v for w, v in zip(weights, nine(p))) + 0.5 + 1e-9)
    if median:
        soft = np.median(np.stack(nine(soft)), axis=0)
    step = (peak + 1) / 256
    diff = (p - soft) / step
    size = np.abs(diff)
    lifted = strength * zero * step * (size / zero) ** (1 / power) * np.divide(diff, size + damping, out=np.zeros_like(diff), where=size + damping > 0)
    return np.floor(np.clip(p + lifted, 0, peak) + 0.5).astype(np.int32)


def _around(plane: np.ndarray, rx: float, ry: float, pick) -> np.ndarray:
    """``pick`` (np.maximum or np.minimum) over an ellipse."""
    out = plane.copy()
    for dy in range(-int(np.ceil(ry)), int(np.ceil(ry)) + 1):
        for dx in range(-int(np.ceil(rx)), int(np.ceil(rx)) + 1):
            if dx * dx / rx**2 + dy * dy / ry**2 <= 1:
                out = pick(out, _at(plane, dx, dy))
    return out


def dehalo(plane: np.ndarray, rx: float = 2.0, ry: float = 2.0, dark: float = 1.0, bright: float = 0.0, low: int = 50, high: int = 50, peak: int = 255) -> np.ndarray:
    """Halos around edges lessened: a sample near the top of its surroundings goes down by ``dark`` and up by ``bright`` of the way, from ``low`` to ``high`` percent of the range fully."""
    p = plane.astype(np.int64)
    top, bottom = _around(p, rx, ry, np.maximum), _around(p, rx, ry, np.minimum)
    span = top - bottom
    place = np.where(span > 0, np.clip((p - bottom) * peak // np.maximum(span, 1), 0, peak), 0)
    lo, hi = low * peak // 100, high * peak // 100
    mask = np.clip((place - lo) * peak // (hi - lo), 0, peak) if hi > lo else np.where(place >= lo, peak, 0)
    share = mask / peak
    return np.floor(np.clip(p - share * dark * (p - bottom) + share * bright * (top - p), 0, peak) + 0.5 + 1e-9).astype(np.int32)


def deblock(plane: np.ndarray, quantiser: int = 28, alpha_offset: int = 0, beta_offset: int = 0, chroma: bool = False, peak: int = 255) -> np.ndarray:
    """Steps at every fourth column, then row, smoothed where they are small for the ``quantiser``. The edges of one direction are all read before one is written."""
    a, b = (min(51, max(0, quantiser + off)) for off in (alpha_offset, beta_offset))
    scale = (peak + 1) // 256
    alpha, beta, limit = ALPHA[a] * scale, BETA[b] * scale, LIMIT[a] * scale

    def along_rows(p: np.ndarray) -> np.ndarray:
        width = p.shape[1]
        at = np.arange(4, width, 4)
        at = at[at <= width - 3]
        if not len(at):
            return p
        p2, p1, p0, q0, q1, q2 = (p[:, at + k] for k in range(-3, 3))
        fits = (np.abs(p0 - q0) < alpha) & (np.abs(p1 - p0) < beta) & (np.abs(q1 - q0) < beta)
        left, right = np.abs(p2 - p0) < beta, np.abs(q2 - q0) < beta
        most = limit + 1 if chroma else limit + left.astype(int) + right
        delta = np.clip((q0 - p0) * 4 + (p1 - q1) + 4 >> 3, -most, most)
        mean = p0 + q0 + 1 >> 1
        out = p.copy()
        out[:, at - 1], out[:, at] = np.where(fits, np.clip(p0 + delta, 0, peak), p0), np.where(fits, np.clip(q0 - delta, 0, peak), q0)
        if not chroma:
            out[:, at - 2] = np.where(fits & left, np.clip(p1 + np.clip(p2 + mean - 2 * p1 >> 1, -limit, limit), 0, peak), p1)
            out[:, at + 1] = np.where(fits & right, np.clip(q1 + np.clip(q2 + mean - 2 * q1 >> 1, -limit, limit), 0, peak), q1)
        return out

    return along_rows(along_rows(plane.astype(np.int64)).T).T.astype(np.int32)


def chroma_shift(plane: np.ndarray, dx: float, dy: float, peak: int = 255) -> np.ndarray:
    """A chroma plane moved by a fraction of its samples, rounded down."""
    height, width = plane.shape
    x, y = np.arange(width)[None, :] + dx + np.zeros((height, 1)), np.arange(height)[:, None] + dy + np.zeros((1, width))
    return _down(between(plane, x, y), peak)


def chroma_offset(luma: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[int, int, int]:
    """Summed ways across and down from the luma's edges to the nearest edge of the chroma, and how many edges have one.

    An edge is where the sign of the Laplacian changes to the right or below; chroma is
    brought to the luma's size first. Of equally near ones the upper, then the left counts.
    """
    height, width = luma.shape
    sx, sy = max(1, width // u.shape[1]), max(1, height // u.shape[0])

    def signs(c, up, down, left, right):
        return np.sign(4 * c - up - down - left - right)

    p = luma.astype(np.int64)
    of_luma = signs(p, _at(p, 0, -1), _at(p, 0, 1), _at(p, -1, 0), _at(p, 1, 0))
    x, y = (np.arange(width)[None, :] + 0.5) / sx - 0.5 + np.zeros((height, 1)), (np.arange(height)[:, None] + 0.5) / sy - 0.5 + np.zeros((1, width))

    def both(dx: float, dy: float) -> np.ndarray:
        cx, cy = np.clip(x + dx, 0, u.shape[1] - 1), np.clip(y + dy, 0, u.shape[0] - 1)
        return (between(u, cx, cy) + between(v, cx, cy)).astype(np.int64)

    of_chroma = signs(both(0, 0), both(0, -1 / sy), both(0, 1 / sy), both(-1 / sx, 0), both(1 / sx, 0))
    turns = lambda s: (s[:-1, :-1] != s[:-1, 1:]) | (s[:-1, :-1] != s[1:, :-1])
    here, there = turns(of_luma), turns(of_chroma)
    best = np.full(here.shape, (CHROMA_REACH + 1) ** 2 * 2)
    bx, by = np.zeros(here.shape, int), np.zeros(here.shape, int)
    rows, columns = here.shape
    for dy in range(-CHROMA_REACH, CHROMA_REACH + 1):
        for dx in range(-CHROMA_REACH, CHROMA_REACH + 1):
            seen = np.zeros(here.shape, bool)
            ys, xs = slice(max(0, -dy), max(0, min(rows, rows - dy))), slice(max(0, -dx), max(0, min(columns, columns - dx)))
            seen[ys, xs] = there[max(0, dy) : max(0, min(rows, rows + dy)), max(0, dx) : max(0, min(columns, columns + dx))]
            nearer = seen & (dx * dx + dy * dy < best)
            best[nearer], bx[nearer], by[nearer] = dx * dx + dy * dy, dx, dy
    found = here & (best < (CHROMA_REACH + 1) ** 2 * 2)
    return int(bx[found].sum()), int(by[found].sum()), int(found.sum())
