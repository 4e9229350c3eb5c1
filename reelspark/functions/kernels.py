"""Pixel operations on whole planes as numpy arrays (rows of samples), for tasks that Spark hands batches of planes.

Each takes and gives two-dimensional arrays and keeps no state. Edges repeat outwards
unless stated; ``peak`` is the greatest sample.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from reelspark.functions.spatial import kernel

# The three-point cosine transform that tells colours apart.
DECORRELATE = np.array([[1, 1, 1], [1, 0, -1], [1, -2, 1]]) / np.sqrt([[3], [2], [6]])
# The kernels that an automatic choice tries, with the two parameters of the cubics.
DESCALE_KERNELS = (("bilinear", {}), ("bicubic", {"b": 0.0, "c": 0.5}), ("bicubic", {"b": 1 / 3, "c": 1 / 3}), ("bicubic", {"b": 0.0, "c": 0.75}), ("spline16", {}), ("spline36", {}), ("spline64", {}), ("lanczos2", {}), ("lanczos3", {}), ("lanczos4", {}))


def _mirror(index: np.ndarray, size: int) -> np.ndarray:
    """Places beyond an end as far inside, without the end sample twice; what a small plane still lacks repeats its end."""
    index = np.where(index < 0, -index, index)
    index = np.where(index > size - 1, 2 * (size - 1) - index, index)
    return np.clip(index, 0, size - 1)


# ---- shifts between frames


def phase_spectrum(plane: np.ndarray, size: int = 256, peak: int = 255) -> np.ndarray:
    """The spectrum of a plane brought to ``size`` by ``size`` samples by means over the samples that fall into each."""
    height, width = plane.shape

    def ends(n: int) -> tuple[np.ndarray, np.ndarray]:
        at = (np.arange(size + 1) * n / size).astype(int)
        return at[:-1], np.minimum(np.maximum(at[1:], at[:-1] + 1), n)

    (y0, y1), (x0, x1) = ends(height), ends(width)
    sums = np.zeros((height + 1, width + 1))
    sums[1:, 1:] = plane.astype(float).cumsum(0).cumsum(1)
    area = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    return np.fft.fft2(area / ((y1 - y0)[:, None] * (x1 - x0)) / peak)


def phase_shift(before: np.ndarray, now: np.ndarray, width: int, height: int) -> tuple[float, float, float]:
    """``(dx, dy, trust)`` in samples by which a frame moved, from two spectra: the peak of their phase correlation, refined by parabolas.

    ``trust`` is the peak over the mean of the correlation.
    """
    cross = now * before.conj()
    size = np.abs(cross)
    corr = np.fft.ifft2(np.where(size > 1e-12, cross / np.where(size > 1e-12, size, 1), 0)).real
    n = len(corr)
    y, x = divmod(int(corr.argmax()), n)

    def refined(a: float, b: float, c: float) -> float:
        bend = a - 2 * b + c
        return 0.0 if abs(bend) < 1e-9 else float(np.clip(0.5 * (a - c) / bend, -0.5, 0.5))

    fx = refined(corr[y, x - 1], corr[y, x], corr[y, (x + 1) % n])
    fy = refined(corr[y - 1, x], corr[y, x], corr[(y + 1) % n, x])
    mean = corr.mean()
    back = lambda k: k - n if k > n // 2 else k
    return (back(x) + fx) * width / n, (back(y) + fy) * height / n, float(corr[y, x] / mean) if mean > 1e-12 else 0.0


def shift(plane: np.ndarray, dx: float, dy: float, border: str = "black", fill: int = 0, peak: int = 255) -> np.ndarray:
    """The plane moved by a fraction of samples, between four samples; beyond the edges ``black`` (``fill``), ``clamp`` or ``mirror``."""
    height, width = plane.shape

    def axis(n: int, d: float) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(n) - d
        low = np.floor(at).astype(int)
        return low, at - low

    (y, fy), (x, fx) = axis(height, dy), axis(width, dx)

    def taken(k: np.ndarray, n: int) -> np.ndarray:
        if border == "mirror":
            k = np.where(k < 0, -k - 1, k)
            k = np.where(k >= n, 2 * n - k - 1, k)
        return np.clip(k, 0, n - 1)

    def sample(j: int, i: int) -> np.ndarray:
        out = plane[taken(y + j, height)][:, taken(x + i, width)].astype(float)
        if border == "black":
            inside = ((y + j >= 0) & (y + j < height))[:, None] & ((x + i >= 0) & (x + i < width))
            out = np.where(inside, out, fill)
        return out

    fx, fy = fx[None, :], fy[:, None]
    v = sample(0, 0) * (1 - fx) * (1 - fy) + sample(0, 1) * fx * (1 - fy) + sample(1, 0) * (1 - fx) * fy + sample(1, 1) * fx * fy
    return np.clip((v + 0.5).astype(int), 0, peak).astype(np.int32)


# ---- denoising along rows, columns and time


@lru_cache(maxsize=64)
def low_pass_table(strength: float, steps: int = 1) -> np.ndarray:
    """What a sample gains by its difference to the one before, for differences of -256 to 256 in ``steps`` parts of an 8-bit step; falls off exponentially."""
    f = np.arange(-256 * steps, 256 * steps) / steps
    if strength <= 0:
        return np.zeros(len(f))
    scale = min(strength, 253.9) * (-1 / np.log(0.25)) + 1e-7
    return np.exp(-np.abs(f) / scale) * f / 256


def low_pass(before: np.ndarray, now: np.ndarray, table: np.ndarray) -> np.ndarray:
    """One step of the filter on samples of 0 to 1."""
    half = len(table) // 2
    gap = (before - now) * 255.0 * (half // 256)
    return now + table[np.clip(np.trunc(gap + np.where(gap >= 0, 0.5, -0.5)).astype(int) + half, 0, len(table) - 1)]


def low_pass_spatial(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """From left to right along rows, then from top to bottom, each sample against the result before."""
    out = plane.copy()
    for x in range(out.shape[1]):
        out[:, x] = low_pass(out[:, max(x - 1, 0)], plane[:, x], table)
    across = out.copy()
    for y in range(out.shape[0]):
        out[y] = low_pass(out[max(y - 1, 0)], across[y], table)
    return out


# ---- denoising by likeness


def _box(values: np.ndarray, radius: int) -> np.ndarray:
    """Sums over squares around each sample."""
    for axis in (0, 1):
        n = values.shape[axis]
        values = sum(np.take(values, np.clip(np.arange(n) + k, 0, n - 1), axis) for k in range(-radius, radius + 1))
    return values


def _moved(plane: np.ndarray, dx: int, dy: int) -> np.ndarray:
    height, width = plane.shape
    return plane[np.clip(np.arange(height) + dy, 0, height - 1)][:, np.clip(np.arange(width) + dx, 0, width - 1)]


def non_local_means(planes: Sequence[np.ndarray], patch: int = 5, search: int = 11, sigma: float = 0.005, h: float = 0.05, peak: int = 255) -> np.ndarray:
    """The first plane with each sample drawn to those around it, and at all places around it in the other planes, by the likeness of their patches.

    Patches are ``patch`` wide, places lie within a square ``search`` wide. Inside the plane
    a pair of places is weighed once, from the later one, and counts for both.
    """
    own, t, r = planes[0] / peak, patch // 2, search // 2
    weigh = lambda there: np.exp(-np.maximum(_box((own - there) ** 2, t) - 2 * sigma, 0) / h**2)
    total, value = np.ones_like(own), own.copy()
    height, width = own.shape
    for dy in range(-r, 1):
        for dx in range(-r, r + 1):
            if dy * (2 * r - 1) + dx >= 0:
                continue
            there = _moved(own, dx, dy)
            w = weigh(there)
            total += w
            value += w * there
            y0, x0, x1 = -dy, max(0, -dx), width - max(0, dx)
            if y0 < height and x0 < x1:  # the same pair, seen from the other place
                from_here = np.s_[y0:height, x0:x1]
                to = np.s_[0 : height - y0, x0 + dx : x1 + dx]
                total[to] += w[from_here]
                value[to] += (w * own)[from_here]
    for other in planes[1:]:
        other = other / peak
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                there = _moved(other, dx, dy)
                w = weigh(there)
                total += w
                value += w * there
    return np.floor(np.clip(value / total * peak, 0, peak + 0.9) + 1e-6).astype(np.int32)


# ---- denoising of spectra


def _radial(size: int, mirrored: bool, anchors: Sequence[float]) -> np.ndarray:
    """``anchors`` from the lowest to the highest frequency, joined by lines over the distance from the lowest."""
    k = np.arange(size)
    f = np.minimum(k, size - k) / (size // 2) if mirrored else k / max(1, size - 1)
    at = np.minimum(np.hypot(f[:, None], f), np.sqrt(2)) / np.sqrt(2)
    return np.interp(at, np.linspace(0, 1, len(anchors)), anchors)


def _blocks(plane: np.ndarray, first: int, step: int, count: tuple[int, int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Square blocks of the plane, mirrored beyond its ends, and the rows and columns where they begin."""
    ys, xs = first + step * np.arange(count[0]), first + step * np.arange(count[1])
    rows, cols = (_mirror(o[:, None] + np.arange(size), n) for o, n in ((ys, plane.shape[0]), (xs, plane.shape[1])))
    return plane[rows[:, None, :, None], cols[None, :, None, :]], ys, xs


def fft3d(planes: Sequence[np.ndarray], current: int = 0, size: int = 32, overlap: float = 0.5, sigma: float | Sequence[float] = 1.0, amount: float = 1.0, hard: bool = False, peak: int = 255) -> np.ndarray:
    """The plane ``current`` of one to four in a row, with weak parts of its spectrum in space and time lessened.

    Windowed blocks of ``size`` are kept in their middle part, ``overlap`` of their width
    lies over others. A part of power P keeps ``(P - sigma / 255) / P`` of itself, not below
    ``1 - amount``; ``hard`` keeps all of the parts from ``sigma / 255`` on. ``sigma`` may be
    four numbers from the highest to the lowest frequency.
    """
    side = int(size * 0.5 * overlap + 0.5)
    step = size - 2 * side
    if not 0 < step < size:
        raise ValueError("overlap must leave a middle part and a border of a block")
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    shape = window[:, None] * window
    height, width = planes[0].shape
    count = -(-height // step), -(-width // step)
    spectra = np.stack([np.fft.fft2(_blocks(p / peak, -side, step, count, size)[0] * shape) for p in planes])
    spectra = np.fft.fft(spectra, axis=0)
    limit = (_radial(size, True, np.atleast_1d(sigma)[::-1]) if np.ndim(sigma) else np.full((size, size), float(sigma))) / 255
    power = np.abs(spectra) ** 2
    keep = np.where(power < limit, 1 - amount, 1.0) if hard else np.maximum(1 - amount, (power - limit) / (power + 1e-15))
    blocks = np.fft.ifft2(np.fft.ifft(spectra * keep, axis=0)[current]).real
    middle = np.s_[side : side + step]
    inner = blocks[:, :, middle, middle] / shape[middle, middle] * peak
    whole = inner.swapaxes(1, 2).reshape(count[0] * step, count[1] * step)[:height, :width]
    return np.floor(np.clip(whole, 0, peak + 1 - 1e-6) + 1e-6).astype(np.int32)


@lru_cache(maxsize=16)
def cosine_matrix(size: int) -> np.ndarray:
    """The orthonormal cosine transform."""
    k = np.arange(size)
    out = np.cos(np.pi * (k + 0.5) * k[:, None] / size) * np.sqrt(2 / size)
    out[0] /= np.sqrt(2)
    return out


def dct_denoise(plane: np.ndarray, size: int = 8, step: int = 2, sigma: float | Sequence[float] = 4.0) -> np.ndarray:
    """Blocks at every ``step`` samples without the parts of their cosine transform up to ``3 sigma`` (the mean stays), averaged; not rounded.

    ``sigma`` may be four numbers from the highest to the lowest frequency.
    """
    height, width = plane.shape
    count = tuple((n - 1) // step + size // step for n in plane.shape)
    blocks, ys, xs = _blocks(plane.astype(float), step - size, step, count, size)
    m = cosine_matrix(size)
    parts = m @ blocks @ m.T
    limit = 3.0 * (_radial(size, False, np.atleast_1d(sigma)[::-1]) if np.ndim(sigma) else np.full((size, size), float(sigma)))
    limit[0, 0] = -1
    blocks = m.T @ np.where(np.abs(parts) <= limit, 0, parts) @ m
    # Blocks a whole size apart don't overlap, so each phase is added at once.
    out, each = np.zeros((height + 3 * size, width + 3 * size)), size // step
    for j in range(each):
        for i in range(each):
            some = blocks[j::each, i::each]
            if some.size:
                tiles = some.swapaxes(1, 2).reshape(some.shape[0] * size, some.shape[1] * size)
                y, x = ys[j] + size, xs[i] + size
                out[y : y + tiles.shape[0], x : x + tiles.shape[1]] += tiles[: out.shape[0] - y, : out.shape[1] - x]
    return out[size : size + height, size : size + width] / each**2


def dct_denoise_colours(planes: Sequence[np.ndarray], size: int = 8, step: int = 2, sigma: float | Sequence[float] = 4.0, peak: int = 255) -> list[np.ndarray]:
    """Red, green and blue denoised where they are least alike: their mean and two differences, each by itself."""
    apart = np.einsum("ij,jyx->iyx", DECORRELATE, np.stack(planes).astype(float))
    clean = np.stack([dct_denoise(p, size, step, sigma) for p in apart])
    return [np.clip(np.floor(p + 0.5), 0, peak).astype(np.int32) for p in np.einsum("ji,jyx->iyx", DECORRELATE, clean)]


# ---- undoing a resize


def scale_matrix(size: int, target: int, name: str = "bicubic", border: str = "mirror", shift: float = 0.0, active: float | None = None, **shape: float) -> np.ndarray:
    """``target`` rows of weights over ``size`` samples; weights beyond the ends are ``mirror``-ed, given to the end (``repeat``) or left out (``zero``)."""
    radius, weigh = kernel(name, **shape)
    out = np.zeros((target, size))
    ratio = target / (active or size)
    for i in range(target):
        pos = (i + 0.5) / ratio + shift
        begin = np.floor(pos - radius + (0.5 if pos < radius else 0.49999999999999994)) + 0.5
        at = begin + np.arange(2 * radius)
        w = weigh(at - pos)
        w = w / w.sum()
        beyond = (at < 0) | (at > size)
        if border == "zero":
            at, w = at[~beyond], w[~beyond]
        elif border == "repeat":
            at = np.clip(at, 0, size - 0.5)
        else:
            at = np.where(at < 0, -at, np.where(at > size, np.minimum(2.0 * size - at, size - 0.5), at))
        np.add.at(out[i], np.floor(at).astype(int), w)
    return out


@lru_cache(maxsize=128)
def _solver(size: int, target: int, name: str, border: str, shape: tuple) -> np.ndarray:
    """What brings ``size`` samples to the ``target`` ones whose enlargement is nearest to them in least squares."""
    a = scale_matrix(target, size, name, border, **dict(shape))
    return np.linalg.solve(a.T @ a + np.eye(target) * np.finfo(float).eps, a.T)


@lru_cache(maxsize=256)
def _scaler(size: int, target: int, name: str, shape: tuple) -> np.ndarray:
    return scale_matrix(size, target, name, **dict(shape))


def descale_exact(plane: np.ndarray, to_width: int, to_height: int, name: str = "bicubic", border: str = "mirror", **shape: float) -> np.ndarray:
    """The smaller plane whose enlargement by ``name`` is nearest to ``plane``; not rounded."""
    key = tuple(sorted(shape.items()))
    down, across = _solver(plane.shape[0], to_height, name, border, key), _solver(plane.shape[1], to_width, name, border, key)
    return down @ plane.astype(float) @ across.T


def descale(plane: np.ndarray, to_width: int, to_height: int, name: str = "bicubic", border: str = "mirror", peak: int = 255, **shape: float) -> np.ndarray:
    return np.floor(np.clip(descale_exact(plane, to_width, to_height, name, border, **shape), 0, peak) + 0.5 + 1e-9).astype(np.int32)


def descale_error(plane: np.ndarray, to_width: int, to_height: int, name: str, peak: int = 255, **shape: float) -> float:
    """How far the plane, brought down and up again, is from itself: squares that become lines at 4/255, weighted by the steepness of edges."""
    height, width = plane.shape
    small = descale_exact(plane, to_width, to_height, name, **shape)
    key = tuple(sorted(shape.items()))
    again = _scaler(to_height, height, name, key) @ small @ _scaler(to_width, width, name, key).T
    p = plane / peak
    edge = np.zeros_like(p)
    if height > 2 and width > 2:
        smooth = lambda a, axis: sum(w * np.take(a, np.arange(k, a.shape[axis] - 2 + k), axis) for k, w in enumerate((1, 2, 1)))
        gx, gy = smooth(p[:, 2:] - p[:, :-2], 0), smooth(p[2:] - p[:-2], 1)
        edge[1:-1, 1:-1] = np.hypot(gx, gy)
    d, bend = np.abs(p - again / peak), 4 / 255
    loss = np.where(d < bend, d * d, 2 * bend * d - bend**2)
    return float(((edge + 0.1) * loss).sum() / p.size)


# ---- combed frames


def decomb(planes: Sequence[np.ndarray], full: bool = True, threshold: int = 20, blend_threshold: int = 7, blend: bool = False, box_limit: int = 15, peak: int = 255) -> tuple[list[np.ndarray], bool]:
    """Planes with combed samples of every second row interpolated, or blended with both rows beside (``blend``), and whether the frame was combed.

    A sample is combed if the rows beside it differ from it to one side by a product above
    a threshold squared. Unless ``full``, a frame changes only if a box of 4 by 8 samples of
    the first plane has over ``box_limit`` that are combed with those above and below. Chroma planes of half
    the height follow the first plane's samples.
    """
    scale = peak / 255
    luma = planes[0].astype(np.int64)
    product = np.zeros(luma.shape)
    product[1:-1] = (luma[2:] - luma[1:-1]) * (luma[:-2] - luma[1:-1])
    change = product > (blend_threshold * scale) ** 2
    change[[0, -1]] = True
    combed = full
    if not full:
        strong = product > (threshold * scale) ** 2
        padded = np.pad(strong, ((1, 1), (0, 0)), "edge")
        three = padded[:-2] & padded[1:-1] & padded[2:]
        boxes = np.add.reduceat(np.add.reduceat(three.astype(int), np.arange(0, three.shape[0], 8), 0), np.arange(0, three.shape[1], 4), 1)
        combed = bool((boxes > box_limit).any())
    if not combed:
        return [np.asarray(p) for p in planes], False
    out = []
    for p in planes:
        p = p.astype(np.int32)
        mask = change[:: change.shape[0] // p.shape[0], :: change.shape[1] // p.shape[1]][: p.shape[0], : p.shape[1]]
        up, down = np.vstack([p[:1], p[:-1]]), np.vstack([p[1:], p[-1:]])
        if blend:
            made = np.where(mask, p * 2 + up + down + 3 >> 2, p)
            made[0], made[-1] = p[0] + down[0] + 1 >> 1, p[-1] + up[-1] + 1 >> 1
        else:
            odd = (np.arange(len(p)) % 2 == 1) & (np.arange(len(p)) < len(p) - 1)
            made = np.where(mask & odd[:, None], up + down + 1 >> 1, p)
        out.append(made)
    return out, True


# ---- quality


def plane_ssim(a: np.ndarray, b: np.ndarray, peak: int = 255) -> float:
    """Mean structural similarity over all windows of eight by eight samples, four apart; rows and columns that don't fill a block of four are left out."""
    height, width = (n // 4 * 4 for n in a.shape)
    a, b = (p[:height, :width].astype(np.int64) for p in (a, b))
    blocks = np.stack([v.reshape(height // 4, 4, width // 4, 4).sum((1, 3)) for v in (a, b, a * a + b * b, a * b)])
    s1, s2, squares, cross = (blocks[:, :-1, :-1] + blocks[:, 1:, :-1] + blocks[:, :-1, 1:] + blocks[:, 1:, 1:]).astype(float)
    c1, c2 = 0.01**2 * peak**2 * 64, 0.03**2 * peak**2 * 64 * 63
    spread, joint = 64 * squares - s1 * s1 - s2 * s2, 64 * cross - s1 * s2
    return float(((2 * s1 * s2 + c1) * (2 * joint + c2) / ((s1 * s1 + s2 * s2 + c1) * (spread + c2))).mean())
