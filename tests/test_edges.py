"""Edge kernels against plain versions and what they promise."""

from __future__ import annotations

import numpy as np
import pytest

from reelspark.functions import edges
from reelspark.operators import plane_map


def clamp(v, n):
    return min(max(v, 0), n - 1)


def plain_warp(p, depth, blur):
    """Sample by sample, with the wide blur."""
    height, width = p.shape
    at = lambda a, y, x: a[clamp(y, height), clamp(x, width)]
    mean = lambda a, b: (int(a) + int(b) + 1) >> 1
    mask = np.zeros(p.shape)
    for y in range(height):
        for x in range(width):
            n = {(j, i): int(at(p, y + j, x + i)) for j in (-1, 0, 1) for i in (-1, 0, 1)}
            v = abs(mean(n[-1, 0], mean(n[-1, -1], n[-1, 1])) - mean(n[1, 0], mean(n[1, -1], n[1, 1])))
            h = abs(mean(n[0, -1], mean(n[-1, -1], n[1, -1])) - mean(n[0, 1], mean(n[-1, 1], n[1, 1])))
            e = min(min(v + h, 255) + max(v, h), 255)
            e = min(min(e * 2, 255) + e, 255)
            mask[y, x] = min(min(e * 2, 255), 128)
    taps = [0.375, 0.09375, 0.09375, 0.03125, 0.03125, 0.03125, 0.03125]
    for _ in range(blur):
        across = np.array([[sum(taps[abs(k)] * at(mask, y, x + k) for k in range(-6, 7)) for x in range(width)] for y in range(height)])
        mask = np.array([[int(sum(taps[abs(k)] * at(across, y + k, x) for k in range(-6, 7)) + 0.5) for x in range(width)] for y in range(height)])
    out = np.zeros(p.shape, int)
    for y in range(height):
        for x in range(width):
            fx, fy = x + (at(mask, y, x - 1) - at(mask, y, x + 1)) * depth / 256, y + (at(mask, y - 1, x) - at(mask, y + 1, x)) * depth / 256
            x0, y0 = int(np.floor(fx)), int(np.floor(fy))
            v = sum(at(p, y0 + j, x0 + i) * (fx - x0 if i else 1 - fx + x0) * (fy - y0 if j else 1 - fy + y0) for j in (0, 1) for i in (0, 1))
            out[y, x] = int(min(v, 255 * (1 - 1e-6)) + 1e-6)
    return out


@pytest.mark.parametrize("depth, blur", [(16.0, 2), (40.0, 1), (16.0, 0)])
def test_warp(depth, blur):
    p = np.random.default_rng(1).integers(0, 256, (11, 14))
    assert (edges.warp_sharpen(p, depth=depth, blur=blur) == plain_warp(p, depth, blur)).all()
    flat = np.full((9, 9), 200)
    assert (edges.warp_sharpen(flat) == 200).all() and (edges.warp_sharpen(p, depth=0.0) == np.minimum(p, 254)).sum() > 150


def test_warp_narrows_an_edge():
    ramp = np.tile(np.clip((np.arange(40) - 14) * 20, 0, 240), (12, 1))
    sharp = edges.warp_sharpen(ramp, depth=32.0)
    assert np.abs(np.diff(sharp[6])).max() > np.abs(np.diff(ramp[6])).max()
    mild = edges.warp_sharpen(ramp, depth=32.0, least_depth=0.0, gamma=2.0)
    assert np.abs(mild - ramp).sum() < np.abs(sharp - ramp).sum()


def test_detail():
    p = np.random.default_rng(2).integers(100, 140, (9, 10))
    soft = np.array([[int(sum(p[clamp(y + j, 9), clamp(x + i, 10)] for j in (-1, 0, 1) for i in (-1, 0, 1)) / 9 + 0.5 + 1e-9) for x in range(10)] for y in range(9)])
    d = p - soft
    want = [[int(min(255, max(0, v + 6 * (abs(k) / 4) ** 0.25 * k / (abs(k) + 1))) + 0.5) for v, k in zip(row, ks)] for row, ks in zip(p.tolist(), d.tolist())]
    assert edges.detail_sharpen(p).tolist() == want
    assert (edges.detail_sharpen(np.full((5, 5), 9), damping=0.0) == 9).all()
    assert edges.detail_sharpen(p, binomial=True, median=True).shape == p.shape


def test_dehalo():
    """A bright rim beside an edge is taken down to its surroundings; flat parts stay."""
    p = np.full((12, 24), 60)
    p[:, 12:] = 180
    p[:, 12] = 230
    out = edges.dehalo(p)
    assert (out[:, 12] < 230).all() and (out[:, :9] == 60).all() and (out[:, 16:] == 180).all()
    up = edges.dehalo(p, dark=0.0, bright=1.0, low=100, high=100)
    assert (up >= p).all()
    assert (edges.dehalo(np.full((3, 3), 5)) == 5).all()


def test_deblock():
    step = np.full((8, 16), 100)
    step[:, 8:] = 106
    out = edges.deblock(step, 40)
    assert np.abs(np.diff(out[3])).max() < 6 and (out[:, :6] == 100).all() and (out[:, 10:] == 106).all()
    assert (edges.deblock(step, 10) == step).all()  # the thresholds are 0 for low quantisers
    steep = step.copy()
    steep[:, 8:] = 250
    assert (edges.deblock(steep, 40) == steep).all()
    chroma = edges.deblock(step, 40, chroma=True)
    assert (chroma[:, [7, 8]] != step[:, [7, 8]]).all() and (chroma[:, 6] == 100).all()
    assert (edges.deblock(step.T, 40) == out.T).all() and edges.deblock(np.ones((2, 3), int)).shape == (2, 3)


def test_chroma_moves():
    p = np.arange(30).reshape(5, 6) * 8
    assert (edges.chroma_shift(p, 1, 0)[:, :5] == p[:, 1:]).all() and (edges.chroma_shift(p, 0, 0) == p).all()
    assert edges.chroma_shift(p, 0.5, 0)[0, 0] == 4 and edges.chroma_shift(p, 0, -0.25)[1, 0] == 36


def shapes(height, width, dx=0):
    """Tall boxes, moved by ``dx``."""
    out = np.full((height, width), 40)
    for x in range(8, width - 12, 24):
        out[4 : height - 4, x + dx : x + dx + 10] = 200
    return out


@pytest.mark.parametrize("dx", [0, 2, -2])
def test_chroma_offset(dx):
    luma, chroma = shapes(96, 96), shapes(96, 96, dx)
    sx, sy, n = edges.chroma_offset(luma, chroma, chroma)
    assert n > 500 and np.sign(round(sx / n, 1)) == np.sign(dx) and abs(sy / n) < 0.1


def test_chroma_place():
    luma, chroma = shapes(64, 64), shapes(64, 64, 2)
    row = {"y": luma.ravel(), "u": chroma.ravel(), "v": chroma.ravel()}
    fold, out = plane_map.ChromaPlace(64, 64, frames=3, pairs=50), []
    flat = {k: np.full(64 * 64, 9) for k in row}
    for k, r in enumerate([flat, row, row, row, row]):
        out += fold.push({"frame_id": k} | r)
    assert [r["dx"] == 0 for r in out] == [True, True, True, False, False] and out[3]["dx"] > 0.2
    moved = np.asarray(out[3]["u"]).reshape(64, 64)
    assert np.abs(moved - luma).mean() < np.abs(chroma - luma).mean()
    late = plane_map.ChromaPlace(64, 64, frames=1, pairs=10**9, fallback=(1.0, 0.0))
    got = [late.push({"frame_id": k} | row)[0]["dx"] for k in range(14)]
    assert got[:12] == [0.0] * 12 and got[12:] == [1.0, 1.0]
