"""A logo's strength found from the picture."""

from __future__ import annotations

import numpy as np
import pytest

from reelspark.operators import logo as logos


def scene(seed, height=40, width=48):
    rng = np.random.default_rng(seed)
    p = rng.normal(size=(height // 8 + 2, width // 8 + 2)).repeat(8, 0).repeat(8, 1)
    for axis in (0, 1):
        p = sum(np.roll(p, k, axis) for k in range(8)) / 8
    p = p[:height, :width]
    return 110 + 25 * (p - p.mean()) / p.std()


def mark(height=40, width=48):
    """Bright letters of half depth."""
    depth = np.zeros((height, width))
    depth[10:30, 12:16] = depth[10:14, 12:30] = depth[20:24, 12:26] = depth[10:30, 34:38] = 0.5
    return np.full((height, width), 235.0), depth


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.8, 1.0])
def test_known_strengths_are_found(share):
    logo, depth = mark()
    mask = logos.prewitt(logo * depth, 1) > 8
    for seed in range(3):
        d = depth * share
        plane = np.round(scene(seed) * (1 - d) + logo * d)
        assert logos.strength(plane, logo, depth, mask) == pytest.approx(256 * share, abs=32)


def test_parabolas():
    x = np.arange(9.0)
    assert logos.parabola(x, 3 - 2 * x + x * x) == pytest.approx([3, -2, 1])
    assert logos.parabola(x[:2], x[:2] * 4 + 1) == pytest.approx([1, 4, 0]) and logos.parabola(x[:1], np.array([7.0])) == pytest.approx([7, 0, 0])
    assert logos.least_point(x, np.abs(x - 4.5)) == pytest.approx(4.5, abs=0.6)
    assert logos.least_point(x, (x - 3.3) ** 2) == pytest.approx(3.3, abs=1e-6)
    assert logos.least_point(x, (x + 1.0) ** 2) == pytest.approx(-1.0)


def test_prewitt():
    ramp = np.tile(np.arange(8.0) * 2, (6, 1))
    assert logos.prewitt(ramp, 1)[3, 4] == pytest.approx(3 * 4) and (logos.prewitt(np.full((5, 5), 3), 2) == 0).all()


def test_smoothing(spark):
    def run(values):
        rows = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(values)], "stream_id long, frame_id long, strength double")
        return [r.strength for r in logos.smooth_strengths(rows).orderBy("frame_id").collect()]

    assert run([0, 10, 10, 10, 0]) == pytest.approx([0, 3, 3, 3, 0])
    assert run([250] * 4) == pytest.approx([254.2] * 4)
    assert run([100, 100, 100, 60, 100, 100, 100])[3] == 100  # a dip is filled
    assert run([100, 100, 100, 140, 100, 100, 100])[3] == 100 and run([100, 100, 100, 110, 100, 100, 100])[3] == 110
    assert run([150]) == [150]


def test_take_off(spark):
    logo, depth = mark()
    shares = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0, 1.0, 1.0]
    truth = [scene(k // 4) for k in range(len(shares))]
    rows = [(1, k, np.round(t * (1 - depth * s) + logo * depth * s).astype(int).ravel().tolist()) for k, (t, s) in enumerate(zip(truth, shares))]
    frames = spark.createDataFrame(rows, "stream_id long, frame_id long, plane array<int>")
    got = logos.take_off(frames, 48, logo, depth).orderBy("frame_id").collect()
    assert [r.strength / 256 for r in got] == pytest.approx(shares, abs=0.12)
    for r, t, (_, _, p) in zip(got[3:], truth[3:], rows[3:]):
        before, after = (np.abs(np.array(v).reshape(40, 48) - t)[depth > 0].mean() for v in (p, r.plane))
        assert after < before / 3
    with pytest.raises(ValueError):
        logos.logo_strengths(frames, 48, np.zeros((1 << 17, 48)), np.zeros((1 << 17, 48)))
