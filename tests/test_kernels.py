"""Whole-plane kernels against plain versions and what they promise."""

from __future__ import annotations

import math

import numpy as np
import pytest

from reelspark.functions import kernels
from reelspark.operators import plane_map


def texture(height, width, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.normal(size=(height // 4 + 3, width // 4 + 3)).repeat(4, 0).repeat(4, 1)
    for axis in (0, 1):
        p = sum(np.roll(p, k, axis) for k in range(4)) / 4
    p = p[4 : height + 4, 4 : width + 4]
    return np.clip(128 + 40 * (p - p.mean()) / p.std(), 0, 255)


@pytest.mark.parametrize("dx, dy", [(0, 0), (3, -5), (-7, 2), (12, 9)])
def test_phase_shift_of_whole_samples(dx, dy):
    big = np.round(texture(300, 300))
    a, b = big[20:276, 20:276], big[20 - dy : 276 - dy, 20 - dx : 276 - dx]
    x, y, trust = kernels.phase_shift(kernels.phase_spectrum(a), kernels.phase_spectrum(b), 256, 256)
    assert abs(x - dx) < 0.05 and abs(y - dy) < 0.05 and trust > 1000


def test_phase_shift_of_larger_planes():
    """A plane of twice the transform's size: shifts by whole means of two samples."""
    big = np.round(texture(560, 560))
    a, b = big[20:532, 20:532], big[26:538, 12:524]
    x, y, _ = kernels.phase_shift(kernels.phase_spectrum(a), kernels.phase_spectrum(b), 512, 512)
    assert abs(x - 8) < 0.1 and abs(y + 6) < 0.1


def test_shift():
    p = np.arange(12).reshape(3, 4) * 10
    assert (kernels.shift(p, 1, 0)[:, 1:] == p[:, :3]).all() and (kernels.shift(p, 1, 0, fill=7)[:, 0] == 7).all()
    assert (kernels.shift(p, 0, -1, "clamp")[2] == p[2]).all()
    assert (kernels.shift(p, 2, 0, "mirror")[:, :2] == p[:, 1::-1]).all()
    assert kernels.shift(p, 0.5, 0, "clamp")[0, 2] == 15 and (kernels.shift(p, 0, 0) == p).all()


def test_stabilise():
    """A camera that moves two samples a frame: the average follows and frames move against it."""
    big = np.round(texture(120, 160)).astype(np.int32)
    frames = [big[20:84, 20 + 2 * k : 84 + 2 * k] for k in range(8)]
    fold, out = plane_map.Stabilise(64, 64, damping=0.0, threshold=0.1, border="clamp"), []
    for k, p in enumerate(frames):
        out += fold.push({"frame_id": k, "plane": p.ravel()})
    assert (np.asarray(out[0]["plane"]).reshape(64, 64) == frames[0]).all()
    assert all(abs(r["x"] + 2) < 0.3 and abs(r["y"]) < 0.3 and r["accepted"] for r in out[1:])


def plain_low_pass(plane, before, spatial, temporal):
    """Sample by sample."""

    def step(a, b, s):
        if s <= 0:
            return b
        d = (a - b) * 255
        k = max(-256, min(255, int(d + (0.5 if d >= 0 else -0.5))))
        return b + math.exp(-abs(k) / (s / math.log(4) + 1e-7)) * k / 256

    p = [[v / 255 for v in row] for row in plane.tolist()]
    for row in p:
        for x in range(len(row)):
            row[x] = step(row[max(x - 1, 0)], row[x], spatial)
    for y in range(len(p)):
        for x in range(len(p[0])):
            p[y][x] = step(p[max(y - 1, 0)][x], p[y][x], spatial)
    if before is not None:
        p = [[step(b, v, temporal) for b, v in zip(rb, rv)] for rb, rv in zip(before, p)]
    return p


def test_low_pass():
    rng = np.random.default_rng(1)
    fold, before = plane_map.LowPass(9, 4.0, 6.0), None
    for k in range(4):
        plane = rng.integers(100, 160, (7, 9))
        before = plain_low_pass(plane, before, 4.0, 6.0)
        got = fold.push({"frame_id": k, "plane": plane.ravel()})[0]["plane"]
        assert got.tolist() == [int(min(1, max(0, v)) * 255 + 0.5) for row in before for v in row]
    flat = plane_map.LowPass(4).push({"frame_id": 0, "plane": np.full(16, 77)})[0]["plane"]
    assert (flat == 77).all()
    same = plane_map.LowPass(4, 0.0, 0.0).push({"frame_id": 0, "plane": np.arange(16)})[0]["plane"]
    assert (same == np.arange(16)).all()
    deep = plane_map.LowPass(4, bitdepth=10).push({"frame_id": 0, "plane": np.full(16, 777)})[0]["plane"]
    assert (deep == 777).all()


def plain_likeness(planes, t, r, sigma, h):
    p = [q / 255 for q in planes]
    height, width = p[0].shape
    at = lambda q, y, x: q[min(max(y, 0), height - 1), min(max(x, 0), width - 1)]
    clamp = lambda v, n: min(max(v, 0), n - 1)
    total, value = np.ones((height, width)), p[0].copy()
    for k, other in enumerate(p):
        for dy in range(-r, (0 if k == 0 else r) + 1):
            for dx in range(-r, r + 1):
                if k == 0 and dy * (2 * r - 1) + dx >= 0:
                    continue
                for y in range(height):
                    for x in range(width):
                        v = 0.0
                        for j in range(-t, t + 1):
                            for i in range(-t, t + 1):
                                cy, cx = clamp(y + j, height), clamp(x + i, width)
                                v += (p[0][cy, cx] - at(other, cy + dy, cx + dx)) ** 2
                        w = math.exp(-max(v - 2 * sigma, 0) / h**2)
                        total[y, x] += w
                        value[y, x] += w * at(other, y + dy, x + dx)
                        if k == 0 and 0 <= y + dy < height and 0 <= x + dx < width:
                            total[y + dy, x + dx] += w
                            value[y + dy, x + dx] += w * p[0][y, x]
    return np.floor(np.clip(value / total * 255, 0, 255.9) + 1e-6)


def test_non_local_means():
    rng = np.random.default_rng(2)
    planes = [rng.integers(90, 150, (6, 8)) for _ in range(2)]
    assert (kernels.non_local_means(planes, 3, 5, 0.005, 0.4) == plain_likeness(planes, 1, 2, 0.005, 0.4)).all()
    noisy = np.clip(np.round(texture(32, 32) + rng.normal(0, 6, (32, 32))), 0, 255)
    clean = kernels.non_local_means([noisy], sigma=0.005, h=0.2)
    assert np.std(clean - texture(32, 32)) < 0.85 * np.std(noisy - texture(32, 32))
    assert (kernels.non_local_means([np.full((9, 7), 200)]) == 200).all()


def test_fft3d():
    rng = np.random.default_rng(3)
    truth = texture(70, 52)
    noisy = [np.clip(np.round(truth + rng.normal(0, 8, truth.shape)), 0, 255) for _ in range(4)]
    error = lambda p: float(np.std(p - truth))
    one, three, four = kernels.fft3d(noisy[:1], 0, sigma=80.0), kernels.fft3d(noisy[:3], 1, sigma=120.0), kernels.fft3d(noisy, 2, sigma=120.0)
    assert error(one) < 0.8 * error(noisy[0]) and error(three) < error(one) and four.shape == truth.shape
    assert set(np.unique(kernels.fft3d([np.full((40, 33), 91)], sigma=50.0))) <= {90, 91}  # the mean is lessened by a trace and rounded down
    same = kernels.fft3d([noisy[0]], sigma=0.0)
    assert np.abs(same - noisy[0]).max() <= 1
    assert np.abs(kernels.fft3d([noisy[0]], sigma=1e9, amount=0.0) - noisy[0]).max() <= 1
    assert np.abs(kernels.fft3d([noisy[0]], sigma=0.0, hard=True) - noisy[0]).max() <= 1
    ramp = kernels.fft3d([noisy[0]], sigma=(200.0, 0.0, 0.0, 0.0))
    assert 0 < np.abs(ramp - noisy[0]).max() and error(ramp) < error(noisy[0])
    with pytest.raises(ValueError):
        kernels.fft3d([truth], overlap=0.0)


def plain_dct(plane, size, step, sigma):
    height, width = plane.shape
    m = kernels.cosine_matrix(size)
    mirror = lambda k, n: min(max(-k if k < 0 else 2 * (n - 1) - k if k > n - 1 else k, 0), n - 1)
    out, seen = np.zeros(plane.shape), np.zeros(plane.shape)
    for y in range(step - size, height, step):
        for x in range(step - size, width, step):
            block = np.array([[plane[mirror(y + j, height), mirror(x + i, width)] for i in range(size)] for j in range(size)], float)
            c = m @ block @ m.T
            c = np.where((np.abs(c) <= 3 * sigma) & (np.arange(size * size).reshape(size, size) > 0), 0, c)
            back = m.T @ c @ m
            for j in range(size):
                for i in range(size):
                    if 0 <= y + j < height and 0 <= x + i < width:
                        out[y + j, x + i] += back[j, i]
                        seen[y + j, x + i] += 1
    assert (seen == (size // step) ** 2).all()
    return out / seen


@pytest.mark.parametrize("size, step, shape", [(8, 2, (20, 27)), (4, 1, (9, 8)), (8, 8, (17, 16)), (8, 4, (5, 30))])
def test_dct(size, step, shape):
    plane = np.random.default_rng(4).integers(0, 256, shape)
    assert np.allclose(kernels.dct_denoise(plane, size, step, 5.0), plain_dct(plane, size, step, 5.0))
    assert np.allclose(kernels.cosine_matrix(size) @ kernels.cosine_matrix(size).T, np.eye(size))


def test_dct_of_colours():
    rng = np.random.default_rng(5)
    truth = [texture(40, 40, k) for k in range(3)]
    noisy = [np.clip(np.round(t + rng.normal(0, 6, t.shape)), 0, 255) for t in truth]
    clean = kernels.dct_denoise_colours(noisy, sigma=6.0)
    assert all(np.std(c - t) < 0.8 * np.std(n - t) for c, n, t in zip(clean, noisy, truth))
    assert all((p == 120).all() for p in kernels.dct_denoise_colours([np.full((9, 9), 120)] * 3))
    assert np.allclose(kernels.DECORRELATE @ kernels.DECORRELATE.T, np.eye(3))


@pytest.mark.parametrize("name, shape", kernels.DESCALE_KERNELS)
@pytest.mark.parametrize("border", ["mirror", "repeat"])
def test_descale_inverts_enlarging(name, shape, border):
    small = np.random.default_rng(6).integers(0, 256, (18, 23))
    big = kernels.scale_matrix(18, 30, name, border, **shape) @ small @ kernels.scale_matrix(23, 41, name, border, **shape).T
    assert (kernels.descale(big, 23, 18, name, border, **shape) == small).all()
    assert np.allclose(kernels.scale_matrix(18, 30, name, border, **shape).sum(1), 1)


def test_descale_knows_the_kernel():
    small = np.round(texture(24, 32))
    for name, shape in kernels.DESCALE_KERNELS:
        big = np.clip(np.round(kernels.scale_matrix(24, 40, name, **shape) @ small @ kernels.scale_matrix(32, 56, name, **shape).T), 0, 255)
        errors = [kernels.descale_error(big, 32, 24, n, **s) for n, s in kernels.DESCALE_KERNELS]
        assert errors[kernels.DESCALE_KERNELS.index((name, shape))] == pytest.approx(min(errors), rel=0.2)


def test_decomb():
    comb = np.zeros((16, 8), int)
    comb[1::2] = 100
    (made,), combed = kernels.decomb([comb], full=False)
    assert combed and (made[:15] == 0).all()
    flat = np.arange(128).reshape(16, 8)
    (made,), combed = kernels.decomb([flat], full=False)
    assert not combed and (made == flat).all()
    (made,), combed = kernels.decomb([flat])
    assert combed and (made == flat).all()
    some = flat.copy()
    some[3, 2] = 255  # one combed sample isn't enough for a box
    assert not kernels.decomb([some], full=False)[1]
    (mixed, chroma), _ = kernels.decomb([comb, np.zeros((8, 4), int)], blend=True)
    assert set(np.unique(mixed[1:-1])) <= {50} and (chroma == 0).all()


def test_planes_of_rows(spark):
    frames = spark.createDataFrame([(1, 1, [5] * 16), (1, 2, None), (2, 1, [7] * 16)], "stream_id long, frame_id long, plane array<int>")
    got = {(r.stream_id, r.frame_id): r.plane for r in plane_map.dct_denoise(frames, 4, size=4).collect()}
    assert got == {(1, 1): [5] * 16, (1, 2): None, (2, 1): [7] * 16}
    assert plane_map.fft3d(frames.limit(0), 4, size=4).collect() == []
    single = frames.where("stream_id = 2")
    assert plane_map.non_local_means(single, 4, reach=2).first().plane == [7] * 16
    assert plane_map.fft3d(single, 4, size=4, frames_at_once=4, sigma=0.0).first().plane == [7] * 16


def test_planes_are_handed_over_in_small_batches(spark, monkeypatch):
    import pyarrow as pa

    from reelspark import media_queries
    from reelspark.operators import plane_map

    frames = spark.createDataFrame([], "stream_id long, frame_id long, plane array<int>")
    caught = []
    with monkeypatch.context() as m:
        m.setattr(type(frames), "mapInArrow", lambda self, run, schema: caught.append(run) or self)
        plane_map.map_planes(frames, ["plane"], lambda p: {"plane": np.repeat(p, 256)}, "plane array<int>", 2)
    planes = [None if k % 7 == 3 else [k, k + 1, k + 2, k + 3] for k in range(5000)]
    batch = pa.record_batch({"stream_id": [5] * 5000, "frame_id": list(range(5000)), "plane": pa.array(planes, pa.list_(pa.int32()))})
    given = list(caught[0](iter([batch, batch.slice(0, 0), batch.slice(4990)])))
    assert max(b.nbytes for b in given) < 3 << 20 and len(given) > 5
    ids, rows = ([v for b in given for v in b.column(c).to_pylist()] for c in ("frame_id", "plane"))
    assert ids == [*range(5000), *range(4990, 5000)]
    assert rows == [None if planes[k] is None else np.repeat(planes[k], 256).tolist() for k in ids]
    plan = media_queries.descale_kernels(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
