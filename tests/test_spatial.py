"""Plane functions that look around a sample, against numpy written from their rules."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.functions import spatial
from reelspark.operators import deinterlace


def planes(spark, *arrays):
    names = [f"p{k}" for k in range(len(arrays))]
    return spark.createDataFrame([tuple(a.ravel().tolist() for a in arrays)], ", ".join(f"{n} array<int>" for n in names))


def noise(height, width, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (height, width))


def test_kernels():
    for name in ["bilinear", "bicubic", "mitchell", "catmull_rom", "hermite", "lanczos2", "lanczos8", "spline16", "spline36", "spline64"]:
        radius, weigh = spatial.kernel(name)
        assert weigh(np.array([float(radius), radius + 0.5])).tolist() == [0, 0]
        assert name in ("mitchell",) or weigh(np.array([0.0]))[0] == pytest.approx(1)
        assert np.allclose(spatial.resize_weights(9, 4, name)[1].sum(1), 1)
    assert spatial.kernel("spline16")[1](np.array([0.5, 1.5])) == pytest.approx([0.575, -0.075])
    assert spatial.kernel("bicubic", b=1.0, c=0.0)[1](np.array([0.0, 1.0])) == pytest.approx([4 / 6, 1 / 6])
    with pytest.raises(ValueError):
        spatial.kernel("lanczos9")


@pytest.mark.parametrize("name, size", [("spline36", (7, 11)), ("lanczos3", (3, 2)), ("bilinear", (5, 6))])
def test_resize(spark, name, size):
    a = noise(5, 6)
    tall, wide = size
    radius, weigh = spatial.kernel(name)

    def matrix(n, m):
        x = (np.arange(m) + 0.5) * n / m
        w = weigh((np.arange(n) + 0.5 - x[:, None]) * min(m / n, 1))
        return w / w.sum(1, keepdims=True)

    want = np.floor(np.clip(matrix(5, tall) @ a @ matrix(6, wide).T, 0, 255.9) + 1e-6).astype(int)
    df = planes(spark, a)
    assert df.select(spatial.resize(df.p0, 6, 5, wide, tall, name).alias("p")).first().p == want.ravel().tolist()


def test_flat_planes_stay(spark):
    df = planes(spark, np.full((6, 6), 100))
    made = [spatial.resize(df.p0, 6, 6, 6, 6), spatial.edge_level(df.p0, 6, 6), spatial.diffuse(df.p0, 6, 6), spatial.knn([df.p0] * 3, 6, 6, radius=1), spatial.edge_sharpen(df.p0, 6, 6), spatial.uncomb(df.p0, 6, 6), spatial.smooth_flat(df.p0, 6, 6), spatial.sharpen_adaptive(df.p0, 6, 6), spatial.lens(df.p0, 6, 6)]
    made += [f(df.p0, df.p0, df.p0, 6, 6, b, s) for f in (spatial.yadif, spatial.bwdif) for b in (False, True) for s in (False, True)]
    for plane in df.select(*[m.alias(f"m{k}") for k, m in enumerate(made)]).first():
        assert plane == [100] * 36


def test_knn_over_time(spark):
    a = [noise(4, 5, k) for k in range(3)]
    want = []
    for y in range(4):
        for x in range(5):
            c, v, w = a[1][y, x] / 256, [], []
            for t in range(3):
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        v.append(a[t][min(max(y + dy, 0), 3), min(max(x + dx, 0), 4)] / 256)
                        w.append(np.exp(-((c - v[-1]) ** 2 / 0.04 + (dx * dx + dy * dy) / 9 + (t - 1) ** 2 / 9)))
            v, w = np.array(v), np.array(w)
            own = 0.2 if (w > 0.01).mean() > 0.8 else 0.8
            mean = (v * w).sum() / w.sum()
            want.append(int((mean + (c - mean) * own) * 256 + 1e-6))
    df = planes(spark, *a)
    assert df.select(spatial.knn([df.p0, df.p1, df.p2], 5, 4, radius=1, strength=0.2).alias("p")).first().p == want


def test_sharpening_options(spark):
    a = np.array([[0, 0, 200, 200, 200]] * 4)
    df = planes(spark, a)
    row = lambda **o: df.select(spatial.edge_sharpen(df.p0, 5, 4, **o).alias("p")).first().p[:5]
    assert row(mask=True) == [254, 254, 254, 254, 0]  # the last place and the one beside it see three columns of 200
    assert row() == [0, 0, 254, 200, 200]
    assert row(luma_limit=255.0, strength=0.5) == [0, 0, int(200 + 200 / 255 * 0.5 * 55 + 1e-6), 200, 200]
    soft = row(slope=50.0, mask=True)
    assert soft[0] > soft[4] > 0


def test_one_rational_diffusion(spark):
    df = planes(spark, np.array([[0, 0, 200, 200, 200]] * 4))
    # Blurred to 13, 63, 138, 188, 200: the edge moves by 200 / 4 / (1 + 75 ** 2 / 256), which is 2.18; threshold 100 keeps it.
    assert df.select(spatial.diffuse(df.p0, 5, 4, threshold=160.0, times=1, exponential=False).alias("p")).first().p[:5] == [0, 2, 198, 200, 200]
    assert df.select(spatial.diffuse(df.p0, 5, 4, exponential=False).alias("p")).first().p[:5] == [0, 0, 200, 200, 200]


@pytest.mark.parametrize("second", [False, True])
def test_bwdif_cubic(spark, second):
    h, w = 12, 3
    a = [noise(h, w, k + 7) for k in range(3)]
    early, late = (a[1], a[2]) if second else (a[0], a[1])
    at = lambda p, y, x: int(p[min(max(y, 0), h - 1), x])
    want = a[1].copy()
    for y in range(1, h, 2):
        for x in range(w):
            up, down = at(a[1], y - 1, x), at(a[1], y + 1, x)
            pair = lambda d: at(early, y + d, x) + at(late, y + d, x)
            t, change = pair(0) >> 1, abs(at(early, y, x) - at(late, y, x))
            moves = [(abs(at(o, y - 1, x) - up) + abs(at(o, y + 1, x) - down)) >> 1 for o in (a[0], a[2])]
            motion = spread = max(change >> 1, *moves)
            if motion == 0:
                want[y, x] = t
                continue
            if 2 <= y < h - 2:
                far = (pair(-2) >> 1) - up, (pair(2) >> 1) - down
                spread = max(motion, min(t - down, t - up, max(far)), -max(t - down, t - up, min(far)))
            value = (up + down) >> 1
            if 4 <= y < h - 4:
                outer = at(a[1], y - 3, x) + at(a[1], y + 3, x)
                if abs(up - down) > change:
                    high = (5570 * pair(0) - 3801 * (pair(-2) + pair(2)) + 1016 * (pair(-4) + pair(4))) >> 2
                    value = (high + 4309 * (up + down) - 213 * outer) >> 13
                else:
                    value = (5077 * (up + down) - 981 * outer) >> 13
            want[y, x] = min(max(min(max(value, t - spread), t + spread), 0), 255)
    df = planes(spark, *a)
    assert df.select(spatial.bwdif(df.p0, df.p1, df.p2, w, h, True, second).alias("p")).first().p == want.ravel().tolist()


def test_field_times_and_order(spark):
    frames = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 41, 0), (1, 2, 80, 7), (2, 0, None, None)], "stream_id long, frame_id long, pts long, duration long")
    got = [(r.frame_id, r.field, r.pts, r.duration) for r in deinterlace.field_times(frames, 40).orderBy("stream_id", "frame_id", "field").collect()]
    assert got == [(0, 0, 0, 20), (0, 1, 20, 20), (1, 0, 41, 21), (1, 1, 62, 20), (2, 0, 80, 4), (2, 1, 84, 3), (0, 0, None, 20), (0, 1, None, 20)]
    assert deinterlace.field_times(frames.limit(0)).count() == 0
    rows = frames.where("stream_id = 1").withColumns({"plane": F.array(*[F.lit(k) for k in (10, 10, 90, 90)]), "note": F.lit("x")})
    top, bottom = (deinterlace.deinterlace(rows, 2, 2, "yadif", top_first=t).orderBy("frame_id").first() for t in (True, False))
    assert top.plane[:2] == [10, 10] and bottom.plane[2:] == [90, 90] and top.note == "x"
    with pytest.raises(KeyError):
        deinterlace.deinterlace(rows, 2, 2, "other")


def test_smoothing_lens_and_adaptive_sharpening(spark):
    a = np.full((5, 5), 100)
    a[2, 2] = 110
    df = planes(spark, a)
    first = lambda c: np.array(df.select(c.alias("p")).first().p).reshape(5, 5)
    smooth = first(spatial.smooth_flat(df.p0, 5, 5, times=1))
    # 510 / 5 in the middle and beside it; the corners of the inner square have two neighbours away from the border, both 100.
    assert smooth[2].tolist() == [100, 103, 102, 103, 100] and smooth[1].tolist() == [100, 100, 103, 100, 100]
    assert (first(spatial.smooth_flat(df.p0, 5, 5, threshold=0.0)) == a).all()
    assert (first(spatial.lens(df.p0, 5, 5)) == a).all()
    pulled = first(spatial.lens(df.p0, 5, 5, k1=2.0, fill=7))
    assert pulled[0, 0] == 7 and pulled[2, 2] != 7
    e, b = 110 / 255, 100 / 255
    w = -np.sqrt(min(b, 1 - e) / e) / 8
    assert first(spatial.sharpen_adaptive(df.p0, 5, 5, sharpness=0.0, squared=False))[2, 2] == int((4 * b * w + e) / (1 + 4 * w) * 255 + 1e-6)


def test_seek_from_the_first_key_frame(spark):
    from reelspark.operators import selection

    rows = [(1, k, 10 * k, k == 2) for k in range(6)] + [(2, 0, 999, False), (2, 1, 5000, None)]
    frames = spark.createDataFrame(rows, "stream_id long, frame_id long, pts long, key boolean")
    ids = lambda df: sorted((r.stream_id, r.frame_id) for r in df.collect())
    assert ids(selection.seek(frames, 15, 5, key="key")) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]
    assert ids(selection.seek(frames, 0)) == ids(frames)
    assert selection.seek(frames.limit(0), 15, key="key").count() == 0
