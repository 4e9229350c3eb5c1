"""Rates, whole-frame quality, functions of the user's own, and what side tables and field flags do."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.functions import kernels, user
from reelspark.operators import deinterlace, folds, lookups, plane_map
from reelspark.operators.fold import column_values, fold_streams
from reelspark.sources import text


def frames_of(spark, rows, more=""):
    return spark.createDataFrame(rows, "stream_id long, frame_id long, pts long, duration long" + more)


def test_multiplied_frames(spark):
    out = deinterlace.multiply_frames(frames_of(spark, [(1, 1, 100, 7), (1, 2, 110, 7), (1, 3, 105, 9), (2, 1, 0, 5)]), 4).orderBy("stream_id", "frame_id", "part").collect()
    assert [(r.frame_id, r.part, r.pts, r.duration) for r in out if r.stream_id == 1] == [(1, 4, 100, 7), (2, 1, 102, 2), (2, 2, 105, 2), (2, 3, 107, 2), (2, 4, 110, 2), (3, 1, 110, 9), (3, 2, 110, 9), (3, 3, 110, 9), (3, 4, 105, 9)]
    assert [(r.frame_id, r.pts, r.position) for r in out if r.stream_id == 2] == [(1, 0, 1.0)]


def test_converted_rate():
    def run(ticks, times):
        fold, out = deinterlace.RateConversion(ticks), []
        for k, t in enumerate(times):
            out += fold.push({"frame_id": k, "pts": t, "duration": 3})
        return [(r["frame_id"], r["pts"], r["duration"], r["copied"]) for r in out]

    assert run(None, [0, 10, 21]) == [(0, 0, 3, True), (1, 5, 5, False), (1, 10, 5, True), (2, 15, 5, False), (2, 21, 6, True)]
    # Every 8 ticks: a place one tick from a frame takes it, and the next places count from there.
    assert run((8, 1), [0, 9, 20, 21]) == [(0, 0, 3, True), (1, 8, 8, True), (2, 16, 8, False)]
    assert run((5, 2), [0, 10]) == [(0, 0, 3, True), (1, 3, 3, False), (1, 5, 2, False), (1, 8, 3, False), (1, 10, 2, True)]
    assert run((100, 1), [0, 10, 20]) == [(0, 0, 3, True)]
    assert run((8, 1), [50, 10, 60])[1:] == [(2, 58, 8, False)]


def plain_ssim(a, b):
    """Every window by itself."""
    total, count = 0.0, 0
    for y in range(0, a.shape[0] // 4 * 4 - 7, 4):
        for x in range(0, a.shape[1] // 4 * 4 - 7, 4):
            p, q = a[y : y + 8, x : x + 8].astype(float).ravel(), b[y : y + 8, x : x + 8].astype(float).ravel()
            c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
            spread = p.var() * 64 / 63 + q.var() * 64 / 63
            joint = ((p - p.mean()) * (q - q.mean())).sum() / 63
            total += (2 * p.mean() * q.mean() + c1) * (2 * joint + c2) / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (spread + c2))
            count += 1
    return total / count


def test_plane_ssim():
    rng = np.random.default_rng(1)
    for shape in ((8, 8), (20, 33), (15, 40)):
        a = rng.integers(0, 256, shape)
        b = np.clip(a + rng.integers(-20, 20, shape), 0, 255)
        assert kernels.plane_ssim(a, b) == pytest.approx(plain_ssim(a, b))
        assert kernels.plane_ssim(a, a) == pytest.approx(1)


def test_frame_quality(spark):
    rng = np.random.default_rng(2)
    rows = [(1, k, rng.integers(0, 256, 16 * 12).tolist(), rng.integers(0, 256, 8 * 8).tolist()) for k in range(3)]
    schema = "stream_id long, frame_id long, y array<int>, u array<int>"
    source, coded = spark.createDataFrame(rows, schema), spark.createDataFrame([(s, k + 10, [v // 2 * 2 for v in y], u) for s, k, y, u in rows[:2]], schema)
    got = {r["plane"]: r for r in plane_map.frame_quality(source, coded, {"y": 16, "u": 8}).collect()}
    error = [sum((v % 2) ** 2 for v in y) / 192 for _, _, y, _ in rows[:2]]
    assert set(got) == {"all", "y", "u"} and {r.frames for r in got.values()} == {2}
    assert got["u"].ssim == 1 and got["u"].psnr is None and got["u"].ssim_db is None
    assert got["y"].psnr == pytest.approx(10 * math.log10(255**2 / np.mean(error)))
    assert got["all"].psnr == pytest.approx(10 * math.log10(255**2 / (np.mean(error) * 192 / 256)))
    assert got["all"].ssim == pytest.approx(got["y"].ssim * 0.75 + 0.25)
    assert plane_map.frame_quality(source.limit(0), coded, {"y": 16}).collect() == []


def test_user_functions(spark):
    frames = spark.createDataFrame([(1, 1, [1, 2, 3, 4]), (1, 2, None), (1, 3, []), (1, 4, [9, 9, 9, 9])], "stream_id long, frame_id long, plane array<int>")
    twice = user.sample_kernel(lambda x: x * 2)
    assert [r.p for r in frames.orderBy("frame_id").select(twice(F.col("plane")).alias("p")).collect()] == [[2, 4, 6, 8], None, [], [18, 18, 18, 18]]
    full = frames.where("size(plane) > 0")
    got = user.shade(full, 2, lambda x, y, p: p + np.where((x > 0.5) & (y < 0.5), 100, 0)).orderBy("frame_id").collect()
    assert [r.plane for r in got] == [[1, 102, 3, 4], [9, 109, 9, 9]]
    assert user.shade(full, 2, lambda x, y, p: p / 2, kind="double").orderBy("frame_id").first().plane == [0.5, 1.0, 1.5, 2.0]
    with pytest.raises(Exception, match="same shape"):
        user.shade(full, 2, lambda x, y, p: p[:1]).collect()
    with pytest.raises(Exception, match="a sample for each"):
        full.select(user.sample_kernel(lambda x: x[:1])(F.col("plane"))).collect()


def test_overlapping_grain_intervals(spark):
    frames = frames_of(spark, [(1, k, 10 * k, 10) for k in range(5)])
    table = spark.createDataFrame([(0, 100, 1, "a"), (10, 30, 2, "b"), (10, 30, 3, "c")], "start long, end long, seed long, params string")
    got = [(r.frame_id, r.seed, r.params) for r in lookups.film_grain(frames, table).orderBy("frame_id").collect()]
    assert got == [(0, 1, "a"), (1, 2, "b"), (2, 2, "b"), (3, 1, "a"), (4, 1, "a")]


def test_field_order_of_each_frame(spark):
    rng = np.random.default_rng(3)
    rows = [(1, k, k * 40, 40, rng.integers(0, 256, 64).tolist(), top) for k, top in enumerate((True, False, None, False))]
    frames = frames_of(spark, rows, ", plane array<int>, top boolean")
    by_flag = {r.frame_id: r.plane for r in deinterlace.deinterlace(frames, 8, 8, "bwdif", "top").collect()}
    for flag in (True, False):
        whole = {r.frame_id: r.plane for r in deinterlace.deinterlace(frames, 8, 8, "bwdif", flag).collect()}
        assert all(by_flag[k] == whole[k] for k, r in enumerate(rows) if (r[5] is not False) == flag)


def test_repeats_by_all_planes():
    fold, rows = folds.DropRepeats(high=100, low=50, share=0.5, planes={"y": 8, "u": 4}), []
    y, u = np.zeros(64, int), np.zeros(16, int)
    for dy, du in ((0, 0), (0, 0), (1, 0), (0, 6), (2, 0), (0, 0)):
        rows += fold.push({"frame_id": len(rows), "y": y + dy, "u": u + du})
    rows += fold.finish()
    # One of two blocks may differ by over 50, none by over 100.
    assert [r["dropped"] for r in rows] == [False, True, True, True, False, False]


def test_apple_chapters(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<?xml version="1.0"?><TextStream version="1.1"><TextStreamHeader/><TextSample sampleTime="00:00:00.000">Start</TextSample><TextSample sampleTime="00:01:02.500"/><TextSample sampleTime="odd">x</TextSample><TextSample sampleTime="01:00:00:007">End</TextSample></TextStream>')
    got = [(r.id, r.start_ms, r.name) for r in text.read_apple_chapters(spark, str(tmp_path / "c.xml")).orderBy("id").collect()]
    assert got == [(1, 0, "Start"), (2, 62_500, None), (3, 3_600_007, "End")]


def test_folds_read_arrays_with_nulls(spark):
    """Lists of numbers come as arrays, null ones as None, also in a slice of a batch."""
    import pyarrow as pa

    column = pa.array([[1, 2], None, [], [3]], pa.list_(pa.int32()))
    assert [None if v is None else v.tolist() for v in column_values(column)] == [[1, 2], None, [], [3]]
    assert [None if v is None else v.tolist() for v in column_values(column.slice(1, 3))] == [None, [], [3]]
    assert column_values(pa.array([[1, None]], pa.list_(pa.int32()))) == [[1, None]]
    frames = spark.createDataFrame([(1, k, [k] * 64) for k in range(40)], "stream_id long, frame_id long, plane array<int>")
    out = fold_streams(frames, lambda: plane_map.LowPass(8)).orderBy("frame_id").collect()
    assert len(out) == 40 and out[0].plane == [0] * 64


def test_score_distribution(spark, monkeypatch):
    """Percentiles equal numpy's, with ties, nulls, a null group, one value and many parts."""
    from reelspark.operators import reports

    monkeypatch.setattr(reports, "PARTS", 8)
    rng = np.random.default_rng(4)
    groups = {"a": rng.integers(0, 20, 500).astype(float), "b": rng.normal(size=333), "c": np.array([7.0]), None: np.array([1.0, 1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("d", None)]
    got = {r.kind: r for r in reports.score_distribution(spark.createDataFrame(rows, "kind string, score double"), "kind", "score", (0.01, 0.25, 0.5, 0.99)).collect()}
    assert set(got) == {*groups, "d"} and got["d"].p50 is None and got["d"].mean is None
    for g, vs in groups.items():
        r = got[g]
        assert (r.mean, r.deviation, r.least, r.greatest) == pytest.approx((vs.mean(), vs.std(), vs.min(), vs.max()))
        assert [r.p01, r.p25, r.p50, r.p99] == pytest.approx(np.percentile(vs, [1, 25, 50, 99]).tolist())
