"""Worked examples from the rules, not from the code."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reelspark.functions import planes
from reelspark.operators import folds, lookups, reports, selection, timing


def test_unknown_times_in_a_row(spark):
    known = spark.createDataFrame([(1, 0, 100), (1, 100, 40), (1, 140, 7)], "stream_id long, pts long, duration long")
    given = [None, 0, None, None, 100, 100, 100, 140, 999, 888, 777]
    frames = spark.createDataFrame([(1, k, p) for k, p in enumerate(given)], "stream_id long, frame_id long, pts long")
    got = [(r.pts, r.duration) for r in timing.resolve_output_pts(frames, known).orderBy("frame_id").collect()]
    # 0 lasts 100; the next two halve the rest: 50 and 75. 100 comes again: 120, and the third time it is found with half its duration.
    assert got == [(None, None), (0, 100), (50, 50), (75, 25), (100, 40), (120, 20), (100, 20), (140, 7), (143, 4), (145, 2), (146, 1)]


def test_open_ranges_sort_by_their_given_end(spark):
    frames = spark.createDataFrame([(0,), (2,), (2,), (5,)], "frame_id long")
    ranges = spark.createDataFrame([(0, 0, "open", 1, 1.0), (0, 2, "closed", 2, 2.0)], "start long, end long, mode string, bitrate long, quality double")
    got = sorted((r.frame_id, r.mode) for r in lookups.dynamic_rate_control(frames, ranges).collect())
    assert got == [(0, "closed"), (2, "closed"), (2, "closed"), (5, "open")]
    plan = lookups.dynamic_rate_control(frames, ranges.where("end > 0"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_damping_outlives_a_scene_change():
    fold = folds.Deflicker(30, damping=0.5)
    for k in range(8):
        before = fold.push({"frame_id": k, "mean": 100.0 + k % 2, "sigma": 10.0})[0]
    assert fold.push({"frame_id": 8, "mean": 200.0, "sigma": 10.0})[0]["scene_change"]
    after = fold.push({"frame_id": 9, "mean": 210.0, "sigma": 10.0})[0]
    assert after["offset"] == pytest.approx(0.5 * before["offset"] + 0.5 * (205.0 - 210.0))


def test_a_new_lock_lifts_the_confidence_and_a_held_phase_stays():
    fold = folds.CadenceTracker()
    out = [fold.push({"frame_id": k, "match": m})[0] for k, m in enumerate("cccnn" + "n")]
    # Locked at 4. C was predicted and N came: 3. CCNNN fits phases 0 and 1 with four each; the first stays, so nothing is lifted.
    assert [(r["phase"], r["confidence"]) for r in out[4:]] == [(0, 4), (0, 3)]
    slip = folds.CadenceTracker()
    slip.phase, slip.locked, slip.confidence, slip.predicted = 0, True, 1, "N"
    slip.last.extend("CCNN")
    # A wrong prediction: 0. CCNNC is phase 1 in full: 4.
    assert slip.push({"frame_id": 0, "match": "c"})[0] == {"frame_id": 0, "phase": 1, "locked": True, "confidence": 4, "predicted": "C"}
    held = folds.CadenceTracker()
    held.phase, held.locked, held.confidence = 2, True, 9
    held.last.extend("CCCC")
    assert held.push({"frame_id": 0, "match": "c"})[0] | {"frame_id": 0} == {"frame_id": 0, "phase": 2, "locked": True, "confidence": 9, "predicted": "C"}


def test_curves_pass_through_their_points():
    table = planes.curve_table([(0, 0.5), (0.5, 0.25), (1, 1)])
    assert (table[0], table[128], table[255]) == (128, 64, 255)
    assert planes.curve_table([(0, 0), (1, 1)]) == list(range(256))
    steps = planes.curve_table([(0.25, 0.25), (0.5, 0.75), (0.75, 0.75), (1, 1)], monotone=True)
    assert steps[:65] == [64] * 65 and steps[128:193] == [192] * 65 and steps == sorted(steps)


@pytest.mark.parametrize("formula", ["pegtop", "w3c", "illusionshu"])
def test_soft_light_under_one_less_the_mean(spark, formula):
    rows = spark.createDataFrame([([0, 128, 255],)], "plane array<int>")
    got = rows.select(planes.soft_light(rows.plane, formula, skip_black=True).alias("p")).first().p
    b = 1 - 383 / 2 / 255
    a = 128 / 255
    exact = {"pegtop": (1 - 2 * b) * a * a + 2 * b * a, "w3c": a - (1 - 2 * b) * a * (1 - a), "illusionshu": a ** (2 ** (1 - 2 * b))}[formula]
    assert got == [0, int(exact * 255 + 0.5), 255]


def test_idr_frames_count_as_i(spark):
    rows = [("IDR", 100, 20), ("I", 50, 30), ("P", 10, None), (None, 40, 26)]
    coded = spark.createDataFrame(rows, "frame_type string, bytes long, qp int")
    got = {r.frame_type: tuple(r)[1:] for r in reports.encode_statistics(coded, 25.0, 1).collect()}
    assert got == {"I": (2, 1, 150, 25.0, None), "P": (1, 0, 10, None, None), "all": (4, 1, 200, pytest.approx(76 / 3), pytest.approx(8.0))}
    assert reports.encode_statistics(coded.limit(0), 25.0).count() == 0


def test_two_of_five_frames_go(spark):
    # Differences by frame; the last cycle has three frames.
    diffs = [9, 1, 5, 1, 7, 8, 90, 6, 95, 4, 3, 2, 1]
    rows = [(1, n, 10 * n, float(d)) for n, d in enumerate(diffs)]
    frames = spark.createDataFrame(rows, "stream_id long, frame_id long, pts long, block_diff double").withColumn("total_diff", F.col("block_diff"))
    got = selection.decimate(frames, 5, 50.0, 2.0, drop=2).orderBy("frame_id")
    # First cycle: 1 and 3 are duplicates and go; 20 ticks are spread, times off * 20 / 6. Second: no duplicate, so the scene changes 8, then 6 go.
    # Last: 8 + 5 lies at the end, not before it, so nothing goes.
    want = [(0, 0), (2, 20 + (2 * 2 - 5) * 20 // 6 + 1), (4, 40 - 2 * 20 // 6), (5, 50), (7, 70 - 1 * 20 // 6), (9, 90 - 2 * 20 // 6), (10, 100), (11, 110), (12, 120)]
    assert [(r.frame_id, r.pts) for r in got.collect()] == want


def test_repeated_fields_by_windows_equal_the_fold(spark):
    from reelspark.operators.fold import fold_streams

    rows = [(s, k, 30 * k + (k * s) % 4 - 5 * (k == 7), (k * 11) % 4 * 10, (k * k + s) % 3 == 0 if k % 5 else None, k % 2 == s % 2) for s in (1, 2, 3) for k in range(25)]
    frames = spark.createDataFrame(rows, "stream_id long, frame_id long, pts long, duration long, repeats boolean, top_first boolean")
    want = sorted(map(tuple, fold_streams(frames, folds.RepeatFields).select("stream_id", "frame_id", "part", "pts", "duration", "top_first").collect()))
    assert sorted(map(tuple, timing.repeat_fields(frames).collect())) == want and len(want) > 75
    assert timing.repeat_fields(frames.limit(0)).count() == 0
