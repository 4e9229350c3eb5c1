"""Field pairing, cycles and field shift on worked examples."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import pulldown, telecine
from reelspark.operators.fold import fold_streams


def push_all(fold, rows):
    out = []
    for k, row in enumerate(rows):
        out += fold.push({"frame_id": k} | row)
    return out + fold.finish()


def film(count, height=64, width=96, speed=3):
    """Frames of a textured picture that moves."""
    rng = np.random.default_rng(1)
    wide = rng.integers(0, 256, (height // 4, (width + speed * count) // 4 + 2)).repeat(4, 0).repeat(4, 1)
    return [wide[:height, speed * k : speed * k + width].astype(np.int32) for k in range(count)]


def telecined(frames, start=0):
    """Five frames of every four, as (top, bottom) of the film frames: AA BB BC CD DD, from ``start`` on."""
    out = []
    for k in range(0, len(frames) - 3, 4):
        a, b, c, d = frames[k : k + 4]
        for top, bottom in ((a, a), (b, b), (b, c), (c, d), (d, d)):
            made = top.copy()
            made[1::2] = bottom[1::2]
            out.append(made)
    return out[start:]


@pytest.mark.parametrize("start", range(5))
@pytest.mark.parametrize("guide", [0, 1])
def test_pairing_finds_the_film(start, guide):
    """At each phase of the cadence the woven frames are film frames in order; with the cadence's guide none is missing."""
    source = film(41)
    coded = telecined(source, start)
    # A scene change can't be told from fast motion on such small frames, so it is set out of reach.
    got = push_all(telecine.FieldMatch(96, guide=guide, scene=1.0), [{"plane": p.ravel(), "pts": k, "top_first": None} for k, p in enumerate(coded)])
    names = {p.tobytes(): k for k, p in enumerate(source)}
    found = [names.get(np.asarray(r["plane"], np.int32).reshape(64, 96).tobytes()) for r in got]
    inner = found[2:-2]
    assert None not in inner and inner == sorted(inner)
    missing = set(range(inner[0], inner[-1] + 1)) - set(inner)
    assert not missing or guide == 0 and len(missing) < 4  # a frame of mixed fields makes a film frame with either neighbour
    assert {r["pairing"] for r in got} >= {"c", "n"}


def test_pairing_keeps_progressive_frames_and_scene_changes():
    source = film(12)
    rows = [{"plane": p.ravel(), "pts": 0, "top_first": True} for p in source]
    got = push_all(telecine.FieldMatch(96, guide=0, scene=1.0), rows)
    assert {r["pairing"] for r in got} == {"c"}
    cut = [np.zeros((16, 8), np.int32)] * 3 + [np.full((16, 8), 200, np.int32)] * 3
    got = push_all(telecine.FieldMatch(8), [{"plane": p.ravel(), "pts": 0, "top_first": None} for p in cut])
    assert [r["scene_change"] for r in got] == [False, False, False, True, False, False]
    assert push_all(telecine.FieldMatch(8, guide=2), [{"plane": cut[0].ravel(), "pts": 0, "top_first": None}] * 4)[1]["pairing"] == "n"
    assert push_all(telecine.FieldMatch(8), []) == []
    bottom = push_all(telecine.FieldMatch(96, guide=0, scene=1.0), [r | {"top_first": False} for r in rows])
    assert {r["pairing"] for r in bottom} == {"c"}


def test_drop_of_cycle(spark):
    """One of five goes and time is carried across cycles; the last, short cycle stays whole."""
    diffs = [None, 9, 8, 0, 7, 5, 5, 6, 7, 8, 1, 2]
    rows = [(s, k, None if s == 2 and k == 1 else 1000 + 33 * k, d, s == 3 and k == 9) for s in (1, 2, 3) for k, d in enumerate(diffs)]
    frames = spark.createDataFrame(rows, "stream_id long, frame_id long, pts long, diff long, synthetic boolean")
    got = telecine.drop_of_cycle(frames.drop("synthetic"), 5, (24000, 1001), 1000).orderBy("stream_id", "frame_id").collect()
    first = [(r.frame_id, r.pts, r.duration) for r in got if r.stream_id == 1]
    assert [f for f, *_ in first] == [0, 1, 2, 4, 6, 7, 8, 9, 10, 11]
    assert [p for _, p, _ in first] == [1000 + round(k * 1001 * 1000 / 24000) for k in range(10)]
    assert all(p + d == q for (_, p, d), (_, q, _) in zip(first, first[1:]))
    assert [r.pts for r in got if r.stream_id == 2][:2] == [0, 42]
    made = telecine.drop_of_cycle(frames, 5).where("stream_id = 3").orderBy("frame_id").collect()
    assert [r.frame_id for r in made] == [0, 1, 2, 4, 5, 6, 7, 8, 10, 11]
    assert telecine.drop_of_cycle(frames.limit(0), 5).collect() == []


def test_field_shift():
    """Progressive frames stay where they are; a frame whose first field is shifted moves by half a frame, and time doesn't run back."""
    shift = telecine.FieldShift
    plain = push_all(shift(), [{"status": shift.PROGRESSIVE, "pts": 4 * k} for k in range(8)])
    assert [(r["pts"], r["duration"]) for r in plain] == [(4 * k, 4) for k in range(7)] + [(28, 4)]
    moved = push_all(shift(), [{"status": s, "pts": 4 * k} for k, s in enumerate([0, 0, 0, 0, 0, 1, 0, 0, 0])])
    assert moved[5]["pts"] == 18 and moved[4]["duration"] == 2 and moved[6]["pts"] == 22
    # 24 of 30 frames: one of five goes, and the others share its time.
    film = push_all(shift(), [{"status": shift.FORCE24 | shift.DROP, "pts": 4 * k} for k in range(31)])
    kept = [r for r in film if not r["dropped"]]
    assert len(kept) in (25, 26) and {r["duration"] for r in kept[2:-2]} == {5}
    assert push_all(shift(), []) == []
    assert len(push_all(shift(), [{"status": 0, "pts": 0}])) == 1


def test_patterns():
    names = [(n, k) for n, k, _ in pulldown.patterns()]
    assert len(names) == 21 and names[0] == ("2323", 0) and names[5] == ("2233", 0) and names[-1] == ("30p", 0)
    assert [i for i, e in enumerate(pulldown.patterns()[0][2]) if e] == [1, 3, 6, 8, 11, 13]


def cycles_of(spark, name, rotation, count, noise=0.0):
    """Cycles whose fields change where the pattern's film frames end."""
    rng = np.random.default_rng(2)
    ends = next(e for n, k, e in pulldown.patterns() if (n, k) == (name, rotation))
    rows = []
    for c in range(count):
        split = [0, 0, *(1000 if e else 0 for e in ends), 0, 0]
        moves = [0] * 18
        rows.append((1, c, [(int(m + noise * rng.integers(0, 50)), int(s), 0) for m, s in zip(moves, split)]))
    return spark.createDataFrame(rows, "stream_id long, cycle long, counts array<struct<move:long,shima:long,lshima:long>>")


@pytest.mark.parametrize("name, rotation", [("2323", 0), ("2323", 3), ("2233", 7), ("2224", 2), ("30p", 0)])
def test_each_pulldown_is_recognised(spark, name, rotation):
    got = pulldown.classify(cycles_of(spark, name, rotation, 8, 1.0), 720, 480).orderBy("cycle").collect()
    assert len(got) == 8 and {(r.family, r.rotation) for r in got} == {(name, rotation)}  # found late, and put in force from the first cycle on


def test_pulldown_history():
    """A single other cycle doesn't change the pattern; five do, from their first on."""
    score = lambda p: {"scores": [3.0 if k == p else 0.0 for k in range(21)], "costs": [0.5] * 21, "reliabilities": [1.0] * 21}
    rows = [score(4)] * 3 + [score(9)] + [score(4)] * 3 + [score(9)] * 5
    out = []
    fold = pulldown.PulldownChoice()
    for k, r in enumerate(rows):
        out += fold.push(r | {"cycle": k})
    out += fold.finish()
    assert [r["cycle"] for r in out] == list(range(12)) and [r["pattern"] for r in out] == [4] * 7 + [9] * 5
    late = pulldown.PulldownChoice(past=2)
    out = []
    for k, r in enumerate([score(7)] * 9):
        out += late.push(r | {"cycle": k})
    assert len(out) == 6 and len(out + late.finish()) == 9
    assert pulldown.PulldownChoice().finish() == []


def test_60p_runs(spark):
    costs = [(0.5, 1.0), (0.0, 0.0), (0.5, 1.0), (3.5, 1.0), (0.05, 1.0), (0.5, 1.0), (0.0, 0.1), (1.0, 1.0)]
    frames = spark.createDataFrame([(1, k, c, r) for k, (c, r) in enumerate(costs)], "stream_id long, cycle long, cost double, reliability double")
    got = [r.is_60p for r in pulldown.mark_60p(frames).orderBy("cycle").collect()]
    assert got == [True, False, True, True, False, True, False, False]


def test_field_windows_and_tsv(spark, tmp_path):
    fields = spark.createDataFrame([(1, k, k, 1, 2) for k in range(25)] + [(2, 0, 5, 0, 0), (2, 0, 1, 0, 0)], "stream_id long, field_id long, move long, shima long, lshima long")
    got = {(r.stream_id, r.cycle): [c.move for c in r.counts] for r in pulldown.field_windows(fields).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, 0)}
    assert got[1, 0] == [0, 0, 0, 0, *range(14)] and got[1, 1] == list(range(6, 24)) and got[1, 2] == [*range(16, 25), *[0] * 9]
    assert got[2, 0] == [0] * 4 + [6] + [0] * 13
    done = pulldown.classify(pulldown.field_windows(fields), 720, 480)
    pulldown.write_cycle_tsv(done, str(tmp_path / "tsv"))
    lines = (next((tmp_path / "tsv" / "stream_id=1").glob("*.csv"))).read_text().splitlines()
    assert lines[0].split("\t") == ["cycle", "pattern", "family", "rotation", "is60p", "score", "cost", "reliability"] and len(lines) == 4


def test_streams_by_fold(spark):
    frames = spark.createDataFrame([(s, k, 4 * k, 128) for s in (1, 2) for k in range(5)], "stream_id long, frame_id long, pts long, status int")
    got = fold_streams(frames, telecine.FieldShift).where(F.col("dropped")).count()
    assert got == 0
