"""Timeline operators: registered queries against DuckDB, folds against worked examples."""

import os
import sys

import duckdb
import numpy as np
import pytest

from reelspark import media_queries, timeline_queries  # noqa: F401 (registers more queries)
from reelspark.functions import planes
from reelspark.operators import folds
from reelspark.operators.fold import fold_streams
from reelspark.plans import colour

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return [plain(x) for x in value] if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.partition('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", list(timeline_queries.ORACLE_SQL))
def test_oracle(spark, con, name):
    df = timeline_queries.QUERIES[name](spark, SF)
    want = con.sql(timeline_queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(repr(plain(tuple(r[c] for c in columns))) for r in df.collect())
    assert got == sorted(repr(plain(r)) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(timeline_queries.QUERIES) - set(timeline_queries.ORACLE_SQL)))
def test_runs_over_all_frames(spark, name):
    assert timeline_queries.QUERIES[name](spark, SF).count() > 0


def push_all(fold, rows):
    out = [x for k, r in enumerate(rows) for x in fold.push({"frame_id": k} | r)]
    return out + fold.finish()


def test_regularize():
    at = lambda pts: [{"pts": p, "duration": 0} for p in pts]
    pts = lambda out: [(r["frame_id"], r["pts"], r["inserted"]) for r in out]
    assert pts(push_all(folds.RegularizeTimestamps(10), at([100, 110, None, 125, 125, 500]))) == [(0, 0, False), (1, 10, False), (2, 20, False), (3, 25, False), (4, 27, False), (5, 400, False)]
    assert pts(push_all(folds.RegularizeTimestamps(16, "forcecfr"), at([0, 16, 17, 64, 80]))) == [(0, 0, False), (1, 16, False), (3, 32, True), (3, 48, True), (3, 64, False), (4, 80, False)]
    far = push_all(folds.RegularizeTimestamps(16, "forcecfr"), at([0, 16, 16 + 18_001 * 16, 32 + 18_001 * 16]))
    assert pts(far) == [(0, 0, False), (1, 16, False), (2, 32, False), (3, 48, False)]
    back = push_all(folds.RegularizeTimestamps(16), at([16 * 2000, 16 * 2001, 0, 16]))
    assert [r["pts"] for r in back] == [0, 16, 32, 48]


def test_drop_repeats():
    frame = lambda v: {"plane": [v] * 64}
    dropped = lambda out: [r["dropped"] for r in out]
    assert dropped(push_all(folds.DropRepeats(), [frame(v) for v in (0, 1, 2, 30, 31, 31)])) == [False, True, True, False, True, False]
    assert dropped(push_all(folds.DropRepeats(keep=1), [frame(5)] * 5)) == [False, False, True, True, False]
    assert dropped(push_all(folds.DropRepeats(most=1), [frame(5)] * 5)) == [False, True, False, True, False]
    assert push_all(folds.DropRepeats(), []) == []


def test_deflicker_and_low_pass():
    steady = push_all(folds.Deflicker(4), [{"mean": 100.0, "sigma": 10.0}] * 6)
    assert all(r["gain"] == 1 and r["offset"] == 0 for r in steady)
    jump = push_all(folds.Deflicker(30), [{"mean": 100.0 + k % 2, "sigma": 10.0} for k in range(8)] + [{"mean": 200.0, "sigma": 10.0}] * 2)
    assert [r["scene_change"] for r in jump] == [False] * 8 + [True, False]
    assert push_all(folds.Deflicker(2), [{"mean": 50.0, "sigma": 16.0}, {"mean": 50.0, "sigma": 4.0}])[1]["gain"] == pytest.approx((10 / 4) ** 0.5)
    low = push_all(folds.TemporalLowPass(), [{"plane": [0, 100]}, {"plane": [0, 104]}, {"plane": [255, 0]}])
    assert low[0]["plane"] == [0, 100] and 100 < low[1]["plane"][1] < 104 and low[2]["plane"][0] == pytest.approx(255, abs=1)


def test_chapters_fields_guard_cadence_grain_order():
    keys = push_all(folds.ChapterKeys([1, 2, 9], (1, 1), (1, 1)), [{"pts": p} for p in (0, 3, 4, 8, None, 9)])
    assert [(r["frame_id"], r["chapter"]) for r in keys] == [(1, 0), (2, 1), (5, 2)]
    field = lambda pts, r: {"pts": pts, "duration": 3, "repeats": r, "top_first": True}
    out = push_all(folds.RepeatFields(), [field(0, True), field(3, False), field(6, True), field(9, False)])
    assert [(r["frame_id"], r["part"], r["pts"], r["duration"], r["top_first"]) for r in out] == [(0, 0, 0, 2, True), (1, 0, 2, 3, False), (2, 0, 5, 2, False), (2, 1, 7, 2, False), (3, 0, 9, 3, True)]
    guard = push_all(folds.ChromaGuard(warm_up=2), [{"variance": v, "u": 1.0, "v": 2.0} for v in (200, 200, 5000, 300, 1)])
    assert [r["accepted"] for r in guard] == [True, True, False, True, False]  # after the restart at 5000, 300 is above a thirtieth of the mean, 1 is not
    cadence = push_all(folds.CadenceTracker(), [{"match": m} for m in "cccnn" * 3])
    assert not cadence[3]["locked"] and all(r["locked"] for r in cadence[4:])
    assert [r["predicted"] for r in cadence[4:9]] == list("CCCNN")
    eye = [1.0, 0.0, 0.0, 1.0]
    grain = push_all(folds.GrainWindow(2), [{"lhs": eye, "rhs": r, "reliable": ok} for r, ok in (([1.0, 2.0], True), ([3.0, 4.0], True), ([5.0, 6.0], True), ([0.0, 0.0], False))])
    assert [r["used"] for r in grain] == [1, 2, 2, 0] and grain[2]["coefficients"] == pytest.approx([4, 5])
    order = push_all(folds.ReorderByPts(1), [{"pts": p} for p in (3, 1, 2, 2, 5, 4)])
    assert [(r["pts"], r["poc"]) for r in order] == [(1, 0), (2, 1), (2, None), (3, 2), (4, 3), (5, 4)]


def test_fold_per_stream(spark):
    rows = [(s, k, k * 10, 10) for s in (1, 2, None) for k in range(3)]
    frames = spark.createDataFrame(rows, "stream_id long, frame_id long, pts long, duration long")
    out = fold_streams(frames, lambda: folds.RegularizeTimestamps(10)).collect()
    assert sorted((r.stream_id or 0, r.frame_id, r.pts) for r in out) == [(s, k, k * 10) for s in (0, 1, 2) for k in range(3)]
    assert fold_streams(frames.limit(0), lambda: folds.RegularizeTimestamps(10)).collect() == []


def test_colour_plan(spark):
    assert colour.conversion("bt709", "bt709") == []
    steps = colour.conversion("bt601", "bt709")
    assert [type(s).__name__ for s in steps] == ["Matrix", "PerChannel", "Matrix", "PerChannel", "Matrix"]
    from pyspark.sql import functions as F

    grey = spark.range(1).select(F.array(F.struct(F.lit(0.5).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))).alias("p"))
    out = grey.select(colour.apply(F.col("p"), steps).alias("p")).first().p[0]
    assert np.allclose([out.a, out.b, out.c], [0.5, 0, 0], atol=1e-9)
    assert np.allclose(np.array(colour.rgb_to_xyz("bt709").m)[1], [0.2126, 0.7152, 0.0722], atol=1e-3)


def test_streaming_equals_batch(spark, tmp_path):
    from reelspark.streaming.folds import fold_stream

    frames = spark.createDataFrame([(s, k, (k * 7 + k % 3 * 9) * 10, 0) for s in (1, 2) for k in range(40)], "stream_id long, frame_id long, pts long, duration long")
    for part in range(4):
        frames.where(f"frame_id div 10 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    run = fold_stream(source, lambda: folds.RegularizeTimestamps(70, "forcecfr")).writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted(map(tuple, spark.table("folded").collect()))
    assert got == sorted(map(tuple, fold_streams(frames, lambda: folds.RegularizeTimestamps(70, "forcecfr")).collect()))


def test_sources(spark, tmp_path):
    from reelspark.sources import text, video

    write = lambda name, s: (tmp_path / name).write_bytes(s if isinstance(s, bytes) else s.encode()) and str(tmp_path / name)
    codes = text.read_timecodes(spark, write("tc.txt", "# timecode format v2\n0\n33.366700\n\n66.733\n")).orderBy("frame_id").collect()
    assert [(r.frame_id, r.pts, r.duration) for r in codes] == [(0, 0, 33367), (1, 33367, 33366), (2, 66733, None)]
    chapters = text.read_chapters(spark, write("ch.txt", "CHAPTER01=00:00:00.000\r\nCHAPTER01NAME=Start\r\nCHAPTER02=01:02:03.5\r\n")).orderBy("id").collect()
    assert [(r.id, r.start_ms, r.name) for r in chapters] == [(1, 0, "Start"), (2, 3723500, None)]
    xml = "<Chapters><EditionEntry><ChapterAtom><ChapterTimeStart>00:00:01.250000000</ChapterTimeStart><ChapterDisplay><ChapterString>A</ChapterString></ChapterDisplay></ChapterAtom></EditionEntry></Chapters>"
    assert [(r.id, r.start_ms, r.name) for r in text.read_matroska_chapters(spark, write("ch.xml", xml)).collect()] == [(1, 1250, "A")]
    assert sorted(r.frame_id for r in text.read_keyframes(spark, write("k.txt", "5\n\nx\n12\n5\n")).collect()) == [5, 12]
    grain = text.read_grain_table(spark, write("g.tbl", "filmgrn1\nE 0 100 1 7 1\n\tp 3 6\n\tsY 1\nE 100 200 1 8 1\n\tp 4 7\n")).orderBy("start").collect()
    assert [(r.start, r.end, r.seed, r.params) for r in grain] == [(0, 100, 7, "p 3 6 sY 1"), (100, 200, 8, "p 4 7")]
    body = b"YUV4MPEG2 W4 H2 F25:1 C420\n" + b"".join(b"FRAME\n" + bytes(range(k, k + 12)) for k in (0, 50))
    frames = video.read_y4m(spark, write("v.y4m", body))
    rows = frames.orderBy("frame_id").collect()
    assert [[len(p) for p in r.planes] for r in rows] == [[8, 2, 2]] * 2 and rows[1].planes[0][0] == 50
    again = b"".join(bytes(r.content) for r in video.to_y4m(frames).orderBy("frame_id").collect())
    assert body.endswith(again) and video.luma_statistics(frames).orderBy("frame_id").first()["mean"] == 3.5
    text.write_timecodes(spark.createDataFrame([(1, 0), (1, 40000)], "stream_id long, pts long"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "stream_id=1")).count() == 2


def test_entry_without_llm(tmp_path):
    """The registry works where the llm folder and the pipeline are gone."""
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert 'trim' in e.queries() and 'pipeline' not in e.queries(); e.oracle_sql()"
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    os.mkdir(tmp_path / "reelspark")
    for name in os.listdir(f"{root}/reelspark"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/reelspark/{name}", tmp_path / "reelspark" / name)
    (tmp_path / "entry.py").write_text((tmp_path / "__spark_entry__.py").read_text())
    done = subprocess.run([sys.executable, "-c", code.replace("__spark_entry__", "entry")], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr


def test_curves_give_what_their_sql_gives_for_every_code(spark, tmp_path):
    con = duckdb.connect()
    ramp = "list_transform(range(64), lambda i: CAST((k * 64 + i - 127.5::DOUBLE) / 255 AS FLOAT))"
    con.sql(f"COPY (SELECT k AS vec_id, {ramp} AS embedding, CAST(0 AS INTEGER) AS label FROM range(4) t(k)) TO '{tmp_path}/embeddings.parquet'")
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = {r.frame_id: r.plane for r in timeline_queries.QUERIES["plane_curves"](spark, str(tmp_path)).collect()}
    assert got == dict(con.sql(timeline_queries.ORACLE_SQL["plane_curves"]).fetchall())
    assert (got[0][0], got[3][-1]) == (0, 254) and planes.curve_table([(0, 0), (0.5, 0.25), (1, 1)])[-1] == 255


def test_timecodes_of_many_streams_need_few_files(spark, tmp_path):
    from reelspark.sources import text

    frames = spark.sql("SELECT nullif(k - 50, 0) AS stream_id, (k + 3) * i * i * 1001 AS pts FROM range(700) t(k), range(9) u(i) WHERE i <= k % 9")
    want = {}
    for r in sorted(frames.collect(), key=lambda r: r.pts):
        want.setdefault(r.stream_id, []).append(r.pts)
    text.write_timecode_sets(frames, str(tmp_path / "sets"))
    files = list((tmp_path / "sets").glob("part-*"))
    assert 0 < len(files) <= 4 and sum(f.read_text().count(text.TIMECODE_HEADER) for f in files) == 700
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")  # every file is cut at many places, also within headers
    try:
        back = text.read_timecode_sets(spark, str(tmp_path / "sets"))
        assert back.rdd.getNumPartitions() > 100
        got = {}
        for r in sorted(back.collect(), key=lambda r: r.frame_id):
            got.setdefault(r.stream_id, []).append((r.frame_id, r.pts, r.duration))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {s: [(k, p, q and q - p) for k, (p, q) in enumerate(zip(ps, [*ps[1:], None]))] for s, ps in want.items()}


def test_timecode_round_trip_writes_few_files(spark, monkeypatch):
    made = []
    folder = media_queries.shared_folder
    monkeypatch.setattr(media_queries, "shared_folder", lambda *a: made.append(folder(*a)) or made[-1])
    streams = timeline_queries.QUERIES["timecode_round_trip"](spark, "/root/testdata/sf0.01").select("stream_id").distinct().count()
    assert streams == 150 and len(spark.read.text(made[0]).inputFiles()) <= 4
