"""y4m and headerless files by ranges of frames."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.sources import frame_files, text, video


def clip(count, layout, seed=0):
    rng = np.random.default_rng(seed)
    return [[rng.integers(0, 1 << layout.bitdepth, w * h) for w, h in layout.sizes] for _ in range(count)]


def y4m_bytes(frames, layout, tag, marks=None):
    head = f"YUV4MPEG2 W{layout.width} H{layout.height} F30000:1001 It A1:1 C{tag} XNOTE\n".encode()
    return head + b"".join(b"FRAME" + (marks[k % len(marks)] if marks else b"") + b"\n" + layout.content(f) for k, f in enumerate(frames))


def rows_of(df):
    return [(r.frame_id, [list(p) for p in r.planes]) for r in df.orderBy("frame_id").collect()]


@pytest.mark.parametrize("tag", ["420jpeg", "420p10", "422", "444", "mono", "422p12"])
def test_ranges_equal_the_whole(spark, tmp_path, tag):
    """Frames in the order of the file, whatever the number of tasks, equal to those of the reader of whole files."""
    layout = frame_files.Layout.of(tag, 7, 5)
    frames = clip(11, layout)
    (tmp_path / "a.y4m").write_bytes(y4m_bytes(frames, layout, tag))
    want = [(k, [p.tolist() for p in f]) for k, f in enumerate(frames)]
    for per_task in (1, 4, 100):
        df = frame_files.read_frames(spark, str(tmp_path / "a.y4m"), framesPerTask=per_task)
        assert df.rdd.getNumPartitions() == -(-11 // per_task) and rows_of(df) == want
    first = df.first()
    assert (first.rate_num, first.rate_den, first.aspect_num, first.interlace, first.bitdepth) == (30000, 1001, 1, "t", layout.bitdepth)
    if tag in video.CHROMA and tag != "422p12":
        assert rows_of(video.read_y4m(spark, str(tmp_path / "a.y4m"))) == want


def test_frame_marks_with_parameters(spark, tmp_path):
    """Marks of different lengths are stepped through; a last frame that is cut off is left out."""
    layout = frame_files.Layout.of("420", 4, 4)
    frames = clip(6, layout)
    data = y4m_bytes(frames, layout, "420", [b"", b" Ip", b" It XLONG=1"])
    (tmp_path / "a.y4m").write_bytes(data[:-3])
    df = frame_files.read_frames(spark, str(tmp_path / "a.y4m"), framesPerTask=2)
    assert rows_of(df) == [(k, [p.tolist() for p in f]) for k, f in enumerate(frames[:5])]


def test_folders_and_empty_files(spark, tmp_path):
    layout = frame_files.Layout.of("mono", 3, 2)
    parts = clip(3, layout, 1), [], clip(2, layout, 2)
    for k, frames in enumerate(parts):
        (tmp_path / f"{k}.y4m").write_bytes(y4m_bytes(frames, layout, "mono"))
    (tmp_path / "note.txt").write_text("no video")
    joined = rows_of(frame_files.read_frames(spark, str(tmp_path), joined=True))
    assert joined == [(k, [p.tolist() for p in f]) for k, f in enumerate(parts[0] + parts[2])]
    assert sorted(k for k, _ in rows_of(frame_files.read_frames(spark, str(tmp_path)))) == [0, 0, 1, 1, 2]
    (tmp_path / "none").mkdir()
    assert rows_of(frame_files.read_frames(spark, str(tmp_path / "none"))) == []


def test_what_is_not_video_fails(spark, tmp_path):
    (tmp_path / "a.y4m").write_bytes(b"something else\n")
    with pytest.raises(Exception, match="isn't y4m"):
        frame_files.read_frames(spark, str(tmp_path / "a.y4m")).collect()
    with pytest.raises(ValueError, match="isn't supported"):
        frame_files.Layout.of("411", 4, 4)


@pytest.mark.parametrize("layout", ["420", "420p16", "422", "nv12", "p010"])
def test_headerless_round_trip(spark, tmp_path, layout):
    kind = frame_files.Layout.of(layout, 6, 4)
    frames = clip(9, kind)
    df = spark.createDataFrame([(k, [p.tolist() for p in f]) for k, f in enumerate(frames)], "frame_id long, planes array<array<int>>")
    frame_files.write_frames(df, str(tmp_path / "raw"), 6, 4, "rawvideo", parts=3, layout=layout)
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "raw").glob("*.yuv")))
    assert len(whole) == 9 * kind.frame_bytes and whole == b"".join(kind.content(f) for f in frames)
    (tmp_path / "one.yuv").write_bytes(whole)
    for path in ("raw", "one.yuv"):
        back = frame_files.read_frames(spark, str(tmp_path / path), "rawvideo", joined=True, width=6, height=4, layout=layout, framesPerTask=2)
        assert rows_of(back) == [(k, [p.tolist() for p in f]) for k, f in enumerate(frames)]


def test_written_y4m_is_read_by_the_whole_reader(spark, tmp_path):
    layout = frame_files.Layout.of("420", 4, 2)
    frames = clip(7, layout)
    df = spark.createDataFrame([(k, [p.tolist() for p in f]) for k, f in enumerate(frames)], "frame_id long, planes array<array<int>>")
    for _ in range(2):  # the second time replaces the first
        frame_files.write_frames(df, str(tmp_path / "out"), 4, 2, parts=2, rate="25:1")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["part-000000.y4m", "part-000001.y4m"]
    read = video.read_y4m(spark, str(tmp_path / "out" / "*.y4m"))
    assert sorted(map(str, (list(map(list, r.planes)) for r in read.collect()))) == sorted(str([p.tolist() for p in f]) for f in frames)


def test_no_frames_make_an_empty_folder(spark, tmp_path):
    none = spark.createDataFrame([], "frame_id long, planes array<array<int>>")
    frame_files.write_frames(none, str(tmp_path / "out"), 4, 2)
    assert rows_of(frame_files.read_frames(spark, str(tmp_path / "out"))) == []


def test_a_file_of_three_gigabytes(spark, tmp_path):
    """Places beyond two gigabytes, in a file with holes: the marks are there, the samples in between are zeros."""
    layout = frame_files.Layout.of("mono", 20_000, 10_000)
    stride, count = layout.frame_bytes + 6, 17
    path = tmp_path / "large.y4m"
    with path.open("wb") as out:
        out.write(head := b"YUV4MPEG2 W20000 H10000 F1:1 Cmono\n")
        for k in range(count):
            out.seek(len(head) + k * stride)
            out.write(b"FRAME\n" + bytes([k + 1]))
        out.truncate(len(head) + count * stride)
    part = frame_files.FrameReader({"path": str(path), "framesPerTask": "1"}, True).partitions()
    assert len(part) == count and path.stat().st_size > 3 << 30
    last = frame_files.FrameReader({"path": str(path)}, True)
    tiny = [p for p in part if p.frame_id in (0, 11, 15)]
    for p in tiny:
        with frame_files._store(str(path))[0].open_input_file(p.path) as file:
            assert file.read_at(7, p.first - 6) == b"FRAME\n" + bytes([p.frame_id + 1])
    assert last.y4m


def test_grain_table_round_trip(spark, tmp_path):
    rows = [(20, 30, 1, 7, 1, "p 1 2"), (0, 10, 1, 5, 0, None), (10, 20, 0, 6, 1, "p 3")]
    df = spark.createDataFrame(rows, "start long, end long, apply int, seed long, update int, params string")
    text.write_grain_table(df, str(tmp_path / "g"))
    got = text.read_grain_table(spark, str(tmp_path / "g")).orderBy("start").collect()
    assert [(r.start, r.end, r.apply, r.seed, r.update, r.params) for r in got] == [(0, 10, 1, 5, 0, ""), (10, 20, 0, 6, 1, "p 3"), (20, 30, 1, 7, 1, "p 1 2")]
    text.write_grain_table(df.where(F.lit(False)), str(tmp_path / "none"))
    assert text.read_grain_table(spark, str(tmp_path / "none")).collect() == []
