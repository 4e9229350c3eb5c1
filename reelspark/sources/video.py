"""Uncompressed video: y4m files as rows of frames, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Chroma tags with the chroma planes' width and height divisors, and bytes per sample.
CHROMA = {"420": (2, 2, 1), "420jpeg": (2, 2, 1), "420mpeg2": (2, 2, 1), "420paldv": (2, 2, 1), "422": (2, 1, 1), "444": (1, 1, 1), "420p10": (2, 2, 2), "422p10": (2, 1, 2), "444p10": (1, 1, 2)}
_FRAME = "path string, frame_id long, width int, height int, bitdepth int, planes array<array<int>>"


def parse_header(line: bytes) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Width, height, bytes per sample and the planes' sizes."""
    fields = {f[:1].decode(): f[1:].decode() for f in line.split()[1:]}
    width, height, tag = int(fields["W"]), int(fields["H"]), fields.get("C", "420")
    if tag == "mono":
        return width, height, 1, [(width, height)]
    if tag not in CHROMA:
        raise ValueError(f"chroma layout {tag} isn't supported")
    x, y, size = CHROMA[tag]
    chroma = (-(-width // x), -(-height // y))
    return width, height, size, [(width, height), chroma, chroma]


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            data = memoryview(content.as_buffer())
            at = bytes(data[:4096]).find(b"\n")
            if bytes(data[:9]) != b"YUV4MPEG2":
                raise ValueError(f"{path} isn't y4m")
            width, height, size, shapes = parse_header(bytes(data[:at]))
            at += 1
            frame = 0
            while at < len(data):
                at += bytes(data[at : at + 256]).index(b"\n") + 1
                planes = []
                for w, h in shapes:
                    planes.append(np.frombuffer(data[at : at + w * h * size], np.uint8 if size == 1 else "<u2").astype(np.int32))
                    at += w * h * size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([frame], pa.int64()), pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([8 if size == 1 else 10], pa.int32()), pa.array([planes], pa.list_(pa.list_(pa.int32())))],
                    names=["path", "frame_id", "width", "height", "bitdepth", "planes"],
                )
                frame += 1


def read_y4m(spark: SparkSession, path: str) -> DataFrame:
    """A row per frame of the y4m files under ``path``, one task per file, one frame in memory besides the file."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_frames, _FRAME)


def to_y4m(frames: DataFrame, chroma: str = "420") -> DataFrame:
    """``path, frame_id, content``: each frame's bytes with its marker, to be put together in order behind a header."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                kind = np.uint8 if row["bitdepth"] == 8 else "<u2"
                body = b"FRAME\n" + b"".join(np.asarray(p).astype(kind).tobytes() for p in row["planes"])
                yield pa.RecordBatch.from_pydict({"path": [row["path"]], "frame_id": [row["frame_id"]], "content": [body]})

    return frames.select("path", "frame_id", "bitdepth", "planes").mapInArrow(encode, "path string, frame_id long, content binary")


def luma_statistics(frames: DataFrame) -> DataFrame:
    """``path, frame_id, mean, sigma`` (population) of the first plane, from array functions."""
    y = F.get("planes", F.lit(0))
    sums = F.aggregate(y, F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q")), lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v.cast("long") * v).alias("q")))
    rows = frames.select("path", "frame_id", F.size(y).alias("n"), sums.alias("x"))
    mean = F.col("x.s") / F.col("n")
    return rows.select("path", "frame_id", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("x.q") / F.col("n") - mean * mean)).alias("sigma"))
