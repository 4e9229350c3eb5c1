"""Whole planes through numpy in Arrow batches, frame by frame or with their neighbours in time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from reelspark.functions import edges, kernels
from reelspark.operators.fold import Fold, column_values
from reelspark.operators.folds import SmoothShift
from reelspark.sources.frames import in_stream


#: Rows, and bytes of planes, that ``map_planes`` hands over at once, so that a task's memory doesn't follow its number of rows.
GIVEN_ROWS = 1024
GIVEN_BYTES = 2 << 20


def map_planes(frames: DataFrame, planes: Sequence[str], work: Callable[..., dict], gives: str, width: int, keep: Sequence[str] = ("stream_id", "frame_id")) -> DataFrame:
    """The columns ``keep`` and what ``work`` gives (``gives``, as DDL) for the ``planes`` of each row, as arrays of rows of ``width`` samples.

    A row that lacks a plane has nulls. Rows are worked on where they lie, without a shuffle.
    """
    kinds = ", ".join(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kinds}, {gives}" if kinds else gives
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = StructType.fromDDL(gives).fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [column_values(batch.column(c)) for c in planes]
            made, first, held = [], 0, 0
            for k, row in enumerate(zip(*columns), 1):
                made.append({} if any(p is None for p in row) else work(*[np.asarray(p).reshape(-1, width) for p in row]))
                held += sum(v.nbytes for v in made[-1].values() if isinstance(v, np.ndarray))
                if held >= GIVEN_BYTES or k - first == GIVEN_ROWS or k == batch.num_rows:
                    values = [pa.array([r.get(n) if not isinstance(r.get(n), np.ndarray) else r[n].ravel() for r in made], arrow.field(n).type) for n in names]
                    same = batch.slice(first, k - first)
                    yield pa.RecordBatch.from_arrays([*(same.column(c).cast(arrow.field(c).type) for c in keep), *values], schema=arrow)
                    made, first, held = [], k, 0

    return frames.select(*dict.fromkeys([*keep, *planes])).mapInArrow(run, schema)


def with_neighbours(frames: DataFrame, before: int, after: int, plane: str = "plane") -> tuple[DataFrame, list[str]]:
    """``frames`` with the planes of so many frames before and after as columns, and the columns' names in order of time; the ends stand in for missing ones."""
    w, near, names = in_stream(), F.col(plane), []
    out = {}
    for side, count in ((F.lag, before), (F.lead, after)):
        held = near
        for k in range(1, count + 1):
            name = f"_{side.__name__}{k}"
            held = F.coalesce(side(near, k).over(w), held)
            out[name] = held
    names = [*(f"_lag{k}" for k in range(before, 0, -1)), plane, *(f"_lead{k}" for k in range(1, after + 1))]
    return frames.withColumns(out) if out else frames, names


def fft3d(frames: DataFrame, width: int, plane: str = "plane", frames_at_once: int = 3, **options) -> DataFrame:
    """``stream_id, frame_id, plane`` denoised over one to four frames: itself, the one before, the one after, the second before."""
    rows, names = with_neighbours(frames, *{1: (0, 0), 2: (1, 0), 3: (1, 1), 4: (2, 1)}[frames_at_once], plane)
    current = names.index(plane)
    return map_planes(rows, names, lambda *p: {"plane": kernels.fft3d(p, current, **options)}, "plane array<int>", width)


def non_local_means(frames: DataFrame, width: int, plane: str = "plane", reach: int = 0, **options) -> DataFrame:
    """``stream_id, frame_id, plane`` denoised by likeness, over ``reach`` frames before and after too."""
    rows, names = with_neighbours(frames, reach, reach, plane)
    names.remove(plane)
    return map_planes(rows, [plane, *names], lambda *p: {"plane": kernels.non_local_means(p, **options)}, "plane array<int>", width)


def dct_denoise(frames: DataFrame, width: int, plane: str = "plane", peak: int = 255, **options) -> DataFrame:
    """``stream_id, frame_id, plane`` denoised by the cosine transform of its blocks."""
    done = lambda p: np.clip(np.floor(kernels.dct_denoise(p, **options) + 0.5 + 1e-9), 0, peak).astype(np.int32)
    return map_planes(frames, [plane], lambda p: {"plane": done(p)}, "plane array<int>", width)


def descale(frames: DataFrame, width: int, to_width: int, to_height: int, name: str = "bicubic", plane: str = "plane", **options) -> DataFrame:
    """``stream_id, frame_id, plane`` at the size from which it was enlarged."""
    return map_planes(frames, [plane], lambda p: {"plane": kernels.descale(p, to_width, to_height, name, **options)}, "plane array<int>", width)


def descale_kernels(frames: DataFrame, width: int, to_width: int, to_height: int, plane: str = "plane", peak: int = 255, prepare: Callable[[np.ndarray], np.ndarray] = lambda p: p) -> DataFrame:
    """``stream_id, kernel, error``: the kernel that a stream was most likely enlarged by, of the least mean error over its frames; ties go to the first that is tried.

    ``prepare`` makes the plane that is judged from the one of ``width``, in the same worker.
    """
    tried = kernels.DESCALE_KERNELS

    def errors(p: np.ndarray) -> dict:
        p = prepare(p)
        return {"errors": np.array([kernels.descale_error(p, to_width, to_height, n, peak, **s) for n, s in tried])}

    rows = map_planes(frames, [plane], errors, "errors array<double>", width, keep=("stream_id",)).select("stream_id", F.posexplode("errors").alias("k", "error"))
    names = F.array(*[F.lit(n if not s else f"{n}(b={s['b']:.3g},c={s['c']:.3g})") for n, s in tried])
    means = rows.groupBy("stream_id", "k").agg(F.avg("error").alias("error"))
    best = F.min(F.struct("error", "k")).alias("x")
    return means.groupBy("stream_id").agg(best).select("stream_id", F.get(names, F.col("x.k")).alias("kernel"), "x.error")


def decomb(frames: DataFrame, width: int, plane: str = "plane", **options) -> DataFrame:
    """``stream_id, frame_id, combed, plane``."""

    def work(p: np.ndarray) -> dict:
        (made,), combed = kernels.decomb([p], **options)
        return {"combed": combed, "plane": made}

    return map_planes(frames, [plane], work, "combed boolean, plane array<int>", width)


class PhaseShift(Fold):
    """By how much each frame moved from the one before; the first one has zeros. A frame's spectrum is worked out once."""

    reads = ("plane",)
    gives = "frame_id long, dx double, dy double, trust double"

    def __init__(self, width: int, size: int = 256, peak: int = 255):
        self.width, self.size, self.peak, self.before = width, size, peak, None

    def push(self, row):
        plane = np.asarray(row["plane"]).reshape(-1, self.width)
        now = kernels.phase_spectrum(plane, self.size, self.peak)
        dx, dy, trust = kernels.phase_shift(self.before, now, self.width, len(plane)) if self.before is not None else (0.0, 0.0, 0.0)
        self.before = now
        return [{"frame_id": row["frame_id"], "dx": dx, "dy": dy, "trust": trust}]


class Stabilise(Fold):
    """Each frame moved against its shift from the frame before, as smoothed by ``SmoothShift``."""

    reads = ("plane",)
    gives = "frame_id long, x double, y double, accepted boolean, plane array<int>"

    def __init__(self, width: int, size: int = 256, strength: float = 1.0, border: str = "black", fill: int = 0, peak: int = 255, **smoothing):
        self.measure, self.smooth = PhaseShift(width, size, peak), SmoothShift(**smoothing)
        self.width, self.strength, self.border, self.fill, self.peak = width, strength, border, fill, peak

    def push(self, row):
        at = self.smooth.push(self.measure.push(row)[0])[0]
        plane = np.asarray(row["plane"], np.int32).reshape(-1, self.width)
        if self.smooth.at is not None:
            plane = kernels.shift(plane, self.strength * at["x"], self.strength * at["y"], self.border, self.fill, self.peak)
        return [at | {"plane": plane.ravel()}]


class LowPass(Fold):
    """Samples drawn to their left, upper and former results, by a table of differences in 8-bit steps (finer for more bits)."""

    reads = ("plane",)
    gives = "frame_id long, plane array<int>"

    def __init__(self, width: int, spatial: float = 4.0, temporal: float = 6.0, bitdepth: int = 8):
        steps = min(1 << max(bitdepth, 8) - 8, 16)
        self.width, self.peak = width, (1 << bitdepth) - 1
        self.spatial, self.temporal, self.before = kernels.low_pass_table(spatial, steps), kernels.low_pass_table(temporal, steps), None

    def push(self, row):
        now = kernels.low_pass_spatial(np.asarray(row["plane"], float).reshape(-1, self.width) / self.peak, self.spatial)
        if self.before is not None:
            now = kernels.low_pass(self.before, now, self.temporal)
        self.before = now
        return [{"frame_id": row["frame_id"], "plane": np.floor(np.clip(now, 0, 1) * self.peak + 0.5).astype(np.int32).ravel()}]


def frame_quality(source: DataFrame, encoded: DataFrame, planes: dict[str, int], peak: int = 255) -> DataFrame:
    """Per stream: frames, mean SSIM and PSNR of each of ``planes`` (columns with their widths) and of all, in order ``all`` then the planes.

    Planes weigh by their samples. Frames pair by place in their stream; those without a
    partner are left out. dB are null where there is no error.
    """
    number = lambda df, mark: df.select("stream_id", F.row_number().over(in_stream()).alias("n"), *[F.col(c).alias(f"{mark}{c}") for c in planes])
    pairs = number(source, "a_").join(number(encoded, "b_"), ["stream_id", "n"])
    columns = [f"{mark}{c}" for c in planes for mark in ("a_", "b_")]

    def work(*flat: np.ndarray) -> dict:
        out = {"ssim": [], "error": [], "samples": []}
        for a, b, width in zip(flat[::2], flat[1::2], planes.values()):
            a, b = a.reshape(-1, width), b.reshape(-1, width)
            out["ssim"].append(kernels.plane_ssim(a, b, peak))
            out["error"].append(int(((a.astype(np.int64) - b) ** 2).sum()))
            out["samples"].append(a.size)
        return out

    scored = map_planes(pairs, columns, work, "ssim array<double>, error array<long>, samples array<long>", 1, keep=("stream_id",))
    scored = scored.where("ssim IS NOT NULL")
    each = scored.select("stream_id", F.posexplode(F.arrays_zip("ssim", "error", "samples")).alias("k", "x"), F.aggregate("samples", F.lit(0).cast("long"), lambda s, v: s + v).alias("whole"))
    share = F.col("x.samples") / F.col("whole")
    rows = each.select("stream_id", F.explode(F.array(F.struct((F.col("k") + 1).alias("k"), F.col("x.ssim").alias("s"), (F.col("x.error") / F.col("x.samples")).alias("e")), F.struct(F.lit(0).alias("k"), (F.col("x.ssim") * share).alias("s"), (F.col("x.error") / F.col("x.samples") * share).alias("e")))).alias("y"))
    sums = rows.groupBy("stream_id", "y.k").agg(F.sum("y.s").alias("s"), F.sum("y.e").alias("e"), F.count("*").alias("c"))
    frames = F.when(F.col("k") == 0, F.col("c") / len(planes)).otherwise(F.col("c"))
    names = F.array(F.lit("all"), *map(F.lit, planes))
    s, e = F.col("s") / frames, F.col("e") / frames
    return sums.select("stream_id", F.get(names, F.col("k")).alias("plane"), frames.cast("long").alias("frames"), s.alias("ssim"), F.when(1 - s > 1e-12, -10 * F.log10(1 - s)).alias("ssim_db"), F.when(e > 0, 10 * F.log10(peak**2 / e)).alias("psnr"))


class ChromaPlace(Fold):
    """Chroma planes ``u`` and ``v`` moved to where the luma's edges are: by the mean offset of the first ``frames`` that have ``pairs`` edges or more.

    Until so many are found nothing moves. Frames without an edge before the first one
    found don't count; after ``3 * frames + 10`` frames, or 1,000 with those, what is found
    decides if it is half of what was asked for, else ``fallback``.
    """

    reads = ("y", "u", "v")
    gives = "frame_id long, dx double, dy double, u array<int>, v array<int>"
    PATIENCE = 1_000

    def __init__(self, width: int, chroma_width: int, frames: int = 30, pairs: int = 200, fallback: tuple[float, float] = (0.0, 0.0), peak: int = 255):
        self.width, self.chroma_width, self.frames, self.pairs, self.fallback, self.peak = width, chroma_width, frames, pairs, fallback, peak
        self.found: list[tuple[float, float]] = []
        self.seen = self.empty = 0
        self.shift: tuple[float, float] | None = None

    def _look(self, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
        dx, dy, count = edges.chroma_offset(y, u, v)
        if not count and not self.found:
            self.empty += 1
        else:
            self.seen += 1
            if count >= self.pairs:
                self.found.append((dx / count, dy / count))
        if len(self.found) >= self.frames or self.seen >= 3 * self.frames + 10 or self.seen + self.empty >= self.PATIENCE:
            enough = len(self.found) >= max(1, self.frames // 2)
            self.shift = tuple(float(np.mean(c)) for c in zip(*self.found)) if enough else self.fallback

    def push(self, row):
        y, u, v = (np.asarray(row[c], np.int32).reshape(-1, w) for c, w in (("y", self.width), ("u", self.chroma_width), ("v", self.chroma_width)))
        if self.shift is None:
            self._look(y, u, v)
        dx, dy = self.shift or (0.0, 0.0)
        if dx or dy:
            sx, sy = max(1, self.width // self.chroma_width), max(1, len(y) // len(u))
            u, v = (edges.chroma_shift(p, dx / sx, dy / sy, self.peak) for p in (u, v))
        return [{"frame_id": row["frame_id"], "dx": dx, "dy": dy, "u": u.ravel(), "v": v.ravel()}]
