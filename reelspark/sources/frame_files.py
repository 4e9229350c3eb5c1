"""Uncompressed video by ranges of frames: one file is read, or a folder of files written, by many tasks.

``register`` makes the formats ``y4m`` and ``rawvideo`` known to a session. A reading task has
a run of frames at a place in one file that is known beforehand, as all frames take the
same number of bytes; it reads a frame at a time. Files whose frame marks carry
parameters of different lengths are stepped through once, mark by mark, when the read
is planned. Paths are those that ``pyarrow.fs`` opens (local and shared folders, and
the stores that it is built with).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of frames that a task reads, and bytes of rows that it hands over at once.
TASK_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
MAGIC, MARK = b"YUV4MPEG2", b"FRAME"
SCHEMA = "path string, frame_id long, width int, height int, bitdepth int, planes array<array<int>>, rate_num int, rate_den int, aspect_num int, aspect_den int, interlace string"
ARROW = pa.schema([(name, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}.get(kind, pa.list_(pa.list_(pa.int32())))) for name, kind in (part.split() for part in SCHEMA.split(", "))])
# Divisors of the chroma planes' width and height by layout, and the depths that a suffix p<bits> may give.
SUBSAMPLING = {"420": (2, 2), "422": (2, 1), "444": (1, 1), "mono": (0, 0)}
ALIASES = {"420jpeg": "420", "420mpeg2": "420", "420paldv": "420"}
DEPTHS = (9, 10, 12, 14, 16)
#: Layouts of headerless files with U and V side by side, by the layout and depth of their planes; p010 has its ten bits on top.
INTERLEAVED = {"nv12": ("420", 8), "p010": ("420", 10)}


@dataclass(frozen=True)
class Layout:
    """How a frame lies in a file: ``kind`` is a key of SUBSAMPLING, ``packed`` has U and V side by side."""

    width: int
    height: int
    kind: str
    bitdepth: int = 8
    packed: bool = False

    @staticmethod
    def of(tag: str, width: int, height: int) -> Layout:
        tag = tag.lower()
        if tag in INTERLEAVED:
            return Layout(width, height, *INTERLEAVED[tag], True)
        kind, _, bits = ALIASES.get(tag, tag).partition("p") if tag not in SUBSAMPLING else (tag, "", "")
        if kind not in SUBSAMPLING or bits and bits not in map(str, DEPTHS):
            raise ValueError(f"chroma layout {tag} isn't supported")
        return Layout(width, height, kind, int(bits or 8))

    @property
    def sizes(self) -> list[tuple[int, int]]:
        x, y = SUBSAMPLING[self.kind]
        chroma = (-(-self.width // x), -(-self.height // y)) if x else None
        return [(self.width, self.height), *([chroma, chroma] if chroma else [])]

    @property
    def sample(self) -> str:
        return "u1" if self.bitdepth == 8 else "<u2"

    @property
    def frame_bytes(self) -> int:
        return sum(w * h for w, h in self.sizes) * np.dtype(self.sample).itemsize

    def planes(self, data: bytes) -> list[np.ndarray]:
        values = np.frombuffer(data, self.sample).astype(np.int32)
        if not self.packed:
            return np.split(values, np.cumsum([w * h for w, h in self.sizes])[:-1])
        luma, chroma = values[: self.width * self.height], values[self.width * self.height :]
        out = [luma, chroma[0::2], chroma[1::2]]
        return out if self.bitdepth == 8 else [p >> 16 - self.bitdepth for p in out]

    def content(self, planes: list) -> bytes:
        planes = [np.asarray(p) for p in planes]
        if [p.size for p in planes] != [w * h for w, h in self.sizes]:
            raise ValueError(f"a frame's planes don't have the sizes {self.sizes}")
        if self.packed:
            planes = [planes[0], np.stack(planes[1:], 1).ravel()]
            planes = planes if self.bitdepth == 8 else [p.astype(np.int32) << 16 - self.bitdepth for p in planes]
        return b"".join(p.astype(self.sample).tobytes() for p in planes)


@dataclass(frozen=True)
class Stream:
    """A file's layout and what its header says; unknown rates and aspects are 0, a header without a field order has null."""

    layout: Layout
    rate: tuple[int, int] = (0, 0)
    aspect: tuple[int, int] = (0, 0)
    interlace: str | None = None


def _ratio(text: str) -> tuple[int, int]:
    a, _, b = text.partition(":")
    return int(a), int(b or 1)


def parse_header(line: bytes) -> Stream:
    """Of a y4m file's first line; a layout that isn't given is 420, unknown fields are passed over."""
    fields = {f[:1]: f[1:] for f in line.decode("ascii", "replace").split()[1:]}
    if not fields.get("W", "").isdigit() or not fields.get("H", "").isdigit():
        raise ValueError(f"no width and height in {line!r}")
    layout = Layout.of(fields.get("C", "420"), int(fields["W"]), int(fields["H"]))
    return Stream(layout, _ratio(fields.get("F", "0:0")), _ratio(fields.get("A", "0:0")), fields.get("I"))


@dataclass
class FrameRange(InputPartition):
    """``count`` frames of ``path``: the first has its samples at ``first``, the next ones ``stride`` on, or all are at ``places``."""

    path: str
    frame_id: int
    first: int
    stride: int
    count: int
    stream: Stream
    places: list[int] | None = None


def _store(path: str):
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return stores.FileSystem.from_uri(path) if "://" in path else (stores.LocalFileSystem(), path)


def _files(store, path: str, ending: str) -> list[tuple[str, int]]:
    found = store.get_file_info(path)
    if found.type == stores.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type == stores.FileType.File:
        return [(found.path, found.size)]
    inside = store.get_file_info(stores.FileSelector(path))
    return sorted((f.path, f.size) for f in inside if f.type == stores.FileType.File and f.base_name[0] not in "._" and f.base_name.endswith(ending))


def _frame_places(file, at: int, size: int, frame_bytes: int) -> tuple[int, int] | list[int]:
    """Where the samples of a y4m file's frames begin: the first and the stride if all marks are alike, else all of them."""
    head = file.read_at(min(4096, size - at), at) if at < size else b""
    end = head.find(b"\n")
    if head and (end < 0 or not head.startswith(MARK)):
        raise ValueError("no frame mark behind the header")
    stride = end + 1 + frame_bytes
    if head and end + 1 == len(MARK) + 1 and (size - at) % stride == 0:
        return at + end + 1, stride  # reading checks each mark
    places = []
    while at < size:
        head = file.read_at(min(4096, size - at), at)
        end = head.find(b"\n")
        if end < 0 or not head.startswith(MARK):
            raise ValueError(f"no frame mark at byte {at}")
        if at + end + 1 + frame_bytes > size:
            break  # the last frame is cut off
        places.append(at + end + 1)
        at += end + 1 + frame_bytes
    return places


class FrameReader(DataSourceReader):
    def __init__(self, options: dict, y4m: bool):
        self.options, self.y4m = {k.lower(): v for k, v in options.items()}, y4m

    def partitions(self) -> list[FrameRange]:
        o = self.options
        store, root = _store(o["path"])
        joined, first_id, out = str(o.get("joined", "false")).lower() == "true", 0, []
        for path, size in _files(store, root, ".y4m" if self.y4m else ".yuv"):
            if self.y4m:
                with store.open_input_file(path) as file:
                    head = file.read_at(min(4096, size), 0)
                    if not head.startswith(MAGIC) or b"\n" not in head:
                        raise ValueError(f"{path} isn't y4m")
                    stream = parse_header(head[: head.index(b"\n")])
                    places = _frame_places(file, head.index(b"\n") + 1, size, stream.layout.frame_bytes)
            else:
                stream = Stream(Layout.of(o.get("layout", "420"), int(o["width"]), int(o["height"])), _ratio(o.get("rate", "0:0")))
                places = (0, stream.layout.frame_bytes)
            frame = max(1, stream.layout.frame_bytes)
            per_task = int(o.get("framespertask", max(1, TASK_BYTES // frame)))
            if isinstance(places, tuple):
                first, stride = places
                count = max(0, size - first + stride - frame) // stride
                out += [FrameRange(path, first_id + k, first + k * stride, stride, min(per_task, count - k), stream) for k in range(0, count, per_task)]
            else:
                count = len(places)
                out += [FrameRange(path, first_id + k, 0, 0, len(run), stream, run) for k in range(0, count, per_task) if (run := places[k : k + per_task])]
            first_id += count if joined else 0
        return out or [FrameRange("", 0, 0, 0, 0, Stream(Layout(0, 0, "mono")))]

    def read(self, part: FrameRange) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        schema, s, size = ARROW, part.stream, part.stream.layout.frame_bytes
        store, _ = _store(self.options["path"])
        with store.open_input_file(part.path) as file:
            rows, held = [], 0
            for k in range(part.count):
                at = part.places[k] if part.places is not None else part.first + k * part.stride
                lead = len(MARK) + 1 if self.y4m and part.places is None else 0
                data = file.read_at(size + lead, at - lead)
                if len(data) != size + lead or lead and data[:lead] != MARK + b"\n":
                    raise ValueError(f"{part.path}: no whole frame at byte {at}")
                rows.append((part.frame_id + k, s.layout.planes(data[lead:])))
                held += size
                if held >= BATCH_BYTES or k == part.count - 1:
                    n = len(rows)
                    same = [part.path, s.layout.width, s.layout.height, s.layout.bitdepth, *s.rate, *s.aspect, s.interlace]
                    path, width, height, depth, *rest = [[v] * n for v in same]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([path, [r[0] for r in rows], width, height, depth, [r[1] for r in rows], *rest], schema)], schema=schema)
                    rows, held = [], 0


@dataclass
class Written(WriterCommitMessage):
    waiting: str
    name: str


class FrameWriter(DataSourceArrowWriter):
    """A file per task, in place once all tasks are done; a task that is tried again writes another one."""

    def __init__(self, options: dict, y4m: bool, overwrite: bool):
        o = self.options = {k.lower(): v for k, v in options.items()}
        self.y4m, self.overwrite = y4m, overwrite
        self.layout = Layout.of(o.get("layout", "420"), int(o["width"]), int(o["height"]))
        if y4m and self.layout.packed:
            raise ValueError("y4m has no layout with U and V side by side")

    def _header(self) -> bytes:
        o, depth = self.options, self.layout.bitdepth
        tag = self.layout.kind + (f"p{depth}" if depth > 8 else "")
        parts = [MAGIC.decode(), f"W{self.layout.width}", f"H{self.layout.height}", f"F{o.get('rate', '0:0')}", f"I{o.get('interlace', 'p')}", f"A{o.get('aspect', '0:0')}", f"C{tag}"]
        return " ".join(parts).encode() + b"\n"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, root = _store(self.options["path"])
        part = TaskContext.get().partitionId()
        store.create_dir(root, recursive=True)
        waiting = f"{root}/.{part}-{uuid.uuid4().hex}"
        frames = 0
        with store.open_output_stream(waiting) as out:
            if self.y4m:
                out.write(self._header())
            for batch in batches:
                column = batch.column("planes")
                for k in range(batch.num_rows):
                    planes = column[k].values
                    samples, edges = planes.flatten().to_numpy(zero_copy_only=False), np.cumsum([len(p) for p in planes])[:-1]
                    out.write((MARK + b"\n" if self.y4m else b"") + self.layout.content(np.split(samples, edges)))
                    frames += 1
        return Written(waiting, f"part-{part:06d}" + (".y4m" if self.y4m else ".yuv") if frames else "")

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.options["path"])
        ending = ".y4m" if self.y4m else ".yuv"
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for path, _ in _files(store, root, ending):
                store.delete_file(path)
        at = len(_files(store, root, ending))
        for k, m in enumerate(sorted((m for m in messages if m and m.name), key=lambda m: m.name)):
            store.move(m.waiting, f"{root}/part-{at + k:06d}{ending}")
        self.abort([m for m in messages if m and not m.name])

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.options["path"])
        for m in messages:
            if m and store.get_file_info(m.waiting).type == stores.FileType.File:
                store.delete_file(m.waiting)


class RawVideo(DataSource):
    """Headerless frames, ``.yuv`` in folders. Options: ``width``, ``height``, ``layout`` (420, 420p10, 422, 444, mono, nv12, p010 and so on), ``rate``, ``framesPerTask``, ``joined``."""

    Y4M = False

    @classmethod
    def name(cls) -> str:
        return "rawvideo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(dict(self.options), self.Y4M)

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(dict(self.options), self.Y4M, overwrite)


class Y4m(RawVideo):
    """y4m files. Reading: ``framesPerTask`` and ``joined`` (frame ids count on over a folder's files). Writing: ``width``, ``height``, ``layout``, ``rate``, ``aspect``, ``interlace``."""

    Y4M = True

    @classmethod
    def name(cls) -> str:
        return "y4m"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Y4m)
    spark.dataSource.register(RawVideo)


def read_frames(spark: SparkSession, path: str, kind: str = "y4m", **options) -> DataFrame:
    """Rows of frames of the file or folder at ``path``; ``kind`` is ``y4m`` or ``rawvideo``."""
    register(spark)
    return spark.read.format(kind).options(**options).load(path)


def write_frames(frames: DataFrame, path: str, width: int, height: int, kind: str = "y4m", order: str = "frame_id", parts: int = 8, **options) -> None:
    """Writes the column ``planes`` in ``order`` as a folder of files that follow on each other, replacing what was there."""
    register(frames.sparkSession)
    rows = frames.repartitionByRange(parts, order).sortWithinPartitions(order).select("planes")
    rows.write.format(kind).mode("overwrite").options(width=width, height=height, **options).save(path)
