"""Packing by non-negative least squares over the histogram of piece lengths.

Documents are tokenised where they lie and cut into windows; what is left of each, or a
short document, is a piece. The histogram of these lengths has one count per length,
however many documents there are. Every combination of at most three lengths that fills
a window is a column of a system whose right side is the histogram; non-negative least
squares says how often each combination is used. The counts are rounded and cut to the
pieces that exist, and what is left of the histogram is solved again until little more
is gained. Pieces then find their sequences by their rank among those of their length.

Pieces that no combination takes are dealt to nodes of bounded size and packed best-fit.
Bins that aren't full are put in a row and cut where a sequence ends; the last sequence
of a node is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelspark.llm._bytes import chunks
from reelspark.llm._scratch import Scratch
from reelspark.llm.packing import best_fit, words_of

#: Pieces that one node packs, sequence numbers that it has, and sweeps of the solver over all combinations.
NODE_ITEMS = 4_000
NODE_SEQUENCES = 1 << 20
SWEEPS = 300
ROUNDS = 12
_PIECE = "piece_id long, part int, rank long, id long, start long, length int, ids_crc32 long, doc_tokens long, tokens binary"
_PLACED = "piece_id long, id long, start long, length int, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CUT = "piece_id long, id long, start long, skip int, length int, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All ways to fill ``window`` with two or three of ``lengths`` (repeats allowed), ascending, with 0 where there are two."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    lengths = np.unique(lengths)
    pairs = lengths[(lengths <= window - lengths) & there[window - lengths]]
    found = [np.stack([np.zeros_like(pairs), pairs, window - pairs], 1)]
    for a in lengths[3 * lengths <= window]:
        b = lengths[(lengths >= a) & (2 * lengths <= window - a)]
        b = b[there[window - a - b]]
        found.append(np.stack([np.full_like(b, a), b, window - a - b], 1))
    return np.concatenate(found)


def repeat_counts(columns: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative ``x`` that brings the lengths used near ``histogram`` in least squares, by descent along the steepest coordinates.

    Stops when no coordinate would move by half a sequence or a millionth of the largest
    count: less doesn't change a rounded count.
    """
    rest = histogram.astype(float)
    rest[0] = 0.0
    same = lambda i, j: (columns[:, i] == columns[:, j]) & (columns[:, i] > 0)
    square = (columns > 0).sum(1) + 2 * (same(0, 1).astype(int) + same(1, 2) + same(0, 2))
    x, least = np.zeros(len(columns)), max(0.5, 1e-6 * rest.max(initial=0))
    for _ in range(SWEEPS):
        step = np.maximum(rest[columns].sum(1) / square, -x)
        most = min(len(step), 512)
        steepest = np.argpartition(-np.abs(step), most - 1)[:most] if most else np.zeros(0, int)
        steepest = steepest[np.lexsort((steepest, -np.abs(step[steepest])))]
        if not most or abs(step[steepest[0]]) < least:
            break
        for c in steepest:
            move = max(rest[columns[c]].sum() / square[c], -x[c])
            if abs(move) < least or abs(move) < abs(step[c]) / 2:
                continue
            x[c] += move
            for length in columns[c]:
                if length:
                    rest[length] -= move
    return x


def recipes(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths and how often to use each, never beyond the pieces of ``histogram`` (counts by length, 0 to ``window``)."""
    left, out = histogram.astype(np.int64).copy(), []
    if left[window]:
        out.append(((window,), int(left[window])))
    left[window] = 0
    for _ in range(ROUNDS):
        columns = combinations(np.flatnonzero(left), window)
        if not len(columns):
            break
        x = repeat_counts(columns, left)
        before = left.sum()
        for c in np.lexsort((np.arange(len(x)), -x))[: int((x >= 0.5).sum())]:
            slots = tuple(int(n) for n in columns[c] if n)
            times = min(int(x[c] + 0.5), *(int(left[n]) // slots.count(n) for n in slots))
            if times:
                out.append((slots, times))
                for n in slots:
                    left[n] -= times
        if before - left.sum() < 0.01 * before:
            break
    return out


def _pieces(path: str, window: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, made = words_of(path), TaskContext.get().partitionId(), 0
        seen = [0] * (window + 1)
        for rows, _, _ in chunks(batches, "text"):
            out = []
            for key, text in zip(rows.column("id").to_pylist(), rows.column("text").to_pylist()):
                ids = words.of(text or "") + end
                for at in range(0, len(ids), 4 * window):
                    piece = ids[at : at + 4 * window]
                    n = len(piece) // 4
                    out.append(((part << 36) + made, part, seen[n], key, at // 4, n, zlib.crc32(piece), len(ids) // 4, piece if n < window else None))
                    seen[n] += 1
                    made += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            names = ["piece_id", "part", "rank", "id", "start", "length", "ids_crc32", "doc_tokens", "tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return run


def _place(plan: list[tuple[tuple[int, ...], int]]):
    """Gives a piece, by its length and rank, its sequence and its place there; pieces beyond the plan have none."""
    ranges, taken, sequence = [], {}, 0
    for slots, times in plan:
        offset = 0
        for n in slots:
            first = taken.get(n, 0)
            ranges.append((n, first, times, sequence, offset))
            taken[n] = first + times
            offset += n
        sequence += times
    ranges.sort()
    length, first, times, base, offsets = np.array(ranges or [(0, 0, 0, 0, 0)], np.int64).T
    keys = (length << 40) + first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.maximum(np.searchsorted(keys, (n << 40) + rank, "right") - 1, 0)
            hit = (length[at] == n) & (rank < first[at] + times[at])
            found = [pa.array(v, pa.int64(), mask=~hit) for v in (base[at] + rank - first[at], offsets[at])]
            names = ["piece_id", "id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found], names=[*names, "sequence_id", "offset"])

    return run, sequence


def _ends(total: int, window: int) -> np.ndarray:
    """Where sequences end on a line of ``total`` tokens: every ``window``, then at powers of two, largest first."""
    ends = list(range(window, total + 1, window))
    at = total - total % window
    for bit in reversed(range(window.bit_length())):
        if (total - at) >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return np.array(ends, np.int64)


def _pack_rest(window: int, base: int):
    def run(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py()
        table = table.drop_columns(["node"]).combine_chunks()
        table = table.take(pa.array(np.argsort(table.column("piece_id").to_numpy(), kind="stable")))
        sizes = table.column("length").to_numpy().astype(np.int64)
        bins = best_fit(sizes, window)
        used = np.array([sizes[b].sum() for b in bins])
        order = np.argsort(-used, kind="stable")  # full bins come first and end where a sequence does
        line = np.concatenate([np.array(bins[k]) for k in order])
        until = np.cumsum(sizes[line])
        ends = _ends(int(until[-1]), window)
        edges = np.union1d(until, ends)
        begins = np.concatenate([[0], edges[:-1]])
        item = np.searchsorted(until, begins, "right")
        sequence = np.searchsorted(ends, begins, "right")
        starts = np.concatenate([[0], ends[:-1]])
        skip = begins - (until[item] - sizes[line[item]])
        rows = table.take(pa.array(line[item]))
        return pa.table({
            "piece_id": rows.column("piece_id"), "id": rows.column("id"), "start": pa.array(rows.column("start").to_numpy() + skip), "skip": pa.array(skip.astype(np.int32)), "length": pa.array((edges - begins).astype(np.int32)),
            "ids_crc32": pa.array(rows.column("ids_crc32").to_numpy(), pa.int64(), mask=edges - begins != sizes[line[item]]), "doc_tokens": rows.column("doc_tokens"),
            "sequence_id": pa.array(base + node * NODE_SEQUENCES + sequence), "offset": pa.array(begins - starts[sequence]),
        })

    return run


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1) -> DataFrame:
    """Packs all rows; returns ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece.

    A null or empty text is its end token alone; long texts are read whole and cut every
    ``window`` tokens, other pieces only where the best fit leaves bins that aren't full.
    All sequences are full or a power of two long, so none needs padding; ``window`` must
    be a power of two. Each row is packed, also where ids are null or repeated, ties
    among pieces of one length go by the order of tasks and rows. ``sequence_id`` is
    unique but not dense. An empty table gives none. Other columns are ignored.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    scratch = Scratch(docs.sparkSession, "nnls")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = scratch.stage(source.mapInArrow(_pieces(tokenizer_path, window, end_id), _PIECE), "pieces", compression="zstd")
    per_part = scratch.stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(window + 1, np.int64)
    for n, count in per_part.groupBy("length").agg(F.sum("n")).collect():  # one row for each length up to the window
        histogram[n] = count
    place, sequences = _place(recipes(histogram, window))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = pieces.drop("tokens").join(per_part.select("part", "length", before.alias("before")), ["part", "length"])
    ranked = ranked.select("piece_id", "id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank"))
    placed = scratch.stage(ranked.mapInArrow(place, _PLACED), "placed")
    rest = placed.where(F.col("sequence_id").isNull()).drop("sequence_id", "offset")
    nodes = max(1, -(-rest.count() // NODE_ITEMS))
    dealt = rest.withColumn("node", F.pmod(F.xxhash64("piece_id"), F.lit(nodes)))
    cut = scratch.stage(dealt.groupBy("node").applyInArrow(_pack_rest(window, sequences), _CUT), "rest")
    columns = [F.col("id"), F.col("start"), F.col("length").cast("long").alias("length"), F.col("ids_crc32"), F.col("doc_tokens"), F.col("sequence_id"), F.col("offset")]
    part = F.expr("substring(tokens, 4 * skip + 1, 4 * length)")
    parts = cut.where("ids_crc32 IS NULL").join(pieces.select("piece_id", "tokens"), "piece_id").withColumn("ids_crc32", F.crc32(part))
    return placed.where(F.col("sequence_id").isNotNull()).select(*columns).unionByName(cut.where("ids_crc32 IS NOT NULL").select(*columns)).unionByName(parts.select(*columns))
