"""Removal of repeated passages through a sparse suffix array refined by bucket pointers.

A passage of ``length`` bytes that occurs twice is found without sorting every
suffix. Of the q-grams in each window of ``length`` bytes the one with the least
hash stands for the window (the leftmost on ties). Equal windows choose the same
q-gram at the same place, so only windows whose q-grams share a bucket can be equal.

The buckets are then refined level by level. A refined bucket is named by its old
bucket and by the bucket found some bytes later, the pointer (``bucket_ids``): names of
40-grams give those of 80-grams, these give 160, and so on up to ``length``, each
refinement reusing the names that the one before has made. Names are mixed pairs of
names instead of ranks, as only equality counts here; so a task refines its own texts
and only bucket sizes travel.

* a bucket with one member holds no repeat and is left;
* members that agree on everything their windows cover settle all of these windows;
* what is left is refined again at the q-grams chosen inside its windows, together
  with one member of each settled class, which the others may still match.

At the last level a q-gram is the window itself, so the result is exact up to hash
collisions (a level's bucket and its own hash must collide together). Groups are
counted with partial aggregates and members are found by joins, so a passage that a
third of all documents share is never gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm._bytes import Substrings, chunks, mix
from reelspark.llm._rows import has_repeats, row_key
from reelspark.llm._scratch import Scratch

#: q-gram lengths before the last level, as parts of the passage's length.
LEVELS = (0.2, 0.8)
BUCKET_BYTES = 24 << 20
#: Bytes of text that are worked on at once; longer texts are cut into pieces that overlap by a passage.
PIECE_BYTES = 32 << 20
_ITEM = "id long, lo int, hi int, h long, e long, off int"


def _least_positions(keys: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` keys, the place of the least, the leftmost on ties."""
    places = np.arange(len(keys), dtype=np.uint64)
    least = (keys & ~np.uint64((1 << 28) - 1)) | places
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return (least & np.uint64((1 << 28) - 1)).astype(np.int64)


def bucket_ids(data: np.ndarray, first: int, q: int) -> np.ndarray:
    """The bucket of the ``q`` bytes from every position on, refined from those of the ``first``-grams.

    Each refinement pairs a position's bucket with the bucket at a later offset, at
    most as far as the bucket is long, so that the two cover the longer q-gram.
    """
    first = min(first, q)
    ids = mix(Substrings(data).all_of(first))
    covered = first
    while covered < q:
        later = min(covered, q - covered)
        ids = mix(ids[: max(0, len(ids) - later)] * np.uint64(0x9E3779B97F4A7C15) + ids[later:])
        covered += later
    return ids


def _items(data: np.ndarray, starts: np.ndarray, breaks: np.ndarray, first_q: int, q: int, length: int):
    """Groups consecutive windows that share a chosen q-gram.

    ``starts``: window positions, ascending; ``breaks``: True where a window does
    not follow its predecessor. Returns first and last window, bucket, content and
    the q-gram's distance from the first window. Windows that lie far apart are
    grouped by themselves, which splits groups but changes no window's q-gram.
    """
    if len(starts) and starts[-1] - starts[0] > PIECE_BYTES:
        edges = np.append(np.searchsorted(starts, np.arange(starts[0], starts[-1] + 1, PIECE_BYTES)), len(starts))
        parts = []
        for a, b in zip(edges[:-1], edges[1:]):
            if a < b:
                base = starts[a]
                fresh = breaks[a:b].copy()
                fresh[0] = True
                lo, hi, h, e, off = _items(data[base : starts[b - 1] + length], starts[a:b] - base, fresh, first_q, q, length)
                parts.append((lo + base, hi + base, h, e, off))
        return tuple(np.concatenate(x) for x in zip(*parts))
    width = length - q + 1
    grams = bucket_ids(data, first_q, q)
    least = _least_positions(grams, width) if width > 1 else np.arange(len(grams))
    chosen = least[starts]
    cut = breaks.copy()
    cut[1:] |= chosen[1:] != chosen[:-1]
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, at = starts[first], starts[last], chosen[first]
    h = grams[at]
    e = mix(Substrings(data, 1).hashes(lo, hi + length) ^ ((hi - lo) * 977 + (at - lo)).astype(np.uint64))
    return lo, hi, h, e, at - lo


def _batch(ids, lo, hi, h, e, off) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(h.view(np.int64)), pa.array(e.view(np.int64)), pa.array(off, pa.int32())],
        names=["id", "lo", "hi", "h", "e", "off"],
    )


def _first_level(first_q: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text"):
            if rows.num_rows == 1 and len(data) > PIECE_BYTES + length:
                key = rows.column("id").to_numpy(zero_copy_only=False)
                for base in range(0, len(data) - length + 1, PIECE_BYTES):
                    piece = data[base : base + PIECE_BYTES + length - 1]
                    starts = np.arange(len(piece) - length + 1)
                    lo, hi, h, e, off = _items(piece, starts, starts == 0, first_q, first_q, length)
                    yield _batch(np.repeat(key, len(lo)), lo + base, hi + base, h, e, off)
                continue
            sizes = np.diff(offsets)
            if len(data) < length or (sizes < length).all():
                continue
            ids = rows.column("id").to_numpy(zero_copy_only=False)
            usable = np.zeros(len(data) + 1, np.int8)
            long = sizes >= length
            usable[offsets[:-1][long]] += 1
            usable[offsets[1:][long] - length + 1] -= 1
            starts = np.flatnonzero(np.cumsum(usable[:-1]))
            doc = np.searchsorted(offsets, starts, "right") - 1
            breaks = np.ones(len(starts), bool)
            breaks[1:] = (starts[1:] != starts[:-1] + 1) | (doc[1:] != doc[:-1])
            lo, hi, h, e, off = _items(data, starts, breaks, first_q, first_q, length)
            doc = np.searchsorted(offsets, lo, "right") - 1
            yield _batch(ids[doc], lo - offsets[doc], hi - offsets[doc], h, e, off)

    return run


def _next_level(first_q: int, q: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text"):
            ids = rows.column("id").to_numpy(zero_copy_only=False)
            spans = rows.column("spans")
            counts = np.asarray(spans.value_lengths())
            flat = spans.flatten()
            doc = np.repeat(np.arange(len(ids)), counts)
            lo = flat.field("lo").to_numpy(zero_copy_only=False).astype(np.int64) + offsets[doc]
            size = flat.field("hi").to_numpy(zero_copy_only=False).astype(np.int64) + offsets[doc] - lo + 1
            if not len(lo):
                continue
            head = np.cumsum(size) - size
            starts = np.repeat(lo - head, size) + np.arange(size.sum())
            starts = np.unique(starts)
            owner = np.searchsorted(offsets, starts, "right") - 1
            breaks = np.ones(len(starts), bool)
            breaks[1:] = (starts[1:] != starts[:-1] + 1) | (owner[1:] != owner[:-1])
            lo, hi, h, e, off = _items(data, starts, breaks, first_q, q, length)
            owner = np.searchsorted(offsets, lo, "right") - 1
            yield _batch(ids[owner], lo - offsets[owner], hi - offsets[owner], h, e, off)

    return run


def _merge_and_cut(length: int):
    """Joins a row's windows to maximal removed runs and cuts them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text"):
            spans, whole = rows.column("spans"), rows.column("whole").to_pylist()
            counts = np.asarray(spans.value_lengths().fill_null(0))
            flat = spans.flatten()
            los, his = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "hi"))
            ends = np.cumsum(counts)
            removed, runs, digests, kept_text, out_spans = [], [], [], [], []
            for row, end in enumerate(ends):
                raw = data[offsets[row] : offsets[row + 1]]
                lo, hi = los[end - counts[row] : end], his[end - counts[row] : end] + length
                if whole[row]:
                    lo, hi = np.zeros(1, np.int64), np.array([len(raw)])
                order = np.argsort(lo, kind="stable")
                lo, reach = lo[order], np.maximum.accumulate(hi[order]) if len(hi) else hi
                fresh = np.ones(len(lo), bool)
                fresh[1:] = lo[1:] > reach[:-1]
                begin = lo[fresh]
                stop = reach[np.append(np.flatnonzero(fresh)[1:], len(lo)) - 1] if len(lo) else lo
                keep = b"".join(raw[a:b].tobytes() for a, b in zip([0, *stop.tolist()], [*begin.tolist(), len(raw)]))
                removed.append(len(raw) - len(keep))
                runs.append(len(begin))
                digests.append(hashlib.sha256(keep).hexdigest())
                kept_text.append(keep.decode("utf-8", "ignore"))
                out_spans.append([{"start": int(a), "end": int(b)} for a, b in zip(begin, stop)])
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_text, pa.string()), pa.array(out_spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans"],
            )

    return run


def _classify(items: DataFrame, scratch: Scratch, level: int):
    """Settled windows, and what the next level must look at (all members that share a bucket but no class)."""
    buckets = scratch.stage(items.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), f"buckets{level}")  # written, so that the join can split a crowded bucket
    shared = scratch.stage(items.join(buckets, "h", "left_semi"), f"shared{level}")
    classes = scratch.stage(
        shared.groupBy("h", "e", "off").agg(F.count("*").alias("n"), F.min(F.struct("id", "lo", "hi")).alias("one")),
        f"classes{level}",
    )
    settled = shared.join(classes.where("n > 1").select("h", "e", "off"), ["h", "e", "off"], "left_semi").select("id", "lo", "hi")
    mixed = classes.groupBy("h").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 AND least = 1").select("h")
    mixed = scratch.stage(mixed, f"mixed{level}")
    left = classes.join(mixed, "h", "left_semi").select("one.*")
    return settled, left


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """Removes every byte covered by a ``length``-byte string that starts at another place too.

    Returns ``id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, spans`` for
    each row. Null and empty texts, and texts below ``length`` bytes, lose nothing; long
    texts are read whole, in pieces. An empty table gives none.
    Rows with the same text are settled as a group: from ``length`` bytes on they
    lose all, and one of them stands for the group against the rest. Rows of one id
    are such rows too if their texts are the same, else texts of their own; ids may be
    null. A cut inside a multi-byte character drops the broken rest of that
    character from ``kept_text``; digest and counts are those of the raw bytes.
    Columns besides the two named are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(1).cast("long").alias("rows"))
    repeats = has_repeats(source, "id")
    if repeats:  # equal rows as one, under a key of its own
        keyed = source.withColumn("key", row_key("id", "text"))
        named = keyed.select("key", F.col("id").alias("own"))
        source = keyed.groupBy(F.col("key").alias("id")).agg(F.first("text").alias("text"), F.count("*").alias("rows"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    keyed = source.withColumn("twin", F.md5("text"))
    copies = scratch.stage(
        keyed.where(F.octet_length("text") >= length).groupBy("twin").agg(F.sum("rows").alias("n"), F.min("id").alias("one")).where("n > 1"), "copies"
    )
    texts = scratch.bucketed(keyed.drop("rows"), "id", buckets, "texts")
    members = texts.select("id", "twin").join(copies, "twin").select("id", (F.col("id") == F.col("one")).alias("chief"))
    members = scratch.stage(members, "members")
    distinct = texts.join(members.where("NOT chief"), "id", "left_anti").select("id", "text")

    grams = [max(1, int(length * part)) for part in LEVELS]
    items = distinct.mapInArrow(_first_level(grams[0], length), _ITEM)
    items = scratch.stage(items, "items0")
    found = []
    for level, q in enumerate([*grams[1:], length]):
        settled, left = _classify(items, scratch, level)
        found.append(settled)
        spans = left.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
        items = scratch.stage(texts.select("id", "text").join(spans, "id").mapInArrow(_next_level(grams[0], q, length), _ITEM), f"items{level + 1}")
        scratch.drop(f"items{level}")
    again = scratch.stage(items.groupBy("h", "e").agg(F.count("*").alias("n")).where("n > 1").select("h", "e"), "again")
    found.append(items.join(again, ["h", "e"], "left_semi").select("id", "lo", "hi"))
    windows = found[0]
    for more in found[1:]:
        windows = windows.unionByName(more)
    spans = windows.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    marked = (
        texts.select("id", "text").join(spans, "id", "left").join(members.select("id", F.lit(True).alias("whole")), "id", "left")
        .select("id", "text", F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>")).alias("spans"), F.coalesce("whole", F.lit(False)).alias("whole"))
    )
    out = marked.mapInArrow(_merge_and_cut(length), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, spans array<struct<start:int,end:int>>")
    if repeats:
        return named.join(out.withColumnRenamed("id", "key"), "key").select(F.col("own").alias("id"), *out.columns[1:])
    return out
