"""Hierarchical residual packing of tokenised documents into sequences of a fixed length.

Documents are tokenised where they lie and cut only if they exceed a sequence.
Each partition packs its pieces best-fit, longest first, and emits the nearly full
bins. The other bins travel up a tree as items: a node packs the underfull bins of
several children best-fit again, emits what has become nearly full, and passes on
the rest. A node holds a bounded number of items; once rounds no longer lessen what
is left, or one node holds it all, the remaining bins are emitted as they are.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm._bytes import chunks
from reelspark.llm._scratch import Scratch

#: Items a node of the tree packs at once, words that a worker remembers, and the longest of these in characters.
NODE_ITEMS = 4_000
REMEMBERED_WORDS = 400_000
REMEMBERED_LENGTH = 64
_PIECE = "id long, piece int, start long, length long, ids_crc32 long"
_BIN = "used int, bin long, members array<struct<id:long,piece:int,start:long,length:long,ids_crc32:long>>"


# The settings of tokenizers that lower-case, split off runs of letters and read bytes; words can be remembered under these.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of letters whose composed form and lower case are their own, with a mark behind at most.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")


class _Words(dict):
    """Token ids of blank-separated words, as little-endian 32-bit integers.

    The known settings never join or tell apart text across a blank or a line feed, so
    a text's ids are those of its parts in a row, and a plain word's are those of its
    letters and its mark. Under other settings each text is tokenised whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        split, *rest = (settings["pre_tokenizer"] or {}).get("pretokenizers", [None])
        self.known = (
            (settings["normalizer"] or {}).get("normalizers") == NORMALIZERS and bool(split) and split.get("pattern") == {"Regex": SPLITTER}
            and [(r["type"], r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)] and not settings["model"].get("dropout")
        )
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = {k: as_bytes.pre_tokenize_str(chr(k))[0][0] for k in range(0xC0, 0x100)}
        self.parts: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """Of lower-case letters or a mark, by the model alone."""
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= REMEMBERED_WORDS:
                self.parts.clear()
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(part.translate(self.bytes_of))]).tobytes()
            if len(part) <= REMEMBERED_LENGTH:
                self.parts[part] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        plain = _PLAIN.fullmatch(word)
        ids = self._part(plain[1].lower()) + (self._part(plain[2]) if plain[2] else b"") if plain else self._ids(word)
        if len(word) <= REMEMBERED_LENGTH:
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        if not self.known:
            return self._ids(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def words_of(path: str) -> _Words:
    """Of this worker, which keeps what it has tokenised from task to task."""
    return _Words(path)


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for rows, _, _ in chunks(batches, "text"):
            out = []
            for key, text in zip(rows.column("id").to_pylist(), rows.column("text").to_pylist()):
                ids = words.of(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest bin that still holds it, in time O(items * log bins)."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with r left
    for item in np.argsort(-sizes, kind="stable"):
        size = int(sizes[item])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(int(item))
        by_room[room - size].append(at)
        rooms |= 1 << (room - size)
    return bins


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.drop_columns(["node"]).combine_chunks()
        order = np.argsort(table.column("bin").to_numpy(), kind="stable")  # the same whatever order the rows came in
        table = table.take(pa.array(order))
        bins = best_fit(table.column("used").to_numpy(), capacity)
        members = table.column("members").combine_chunks()
        counts = np.asarray(members.value_lengths())
        first = np.cumsum(counts) - counts
        used = table.column("used").to_numpy()
        flat_order = [np.arange(first[i], first[i] + counts[i]) for b in bins for i in b]
        flat = members.flatten().take(pa.array(np.concatenate(flat_order)))
        offsets = np.concatenate([[0], np.cumsum([int(counts[b].sum()) for b in bins])]).astype(np.int32)
        ids = table.column("bin").to_numpy()
        return pa.table({"used": pa.array([int(used[b].sum()) for b in bins], pa.int32()), "bin": pa.array([int(ids[b[0]]) for b in bins], pa.int64()), "members": pa.ListArray.from_arrays(pa.array(offsets), flat)})

    return run


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, full_share: float = 0.995) -> DataFrame:
    """Packs all rows; returns ``id, piece, start, length, ids_crc32, sequence_id, offset`` per piece.

    A null or empty text is its end token alone; long texts are read whole. Each row is
    packed, also where ids are null or repeated. ``sequence_id`` is unique but not dense.
    An empty table gives none. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = source.mapInArrow(_pieces(tokenizer_path, capacity, end_id), _PIECE).withColumn("bin", F.monotonically_increasing_id())
    pieces = scratch.stage(pieces, "pieces")  # once written, the numbers stay
    whole = pieces.where(F.col("length") == capacity).withColumnRenamed("bin", "sequence_id").withColumn("offset", F.lit(0).cast("long"))
    items = pieces.where(F.col("length") < capacity).select(
        F.col("length").cast("int").alias("used"), "bin", F.array(F.struct("id", "piece", "start", "length", "ids_crc32")).alias("members")
    )
    done = []
    left = items.count()
    level = 0
    while left:
        nodes = -(-left // NODE_ITEMS)
        tree = items.withColumn("node", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(nodes)))
        bins = scratch.stage(tree.groupBy("node").applyInArrow(_pack(capacity), _BIN), f"bins{level}")
        near = F.col("used") >= int(capacity * full_share)
        now = bins.where(~near).count()
        if nodes == 1 or now > 0.9 * left:
            done.append(bins)
            break
        done.append(bins.where(near))
        items, left, level = bins.where(~near), now, level + 1
    out = whole
    for bins in done:
        spread = bins.select(F.col("bin").alias("sequence_id"), F.posexplode("members").alias("k", "m"), "members")
        before = F.aggregate(F.slice("members", 1, F.col("k")), F.lit(0).cast("long"), lambda s, m: s + m["length"])
        out = out.unionByName(spread.select("m.*", "sequence_id", before.alias("offset")))
    return out

