"""Near-duplicate documents by an LSH forest over MinHash signatures.

Each tree of the forest sorts the documents by the signature, read from another
place on. Documents whose order agrees on the first ``MIN_DEPTH`` entries form a
region; inside it a document's candidates are its neighbours in the sorted order,
which are those with the longest common prefix, so a crowded region is searched at
a greater depth than a sparse one. A crowded region is also split at a depth of its
own, the deeper the more members it has; the leader of the region and that of each
part, the members with most close neighbours, are candidates for all their members.

Candidates are confirmed on the full shingle sets, those with a leader or from a
sparse region first: the other pairs of crowded regions need no test where the first
links join their ends already. Documents with the same shingle set are one class
from the start, so copies are never paired.

Neighbours and leaders can miss the one link of a document in a crowded region. So the
members that are outside the component most common in their region are compared, as a
query set, with the whole region, on full sets and in blocks of bounded size; two
documents meet in the first tree that brings them together. A block returns only links
that join components, fewer than it has members, so what leaves it grows with the
members and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm._bytes import chunks, mix, word_hashes
from reelspark.llm._rows import has_repeats, row_key
from reelspark.llm._scratch import Scratch
from reelspark.llm.components import connected

ENTRIES = 128
TREES = 16
MIN_DEPTH = 3
#: Neighbours on each side in each tree.
NEIGHBOURS = 8
#: How far the share of equal signature entries may lie below the threshold. In sparse regions a true link falls short with odds of some three in a million; in crowded ones (one in a thousand) the pair is met again.
SPARSE_MARGIN, CROWDED_MARGIN = 0.18, 0.11
_MULTIPLIERS = np.random.default_rng(20240301).integers(1, 2**63, ENTRIES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = ENTRIES // TREES
BUCKET_BYTES = 24 << 20
#: Members of a crowded region, or of those left out in it, in one block, and the bytes of their sets.
REGION_BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Members that a part of a crowded region has about, and how much another entry lessens them.
PART_MEMBERS, PART_FACTOR = 64, 1.5
_PAIRS = "a long, b long, alike double, later boolean"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes in ascending order."""
    words, first = word_hashes(data, offsets)
    n = len(words) - size + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(grams)]
    grams = mix(grams)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = np.uint64((int(whole) * 0x9E3779B97F4A7C15 + int(w)) & (2**64 - 1))
            yield mix(np.array([whole ^ np.uint64(0x5851F42D4C957F2D)]))
        else:
            yield words[:0]


def _minima(grams: np.ndarray) -> np.ndarray:
    out = np.full(ENTRIES, np.uint64(2**64 - 1))
    for at in range(0, len(grams), 1024):
        out = np.minimum(out, (grams[at : at + 1024, None] * _MULTIPLIERS).min(0))
    return out


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text"):
            n, d1, d2, sig, keys = [], [], [], [], []
            for grams in shingle_sets(data, offsets, size):
                n.append(len(grams))
                d1.append(int(mix(grams ^ np.uint64(0x1234567)).sum(dtype=np.uint64)))
                d2.append(int(mix(grams * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)))
                least = mix(_minima(grams))
                sig.append((least & np.uint64(255)).astype(np.uint8).tobytes() if len(grams) else b"")
                start = least.reshape(TREES, _STEP)
                key = start[:, 0]
                for depth in range(1, MIN_DEPTH):
                    key = mix(key * np.uint64(31) + start[:, depth])
                keys.append(key.view(np.int64).tolist() if len(grams) else [])
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.array(n, pa.int64()), pa.array(np.array(d1, np.uint64).view(np.int64)), pa.array(np.array(d2, np.uint64).view(np.int64)), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "n", "d1", "d2", "sig", "keys"],
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array([g.tobytes() for g in shingle_sets(data, offsets, size)], pa.binary())], names=["id", "grams"])

    return run


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _neighbours(threshold: float):
    """Compares each entry of a sorted run with those just before it. A sparse region lies in one run; in crowded ones pairs across two runs are left to the later steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "key", "id", "n", "size")] + [_fixed(batch.column("sig"), ENTRIES)]
            fresh = 0
            if held is not None:
                fresh = len(held[0])
                now = [np.concatenate([a, b]) for a, b in zip(held, now)]
            tree, key, ids, n, size, sig = now
            for back in range(1, NEIGHBOURS + 1):
                at = np.arange(max(fresh, back), len(ids))
                at = at[(tree[at] == tree[at - back]) & (key[at] == key[at - back])]
                at = at[np.minimum(n[at], n[at - back]) >= threshold * np.maximum(n[at], n[at - back])]
                like = (sig[at] == sig[at - back]).mean(1)
                alike = like >= threshold - np.where(size[at] > NEIGHBOURS, CROWDED_MARGIN, SPARSE_MARGIN)
                at, like = at[alike], like[alike]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[at], ids[at - back])), pa.array(np.maximum(ids[at], ids[at - back])), pa.array(like), pa.array(size[at] > NEIGHBOURS)], names=["a", "b", "alike", "later"])
            held = [x[-NEIGHBOURS:] for x in now]

    return run


def _alike(alike: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                like = (_fixed(batch.column("sig_node"), ENTRIES) == _fixed(batch.column("sig_hub"), ENTRIES)).mean(1)
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("hub"), pa.array(np.zeros(len(like), bool))], names=["node", "hub", "later"]).filter(pa.array(like >= alike))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("grams_node"), batch.column("grams_hub")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("hub")], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _candidates(reps: DataFrame, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs ``node, hub`` to confirm, ``later`` where both lie in crowded regions only and neither leads one; and the members of crowded regions.

    A hub may have any number of partners, a node has no more than its trees bound.
    """
    trees = reps.select("id", F.posexplode("keys").alias("tree", "key"))
    regions = trees.groupBy("tree", "key").agg(F.count("*").alias("size")).where("size > 1")
    turned = F.concat(F.expr(f"substring(sig, tree * {_STEP} + 1)"), F.expr(f"substring(sig, 1, tree * {_STEP})"))
    entries = trees.join(regions, ["tree", "key"]).join(reps.select("id", "n", "sig"), "id").select("tree", "key", turned.alias("sig"), "id", "n", "size")
    entries = scratch.stage(entries, "entries")
    parts = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), entries.count() // 200_000)
    # Ranges are cut between different values only, so a sparse region, whose rows agree on all three, stays whole.
    ranges = ["tree", "key", F.when(F.col("size") > NEIGHBOURS, F.struct("sig", "id"))]
    runs = entries.repartitionByRange(parts, *ranges).sortWithinPartitions("tree", "key", "sig", "id")
    near = runs.mapInArrow(_neighbours(threshold), _PAIRS).groupBy("a", "b").agg(F.max("alike").alias("alike"), F.min("later").alias("later"))
    near = scratch.stage(near, "near")
    close = near.where(F.col("alike") >= threshold)
    degree = close.select(F.col("a").alias("id")).unionByName(close.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    crowded = entries.where(F.col("size") > NEIGHBOURS)
    deeper = F.ceil(F.log(PART_FACTOR, F.col("size") / PART_MEMBERS)).cast("int")
    part = F.when(deeper > 0, F.expr("substring(sig, 1, deeper)"))
    whole = crowded.withColumn("deeper", MIN_DEPTH + deeper).select("tree", "key", "id", "n", "sig", F.explode(F.array_compact(F.array(F.lit(b""), part))).alias("part"))
    best = F.max_by(F.struct(F.col("id").alias("hub"), F.col("n").alias("n_hub"), F.col("sig").alias("sig_hub")), F.struct("degree", -F.col("id"))).alias("x")
    leaders = scratch.stage(whole.join(degree, "id").groupBy("tree", "key", "part").agg(best).select("tree", "key", "part", "x.*"), "leaders")
    stars = whole.join(leaders, ["tree", "key", "part"]).where((F.col("id") != F.col("hub")) & (F.least("n", "n_hub") >= threshold * F.greatest("n", "n_hub")))
    stars = stars.select(F.col("id").alias("node"), "hub", F.col("sig").alias("sig_node"), "sig_hub").mapInArrow(_alike(threshold - CROWDED_MARGIN), "node long, hub long, later boolean").distinct()
    return scratch.stage(near.select(F.col("a").alias("node"), F.col("b").alias("hub"), "later").unionByName(stars), "pairs"), crowded.select("tree", "key", "id", "n")


class _Postings:
    """Which members of a block have a shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        grams = np.concatenate(sets)
        order = np.argsort(grams, kind="stable")
        self.grams, self.owners = grams[order], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]

    def common(self, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many shingles the members ``at`` share with the set ``own``."""
        if len(at) <= 32:
            return np.array([len(np.intersect1d(own, self.sets[k], assume_unique=True)) for k in at])
        low, high = np.searchsorted(self.grams, own), np.searchsorted(self.grams, own, "right")
        n = high - low
        places = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.owners[places], minlength=len(self.sets))[at]


def _meet(threshold: float, percent: int):
    """Links between a block of members left out and a block of their region, as many as join their components."""

    def run(nodes: pa.Table, hubs: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if nodes.num_rows and hubs.num_rows:
            tree = nodes["tree"][0].as_py()
            nodes, hubs = nodes.sort_by("id"), hubs.sort_by("id")
            sets_of = lambda t: [np.frombuffer(x.as_buffer(), np.uint64) for x in t["grams"]]
            keys_of = lambda t: t["keys"].combine_chunks().flatten().to_numpy().reshape(-1, TREES)[:, :tree]
            ids, ns, roots = (hubs[c].to_numpy() for c in ("id", "n", "root"))
            keys, postings = keys_of(hubs), _Postings(sets_of(hubs))
            above: dict[int, int] = {}

            def top(root: int) -> int:
                while root in above:
                    root = above[root]
                return root

            for v, n, root, common, own, grams in zip(*(nodes[c].to_pylist() for c in ("id", "n", "root", "common")), keys_of(nodes), sets_of(nodes)):
                met = (keys == own).any(1)  # in an earlier tree
                at = np.flatnonzero(~met & (roots != root) & ((roots == common) | (ids > v)) & (np.minimum(n, ns) >= threshold * np.maximum(n, ns)))
                if not len(at):
                    continue
                both = postings.common(grams, at)
                for k in at[100 * both >= percent * (n + ns[at] - both)]:
                    x, y = top(root), top(int(roots[k]))
                    if x != y:
                        above[x] = y
                        found.append((v, int(ids[k])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _left_out(crowded: DataFrame, roots: DataFrame, classes: DataFrame, sets_for, threshold: float, percent: int, scratch: Scratch) -> DataFrame:
    """Links ``a, b`` between different components in a crowded region, one end outside the region's most common component.

    The region and its members left out are both cut into blocks of bounded size, and
    each two blocks meet in a task of their own.
    """
    members = crowded.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    members = scratch.stage(members, "members")
    common = members.groupBy("tree", "key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w")).groupBy("tree", "key")
    order = F.struct("c", -F.col("root"))
    common = common.agg(
        F.max_by("root", order).alias("common"), F.sum("c").alias("size"), F.sum("w").alias("weight"), (F.sum("c") - F.max("c")).alias("left"), (F.sum("w") - F.max_by("w", order)).alias("left_weight")
    ).where("`left` > 0")
    blocks = lambda c, w: F.ceil(F.greatest(F.col(c) / REGION_BLOCK, F.col(w) * 8 / BLOCK_BYTES)).cast("int")
    members = members.join(scratch.stage(common.select("tree", "key", "common", blocks("left", "left_weight").alias("xs"), blocks("size", "weight").alias("ys")), "common"), ["tree", "key"])
    members = scratch.stage(members, "crowd")
    if members.isEmpty():
        return members.select(F.col("id").alias("a"), F.col("id").alias("b"))
    sets = sets_for(members.select("id").distinct()).join(classes.select(F.col("rep").alias("id"), "keys"), "id")
    members = members.join(scratch.stage(sets, "crowd_sets"), "id")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    hubs = members.select("tree", "key", every("xs").alias("x"), own("ys").alias("y"), "id", "n", "root", "keys", "grams")
    new = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  tells the two sides' columns apart
    nodes = members.where("root <> common").select(*new("tree", "key"), own("xs").alias("x"), every("ys").alias("y"), *new("id", "n", "root", "common", "keys", "grams"))
    by = ["tree", "key", "x", "y"]
    return scratch.stage(nodes.groupBy(*by).cogroup(hubs.groupBy(*by)).applyInArrow(_meet(threshold, percent), "a long, b long"), "third")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked on the full sets. Neither side of a join is aggregated, so Spark can split a crowded hub's pairs."""
    of = lambda c: sets.select(F.col("id").alias(c), F.col("grams").alias(f"grams_{c}"))
    return pairs.join(of("hub"), "hub").join(of("node"), "node").mapInArrow(_confirm(percent), "a long, b long")


def _labels(links: DataFrame) -> DataFrame:
    """``node, label``: the least node within two links, which lies in the node's component."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    near = both.groupBy("node").agg(F.min("other").alias("m")).select(F.col("node").alias("other"), F.least("node", "m").alias("m"))
    return both.join(near, "other").groupBy("node").agg(F.min("m").alias("m")).select("node", F.least("node", "m").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Returns ``id, n_shingles, component_id, kept`` per row.

    Words have A-Z lower-cased; a text of fewer than ``size`` words is one shingle.
    Texts without words, null ones among them, are linked with nothing. Two documents
    are linked where ``100 * |A and B| >= percent * |A or B|`` on their full sets,
    whatever the texts' length; a component is named by its least id, whose row is
    kept. Ids may be null or repeated: each row is a document then, null comes after
    all ids, and of the component's rows with the least id one is kept. An empty table
    gives none. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    if not has_repeats(rows, "id"):
        return _judge(rows, size, percent)
    keyed = rows.withColumn("key", row_key("id", "text"))
    once = keyed.groupBy("key").agg(F.first("id").alias("own"), F.first("text").alias("text"), F.count("*").cast("int").alias("copies"))
    once = Scratch(docs.sparkSession, "neardup_rows").stage(once, "once")
    judged = _judge(once.select(F.col("key").alias("id"), "text"), size, percent).withColumnRenamed("id", "key")
    judged = once.select("key", "own", "copies").join(judged, "key")
    chiefs = judged.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "key")).alias("chief"))
    named = judged.join(chiefs, "component_id").select("own", "key", "n_shingles", "chief", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    # Nothing links texts without words, so each of them is its own component.
    alone = F.col("n_shingles") == 0
    return named.select(
        F.col("own").alias("id"), "n_shingles", F.when(alone, F.col("own")).otherwise(F.col("chief.own")).alias("component_id"),
        (alone | (F.col("key") == F.col("chief.key")) & (F.col("copy") == 1)).alias("kept"),
    )


def _judge(rows: DataFrame, size: int, percent: int) -> DataFrame:
    spark = rows.sparkSession
    scratch = Scratch(spark, "neardup")
    threshold = percent / 100
    bytes_in = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_in // BUCKET_BYTES))
    texts = scratch.bucketed(rows, "id", buckets, "texts")
    signs = scratch.stage(texts.mapInArrow(_signatures(size), "id long, n long, d1 long, d2 long, sig binary, keys array<long>"), "signs")
    first = lambda c: F.min_by(c, "id").alias(c)
    classes = scratch.stage(signs.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), first("sig"), first("keys")), "classes")
    reps = classes.select(F.col("rep").alias("id"), "n", "sig", "keys")
    pairs, crowded = _candidates(reps, threshold, scratch)

    sets_for = lambda ids: texts.join(ids, "id", "left_semi").mapInArrow(_sets(size), "id long, grams binary")
    wanted = pairs.select(F.col("node").alias("id")).unionByName(pairs.select(F.col("hub").alias("id"))).distinct()
    sets = scratch.stage(sets_for(wanted), "sets")
    links = scratch.stage(_confirmed(pairs.where("NOT later").select("node", "hub"), sets, percent), "first")
    labels = scratch.stage(_labels(links), "labels")
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    open_ = pairs.where("later").select("node", "hub", F.lit(False).alias("linked")).unionByName(links.select(F.col("a").alias("node"), F.col("b").alias("hub"), F.lit(True).alias("linked")))
    apart = open_.join(of("node"), "node", "left").join(of("hub"), "hub", "left").where(F.coalesce("label_node", "node") != F.coalesce("label_hub", "hub"))
    apart = scratch.stage(apart.select("node", "hub", "linked"), "apart")
    more = scratch.stage(_confirmed(apart.where("NOT linked").select("node", "hub"), sets, percent), "second")
    scratch.drop("sets")
    # What the labels join already needs no link of its own.
    bonds = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(apart.where("linked").select(F.col("node").alias("a"), F.col("hub").alias("b"))).unionByName(more)
    roots = connected(bonds, scratch)
    late = _left_out(crowded, roots, classes, sets_for, threshold, percent, scratch)
    if not late.isEmpty():
        roots = connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late), scratch, "late_cc")
    named = classes.drop("sig", "keys").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = scratch.stage(named.select("d1", "d2", "n", F.coalesce("root", "rep").alias("root")), "named")
    scratch.drop("crowd_sets", "texts")
    out = signs.select("id", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
    root = F.coalesce("root", "id")
    return out.select("id", F.col("n").alias("n_shingles"), root.alias("component_id"), (root == F.col("id")).alias("kept"))
