"""Log-probabilities of texts under a smoothed word n-gram model, as a walk through an automaton.

States are the empty history, the start, and every word that training has. A state's arcs
are all the words seen after it in training. The model is smoothed by backing off: a
state with ``c`` occurrences gives ``m = 2 * c ** 0.9`` of its ``c + m`` parts to the
failure arc, which leads to the empty history, where the word is then read. An arc
carries ``log((n + m * base) / (c + m))`` (n: the pair's count) and the failure arc
``log(m / (c + m))``, so a state's probabilities sum to one. One pass from left to
right carries the state and adds up log-probabilities.

The vocabulary and the arcs grow with the corpus, so no task, no broadcast and no
driver holds them. Documents are labelled with blocks where they lie. A block counts
its words and pairs, the counts meet at each word or pair, and a block receives
totals for those that another block has too; all others it knows itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm._bytes import chunks, mix, word_hashes
from reelspark.llm._scratch import Scratch

BLOCK_BYTES = 8 << 20
#: The failure arc's part of a state with ``c`` occurrences is ``FAILURE_SCALE * c ** FAILURE_POWER``.
FAILURE_SCALE, FAILURE_POWER = 2.0, 0.9
# Hashes that stand for a text's start and end; no word has them but by chance.
START, END = np.uint64(0x5157A26), np.uint64(0xE4DE4C)
_ONE = np.uint64(1)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (even) with an end after every row, and the row's first token (n + 1 entries)."""
    words, first = word_hashes(data, offsets)
    n = len(offsets) - 1
    out = np.full(len(words) + n, END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(first))] = words & ~_ONE
    return out, first + np.arange(n + 1)


def _pairs(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes (odd) of every token with the state before it."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = START
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(tokens)) | _ONE


def _labelled(most: int):
    """Rows with the block that they fall in: runs of about ``most`` bytes of a partition's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for rows, data, _ in chunks([batch], "text"):
                if held and held + len(data) > most:
                    block, held = block + 1, 0
                held += len(data)
                yield rows.append_column("block", pa.array(np.full(rows.num_rows, block, np.int64)))

    return run


class _Block:
    """The words and pairs of one block, each once, with their counts in its training rows."""

    def __init__(self, table: pa.Table):
        tokens, sizes = [], []
        for _, data, offsets in chunks(table.to_batches(), "text"):
            t, first = _tokens(data, offsets)
            tokens.append(t)
            sizes.append(np.diff(first))
        self.sizes = np.concatenate(sizes)
        trained = np.repeat(table["trained"].to_numpy().astype(bool), self.sizes)
        hashes = np.concatenate(tokens)
        del tokens
        self.words, self.word_of, self.word_counts = self._counted(hashes, trained)
        hashes = _pairs(hashes, np.append(0, np.cumsum(self.sizes)))
        self.pairs, self.pair_of, self.pair_counts = self._counted(hashes, trained)

    @staticmethod
    def _counted(hashes: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        once, back = np.unique(hashes, return_inverse=True)
        return once, back.astype(np.int32), np.bincount(back, trained, len(once)).astype(np.int64)

    def correct(self, grams: np.ndarray, totals: np.ndarray) -> None:
        """Sets the counts of the given words and pairs to those of the whole corpus."""
        odd = (grams & _ONE).astype(bool)
        for hashes, counts, mine in ((self.words, self.word_counts, ~odd), (self.pairs, self.pair_counts, odd)):
            if len(hashes) and mine.any():
                at = np.minimum(np.searchsorted(hashes, grams[mine]), len(hashes) - 1)
                there = hashes[at] == grams[mine]
                counts[at[there]] = totals[mine][there]


def _gram_counts(bits: int):
    """Per block its words and pairs with their counts in training rows (0: only in others), one row for all that agree on their first ``bits`` bits: the bucket where blocks compare them."""

    def run(table: pa.Table) -> pa.Table:
        block = _Block(table)
        grams, counts = np.concatenate([block.words, block.pairs]), np.concatenate([block.word_counts, block.pair_counts])
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order]
        bucket = (grams >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        lists = pa.array(np.append(first, len(grams)).astype(np.int32))
        of = lambda x: pa.ListArray.from_arrays(lists, pa.array(x))
        return pa.table({"block": np.full(len(first), table["block"][0].as_py(), np.int64), "bucket": bucket[first], "g": of(grams.view(np.int64)), "n": of(counts)})

    return run


def _walk(block: _Block, base: np.ndarray) -> np.ndarray:
    """log10 probability of each token in the state that the token before it leaves, given those of the empty history."""
    ends = np.cumsum(block.sizes)
    counts = block.word_counts[block.word_of]
    state = np.empty_like(counts)
    state[1:] = counts[:-1]
    # Every training row has one end, so the start has occurred as often as that.
    state[ends - block.sizes] = block.word_counts[np.searchsorted(block.words, END)]
    share = FAILURE_SCALE * np.maximum(state, 1) ** FAILURE_POWER
    seen = block.pair_counts[block.pair_of]
    fail = np.log10(share / (state + share))
    arc = np.log10((seen + share * 10**base) / (state + share))
    return np.where(seen > 0, arc, base + fail)


def _scorer(total: int, distinct: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left)
        block.correct(right["g"].to_numpy().view(np.uint64), right["total"].to_numpy())
        c = block.word_counts[block.word_of]
        base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        first = np.cumsum(block.sizes) - block.sizes
        add = lambda x: np.add.reduceat(x, first)  # noqa: E731  every row has an end, so none is empty
        return pa.table({"id": left["id"], "n_tokens": block.sizes, "n_known": add((c > 0).astype(np.int64)), "base_score": add(base), "score": add(_walk(block, base))})

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trained_col: str = "trained") -> DataFrame:
    """Learns from the rows where ``trained_col`` is true and scores all rows.

    Returns ``id, n_tokens, n_known, train_tokens, base_score, score`` (log10). Words
    have A-Z lower-cased; a text ends with one end token. Null and empty texts are
    the end alone; long texts are read whole, one that exceeds a block as a block of its
    own. Every row counts, also where ids are null or repeated, and has its own score.
    Without training rows all words are unknown; an empty table gives none. Words and
    pairs are told apart by 63-bit hashes. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(F.col(trained_col), F.lit(False)).alias("trained"))
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-3 * size // BLOCK_BYTES))
    labelled = rows.mapInArrow(_labelled(BLOCK_BYTES), "id long, text string, trained boolean, block long")
    dealt = scratch.bucketed(labelled, "block", buckets, "dealt", deal=False)
    bits = max(1, (4 * buckets - 1).bit_length())
    grams = dealt.select("block", "text", "trained").groupBy("block").applyInArrow(_gram_counts(bits), "block long, bucket long, g array<long>, n array<long>")
    # A word or pair has a row per block at most, so a frequent one's window stays as small as the number of blocks.
    same = Window.partitionBy("bucket", "g")
    grams = grams.repartition("bucket").select("block", "bucket", F.inline(F.arrays_zip("g", "n")))
    met = grams.select("block", "g", F.sum("n").over(same).alias("total"), F.count("*").over(same).alias("k"), (F.min("block").over(same) == F.col("block")).alias("lead"))
    met = scratch.stage(met.where("k > 1 OR g % 2 = 0").drop("k"), "met", compression="zstd")
    scratch.release()
    words = met.where("lead AND total > 0 AND g % 2 = 0").agg(F.sum("total").alias("total"), F.count("*").alias("distinct")).first()
    total, distinct = int(words.total or 0), int(words.distinct)
    scored = dealt.groupBy("block").cogroup(met.select("block", "g", "total").groupBy("block")).applyInArrow(
        _scorer(total, distinct), "id long, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select("id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
