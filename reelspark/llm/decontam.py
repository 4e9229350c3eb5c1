"""Benchmark decontamination with a positional inverted index of the training texts.

Built from DataFrame functions alone. Each text is split once; the index, written as a
table, holds postings ``(term, id, pos)`` for the terms that benchmark windows have, and
each text's number of words. A window's lists are intersected from its rarest terms on,
each shifted by the term's offset in the window; the few places left are intersected
with the lists of all its terms. ``proximity_matches`` finds windows whose terms stand
close together in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm._rows import each_row
from reelspark.llm._scratch import Scratch

# Fixed value: what stands between words (ASCII other than letters and digits).
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: The most bytes of benchmark terms that are broadcast; beyond it the joins shuffle.
BROADCAST_BYTES = 48 << 20


def words_of(text: Column) -> Column:
    """The words of a text; null and empty texts have none."""
    low = F.translate(F.coalesce(text, F.lit("")), *_LOWER)
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def _small(df: DataFrame) -> DataFrame:
    texts = [F.octet_length(name) for name, kind in df.dtypes if kind == "string"]
    held = df.agg(F.sum(sum(texts, F.lit(64))).alias("bytes")).first().bytes or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def item_windows(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """Each distinct window of ``size`` words with its items, a row for each; a shorter item is one window."""
    once = F.explode(F.array(words_of(F.col(text_col)))).alias("w")  # a step of its own, so that the windows don't split again
    words = items.select(F.col(item_col).cast("string").alias("item"), once).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window")).distinct()


class PhraseIndex:
    """The positional index of ``docs`` (``id, text``) for the windows of ``items``.

    ``windows``: ``wid, item``; ``terms``: ``wid, off, term, size``; ``postings``: ``term, id,
    pos``, where the empty term stands behind a text's last word.
    """

    def __init__(self, docs: DataFrame, items: DataFrame, item_col: str, item_text_col: str, size: int, scratch: Scratch):
        self.size, self.scratch = size, scratch
        named = item_windows(items, item_col, item_text_col, size).withColumn("wid", F.xxhash64("window"))
        self.windows = scratch.stage(named.select("wid", "item").distinct(), "windows")
        whole = named.dropDuplicates(["wid"]).select("wid", F.size("window").alias("size"), F.posexplode("window").alias("off", "term"))
        self.terms = scratch.stage(whole, "terms")
        ends = self.terms.select("term").distinct().unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term")))
        tokens = docs.select("id", F.posexplode(F.concat(words_of(F.col("text")), F.array(F.lit("")))).alias("pos", "term"))
        self.postings = scratch.stage(tokens.join(_small(ends), "term", "left_semi").select("term", "id", "pos"), "postings", compression="zstd")

    def lengths(self) -> DataFrame:
        return self.postings.where("term = ''").select("id", F.col("pos").cast("long").alias("n_words"))

    def _rarest(self, rare: int) -> DataFrame:
        """The ``rare`` terms of each window that have the fewest postings, each at its first offset; ties go to the lesser term."""
        counts = self.postings.groupBy("term").agg(F.count("*").alias("n"))
        once = self.terms.groupBy("wid", "term").agg(F.min("off").alias("off"))
        ranked = once.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).groupBy("wid").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "term", "off"))), 1, rare).alias("r"))
        found = ranked.where(F.get("r", F.lit(0))["n"] > 0)
        return self.scratch.stage(found.select("wid", F.size("r").alias("need"), F.explode("r").alias("x")).select("wid", "need", "x.term", "x.off"), "searched")

    def phrase_matches(self, rare: int = 2) -> DataFrame:
        """Places where a window stands word for word: ``id, start`` (from 1), ``length, wid``."""
        near = self.postings.join(_small(self._rarest(rare)), "term").select("id", "wid", (F.col("pos") - F.col("off")).alias("start"), "need").where("start >= 0")
        places = near.groupBy("id", "wid", "start").agg(F.max("need").alias("need"), F.count("*").alias("has")).where("has = need").select("id", "wid", "start")
        wanted = self.scratch.stage(places, "places").join(_small(self.terms), "wid").select("id", "wid", "start", "size", "term", (F.col("start") + F.col("off")).alias("pos"))
        whole = wanted.join(self.postings, ["id", "pos", "term"]).groupBy("id", "wid", "start", "size").agg(F.count("*").alias("has")).where("has = size")
        return whole.select("id", (F.col("start") + 1).alias("start"), F.col("size").alias("length"), "wid")

    def proximity_matches(self, slack: int, rare: int = 2) -> DataFrame:
        """Places from which all words of a window stand within its length and ``slack`` more, in any order: ``id, start`` (from 1), ``length, wid``."""
        near = self.postings.join(_small(self._rarest(rare)), "term").groupBy("id", "wid").agg(F.max("need").alias("need"), F.count_distinct("term").alias("has")).where("has = need").select("id", "wid")
        kinds = self.terms.groupBy("wid").agg(F.count_distinct("term").alias("kinds"), (F.max("size") + slack).alias("length"))
        wanted = self.scratch.stage(near, "near").join(self.terms.select("wid", "term").distinct().join(kinds, "wid"), "wid")
        ahead = Window.partitionBy("id", "wid").orderBy("pos").rangeBetween(0, self.size + slack - 1)
        seen = wanted.join(self.postings, ["id", "term"]).withColumn("seen", F.collect_list(F.struct("pos", "term")).over(ahead))
        inside = F.filter("seen", lambda x: x["pos"] < F.col("pos") + F.col("length"))
        whole = seen.where(F.size(F.array_distinct(F.transform(inside, lambda x: x["term"]))) == F.col("kinds"))
        return whole.select("id", (F.col("pos") + 1).alias("start"), "length", "wid")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, slack: int = 0
) -> DataFrame:
    """Per document ``id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A document is hit where a window of ``size`` words of an item stands in it; an item of
    fewer words is one window. With ``slack`` above 0 the window's words may stand within
    so many words more, in any order. Documents without a match, null and empty ones
    among them, have zeros and the digest of the empty string; items without words match
    nothing. Long texts are read whole. Each row is judged by its own text, also where
    ids are null or repeated; items of one id count as one. An empty table of documents
    gives none. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "contamination")

    def judge(rows: DataFrame) -> DataFrame:
        index = PhraseIndex(rows, items, item_col, item_text_col, size, scratch)
        found = scratch.stage(index.proximity_matches(slack) if slack else index.phrase_matches(), "found")
        spans = found.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("s"))
        covered = F.aggregate(
            "s", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
            lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["to"]))).cast("long").alias("n"), F.greatest(a["to"], x["end"]).alias("to")),
            lambda a: a["n"],
        )
        matched = found.select("id", "wid").distinct().join(index.windows, "wid").groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("i"))
        hits = spans.select("id", covered.alias("n_hit")).join(matched, "id")
        hits = hits.select("id", "n_hit", F.size("i").cast("long").alias("n_items"), F.sha2(F.array_join("i", ","), 256).alias("items_sha256"))
        zero = F.lit(0).cast("long")
        # A place near the text's end may reach beyond it.
        n_hit = F.least(F.coalesce("n_hit", zero), "n_words")
        return index.lengths().join(hits, "id", "left").select(
            "id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated")
        )

    return each_row(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), judge)
