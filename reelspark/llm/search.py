"""Ranked lexical search: integer BM25-like scores over a term-bucketed table of postings.

Documents are split once; the postings of all terms that are asked for are dealt and
written by term. The terms' weights are joined to that table where it lies, which scores
each posting. Scored postings then go to their documents, one row per document and term,
and only there meet the items that hold the term: matches are made and summed by item
and document in the same task, so no match is ever exchanged. The best of each item are
found by a window that keeps no more than the rows asked for in each task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelspark.llm._bytes import chunks
from reelspark.llm._rows import row_key
from reelspark.llm._scratch import Scratch

#: Runs of digits, ASCII letters and all characters beyond ASCII, in UTF-8.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Item terms up to this many rows are sent to every task; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Documents by which the postings of a term are split: a term has a part for each so many.
PART_DOCS = 1 << 20
_POSTING = "row long, doc_id long, n long, term string, tf long"
_TERMS = "item long, item_id long, term string"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's terms with their occurrences, and a row with the empty term for its length."""
    made = TaskContext.get().partitionId() << 36
    for rows, data, offsets in chunks(batches, "text"):
        row, doc, length, terms, tf = [], [], [], [], []
        raw = data.tobytes().lower()
        for k, key in enumerate(rows.column("id").to_pylist()):
            found = Counter(TERM.findall(raw[offsets[k] : offsets[k + 1]]))
            n = found.total()
            if n:
                m = len(found) + 1
                row += [made] * m
                doc += [key] * m
                length += [n] * m
                terms.append(b"")
                terms += found
                tf.append(n)
                tf += found.values()
            made += 1
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(doc, pa.int64()), pa.array(length, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64())], names=["row", "doc_id", "n", "term", "tf"])


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, item_id, term, repeats`` of every distinct row; ``item`` is a key of the row."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    words = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return rows.select(row_key("item_id", "text").alias("item"), "item_id", F.explode(words).alias("term")).groupBy("item", "item_id", "term").agg(F.count("*").alias("repeats"))


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = 10, b: int = 75) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents with a score above 0 of every item.

    Weight of a term: floor(1000 ln((2 N + 2) / (2 df + 1))). A posting scores
    (10^9 tf) div (1000 tf + 8 m) with m = 100 - b + ((b n N) div L); sums are 64-bit, and
    one that overflows fails instead of wrapping. Ties go to the lesser id, null ids
    last. A null or empty text has no terms and is never found. Documents with equal ids
    are documents of their own; items that are equal rows count once, items of one id with
    other texts are ranked each for itself. Long texts are read whole. An empty table
    on either side gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    wanted = scratch.stage(item_terms(items, item_col, item_text_col), "items")
    small = wanted.count() <= BROADCAST_ROWS
    near = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    vocabulary = wanted.select("term").distinct().unionByName(spark.createDataFrame([("",)], "term string"))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = -(-max(1, source.count()) // PART_DOCS)
    found = source.mapInArrow(_count, _POSTING).join(near(vocabulary), "term", "left_semi").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    postings = scratch.bucketed(found, ["term", "part"], int(spark.conf.get("spark.sql.shuffle.partitions")), "postings")
    # One row each: the documents with a term and all their terms.
    size = postings.where("term = ''").agg(F.count("*").alias("docs"), F.sum("n").alias("terms"))
    holders = postings.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.col("docs") + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    asked = holders.join(F.broadcast(size)).select("term", weight.alias("w"), "docs", "terms").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    m = 100 - b + F.expr(f"({b} * n * docs) div terms")
    one = F.col("w") * F.expr("(1000000000 * tf) div (1000 * tf + 8 * m)")
    scored = postings.join(asked.where("w > 0"), ["term", "part"]).withColumn("m", m).select("row", "doc_id", "term", one.alias("one")).where("one > 0")
    if small:
        scored = scored.repartition(F.col("row"))
    matches = scored.join(near(wanted), "term")
    sums = matches.groupBy("item", "item_id", "row", "doc_id").agg(F.sum(F.col("one") * F.col("repeats")).alias("score"))
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    return sums.withColumn("rank", best).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
