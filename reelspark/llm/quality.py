"""Quality rules: statistics of each document, and frequent lines across the documents of a host.

Everything is built from DataFrame functions. A line is normalised (A-Z lower-cased,
runs of digits to ``0``, white space to single blanks), hashed, and counted over the
distinct texts of its host. Lines above the limit are removed; a document that keeps
too few of its words is rejected as depleted.

Copies of one text count as one document: counted apart, a text with enough copies
would reject all of them, the one worth keeping too. Copies are the business of the
near-duplicate stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm._scratch import Scratch

# The white space that separates words, and the characters counted as symbols.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text."""
    windows = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
    )
    repeated = lambda o: F.filter(
        o, lambda x, k: F.coalesce(F.get(o, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(o, k + 1)["h"] == x["h"], F.lit(False))
    )
    places = lambda o: F.sort_array(F.transform(repeated(o), lambda x: x["i"]))
    gaps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    total = lambda p: F.aggregate(gaps(p), F.lit(0).cast("long"), lambda s, g: s + g)
    count = lambda w: _bound(F.sort_array(windows(w)), lambda o: _bound(places(o), total))
    return F.when(F.size(words) >= 3, _bound(words, count)).otherwise(F.lit(0).cast("long"))


def normalised_line(line: Column) -> Column:
    low = F.translate(line, *_LOWER)
    return F.trim(F.regexp_replace(F.regexp_replace(low, "[0-9]+", "0"), r"[\x20\x09-\x0D]+", " "))


def without_lines(text: Column, lines: Column) -> Column:
    """``text`` without the lines whose normalised hashes are in ``lines``; all of it where that is null."""
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    left = F.filter(F.split(text, "\n"), lambda line: ~(has_word(line) & F.array_contains(lines, F.xxhash64(normalised_line(line)))))
    return F.when(lines.isNull(), text).otherwise(F.array_join(left, "\n"))


def document_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = 20,
    max_share: float = 0.02,
    min_kept_share: float = 0.2,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    frequent_lines: bool = False,
) -> DataFrame:
    """One row per row of ``docs`` with its statistics and verdict.

    A line of at least one word is removed where it occurs in more than
    ``max(min_docs, max_share * distinct texts of the host)`` distinct texts of its
    host. A document is kept if it passes the base rules and keeps ``min_kept_share``
    of its words. Returns ``id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_frequent_words, kept``, and with ``frequent_lines`` the
    hashes of the lines to remove (null: none), for ``without_lines``. Null and empty texts have no words and fail the base
    rules; long texts are read whole; a null host counts as the empty one. Each row is
    judged for itself, also where ids are null or repeated. An empty table gives none.
    Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    parts = F.explode(F.array(F.struct(_words(F.col("text")).alias("words"), lines.alias("lines")))).alias("parts")  # a step of its own, so that later uses don't split again
    rows = rows.select("id", "host", "text", parts).select("id", "host", "text", "parts.*")
    facts = rows.select(
        "id",
        "host",
        F.xxhash64(F.md5("text"), F.octet_length("text")).alias("twin"),
        F.size("words").cast("long").alias("n_words"),
        F.length(_without(F.col("text"), WHITE)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.transform("lines", lambda line: F.struct(F.xxhash64(normalised_line(line)).alias("line"), F.size(_words(line)).alias("n"))).alias("lines"),
    )
    facts = scratch.stage(facts.withColumn("row", F.monotonically_increasing_id()), "facts")  # once written, the numbers stay
    counted = facts.select("row", "host", "twin", F.explode("lines").alias("x")).select("row", "host", "twin", "x.line", "x.n")
    texts = facts.groupBy("host", "twin").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("texts"))
    frequency = counted.groupBy("host", "line", "twin").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("found")).where(F.col("found") > min_docs)
    frequent = scratch.stage(frequency.join(texts, "host").where(F.col("found") > F.col("texts") * max_share).select("host", "line"), "frequent")
    lost = counted.join(frequent, ["host", "line"], "left_semi").groupBy("row").agg(F.sum("n").cast("long").alias("n_frequent_words"), F.collect_set("line").alias("frequent_lines"))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    n_lost = F.coalesce("n_frequent_words", F.lit(0).cast("long"))
    return facts.drop("lines", "host", "twin").join(lost if frequent_lines else lost.drop("frequent_lines"), "row", "left").select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), n_lost.alias("n_frequent_words"),
        (~base & (F.col("n_words") - n_lost >= min_kept_share * F.col("n_words"))).alias("kept"), *(["frequent_lines"] if frequent_lines else []),
    )
