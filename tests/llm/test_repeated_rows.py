"""Rows whose ids are null or repeated."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import decontam, suffix_dedup

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def words(seed, n):
    return " ".join("".join(chr(97 + int(c)) for c in x) for x in np.random.default_rng(seed).integers(0, 26, (n, 6)))


def rows(spark, *pairs):
    return spark.createDataFrame([(k, t, f"host{j}", "en", len(t or "")) for j, (k, t) in enumerate(pairs)], SCHEMA)


def test_repeated_rows_of_operators(spark):
    a, b, c = (words(k, 60) for k in range(3))
    docs = rows(spark, (1, a), (1, a), (2, b), (2, c), (None, c[:300]), (None, None), (3, words(9, 60)))
    got = sorted((r.id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.repeated_passages(docs).collect())
    n = len(a)
    assert got == sorted([(1, n, n), (1, n, n), (2, n, 0), (2, n, 300), (0, 300, 300), (0, 0, 0), (3, n, 0)])
    items = spark.createDataFrame([(1, " ".join(a.split()[:12])), (2, " ".join(c.split()[:12]))], "item_id long, text string")
    got = sorted((r.id or 0, r.n_words, r.contaminated) for r in decontam.contamination(docs, items).collect())
    assert got == sorted([(1, 60, True), (1, 60, True), (2, 60, False), (2, 60, True), (0, len(c[:300].split()), True), (0, 0, False), (3, 60, False)])


def test_repeated_rows_of_the_pipeline(spark):
    import corpus_pipeline

    a, b, c, d, e = (words(k, 80) for k in range(5))
    sf = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    dirty = d + " " + next(r.text for r in sf.orderBy("item_id").collect() if len(r.text.split()) > 12)
    docs = rows(spark, (1, a), (1, a), (2, b), (2, c), (None, e), (4, dirty), (4, dirty), (0, b))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001").persist()
        assert docs.columns == ["doc_id", "text", "source", "lang", "n_chars"]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in docs.collect()) == sorted([(0, b), (1, a), (2, c), (-1, e)])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs.union(docs.where(F.col("doc_id").isNull())), "/root/testdata/sf0.001")
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in packed.collect()) == [-1, 0, 1, 2]


@pytest.mark.parametrize("repeats", [False, True])
def test_clashing_columns_and_empty_tables_of_the_pipeline(spark, repeats):
    """Columns named like those inside pass through every stage as they are."""
    import corpus_pipeline

    sf, names = "/root/testdata/sf0.001", ["_key", "_lines", "_new", "_rest", "_text", "id", "text_", "component_id", "kept", "n_removed", "kept_text"]
    # Every text has a line that is frequent on its host, and two share a passage.
    shared = words(50, 40)
    texts = [words(k, 90) + ("" if k > 1 else " " + shared) + "\nthe line that all of them have" for k in range(24)]
    pairs = [*enumerate(texts)] + ([(3, texts[3]), (None, words(77, 90))] if repeats else [])
    docs = rows(spark, *pairs).withColumn("source", F.lit("host")).withColumns({c: F.lit(f"own {c}") for c in names})
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, none = stage(spark, docs, sf).persist(), stage(spark, none, sf)
        assert docs.columns == none.columns == ["doc_id", "text", "source", "lang", "n_chars", *names]
        assert docs.select(*names).distinct().collect() == [tuple(f"own {c}" for c in names)] and none.collect() == []
    got = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == (25 if repeats else 24) and not any("the line that all" in t or shared in t for t in got.values())
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1]
    assert packed(spark, none, sf).collect() == [] and {r.doc_id for r in packed(spark, docs, sf).collect()} == set(got)


def test_repeated_rows_of_packing_and_near_duplicates(spark):
    from reelspark.llm import near_dup, packing, quality
    from reelspark.llm.queries import tokenizer_path

    a, b = words(1, 300), words(2, 60)
    docs = rows(spark, (1, a), (1, a), (1, b), (None, a), (None, None), (5, b))
    got = packing.packed(docs, tokenizer_path(), capacity=512).collect()
    taken = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for (s, at, n), (s2, at2, _) in zip(taken, taken[1:]):
        assert at2 == (at + n if s == s2 else 0)
    assert sum(r.piece == 0 for r in got) == 6
    near = sorted((r.id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_dup.near_duplicates(docs).collect())
    assert near == sorted([(1, 296, 1, True), (1, 296, 1, False), (0, 296, 1, False), (1, 56, 1, True), (5, 56, 1, False), (0, 0, 0, True)])
    judged = quality.document_rules(docs).collect()
    assert sorted(r.n_words for r in judged) == [0, 60, 60, 300, 300, 300]


def test_frequent_lines_go(spark):
    from reelspark.llm import quality

    line = "Menu | Home | page 1"
    docs = rows(spark, *[(k, words(k, 60) + f"\n{line.replace('1', str(k))}\n" + words(k + 100, 20)) for k in range(30)]).selectExpr("doc_id", "text", "'h' AS source")
    judged = docs.join(quality.document_rules(docs, frequent_lines=True).withColumnRenamed("id", "doc_id"), "doc_id")
    got = {r.doc_id: r for r in judged.withColumn("clean", quality.without_lines(F.col("text"), F.col("frequent_lines"))).collect()}
    assert all(r.kept and r.n_frequent_words == 6 and r.clean == words(k, 60) + "\n" + words(k + 100, 20) for k, r in got.items())


def test_foreign_records(spark):
    import gzip

    from reelspark.llm import warc

    end = b"\r\n"
    raw = b"".join([
        b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nsoft\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <a>\r\nWARC-Payload-Digest: md5:00\r\nContent-Length: 0\r\n\r\n" + end * 2,
    ])
    files = spark.createDataFrame([("x", bytearray(gzip.compress(raw)))], "archive string, content binary")
    got = warc.read_records(warc.normalise(files)).collect()
    assert [(r.record_type, r.record_id, r.n, r.digest is None) for r in got] == [("warcinfo", None, 4, False), ("revisit", "<a>", None, True)]
