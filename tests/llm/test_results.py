"""Registered operators against brute force on small fixtures and the smallest tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import decontam, language, licenses, lm_score, near_dup, packing, quality, suffix_dedup, url_filter, warc
from reelspark.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
LOW = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, id int, n int, h string, host string"


def frame(spark, texts):
    """Documents with columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(k, t, f"src{k % 2}", "en", len(t or ""), 1, 2, "h", "x") for k, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


EDGE = [None, "", " \n\t", "a", "x" * 5000, "same text here with some words " * 30, "same text here with some words " * 30, "é" * 300, "\U0001f600 emoji " * 100]


def passages(rows, length):
    texts = {k: (t or "").encode() for k, t in rows}
    seen = Counter(b[p : p + length] for b in texts.values() for p in range(len(b) - length + 1))
    out = {}
    for k, b in texts.items():
        mark = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                mark[p : p + length] = True
        keep = bytes(c for c, m in zip(b, mark) if not m)
        spans = int((mark[:-1] & ~np.concatenate([[False], mark[:-2]])).sum()) if len(b) else 0
        out[k] = (len(b), len(b) - len(keep), spans, hashlib.sha256(keep).hexdigest())
    return out


@pytest.mark.parametrize("length", [200, 40])
def test_repeated_passages(spark, small, length):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcde"), 4)) for _ in range(60)]
    line = " ".join(rng.choice(words, 60))
    made = EDGE + [" ".join(rng.choice(words, 50)) + line[k : k + 210 + k] + " ".join(rng.choice(words, 50)) for k in range(0, 40, 3)]
    rows = list(enumerate(made + [t for _, t in small[:60]]))
    got = suffix_dedup.repeated_passages(frame(spark, [t for _, t in rows]), length=length).collect()
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == passages(rows, length)


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[k : k + size]) for k in range(len(w) - size + 1)])


@pytest.mark.parametrize("piece", [37, 200, 1000])
def test_repeated_passages_of_long_texts(spark, monkeypatch, piece):
    """Texts that are worked on in pieces lose the same bytes, wherever the pieces' ends lie."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdef"), 5)) for _ in range(80)]
    text = lambda n: " ".join(rng.choice(words, n))
    shared = [text(60), text(45), text(200)]
    rows = list(enumerate([text(900) + shared[0] + text(400) + shared[1] + text(300) + shared[0][7:], text(50) + shared[2] + text(900) + shared[1][3:280], shared[2] + "x", text(30), shared[2] + text(10), None, text(300) * 2]))
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", piece)
    got = suffix_dedup.repeated_passages(frame(spark, [t for _, t in rows])).collect()
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == passages(rows, 200)


def test_pieces_of_a_text():
    """A text's windows choose the same q-grams whether it is read whole or in pieces."""
    data = np.random.default_rng(9).integers(97, 100, 50_000).astype(np.uint8)
    starts = np.arange(len(data) - 199)
    whole = suffix_dedup._items(data, starts, starts == 0, 40, 40, 200)
    old, suffix_dedup.PIECE_BYTES = suffix_dedup.PIECE_BYTES, 7_001
    try:
        cut = suffix_dedup._items(data, starts, starts == 0, 40, 40, 200)
    finally:
        suffix_dedup.PIECE_BYTES = old
    spread = lambda x: np.repeat(x[2], x[1] - x[0] + 1)
    assert len(cut[0]) in range(len(whole[0]), len(whole[0]) + 8) and (spread(whole) == spread(cut)).all()


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, small, size):
    rng = np.random.default_rng(2)
    base = [str(x) for x in rng.integers(0, 500, 200)]
    near = [" ".join("new" + str(k * 50 + j) if j % 90 == k % 90 else w for j, w in enumerate(base)) for k in range(40)]
    texts = EDGE + near + ["one two", "ONE two", "one two three"] + [t for _, t in small]
    sets = {k: shingles(t, size) for k, t in enumerate(texts)}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.id: r for r in near_dup.near_duplicates(frame(spark, texts), size=size).collect()}
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(s), find(k), find(k) == k) for k, s in sets.items()}


def test_packing(spark, small):
    from tokenizers import Tokenizer

    texts = EDGE + ["long words here and there, isn't it? <|endoftext|>   x\x1cy " * 2000, "Élan ÉTÉ, naïve. ÿ×÷ß Straße! don't it's; e\u0301t\u00e9 ΣΑΣ İI word... \u00a0a\u3000b"] + [t for _, t in small]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = packing.packed(frame(spark, texts), tokenizer_path()).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.id].append(r)
    total = 0
    for k, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        cut = [ids[a : a + 4096] for a in range(0, len(ids), 4096)]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in sorted(pieces[k], key=lambda r: r.piece)] == [(j, 4096 * j, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for j, c in enumerate(cut)]
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= math.ceil(total / 4096) + 1


def test_lm(spark, small):
    texts = EDGE + [t for _, t in small]
    docs = frame(spark, texts).selectExpr("*", "doc_id % 5 <> 1 AS trained")
    tokens = [[*WORD.findall((t or "").translate(LOW)), None] for t in texts]
    counts = Counter(w for k, ws in enumerate(tokens) if k % 5 != 1 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    base = lambda w: (counts[w] + 0.5) / (total + 0.5 * (distinct + 1))
    pairs = Counter((a, b) for k, ws in enumerate(tokens) if k % 5 != 1 for a, b in zip(["<start>", *ws], ws))
    after = Counter({**counts, "<start>": sum(k % 5 != 1 for k in range(len(texts)))})
    got = {r.id: r for r in lm_score.score_texts(docs).collect()}
    for k, ws in enumerate(tokens):
        score = 0.0
        for a, b in zip(["<start>", *ws], ws):
            share = 2 * max(after[a], 1) ** 0.9
            score += math.log10((pairs[a, b] + share * base(b)) / (after[a] + share))
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10(base(w)) for w in ws))
        assert r.score == pytest.approx(score)
    held = [k for k in got if k % 5 == 1]
    assert sum(got[k].score for k in held) > sum(got[k].base_score for k in held)


def test_language(spark):
    rows = QUERIES["op4_language"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang_pred != "und" and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    docs = frame(spark, EDGE + ["123 456", "the cat"])
    out = {r.id: r for r in language.identify(docs, docs).collect()}
    assert [out[k].lang_pred for k in (0, 1, 2, 9, 10)] == ["und"] * 4 + ["en"]
    assert {r.lang_pred for r in language.identify(docs, docs.limit(0)).collect()} == {"und"}


def test_ppm_prices(spark):
    """Code lengths against a walk through counts, byte by byte."""
    texts = ["the cat sat on the mat", "the hat that the cat had"]
    docs = frame(spark, texts)
    table = language.train(docs, "lang", "text")
    seen = Counter()
    for t in texts:
        b = b"\n\n\n" + t.encode()
        for k in range(3, len(b)):
            for depth in range(4):
                seen[b[k - depth : k + 1]] += 1

    def price(context, byte):
        after = {c: n for c, n in ((s[-1], n) for s, n in seen.items() if s[:-1] == context)}
        lower = price(context[1:], byte) if context else math.log2(257)
        if not after:
            return lower
        total, kinds = sum(after.values()), len(after)
        return -math.log2(after[byte] / (total + kinds)) if byte in after else lower - math.log2(kinds / (total + kinds))

    probe = "the mat zat hath"
    b = b"\n\n\n" + probe.encode()
    want = sum(price(b[k - 3 : k], b[k]) for k in range(3, len(b)))
    assert table.langs == ["en"]
    assert language.identify(frame(spark, [probe]), docs).first().bits == pytest.approx(want, rel=1e-5)


def test_warc(spark):
    body = "payload\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/x y\n", body), (2, None, body), (3, "http://b/", None), (4, "http://c/", "small"), (5, "http://d/", "small"), (6, "http://e/", body), (7, "http://f/", "é" * 700)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", pytest.importorskip("pyspark.sql.functions").lit("x"))
    got = {r.page_id: r for r in warc.page_round_trip(pages).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 6), 2: ("revisit", 6), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    for k, _, html in rows:
        raw = (html or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert got[k].payload == (None if got[k].record_type == "revisit" else raw)
    many = b"".join(warc._record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{k}>")], bytes([k]) * 200_000) for k in range(40))
    import gzip

    for whole in (gzip.compress(many), b"".join(gzip.compress(many[a : a + 999_999]) for a in range(0, len(many), 999_999))):
        assert [f["warc-record-id"] for f, _ in warc.records(warc._inflated(whole))] == [f"<{k}>" for k in range(40)]
    with pytest.raises(ValueError):
        list(warc._inflated(gzip.compress(many)[:-20]))


def test_url_rules_and_graph(spark):
    link = '<a href="{}">'
    rows = [
        (1, "http://WWW.example.com/en/x", ""), (2, "http://a.example.com/en/", ""), (3, "https://x.net/es/1?q", link.format("http://bad.org/z")),
        (4, "http://bad.org/p", link.format("https://x.net/es/")), (5, None, None), (6, "nothing", ""), (7, "http://y.com?x/", ""), (8, "http://z.com/p#f/", link.format("//good.org/") + link.format("/own")), (9, "http://good.org/", ""), (10, "http://lone.org", ""),
    ]
    got = {r.id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()} == {
        1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/", "example.com/en/", "block"), 3: ("x.net", "/es/1", "net/es/", "block"),
        4: ("bad.org", "/p", None, "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("y.com", "", None, "allow"), 8: ("z.com", "/p", "com/", "allow"), 9: ("good.org", "/", None, "allow"), 10: ("lone.org", "", None, "allow"),
    }
    assert got[9].trust > 0 and got[4].distrust > 0


def test_quality_and_licenses_on_edges(spark):
    spelt = lambda n: "".join(chr(97 + int(c)) for c in str(n))  # noqa: E731  digits are all alike to the line rule
    out = {r.id: r for r in quality.document_rules(frame(spark, EDGE)).collect()}
    assert (out[0].n_words, out[4].n_words, out[5].n_words, out[5].n_repeat_words, out[5].base_failed) == (0, 1, 180, 180, True)
    common = ["boiler plate line number %d\n" % 7 + " ".join(f"{spelt(k)}x{spelt(j)}" for j in range(60)) for k in range(60)] + ["Boiler  plate line number 8\nrest " * 12]
    kept = quality.document_rules(frame(spark, common), min_docs=5).collect()
    assert all(r.kept and r.n_frequent_words == 5 for r in kept if r.id < 60)
    got = {r.id: r for r in licenses.license_scan(frame(spark, [*EDGE, "x. Released under the MIT License.\nLicensed under the Apache License, Version 2.0. ", "All rights reserved"])).collect()}
    assert (got[9].licenses, got[9].sentence_ids, got[9].n_sentences) == ("Apache-2.0,MIT", "MIT-notice Apache-2.0-notice", 3)
    assert (got[10].licenses, got[0].licenses, got[0].n_sentences) == ("LicenseRef-proprietary", "", 0)


def test_decontamination_on_edges(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (3, ""), (10, " ".join(f"t{k}" for k in range(12)))], "item_id long, text string")
    texts = [None, "", "Alpha, beta gamma!", "alpha gamma beta", "x " + " ".join(f"T{k}" for k in range(11)) + " y", " ".join(f"t{k}" for k in range(12)) * 2]
    got = {r.id: r for r in decontam.contamination(frame(spark, texts), items).collect()}
    assert [(got[k].n_words, got[k].n_hit, got[k].n_items) for k in range(6)] == [(0, 0, 0), (0, 0, 0), (3, 3, 1), (3, 0, 0), (13, 11, 1), (23, 22, 1)]
    assert got[2].items_sha256 == hashlib.sha256(b"1").hexdigest()
    wide = {r.id: (r.n_hit, r.n_items) for r in decontam.contamination(frame(spark, [*texts, "beta x alpha y gamma", "beta x alpha y z gamma"]), items, slack=2).collect()}
    assert (wide[3], wide[6], wide[7], wide[0]) == ((3, 1), (5, 1), (0, 0), (0, 0))


def test_warc_without_ids_and_with_repeats(spark):
    big = "long payload " * 100
    rows = [(None, "http://a/", big), (None, None, None), (4, "http://b/", big), (4, "http://b/", big), (3, None, big), (9, "http://c/", "short")]
    got = warc.page_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    key = lambda r: tuple(str(x) for x in r)
    n = len(big)
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=key) == sorted([(None, n, "response", None), (None, 0, "response", None), (4, n, "response", None), (4, n, "response", None), (3, n, "revisit", 4), (9, 5, "response", None)], key=key)
    assert all(r.payload_digest == hashlib.sha1(big.encode()).hexdigest() for r in got if r.payload_bytes == n)


@pytest.mark.parametrize("op", ["repeated_passages", "near_duplicates", "document_rules", "license_scan", "packed", "score_texts", "contamination", "page_round_trip", "judge_urls", "identify"])
def test_empty_tables(spark, op):
    docs = frame(spark, ["x"]).limit(0)
    run = {
        "repeated_passages": lambda: suffix_dedup.repeated_passages(docs), "near_duplicates": lambda: near_dup.near_duplicates(docs), "document_rules": lambda: quality.document_rules(docs),
        "license_scan": lambda: licenses.license_scan(docs), "packed": lambda: packing.packed(docs, tokenizer_path()), "score_texts": lambda: lm_score.score_texts(docs.selectExpr("*", "true AS trained")), "contamination": lambda: decontam.contamination(docs, frame(spark, ["a b"]), item_col="doc_id"),
        "page_round_trip": lambda: warc.page_round_trip(docs.selectExpr("doc_id AS page_id", "source AS url", "text AS html")), "judge_urls": lambda: url_filter.judge_urls(docs.selectExpr("doc_id AS page_id", "source AS url", "text AS html")), "identify": lambda: language.identify(docs, docs),
    }[op]
    assert run().collect() == []


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, want.project(", ".join(columns)).fetchall()))


def test_pipeline_against_brute_force(spark, small):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("doc_id", "id")
    judged = docs.join(quality.document_rules(docs, "id", frequent_lines=True).where("kept"), "id").withColumn("clean", quality.without_lines(docs.text, F.col("frequent_lines"))).collect()
    texts = {r.id: r.clean for r in judged}
    sets = {k: shingles(t, 5) for k, t in texts.items()}
    groups = {k: k for k in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = groups[a], groups[b]
                groups = {k: min(x, y) if v in (x, y) else v for k, v in groups.items()}
    texts = {k: t for k, t in texts.items() if groups[k] == k}
    lost = passages(texts.items(), 200)
    texts = {k: t for k, t in texts.items() if lost[k][1] < lost[k][0]}
    items = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", r.text.translate(LOW)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9)) if w}
    for k in list(texts):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", texts[k].translate(LOW))
        whole = lost[k][1] == 0
        if whole and any(tuple(w[j : j + 10]) in windows for j in range(max(1, len(w) - 9))):
            del texts[k]
    assert {r.doc_id for r in got} == set(texts)


@pytest.mark.parametrize("block", [4096, 7])
def test_near_duplicates_of_crowded_regions(spark, monkeypatch, block):
    """A family around one text whose members lie just below the threshold of all others but one."""
    monkeypatch.setattr(near_dup, "REGION_BLOCK", block)
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.permutation(150)]
    texts = []
    for k in range(120):
        at = set(rng.choice(38, 4, replace=False) * 4)  # four words changed: 16 shingles each
        at = at if k % 3 else set(list(at)[:2])
        texts.append(" ".join(f"x{k // 2 if k % 2 and j % 8 else k}y{j}" if j in at else w for j, w in enumerate(base)))
    sets = [shingles(t, 4) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    got = {r.id: r.component_id for r in near_dup.near_duplicates(frame(spark, texts), size=4).collect()}
    assert len(set(root)) > 1 and got == dict(enumerate(root))
