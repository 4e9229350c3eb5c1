"""Least-squares packing, fill-in-the-middle and ranked search against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from reelspark.llm import fim, nnls_packing, search
from reelspark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, source string, n int, term string, part int, h string, mark string"
TEXTS = [None, "", " \n\t", "a", "same words here " * 9, "same words here " * 9, "holds <P> a marker", "é\U0001f600 b\x01c \x02\x01 d\x02\x03e\x04 \x0b", "x" * 5000, "  lead and trail \n", "Cat cat CAT dog", "dog Éa éa 9 x-y"]


def frame(spark, rows):
    """Documents with columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(k, t, "s", 1, "t", 2, "h", "m") for k, t in rows], SCHEMA)


def made(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(n))


def held_out_sequences(got, window):
    """Sequences are gapless and full or a power of two; returns each document's pieces in order."""
    lengths, docs = defaultdict(list), defaultdict(list)
    for r in got:
        lengths[r.sequence_id].append((r.offset, r.length))
        docs[r.id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for parts in lengths.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window and not at & (at - 1)
    return docs


@pytest.mark.parametrize("window", [64, 2048])
def test_packing(spark, window):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    texts = TEXTS + [made(k, int(n)) for k, n in enumerate(rng.integers(1, 60, 300))] + [made(9, 4000)]
    rows = list(enumerate(texts))
    got = nnls_packing.packed(frame(spark, rows), tokenizer_path(), window=window).collect()
    docs, plain = held_out_sequences(got, window), Tokenizer.from_file(tokenizer_path())
    assert len(docs) == len(rows)
    for (key, n), parts in docs.items():
        ids = np.array([*plain.encode(texts[key] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for start, length, crc in sorted(parts):
            assert start == at and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == n == len(ids)


def test_packing_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(nnls_packing, "NODE_ITEMS", 3)
    rows = [(1, made(1, 30))] * 7 + [(None, made(2, 11))] * 2 + [(None, None), (5, made(3, 90))]
    got = nnls_packing.packed(frame(spark, rows), tokenizer_path(), window=64).collect()
    assert sum(r.length for r in got) == sum(n * k for (_, n), k in Counter({(r.id, r.doc_tokens): sum(q.start == 0 for q in got if (q.id, q.doc_tokens) == (r.id, r.doc_tokens)) for r in got}).items())
    assert sum(r.start == 0 for r in got) == len(rows)
    held_out_sequences(got, 64)


def test_recipes():
    """Counts that combinations can use up are used up; more is never taken than there is."""
    h = np.zeros(65, np.int64)
    h[[16, 24]] = 40, 20  # 16 + 24 + 24 and 4 x 16 can't be, so 20 of 16 are taken by 10 combinations
    h[[20, 44]] = 7, 7
    plan = nnls_packing.recipes(h, 64)
    assert ((20, 44), 7) in plan and ((16, 24, 24), 10) in plan
    rng = np.random.default_rng(5)
    h = np.concatenate([[0], rng.integers(0, 500, 64)])
    used = np.zeros(65, np.int64)
    for slots, times in nnls_packing.recipes(h, 64):
        assert sum(slots) == 64 and len(slots) <= 3
        for n in slots:
            used[n] += times
    assert (used <= h).all() and used.sum() > 0.6 * h.sum()


def test_repeat_counts_are_least_squares():
    """Near the optimality conditions: no gradient pulls an unused combination up, none moves a used one."""
    h = np.concatenate([[0.0], np.random.default_rng(7).integers(50, 500, 32)])
    columns = nnls_packing.combinations(np.arange(1, 32), 32)
    x = nnls_packing.repeat_counts(columns, h)
    left = h - np.bincount(columns.ravel(), np.repeat(x, 3), 33)
    left[0] = 0
    pull = left[columns].sum(1)
    assert pull.max() < 3 and np.abs(pull[x > 0.5]).max() < 5


def plain_fim(key, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(spark):
    rows = [(k, t) for k in range(0, 400, 20) for t in TEXTS] + [(None, "null id here"), (10**15, " a\tb<") ] + [(k, made(k, 50) + " <S") for k in range(900, 930)]
    got = fim.fill_in_middle(frame(spark, rows)).collect()
    assert sorted((-1 if r.id is None else r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got if r.form != "plain") == sorted((-1 if k is None else k, *x) for k, t in rows if (x := plain_fim(k, t))[1] != "plain")
    assert Counter((r.id, r.n, r.form, r.output) for r in got) == Counter((k, x[0], x[1], x[4]) for k, t in rows if (x := plain_fim(k, t)))
    assert Counter((r.id, r.restored) for r in got) == Counter((k, t or "") for k, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def plain_search(docs, items, top=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({65 + k: 97 + k for k in range(26)}))
    bags = [(k, Counter(terms(t))) for k, t in docs]
    bags = [(k, b, b.total()) for k, b in bags if b]
    count, total = len(bags), sum(n for *_, n in bags)
    df, out = Counter(t for _, b, _ in bags for t in b), []
    for item, text in sorted(set(items), key=str):
        asked, found = Counter(terms(text)), []
        for k, b, n in bags:
            m = 25 + 75 * n * count // total
            score = sum(r * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, r in asked.items() if t in b)
            if score > 0:
                found.append((-score, k is None, k))
        out += [(item, rank, k, -s) for rank, (s, _, k) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return out


@pytest.mark.parametrize("parts, small", [(1 << 20, 1_000_000), (7, 0)])
def test_search(spark, monkeypatch, parts, small):
    monkeypatch.setattr(search, "PART_DOCS", parts)
    monkeypatch.setattr(search, "BROADCAST_ROWS", small)
    rng = np.random.default_rng(2)
    words = made(4, 40).split()
    docs = [*enumerate(TEXTS), *((100 + k, " ".join(rng.choice(words, rng.integers(1, 30)))) for k in range(60)), (7, "cat dog"), (7, "cat dog"), (None, "cat dog")]
    items = [(1, "cat Dog cat"), (2, ""), (3, None), (4, "éa Éa x"), (5, " ".join(words[:9] * 2)), (5, " ".join(words[3:5])), (None, words[0]), (1, "cat Dog cat"), (6, "nowhere")]
    given = spark.createDataFrame([(k, t, 5, 6) for k, t in items], "item_id long, text string, term int, row int")
    got = search.ranked(frame(spark, docs), given).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=key) == sorted(plain_search(docs, items), key=key)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert nnls_packing.packed(none, tokenizer_path()).collect() == []
    assert fim.fill_in_middle(none).collect() == []
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.ranked(none, items).collect() == []
    assert search.ranked(frame(spark, [(1, "a b")]), items.where("false")).collect() == []
    assert search.ranked(frame(spark, [(1, None), (2, "--")]), items).collect() == []
