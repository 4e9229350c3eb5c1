"""The registered language model against one that counts every pair."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pytest

from reelspark.llm.queries import QUERIES


def test_all_pairs_are_learnt(spark, tmp_path):
    texts = [" ".join(["the", f"rare{k}", f"next{k}", "end"] * (1 + k % 2)) + f" once{k % 7} the" for k in range(3000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokens = [[*re.findall(r"\S+", t), None] for t in texts]
    held = [zlib.crc32(str(k).encode()) % 5 == 1 for k in range(len(texts))]
    learnt = [ws for ws, h in zip(tokens, held) if not h]
    counts = Counter(w for ws in learnt for w in ws)
    after = Counter({**counts, "<start>": len(learnt)})
    pairs = Counter(p for ws in learnt for p in zip(["<start>", *ws], ws))
    total, distinct = sum(counts.values()), len(counts)
    base = lambda w: (counts[w] + 0.5) / (total + 0.5 * (distinct + 1))
    share = lambda a: 2 * max(after[a], 1) ** 0.9
    price = lambda a, b: (pairs[a, b] + share(a) * base(b)) / (after[a] + share(a))
    assert sum(price("the", w) for w in counts) + price("the", "unseen") * 1 == pytest.approx(1)  # the empty history keeps a part for one unseen word
    got = {r.doc_id: r for r in QUERIES["op6_lm_score"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and {k for k in got if got[k].held_out} == {k for k, h in enumerate(held) if h}
    for k, ws in enumerate(tokens):
        assert got[k].score == pytest.approx(sum(math.log10(price(a, b)) for a, b in zip(["<start>", *ws], ws)))


def test_blocks_exchange_counts(spark, monkeypatch):
    """The same scores whatever the blocks, with rows whose ids are null or repeated."""
    from reelspark.llm import lm_score

    texts = [f"a b c{k % 5} d{k} a b" for k in range(300)] + [None, "", "a b"]
    docs = spark.createDataFrame([(None if k == 7 else k % 290, t, k % 4 > 0) for k, t in enumerate(texts)], "doc_id long, text string, trained boolean").repartition(3)
    score = lambda: sorted((r.id if r.id is not None else -1, r.n_tokens, r.n_known, round(r.score, 9)) for r in lm_score.score_texts(docs).collect())
    whole = score()
    assert len(whole) == len(texts)
    for size in (1, 500):
        monkeypatch.setattr(lm_score, "BLOCK_BYTES", size)
        assert score() == whole
