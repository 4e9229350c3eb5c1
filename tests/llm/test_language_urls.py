"""Languages and URLs: ties, repeated rows, null ids, clashing columns, verdicts against a dense solution."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from reelspark.llm import language, url_filter


def test_language_ties_and_repeats(spark):
    """Two languages that learn the same are a tie, which the first in order wins."""
    text = "the quick brown fox jumps over the lazy dog and runs away from there " * 5
    other = "der schnelle braune fuchs springt ueber den faulen hund und laeuft davon " * 5
    schema = "doc_id long, text string, lang string, id long, lang_pred string, lettered boolean, bits double"
    rows = [(1, text, "bb", 7, "x", False, 1.0), (1, text, "aa", 7, "x", False, 1.0), (2, other, "cc", 7, "x", False, 1.0), (2, other, "cc", 7, "x", False, 1.0)]
    docs = spark.createDataFrame([*rows, (None, text, None, 1, "y", True, 0.0), (None, None, "cc", 1, "y", True, 0.0), (5, other * 400, "aa", 1, "y", True, 0.0)], schema)
    got = [(r.id, r.lang_pred) for r in language.identify(docs, spark.createDataFrame(rows, schema)).collect()]
    assert Counter(got) == Counter([(1, "aa"), (1, "aa"), (2, "cc"), (2, "cc"), (None, "aa"), (None, "und"), (5, "cc")])
    score = {r.id: r.score for r in language.identify(docs, spark.createDataFrame(rows, schema)).collect() if r.id}
    assert score[1] == pytest.approx(0.5, abs=0.01) and all(0 <= v <= 1 for v in score.values())


def dense(hosts, edges, seeds, damping):
    """The sum over all ways from the seeds, by one linear system."""
    n, at = len(hosts), {h: k for k, h in enumerate(hosts)}
    w = np.zeros((n, n))
    out = Counter()
    for (a, b), k in edges.items():
        out[a] += k
    for (a, b), k in edges.items():
        w[at[b], at[a]] = k / out[a]
    s = np.zeros(n)
    for h, k in seeds.items():
        s[at[h]] = k / sum(seeds.values())
    return dict(zip(hosts, np.linalg.solve(np.eye(n) - damping * w, (1 - damping) * s)))


def test_verdicts_against_a_dense_solution(spark):
    """Every verdict by trust and distrust over a random graph of hosts, with repeated rows, null ids and columns that clash."""
    rng = np.random.default_rng(1)
    hosts = [f"h{k}.{'com' if k % 4 == 0 else 'net' if k % 4 == 1 else 'org'}" for k in range(14)]
    rows = []
    for k, host in enumerate(hosts):
        for page in range(2):
            to = rng.choice(hosts, 4)
            html = " ".join(f'<a href="http://{t}/p">' for t in to)
            rows.append((None if k == 3 else 10 * k + page, f"http://{host}/{'es/' if page else 'a/'}x", html if k % 5 else None))
    rows += [rows[5], rows[5], (None, None, None), (900, "http://alone.org/", "")]
    schema = "page_id long, url string, html string, host string, by string, verdict string, trust int, src string"
    got = url_filter.judge_urls(spark.createDataFrame([(*r, "h", "b", "v", 1, "s") for r in rows], schema), damping=0.5, tolerance=1e-4).collect()
    edges, allow, block = Counter(), Counter(), Counter()
    for _, url, html in rows:
        if not url:
            continue
        host, path = re.match(r"http://([^/]*)(.*)", url).groups()
        edges.update((host, t) for t in re.findall(r'href="http://([^/]*)/', html or "") if t != host)
        allow[host] += host.endswith(".com")
        block[host] += host.endswith(".net") and path.startswith("/es/")
    names = [*hosts, "alone.org"]
    out = Counter()
    for (a, _), k in edges.items():
        out[a] += k
    shares = {(b, a): k / out[a] for (a, b), k in edges.items()}  # distrust goes back along the links' weights
    trust = dense(names, edges, +allow, 0.5)
    distrust = dense(names, shares, +block, 0.5)
    assert len(got) == len(rows)
    bad = 0
    for r in got:
        if not r.host:
            assert r.verdict == "allow"
            continue
        assert r.trust == pytest.approx(trust[r.host], rel=1e-3, abs=1e-9) and r.distrust == pytest.approx(distrust[r.host], rel=1e-3, abs=1e-9)
        if r.rule is None:
            assert r.verdict == ("block" if distrust[r.host] > trust[r.host] else "allow")
            bad += r.verdict == "block"
    assert bad and Counter(r.id for r in got) == Counter(r[0] for r in rows)


def test_a_tie_is_allowed(spark):
    """A host between a trusted and a blocked one, as near to either."""
    link = '<a href="http://{}/">'
    rows = [(1, "http://a.com/", link.format("m.org")), (2, "http://b.net/es/", ""), (3, "http://m.org/", link.format("b.net"))]
    got = {r.id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].trust == pytest.approx(got[3].distrust) and got[3].verdict == "allow"
