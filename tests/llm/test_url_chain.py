"""Trust and distrust over long chains and cycles of hosts."""

from __future__ import annotations

import pytest

from reelspark.llm import url_filter


def test_long_chain(spark):
    link = '<a href="http://{}/">'
    n = 12
    rows = [(k, f"http://h{k}.org/", link.format(f"h{k + 1}.org") if k < n else link.format("bad.net")) for k in range(n + 1)] + [(99, "http://bad.net/es/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r for r in url_filter.judge_urls(pages).collect()}
    for k in range(n + 1):  # distrust runs from the blocked host against the links
        assert got[k].distrust == pytest.approx(0.15 * 0.85 ** (n + 1 - k)) and got[k].verdict == "block"


def test_cycle(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0)], "host string, share double")
    from reelspark.llm._scratch import Scratch

    got = {r.host: r.score for r in url_filter.propagate(edges, seeds, 0.5, 1e-6, Scratch(spark, "test"), "t").collect()}
    whole = 0.5 / (1 - 0.5**3)
    assert got == pytest.approx({"a": whole, "b": 0.5 * whole, "c": 0.25 * whole}, rel=1e-5)
