"""URL verdicts from host and path rules, and from trust that spreads over the links between hosts.

Trust is a personalised PageRank from allowed seed hosts along links; distrust runs
from blocked seeds against the links (who links to a bad host is suspect). Host
edges are aggregated in Spark and each iteration is a join and a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm._scratch import Scratch

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Fixed values: (verdict, host, path prefix).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_LINK = r"""(?i)href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *_LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule (host and path together; the first given on ties) as a struct of name and verdict, or null."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for verdict, rule_host, prefix in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(rule_host + prefix).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Links between different hosts with their share of the source's links: ``src, dst, weight``. Links without a host are the page's own host's and make no edge."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(_LINK), 1)).alias("link"))
    pairs = links.select("src", host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return pairs.join(pairs.groupBy("src").agg(F.sum("n").alias("all")), "src").select("src", "dst", (F.col("n") / F.col("all")).alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float, scratch: Scratch, label: str) -> DataFrame:
    """Personalised PageRank ``host, score`` from ``seeds`` (``host, share``) along ``src, dst, weight``.

    Rounds go on until none reaches a new host or changes a score by more than
    ``tolerance`` of itself, so small scores far from the seeds settle too. The sums grow
    from nothing, one more link in each round.
    """
    start = seeds.select("host", (F.col("share") * (1 - damping)).alias("score"))
    rank, none = start, F.lit(0.0)
    k = 0
    while True:
        moved = edges.join(rank.select(F.col("host").alias("src"), "score"), "src").select(F.col("dst").alias("host"), (F.col("score") * F.col("weight") * damping).alias("score"))
        parts = moved.unionByName(start).select("host", "score", none.alias("before")).unionByName(rank.select("host", none.alias("score"), F.col("score").alias("before")))
        new = scratch.stage(parts.groupBy("host").agg(F.sum("score").alias("score"), F.sum("before").alias("before")), f"{label}{k}")
        scratch.drop(f"{label}{k - 1}")
        rank = new.select("host", "score")
        if new.where(F.abs(F.col("score") - F.col("before")) > tolerance * F.col("score")).isEmpty():
            return rank
        k += 1


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: list[tuple[str, str, str]] | None = None,
    damping: float = 0.85, tolerance: float = 1e-6, max_distrust_ratio: float = 1.0,
) -> DataFrame:
    """Returns ``id, host, path, rule, verdict, trust, distrust`` for each row.

    A fitting rule decides; otherwise a host is blocked where its distrust exceeds
    ``max_distrust_ratio`` times its trust. Seeds are the hosts whose pages a rule
    allows or blocks, in equal parts of all pages so judged. A null url, or one
    without ``://``, has an empty host and path and is allowed; so is a host that no
    seed reaches, and one whose distrust equals its trust (a tie). Seed hosts without
    links spread nothing beyond themselves. Each row has its verdict: ids may be null or
    repeated, and rows that repeat count again, as votes of their host and with their
    links. Null html has no links; html of any length is read whole. An empty table
    gives none. Other columns are ignored.
    """
    rules = rules or RULES
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col(url_col)
    judged = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
    judged = scratch.stage(judged, "judged")
    edges = scratch.stage(host_edges(pages, url_col, html_col), "edges")
    votes = scratch.stage(
        judged.where("host <> ''").groupBy("host").agg(F.count(F.when(F.col("by.verdict") == "allow", 1)).alias("allow"), F.count(F.when(F.col("by.verdict") == "block", 1)).alias("block")), "votes"
    )
    totals = votes.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    scores = votes.select("host")
    ranks = {}
    for kind in ("allow", "block"):
        seeds = votes.where(F.col(kind) > 0).select("host", (F.col(kind) / float(totals[kind] or 1)).alias("share"))
        ways = edges
        if kind == "block":
            back = edges.groupBy("dst").agg(F.sum("weight").alias("all"))
            ways = edges.join(back, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / F.col("all")).alias("weight"))
        ranks[kind] = propagate(ways, seeds, damping, tolerance, scratch, kind)
    scores = scores.join(ranks["allow"].withColumnRenamed("score", "trust"), "host", "left").join(ranks["block"].withColumnRenamed("score", "distrust"), "host", "left").na.fill(0.0, ["trust", "distrust"])
    bad = F.col("distrust") > max_distrust_ratio * F.col("trust")
    return judged.join(scores, "host", "left").select(
        "id", "host", "path", F.col("by.name").alias("rule"),
        F.coalesce("by.verdict", F.when(F.coalesce(bad, F.lit(False)), "block").otherwise("allow")).alias("verdict"), "trust", "distrust",
    )
