"""Cycles of ten fields classified by their pulldown: scores in Spark, the choice with its history as a fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelspark.operators.fold import Fold, fold_streams

# Fields that each film frame takes in a cycle of ten, with the rotation's length and step.
FAMILIES = {"2323": ((2, 3, 2, 3), 5, 1), "2233": ((2, 2, 3, 3), 10, 1), "2224": ((4, 2, 2, 2), 10, 2), "30p": ((2, 2, 2, 2), 2, 2)}
#: Fields of a cycle's counts, from four before it to four behind it, and those that patterns cover.
FIELDS, COVERED, LEAD = 18, 14, 4


def patterns() -> list[tuple[str, int, list[bool]]]:
    """``(family, rotation, whether a film frame ends at each field)`` for each pattern, in the order of their numbers."""
    out = []
    for name, (lengths, period, step) in FAMILIES.items():
        ends, at = set(), 0
        for n in lengths * 4:
            at += n
            ends.add(at - 1)
        out += [(name, k, [8 + k * step + i in ends for i in range(COVERED)]) for k in range(period // step)]
    return out


def field_windows(counts: DataFrame) -> DataFrame:
    """``stream_id, cycle, counts`` (18 structs ``move, shima, lshima`` in order) from a row per field (``stream_id, field_id`` from 0).

    A field belongs to the cycles of ten fields that reach it with a lead of four on either
    side. Fields that a stream doesn't have count nothing. Cycles end with the one that holds
    the last field; several rows of one field add up.
    """
    field = F.col("field_id")
    cycles = F.sequence(F.greatest(F.lit(0), F.floor((field - FIELDS + LEAD) / 10) + 1).cast("long"), F.floor((field + LEAD) / 10).cast("long"))
    values = F.struct(*[F.col(c).cast("long").alias(c) for c in ("move", "shima", "lshima")])
    last = F.expr("max(field_id) OVER (PARTITION BY stream_id) div 10")
    rows = counts.groupBy("stream_id", "field_id").agg(*[F.sum(c).alias(c) for c in ("move", "shima", "lshima")]).withColumn("_last", last)
    placed = rows.withColumn("cycle", F.explode(cycles)).where("cycle <= _last").withColumn("k", (field - F.col("cycle") * 10 + LEAD).cast("int"))
    held = placed.groupBy("stream_id", "cycle").agg(F.map_from_entries(F.collect_list(F.struct("k", values.alias("v")))).alias("at"))
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("move", "shima", "lshima")])
    return held.select("stream_id", "cycle", F.transform(F.sequence(F.lit(0), F.lit(FIELDS - 1)), lambda k: F.coalesce(F.try_element_at("at", k), none)).alias("counts"))


def score_patterns(cycles: DataFrame, width: int, height: int, large: float = 5.0, threshold: float | None = None, less_2224: float = 0.5, less_30p: float = 1.5) -> DataFrame:
    """``stream_id, cycle, scores, costs, reliabilities``: a number per pattern.

    A field's split is the lesser movement to its neighbours with its stripes, ``large``
    times the large ones; its ratio to the fields beside it speaks for patterns that end a
    film frame there and against those that don't. Cost and reliability tell how far ratios
    at ends stay below ``threshold``, the cost weighted by the splits around.
    """
    if threshold is None:
        threshold = 1.5 if height >= 720 else 1.0
    base = max(1, int(width * height * 0.001) >> 4)
    at = lambda k: F.get("counts", k)
    split = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.least(at(i - 1)["move"], at(i)["move"]) + at(i)["shima"] + (at(i)["lshima"] * large).cast("long"))
    rows = cycles.select("stream_id", "cycle", split.alias("s"))
    s = lambda i: F.get("s", i)
    each = F.sequence(F.lit(1), F.lit(COVERED))
    ratio = F.transform(each, lambda i: (s(i) + base) * 2.0 / (s(i - 1) + s(i + 1) + 2.0 * base) - 1.0)
    weight = F.transform(each, lambda i: F.log2((s(i - 1) + s(i + 1)) / base + 1.0))
    rows = rows.select("stream_id", "cycle", F.zip_with(ratio, weight, lambda r, w: F.struct(r.alias("r"), w.alias("w"))).alias("f"))
    sets = patterns()
    ends = F.array(*[F.array(*map(F.lit, e)) for *_, e in sets])
    less = F.array(*[F.lit({"2224": less_2224, "30p": less_30p}.get(name, 0.0)) for name, *_ in sets])

    def total(value) -> Column:
        """The sum over fields of ``value(ends here, field)`` for every pattern."""
        return F.transform(ends, lambda e: F.aggregate(F.zip_with(e, F.col("f"), value), F.lit(0.0), lambda a, x: a + x))

    low = lambda e, f: F.when(e & (f["r"] < threshold), threshold - f["r"]).otherwise(0.0)
    count = F.transform(ends, lambda e: F.size(F.filter(e, lambda x: x)).cast("double"))
    score = F.zip_with(total(lambda e, f: F.when(e, f["r"]).otherwise(-f["r"])), less, lambda a, b: a - b)
    return rows.select(
        "stream_id", "cycle", score.alias("scores"),
        F.zip_with(total(lambda e, f: low(e, f) * f["w"]), count, lambda a, n: a / n).alias("costs"), F.zip_with(total(low), count, lambda a, n: a / n).alias("reliabilities"),
    )


class PulldownChoice(Fold):
    """The pattern of each cycle, which changes only when the best ones have led for long enough.

    While the pattern in force isn't the best of the cycle, its scores of the last ``span``
    cycles are set against the best ones; a gap above ``gap`` times ``span`` puts the best
    pattern in force, also for the cycles before that had it as their best, up to ``past``.
    So a cycle's row is final only ``past`` cycles later. The last cycle counts ``span``
    times more at the end.
    """

    reads = ("scores", "costs", "reliabilities")
    gives = "cycle long, pattern int, score double, cost double, reliability double"

    def __init__(self, span: int = 5, gap: float = 1.0, past: int = 180):
        self.span, self.gap, self.past = span, gap, past
        self.pattern, self.rows, self.best = 0, [], []  # rows: [cycle, numbers, pattern], the last ones; best: patterns, newest first

    def _judge(self, row) -> None:
        scores = [float(x) for x in row["scores"]]
        self.rows.append([row["cycle"], row, self.pattern])
        top = max(range(len(scores)), key=scores.__getitem__)
        self.best.insert(0, (top, scores[top]))
        if top != self.pattern:
            behind = sum(b - float(r["scores"][p]) for (_, b), (_, r, p) in zip(self.best[: self.span], reversed(self.rows)))
            if behind > self.gap * self.span:
                self.pattern = top
                for (p, _), kept in zip(self.best, reversed(self.rows)):
                    if p != top:
                        break
                    kept[2] = top
        del self.best[self.past :]

    def _out(self) -> dict:
        cycle, row, p = self.rows.pop(0)
        return {"cycle": cycle, "pattern": p, "score": float(row["scores"][p]), "cost": float(row["costs"][p]), "reliability": float(row["reliabilities"][p])}

    def push(self, row):
        self._judge(row)
        return [self._out()] if len(self.rows) > self.past + 1 else []

    def finish(self):
        last = self.rows[-1][1] if self.rows else None
        out, left = [], len(self.rows)
        for _ in range(self.span if last else 0):
            self._judge(last | {"cycle": None})
        while left:
            out.append(self._out())
            left -= 1
        return out


def mark_60p(cycles: DataFrame, low: float = 0.1, high: float = 3.0, sure: float = 0.2) -> DataFrame:
    """Adds ``is_60p``: cycles of a cost of ``low`` or more in a run that is taken for 60 frames a second.

    A cheap and reliable cycle ends a run. A run is taken for it if it is the stream's first
    or holds a cost of ``high`` or more.
    """
    w = Window.partitionBy("stream_id").orderBy("cycle")
    ends = ((F.col("cost") < low) & (F.col("reliability") < sure)).cast("int")
    rows = cycles.withColumn("_run", F.sum(ends).over(w))
    taken = (F.col("_run") == 0) | (F.max("cost").over(Window.partitionBy("stream_id", "_run")) >= high)
    return rows.withColumn("is_60p", (F.col("cost") >= low) & taken).drop("_run")


def classify(cycles: DataFrame, width: int, height: int, span: int = 5, gap: float = 1.0, past: int = 180, **scoring) -> DataFrame:
    """``stream_id, cycle, pattern, family, rotation, score, cost, reliability, is_60p`` of cycles with their field counts."""
    chosen = fold_streams(score_patterns(cycles, width, height, **scoring), lambda: PulldownChoice(span, gap, past), order=("cycle",))
    names = patterns()
    family, rotation = F.array(*[F.lit(n) for n, *_ in names]), F.array(*[F.lit(k) for _, k, _ in names])
    named = chosen.withColumns({"family": F.get(family, F.col("pattern")), "rotation": F.get(rotation, F.col("pattern"))})
    return mark_60p(named).select("stream_id", "cycle", "pattern", "family", "rotation", "score", "cost", "reliability", "is_60p")


def write_cycle_tsv(cycles: DataFrame, path: str) -> None:
    """A folder per stream with its cycles in order as tab-separated text with a header, one file each."""
    number = lambda c: F.format_string("%.6f", c)
    rows = cycles.repartition("stream_id").sortWithinPartitions("stream_id", "cycle")
    rows = rows.select("stream_id", "cycle", "pattern", "family", "rotation", F.col("is_60p").cast("int").alias("is60p"), *[number(F.col(c)).alias(c) for c in ("score", "cost", "reliability")])
    rows.write.mode("overwrite").partitionBy("stream_id").option("sep", "\t").option("header", True).csv(path)
