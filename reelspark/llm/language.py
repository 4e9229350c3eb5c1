"""Language identification by prediction with partial matching over bytes.

Each language has a tree of byte contexts up to ``order`` bytes. A byte seen in a
context costs ``-log2(n / (t + d))`` (n: its count, t: all counts, d: distinct bytes);
one not seen there costs the escape ``-log2(d / (t + d))`` and then its price in the
context that is a byte shorter, down to a uniform price. The counts are frozen after
training. The language whose trees give the shortest code wins.

The trees are learnt from a bounded number of labelled rows (``docs_per_lang``), so
they stay of bounded size and every task holds them as flat price tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm._bytes import LOWER, chunks

#: Rows per language that training takes, as an expected number.
DOCS_PER_LANG = 1500
_ORDER = 3


@dataclass
class PriceTables:
    """Prices in bits of every byte in every context, one column per language."""

    langs: list[str]
    symbol: np.ndarray  # byte -> symbol, 0 for bytes not seen in training
    size: int  # symbols
    node: np.ndarray  # three symbols -> row of ``deep``, 0 if no language has that context
    deep: np.ndarray  # (rows, size, langs): after three symbols
    shallow: np.ndarray  # (size**2, size, langs): after two


def _code_counts(order: int):
    """Counts of the (order + 1)-byte strings of each language in a partition; text starts after ``order`` line feeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out():
            for lang, (codes, counts) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])

        for rows, data, offsets in chunks(batches, "text"):
            langs = np.array(rows.column("lang").to_pylist(), object)
            codes, first = _codes(data, offsets, order)
            row = np.searchsorted(first, np.arange(len(codes)), "right") - 1
            for lang in set(langs):
                found, n = np.unique(codes[(langs == lang)[row]], return_counts=True)
                if lang in held:
                    both = np.concatenate([held[lang][0], found])
                    found, back = np.unique(both, return_inverse=True)
                    n = np.bincount(back, np.concatenate([held[lang][1], n])).astype(np.int64)
                held[lang] = found, n
        yield from out()

    return run


def _codes(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte, it and the ``order`` bytes before it in its row as one integer; and the rows' offsets."""
    low = LOWER[data].astype(np.int64)
    code = low.copy()
    row_start = np.repeat(offsets[:-1], np.diff(offsets))
    place = np.arange(len(data)) - row_start
    for back in range(1, order + 1):
        before = np.full(len(data), 10, np.int64)
        before[back:] = low[:-back] if back < len(data) else low[:0]
        before[place < back] = 10
        code |= before << (8 * back)
    return code, offsets[:-1]


def _prices(langs: list[str], rows: list[tuple[str, int, int]]) -> PriceTables:
    code = np.array([r[1] for r in rows], np.int64)
    count = np.array([r[2] for r in rows], np.float64)
    lang = np.array([langs.index(r[0]) for r in rows])
    seen = np.unique(np.concatenate([(code >> (8 * k)) & 255 for k in range(4)]))
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, len(seen) + 1)
    size = len(seen) + 1
    part = [symbol[(code >> (8 * k)) & 255] for k in range(4)]  # part[0]: the byte itself
    prices = np.full((1, size, len(langs)), np.log2(257.0))
    for depth in range(_ORDER + 1):
        context = np.zeros(len(code), np.int64)
        for k in range(depth, 0, -1):
            context = context * size + part[k]
        if depth < _ORDER:
            shape = size**depth
            row = context
        else:
            ids = np.unique(context)
            node = np.zeros(size**3, np.int32)
            node[ids] = np.arange(1, len(ids) + 1)
            shape, row = len(ids) + 1, node[context]
        n = np.bincount((row * size + part[0]) * len(langs) + lang, count, shape * size * len(langs)).reshape(shape, size, len(langs))
        total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
        if depth == 0:
            lower = prices
        elif depth < _ORDER:
            lower = np.tile(prices, (size, 1, 1))  # the context without its first symbol
        else:
            lower = np.zeros((shape, size, len(langs)))
            lower[1:] = prices[ids % size**2]
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            own = -np.log2(n / (total + kinds))
        now = np.where(n > 0, own, lower + escape)
        if depth == 2:
            shallow = now
        prices = now
    return PriceTables(langs, symbol, size, node, prices.astype(np.float32), shallow.astype(np.float32))


def train(docs: DataFrame, lang_col: str, text_col: str, docs_per_lang: int = DOCS_PER_LANG) -> PriceTables | None:
    """Learns from rows with a language and a text; None if there are none.

    Of a language with more than ``docs_per_lang`` rows, that many are expected to be
    taken, by a hash of the text, each with its whole text.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(docs_per_lang / n)).otherwise(share)
    chosen = rows.where(F.crc32(F.col("text")) / F.lit(2.0**32) < share)
    counts = chosen.mapInArrow(_code_counts(_ORDER), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    got = [(r.lang, r.code, r.n) for r in counts.collect()]
    return _prices(sorted({r[0] for r in got}), sorted(got)) if got else None


def _score(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: PriceTables = tables.value
        two = t.size**2
        for rows, data, offsets in chunks(batches, "text"):
            lettered = rows.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            sym = t.symbol[LOWER[data]]
            first = t.symbol[10]
            place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
            before = []
            for back in (1, 2, 3):
                b = np.full(len(data), first, np.int64)
                b[back:] = sym[:-back] if back < len(data) else sym[:0]
                b[place < back] = first
                before.append(b)
            pair = before[1] * t.size + before[0]
            node = t.node[before[2] * two + pair]
            bits = t.deep.reshape(-1, len(t.langs))[node.astype(np.int64) * t.size + sym]
            lost = np.flatnonzero(node == 0)
            bits[lost] = t.shallow.reshape(-1, len(t.langs))[pair[lost] * t.size + sym[lost]]
            sums = np.zeros((len(data) + 1, len(t.langs)))
            np.cumsum(bits, 0, dtype=np.float64, out=sums[1:])
            length = sums[offsets[1:]] - sums[offsets[:-1]]
            best = length.argmin(1)
            size = np.maximum(1, np.diff(offsets))[:, None]
            odds = np.exp2(-(length - length.min(1, keepdims=True)) / np.sqrt(size))
            score = 1 / odds.sum(1)
            pred = [t.langs[k] if ok else "und" for k, ok in zip(best, lettered)]
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(pred, pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(np.where(lettered, length.min(1), 0.0))], names=["id", "lang_pred", "score", "bits"])

    return run


def identify(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """Returns ``id, lang_pred, score, bits`` per row of ``docs``; its language column is not read.

    A null or empty text, and one without a letter, gives ``und``, as does everything
    if there is nothing to learn from. The first language in order wins a tie. The
    score sets the code lengths against each other, damped by the text's length. Texts of
    any length are read whole. Each row is judged for itself, so repeated rows get equal
    results and ids may be null or repeated; an empty table gives none. Rows to learn
    from that are equal count as often as they stand there. Other columns are ignored.
    """
    spark = docs.sparkSession
    model = train(training, lang_col, text_col, docs_per_lang)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("lettered", has_letter(F.col("text")))
    if model is None:
        return rows.select("id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"))
    return rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), "id long, lang_pred string, score double, bits double")


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")
