"""Order-dependent state over the frames of a stream, for what no window function can express.

A fold has the state of one stream: ``push`` takes a frame and gives the rows that
are final, ``finish`` the rest at the end of the stream. Streams are spread over the
cluster and their frames sorted by Spark, which spills; a task then passes over
its rows once and holds one fold and one Arrow batch, however long a stream is. One
stream is one task, as each state depends on the one before; streams that may be cut
at key frames are spread further by ``split_chunks`` and a chunk in ``by``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


#: Rows, and bytes of planes, that a task hands over at once.
BATCH_ROWS = 4096
BATCH_BYTES = 8 << 20


class Fold:
    """State of one stream. Subclasses take their parameters in ``__init__`` and must be picklable."""

    #: Columns that ``push`` reads from a frame.
    reads: Sequence[str] = ()
    #: Columns of the rows that it gives, as DDL.
    gives: str = ""

    def push(self, row: dict) -> list[dict]:
        raise NotImplementedError

    def finish(self) -> list[dict]:
        return []


def column_values(column: pa.Array) -> list:
    """A column's values; lists of numbers come as numpy arrays."""
    kind = column.type
    if not pa.types.is_list(kind) or not (pa.types.is_integer(kind.value_type) or pa.types.is_floating(kind.value_type)) or column.values.null_count:
        return column.to_pylist()
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    there = np.ones(len(column), bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], there)]


def fold_streams(frames: DataFrame, make: Callable[[], Fold], by: Sequence[str] = ("stream_id",), order: Sequence[str] = ("frame_id",)) -> DataFrame:
    """The rows of a fresh fold for each stream: the columns ``by`` and those that the fold gives."""
    probe = make()
    by, order = list(by), list(order)
    columns = list(dict.fromkeys([*by, *order, *probe.reads]))
    kinds = ", ".join(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{kinds}, {probe.gives}"
    empty = frames.sparkSession.createDataFrame([], schema)
    arrow = empty.toArrow().schema
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold, out, held = None, None, [], 0

        def batch() -> pa.RecordBatch:
            rows = {n: [r.get(n) for r in out] for n in names}
            out.clear()
            return pa.RecordBatch.from_pydict(rows, schema=arrow)

        def add(rows: list[dict]) -> int:
            out.extend(dict(zip(by, key)) | r for r in rows)
            return sum(v.nbytes for r in rows for v in r.values() if isinstance(v, np.ndarray))

        for rows in batches:
            for values in zip(*map(column_values, rows.columns)):
                row = dict(zip(columns, values))
                now = tuple(row[c] for c in by)
                if fold is None or now != key:
                    if fold is not None:
                        held += add(fold.finish())
                    key, fold = now, make()
                held += add(fold.push(row))
                if len(out) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield batch()
                    held = 0
        if fold is not None:
            add(fold.finish())
        if out:
            yield batch()

    return frames.select(*columns).repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
