"""The folds on unbounded streams: the same state classes under Structured Streaming."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelspark.operators.fold import Fold


def fold_stream(frames: DataFrame, make: Callable[[], Fold], key: str = "stream_id", order: str = "frame_id", idle_ms: int = 0) -> DataFrame:
    """``fold_streams`` for a streaming DataFrame; rows come out as soon as they are final.

    Frames of a stream are taken in the order of their micro-batches and, within one,
    of ``order``. With ``idle_ms`` a stream without frames for so long is ended: what its
    fold still holds comes out and its state goes. Without, an unfinished tail waits.
    """
    probe = make()
    schema = f"`{key}` {frames.schema[key].dataType.simpleString()}, {probe.gives}"
    names = [key, *[part.split()[0] for part in _columns(probe.gives)]]
    columns = list(dict.fromkeys([key, order, *probe.reads]))

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = pickle.loads(state.get[0]) if state.exists else make()
        if state.hasTimedOut:
            out = fold.finish()
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(order, kind="stable").astype(object)
            rows = rows.where(rows.notna(), None)
            out = [r for row in rows.to_dict("records") for r in fold.push(row)]
            state.update((pickle.dumps(fold),))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame([{key: group[0]} | r for r in out], columns=names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return frames.select(*columns).groupBy(key).applyInPandasWithState(run, schema, "fold binary", "append", timeout)


def _columns(ddl: str) -> list[str]:
    """The column definitions of a DDL string, which has no nested struct."""
    return [part.strip() for part in ddl.split(",")]
