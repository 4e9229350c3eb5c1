"""Functions of the user's own over samples and over planes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import pandas_udf

from reelspark.operators.plane_map import map_planes


def sample_kernel(f: Callable[[np.ndarray], np.ndarray], kind: str = "int") -> Callable[[Column], Column]:
    """A function on a plane column from ``f``, which maps an array of samples to as many samples of ``kind``.

    ``f`` is called once for all planes of an Arrow batch and sees no order or shape. A null
    plane stays null.
    """

    def run(planes: pd.Series) -> pd.Series:
        there = planes.notna().to_numpy()
        arrays = [np.asarray(p) for p in planes[there]]
        sizes = [len(p) for p in arrays]
        made = f(np.concatenate(arrays)) if arrays else np.zeros(0)
        if len(made) != sum(sizes):
            raise ValueError("the function must give a sample for each sample")
        out = pd.Series([None] * len(planes), dtype=object)
        for at, part in zip(np.flatnonzero(there), np.split(made, np.cumsum(sizes)[:-1]) if arrays else []):
            out.iat[at] = part
        return out

    return pandas_udf(run, f"array<{kind}>")


def shade(frames: DataFrame, width: int, f: Callable[..., np.ndarray], planes: tuple[str, ...] = ("plane",), kind: str = "int") -> DataFrame:
    """``stream_id, frame_id, plane`` by ``f(x, y, *planes)``, called once a frame.

    ``x`` and ``y`` are the samples' places from 0 to 1 (their middles), a row and a column
    that numpy spreads; the planes are arrays of rows. What ``f`` gives has their shape.
    """

    def work(*arrays: np.ndarray) -> dict:
        height = len(arrays[0])
        x, y = (np.arange(width)[None, :] + 0.5) / width, (np.arange(height)[:, None] + 0.5) / height
        made = np.asarray(f(x, y, *arrays))
        if made.shape != arrays[0].shape:
            raise ValueError("the function must give a plane of the same shape")
        return {"plane": made.astype(np.int32) if kind == "int" else made.astype(float)}

    return map_planes(frames, planes, work, f"plane array<{kind}>", width)
