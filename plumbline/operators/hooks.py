"""Where models enter: batches of frames in, arrays out, behind a fixed schema.

A hook is a function from a pandas frame of a window's rows, in order, to a frame of the
output's columns. It is called with whole windows of a fixed length, so memory is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_windows(df: DataFrame, by: list[str], at: str, hook: Callable[[pd.DataFrame], pd.DataFrame], schema: str, length: int = 16, together: int = 64) -> DataFrame:
    """hook over each window of length rows of a sequence; the last is padded with its last row, and cut again.

    A task gets so many windows of a sequence together, one after another.
    """
    rows = df.withColumn("__w", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(at)) - 1) / length))
    rows = rows.withColumn("__g", F.floor(F.col("__w") / together))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        made = []
        for _, window in group.sort_values(at).drop(columns="__g").groupby("__w", sort=True):
            window = window.drop(columns="__w")
            n = len(window)
            padded = pd.concat([window, *[window.iloc[-1:]] * (length - n)], ignore_index=True)
            made.append(hook(padded).iloc[:n])
        return pd.concat(made, ignore_index=True)

    return rows.groupBy(*by, "__g").applyInPandas(run, schema)


def over_batches(df: DataFrame, hook: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """hook over Arrow batches in no order, for models that see a row at a time."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            yield hook(batch)

    return df.mapInPandas(run, schema)


def encode_rle(mask: np.ndarray) -> list[int]:
    """Run lengths of a mask column by column, first the run of zeros."""
    flat = np.asarray(mask, bool).ravel(order="F")
    ends = np.flatnonzero(np.diff(flat)) + 1
    runs = np.diff(np.concatenate([[0], ends, [len(flat)]])).tolist()
    return ([0] if len(flat) and flat[0] else []) + runs


def decode_rle(runs: list[int], height: int, width: int) -> np.ndarray:
    flat = np.repeat(np.arange(len(runs)) % 2 == 1, runs)
    return flat.reshape((height, width), order="F")
