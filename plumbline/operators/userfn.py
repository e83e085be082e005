"""The user's own Python over a table or its groups, one Arrow batch at a time."""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

SALTS = 64
MERGE_ROWS = 50_000
Function = Callable[[pd.DataFrame], pd.DataFrame]


def map_function(df: DataFrame, function: Function, schema: str) -> DataFrame:
    """Apply ``function`` to every batch of rows; its rows are the result."""

    def over_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(over_batches, schema)


def grouped_function(
    df: DataFrame, keys: Sequence[str], partial: Function, merge: Function, schema: str
) -> DataFrame:
    """Summarise every group in Python without ever holding a group in memory.

    ``partial`` turns a batch of rows into one row per key seen in it. ``merge`` folds rows of
    ``schema`` to one row per key and must be associative. Rows are folded where they are read,
    then per key and salt, so that the rows of a key holding a third of the table are spread over
    many tasks, and last per key, where at most one row per salt is left.
    """
    names = list(keys)

    def folded(batches: Iterator[pd.DataFrame], prepare: Function) -> Iterator[pd.DataFrame]:
        kept, waiting, rows = None, [], 0
        for batch in batches:
            waiting.append(prepare(batch))
            rows += len(waiting[-1])
            # Merging only when as many rows wait as are kept keeps the work linear.
            if rows >= max(MERGE_ROWS, 0 if kept is None else len(kept)):
                kept = merge(pd.concat(waiting if kept is None else [kept, *waiting], ignore_index=True))
                waiting, rows = [], 0
        if waiting:
            kept = merge(pd.concat(waiting if kept is None else [kept, *waiting], ignore_index=True))
        if kept is not None:
            yield kept

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return folded(batches, partial)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return folded(batches, lambda batch: batch)

    parts = df.mapInPandas(read, schema)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in parts.columns]), F.lit(SALTS))
    first = parts.repartition(*names, salt).mapInPandas(fold, schema)
    return first.repartition(*names).mapInPandas(fold, schema)
