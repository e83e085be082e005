"""One-row results used inside other plans as scalar subqueries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def one_row(df: DataFrame) -> Column:
    """The single row of an ungrouped aggregate as a struct column.

    Spark evaluates it once, ahead of the stage that reads it, so no join is planned and
    nothing but that one row travels. Use only on results that have exactly one row.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).scalar()
