"""M1-M2: named metrics and the dates a table is anchored to."""

from __future__ import annotations

import re
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from plumbline import fixed_values as fixed
from plumbline.plans.predicates import quoted_columns, spark_expression


def resolve_metrics(
    columns: Sequence[str], pack: Mapping[str, Sequence[str]] = fixed.SALES_METRIC_PACK
) -> dict[str, str]:
    """M1: for each metric the first expression whose columns all exist, in the table's own case."""
    own = {c.lower(): c for c in columns}

    def renamed(sql: str) -> str:
        return re.sub('"([^"]*)"', lambda m: f'"{own[m[1].lower()]}"', sql)

    def usable(sql: str) -> bool:
        return {c.lower() for c in quoted_columns(sql)} <= own.keys()

    first = {name: next(filter(usable, choices), None) for name, choices in pack.items()}
    return {name: renamed(sql) for name, sql in first.items() if sql is not None}


def metric_table(df: DataFrame, definitions: Mapping[str, str]) -> DataFrame:
    """Every resolved metric with its expression and value, from one scan."""
    wide = df.agg(
        *[F.expr(spark_expression(sql)).cast("double").alias(m) for m, sql in definitions.items()]
    )
    rows = [
        F.struct(F.lit(m).alias("metric"), F.lit(sql).alias("expression"), F.col(f"`{m}`").alias("value"))
        for m, sql in definitions.items()
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def time_anchor(df: DataFrame, date_col: str) -> DataFrame:
    """M2: one row of anchor dates; no row when the column holds no date.

    The last complete month is the month before the last date's month, and likewise the quarter.
    """
    day = F.col(f"`{date_col}`").cast("date")
    ends = df.agg(F.min(day).alias("min_date"), F.max(day).alias("max_date")).where(
        F.col("max_date").isNotNull()
    )
    month, quarter = F.trunc("max_date", "month"), F.trunc("max_date", "quarter")
    return ends.select(
        "min_date",
        "max_date",
        F.add_months(month, -1).alias("last_complete_month_start"),
        F.date_sub(month, 1).alias("last_complete_month_end"),
        F.add_months(quarter, -3).alias("last_complete_quarter_start"),
        F.date_sub(quarter, 1).alias("last_complete_quarter_end"),
        (F.year("max_date") > F.year("min_date")).alias("data_spans_years"),
    )
