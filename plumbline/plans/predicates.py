"""M4-M8: metric expressions and row predicates as Catalyst columns."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce
from typing import Any, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.plans.spec import TimeWindow

_SQL_PIECE = re.compile(r"""'(?:[^']|'')*'|"([^"]+)\"""")


def spark_expression(sql: str) -> str:
    """Write double-quoted identifiers the way Spark SQL quotes them; string literals stay."""
    return _SQL_PIECE.sub(lambda m: f"`{m.group(1)}`" if m.group(1) else m.group(0), sql)


def quoted_columns(sql: str) -> list[str]:
    """The double-quoted column names of a metric expression, in order."""
    return [m.group(1) for m in _SQL_PIECE.finditer(sql) if m.group(1)]


def metric_column(metric: str, definitions: Mapping[str, str] | None = None) -> Column:
    """M4: the named metric's aggregate, else the sum of the column of that name."""
    sql = (definitions or {}).get(metric)
    return F.expr(spark_expression(sql)) if sql else F.sum(F.col(f"`{metric}`"))


def window_predicate(date_col: str | None, window: TimeWindow | None) -> Column | None:
    """M5: inclusive day window. A cast of the column to date is unwrapped and pushed to the scan."""
    if not date_col or window is None:
        return None
    day = F.col(f"`{date_col}`").cast("date")
    bounds = []
    if window.start:
        bounds.append(day >= F.lit(dt.date.fromisoformat(window.start)))
    if window.end:
        bounds.append(day <= F.lit(dt.date.fromisoformat(window.end)))
    return all_of(bounds)


def filter_predicate(df: DataFrame, filters: Mapping[str, Any] | None) -> Column | None:
    """M6: equality and IN filters, literals typed as the column they are compared with."""
    preds = []
    for name, wanted in (filters or {}).items():
        column = F.col(f"`{name}`")
        kind = df.schema[name].dataType
        if isinstance(wanted, (list, tuple, set)):
            preds.append(column.isin([F.lit(v).cast(kind) for v in wanted]))
        else:
            preds.append(column == F.lit(wanted).cast(kind))
    return all_of(preds)


def all_of(preds: list[Column | None]) -> Column | None:
    """AND of the predicates that exist; ``None`` when there are none."""
    present = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, present) if present else None


def matching_rows(
    df: DataFrame,
    filters: Mapping[str, Any] | None = None,
    date_col: str | None = None,
    window: TimeWindow | None = None,
) -> DataFrame:
    """M7: rows inside the window that satisfy every filter."""
    pred = all_of([window_predicate(date_col, window), filter_predicate(df, filters)])
    return df if pred is None else df.where(pred)
