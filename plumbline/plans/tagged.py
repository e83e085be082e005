"""Two time windows measured in one scan."""

from __future__ import annotations

from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.plans.predicates import all_of, filter_predicate, window_predicate
from plumbline.plans.spec import TimeWindow

WINDOW = "__window"


def tag_windows(
    df: DataFrame,
    date_col: str,
    current: TimeWindow,
    baseline: TimeWindow,
    filters: Mapping[str, Any] | None = None,
) -> DataFrame:
    """One output row per (input row, window holding it); rows in neither window are not read.

    Overlapping windows are allowed: a row in both is emitted twice. Windows without a common day,
    the usual case, only add a column.
    """
    in_current = window_predicate(date_col, current)
    in_baseline = window_predicate(date_col, baseline)
    either = None if in_current is None or in_baseline is None else in_current | in_baseline
    pred = all_of([either, filter_predicate(df, filters)])
    rows = df if pred is None else df.where(pred)
    now = F.lit("current") if in_current is None else F.when(in_current, "current")
    then = F.lit("baseline") if in_baseline is None else F.when(in_baseline, "baseline")
    if disjoint(current, baseline):
        return rows.withColumn(WINDOW, F.coalesce(now, then))
    return rows.withColumn(WINDOW, F.explode(F.array(now, then))).where(F.col(WINDOW).isNotNull())


def disjoint(a: TimeWindow, b: TimeWindow) -> bool:
    """No day lies in both windows."""
    return bool((a.end and b.start and a.end < b.start) or (b.end and a.start and b.end < a.start))


def pivot_windows(
    tagged: DataFrame, metrics: Mapping[str, Column], by: Sequence[str | Column] = ()
) -> DataFrame:
    """Aggregate each window, then lay ``<metric>_current`` and ``<metric>_baseline`` side by side.

    Any aggregate works (ratios, distinct counts): the metric is evaluated per window, and only
    the aggregated rows are regrouped.
    """
    per_window = tagged.groupBy(WINDOW, *by).agg(*[c.alias(m) for m, c in metrics.items()])
    keys = [c for c in per_window.columns if c != WINDOW and c not in metrics]
    return per_window.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        *[
            F.max(F.when(F.col(WINDOW) == tag, F.col(f"`{m}`"))).alias(f"{m}_{tag}")
            for m in metrics
            for tag in ("current", "baseline")
        ]
    )
