"""Metrics, period comparison, contribution, volume/price, anomalies, insight tree."""

from __future__ import annotations

from itertools import combinations
from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline import fixed_values as fixed
from plumbline.plans.predicates import matching_rows, metric_column
from plumbline.plans.scalars import one_row
from plumbline.plans.spec import TimeWindow
from plumbline.plans.tagged import WINDOW, pivot_windows, tag_windows

Definitions = Mapping[str, str] | None
Filters = Mapping[str, Any] | None


def generic_metric(
    df: DataFrame,
    metric: str,
    definitions: Definitions = None,
    date_col: str | None = None,
    window: TimeWindow | None = None,
    filters: Filters = None,
) -> DataFrame:
    """A1: the metric and the number of rows behind it, in one pass."""
    return matching_rows(df, filters, date_col, window).agg(
        metric_column(metric, definitions).cast("double").alias("value"),
        F.count(F.lit(1)).alias("rows_used"),
    )


def change_pct(current: Column, baseline: Column) -> Column:
    """Percent change against the magnitude of the baseline; NULL when that is 0 or unknown."""
    return F.when(baseline != 0, (current - baseline) / F.abs(baseline) * 100)


def compare_periods(
    df: DataFrame,
    metric: str,
    date_col: str,
    current: TimeWindow,
    baseline: TimeWindow,
    definitions: Definitions = None,
    filters: Filters = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """A2: the metric in both windows and its change; one row, or one per ``by`` value."""
    measures = {
        "value": metric_column(metric, definitions).cast("double"),
        "rows": F.count(F.lit(1)),
    }
    wide = pivot_windows(tag_windows(df, date_col, current, baseline, filters), measures, by)
    now, then = F.col("value_current"), F.col("value_baseline")
    return wide.select(
        *by,
        now.alias("current"),
        then.alias("baseline"),
        (now - then).alias("change"),
        change_pct(now, then).alias("change_pct"),
        F.lit(current.text).alias("current_period"),
        F.lit(baseline.text).alias("baseline_period"),
        (F.coalesce("rows_current", F.lit(0)) + F.coalesce("rows_baseline", F.lit(0))).alias("rows_used"),
    )


def contribution(
    df: DataFrame,
    metric: str,
    date_col: str,
    current: TimeWindow,
    baseline: TimeWindow,
    dimension: str,
    definitions: Definitions = None,
    filters: Filters = None,
) -> DataFrame:
    """A3: what each segment adds to the change; a NULL segment is a segment.

    Totals are sums over the segments and come in as a one-row scalar, so a dimension with
    millions of values never gathers in one task. Not sorted: see :func:`ordered_segments`.
    """
    measures = {
        "value": metric_column(metric, definitions).cast("double"),
        "rows": F.count(F.lit(1)),
    }
    tagged = tag_windows(df, date_col, current, baseline, filters)
    wide = pivot_windows(tagged, measures, [F.col(f"`{dimension}`").alias("segment")])
    return with_contribution(
        wide.select(
            "segment",
            F.coalesce("value_current", F.lit(0.0)).alias("current"),
            F.coalesce("value_baseline", F.lit(0.0)).alias("baseline"),
            (F.coalesce("rows_current", F.lit(0)) + F.coalesce("rows_baseline", F.lit(0))).alias("rows_used"),
        )
    )


def with_contribution(segments: DataFrame) -> DataFrame:
    """Delta, baseline share and contribution of rows with ``current, baseline, rows_used``.

    The totals read all three columns, so that they come from the shuffle the segments use and
    the table is scanned once.
    """
    totals = one_row(segments.agg(*[F.sum(c).alias(c) for c in ("current", "baseline", "rows_used")]))
    delta = F.col("current") - F.col("baseline")
    moved = totals["current"] - totals["baseline"]
    return segments.select(
        *[c for c in segments.columns if c not in ("current", "baseline", "rows_used")],
        "current",
        "baseline",
        delta.alias("delta"),
        F.when(totals["baseline"] != 0, F.col("baseline") / totals["baseline"] * 100)
        .otherwise(0.0)
        .alias("baseline_share_pct"),
        F.when(moved != 0, delta / F.abs(moved) * 100).otherwise(0.0).alias("contribution_pct"),
        "rows_used",
    )


def ordered_segments(segments: DataFrame) -> DataFrame:
    """K1: segments by falling delta, the label breaking ties."""
    return segments.orderBy(F.col("delta").desc(), F.col("segment").asc_nulls_last())


def volume_price(
    df: DataFrame,
    date_col: str,
    current: TimeWindow,
    baseline: TimeWindow,
    definitions: Definitions = None,
    filters: Filters = None,
    revenue: str = "revenue",
    units: str = "units",
) -> DataFrame:
    """A4: split a revenue change into volume, price and the remaining mix."""
    measures = {
        "revenue": metric_column(revenue, definitions).cast("double"),
        "units": metric_column(units, definitions).cast("double"),
    }
    wide = pivot_windows(tag_windows(df, date_col, current, baseline, filters), measures)
    r1, r0, u1, u0 = (
        F.coalesce(F.col(c), F.lit(0.0))
        for c in ("revenue_current", "revenue_baseline", "units_current", "units_baseline")
    )
    p1, p0 = _price(r1, u1), _price(r0, u0)
    volume, price, moved = (u1 - u0) * p0, (p1 - p0) * u1, r1 - r0
    return wide.select(
        r1.alias("revenue_current"),
        u1.alias("units_current"),
        p1.alias("price_current"),
        r0.alias("revenue_baseline"),
        u0.alias("units_baseline"),
        p0.alias("price_baseline"),
        moved.alias("total_delta"),
        volume.alias("volume_effect"),
        price.alias("price_effect"),
        (moved - volume - price).alias("mix_effect"),
    )


def volume_price_by_segment(
    df: DataFrame,
    date_col: str,
    current: TimeWindow,
    baseline: TimeWindow,
    dimension: str,
    definitions: Definitions = None,
    filters: Filters = None,
    revenue: str = "revenue",
    units: str = "units",
) -> DataFrame:
    """A4 with a real mix term: units shifting between segments of different price."""
    measures = {
        "revenue": metric_column(revenue, definitions).cast("double"),
        "units": metric_column(units, definitions).cast("double"),
    }
    tagged = tag_windows(df, date_col, current, baseline, filters)
    segments = pivot_windows(tagged, measures, [F.col(f"`{dimension}`").alias("segment")]).select(
        *[
            F.coalesce(F.col(f"{m}_{w}"), F.lit(0.0)).alias(f"{m[0]}{i}")
            for m in measures
            for w, i in (("current", 1), ("baseline", 0))
        ]
    )
    units_now, units_then = F.sum("u1"), F.sum("u0")
    p1, p0 = _price(F.col("r1"), F.col("u1")), _price(F.col("r0"), F.col("u0"))
    # Sum over segments of (u1 - u0 * U1/U0) * p0, with the growth factor U1/U0 taken out of the sum.
    growth = F.when(units_then != 0, units_now / units_then).otherwise(0.0)
    then_at_base = F.sum(F.col("u0") * p0)
    return segments.agg(
        (F.sum("r1") - F.sum("r0")).alias("total_delta"),
        ((growth - 1) * then_at_base).alias("volume_effect"),
        F.sum((p1 - p0) * F.col("u1")).alias("price_effect"),
        (F.sum(F.col("u1") * p0) - growth * then_at_base).alias("mix_effect"),
    )


def _price(revenue: Column, units: Column) -> Column:
    return F.when(units != 0, revenue / units).otherwise(0.0)


def daily_values(
    df: DataFrame, metric: str, date_col: str, definitions: Definitions = None, filters: Filters = None
) -> DataFrame:
    """K4: the metric per calendar day. The result is as long as the calendar, whatever the rows."""
    return (
        matching_rows(df, filters)
        .groupBy(F.col(f"`{date_col}`").cast("date").alias("period_date"))
        .agg(
            metric_column(metric, definitions).cast("double").alias("value"),
            F.count(F.lit(1)).alias("rows_used"),
        )
    )


def anomaly_stats(daily: DataFrame) -> DataFrame:
    """A5: one row of spread statistics over a daily series (``period_date, value, rows_used``)."""
    return series_spread(daily).drop("rows_used")


def series_spread(daily: DataFrame) -> DataFrame:
    """One row: periods, rows, mean, deviation, quartiles and the bounds drawn from them."""
    quartiles = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))
    reach = F.lit(fixed.IQR_FACTOR) * F.col("iqr")
    return (
        daily.agg(
            F.count(F.lit(1)).alias("total_periods"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            quartiles.alias("q"),
            F.sum("rows_used").alias("rows_used"),
        )
        .select(
            "total_periods",
            "rows_used",
            "mean",
            "std",
            F.col("q")[0].alias("q1"),
            F.col("q")[1].alias("q3"),
            (F.col("q")[1] - F.col("q")[0]).alias("iqr"),
        )
        .withColumns({"iqr_lower": F.col("q1") - reach, "iqr_upper": F.col("q3") + reach})
    )


def anomalies(daily: DataFrame) -> DataFrame:
    """A5: days outside 1.5 IQR of the quartiles or more than 2.5 standard deviations out.

    The z rule is off where the deviation is unknown or 0 (one day, constant series). Statistics
    and days come from the same columns of the series, hence from one scan.
    """
    s = one_row(series_spread(daily))
    value = F.col("value")
    far = (s["std"] > 0) & (F.abs((value - s["mean"]) / s["std"]) > fixed.Z_THRESHOLD)
    return daily.where(
        (value < s["iqr_lower"]) | (value > s["iqr_upper"]) | F.coalesce(far, F.lit(False))
    )


def insight_tree(
    df: DataFrame,
    metric: str,
    date_col: str,
    current: TimeWindow,
    baseline: TimeWindow,
    dimensions: Sequence[str],
    definitions: Definitions = None,
    filters: Filters = None,
    top: int = 2,
) -> DataFrame:
    """The ``top`` segments that moved the metric most, for each dimension and each pair of them.

    Depth 1 splits by one dimension, depth 2 by two. All levels are grouping sets of one
    scan; each level keeps its ``top`` rows before they are shuffled for ranking.
    """
    dims = list(dimensions)
    sets = [list(s) for depth in (1, 2) for s in combinations(dims, depth)]
    tagged = tag_windows(df, date_col, current, baseline, filters)
    # The set without dimensions gives the totals, so they need no scan of their own.
    grouped = tagged.groupingSets(
        [[F.col(WINDOW), *[F.col(f"`{d}`") for d in s]] for s in [*sets, []]],
        F.col(WINDOW),
        *[F.col(f"`{d}`") for d in dims],
    ).agg(metric_column(metric, definitions).cast("double").alias("value"), F.grouping_id().alias("level"))
    moved = grouped.groupBy("level", *dims).agg(
        *[
            F.coalesce(F.max(F.when(F.col(WINDOW) == w, F.col("value"))), F.lit(0.0)).alias(w)
            for w in ("current", "baseline")
        ]
    )
    delta = F.col("current") - F.col("baseline")
    whole = F.col("level") == _level(dims, [])
    at_level = [F.col("level") == _level(dims, s) for s in sets]
    names = F.coalesce(*[F.when(at, F.lit(" / ".join(s))) for at, s in zip(at_level, sets)])
    depths = F.coalesce(*[F.when(at, F.lit(len(s))) for at, s in zip(at_level, sets)])
    order = W.partitionBy("level").orderBy(
        F.abs(F.col("delta")).desc(), *[F.col(f"`{d}`").asc_nulls_first() for d in dims]
    )
    best = (
        moved.withColumn("delta", delta)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= top)
    )
    # What is left has ``top`` rows per level, so the total can reach them over one small window.
    moved_total = F.max(F.when(whole, F.col("delta"))).over(W.partitionBy(F.lit(1)))
    return (
        best.withColumn("moved", moved_total)
        .where(~whole)
        .select(
            depths.alias("depth"),
            names.alias("split_by"),
            *dims,
            "place",
            "current",
            "baseline",
            "delta",
            F.when(F.col("moved") != 0, F.col("delta") / F.abs("moved") * 100)
            .otherwise(0.0)
            .alias("contribution_pct"),
        )
    )


def _level(dims: Sequence[str], kept: Sequence[str]) -> int:
    """The grouping_id of a set: a bit for every dimension that is rolled up, the last one lowest."""
    return sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in kept)


def insight_levels(
    df: DataFrame,
    metric: str,
    date_col: str,
    current: TimeWindow,
    baseline: TimeWindow,
    dimensions: Sequence[str],
    definitions: Definitions = None,
    filters: Filters = None,
    top: int = 2,
    depth: int = 2,
) -> DataFrame:
    """A7, level by level: the ``top`` segments of every dimension, then only those that moved the metric most are
    opened and split by the other dimensions, and so on.

    ``depth``, ``path`` (the opened segments, ``''`` at first), ``dimension``, ``segment``, ``place``, ``current``,
    ``baseline``, ``delta``, ``contribution_pct`` (of the whole change). Each level is one scan: a row is copied once
    for each opened segment it lies in and dimension left, at most ``top`` times the number of dimensions. Only the
    rows of the answer come to the driver.
    """
    dims = list(dimensions)
    tagged = tag_windows(df, date_col, current, baseline, filters)
    measured = metric_column(metric, definitions).cast("double")
    total = pivot_windows(tagged, {"value": measured}).select(
        F.coalesce("value_current", F.lit(0.0)) - F.coalesce("value_baseline", F.lit(0.0))
    ).first()
    moved = (total[0] if total else 0.0) or 0.0
    schema = (
        "depth int, path string, dimension string, segment string, place int, current double, baseline double, "
        "delta double, contribution_pct double"
    )
    found: list[tuple] = []
    opened: list[tuple[tuple[str, str | None], ...]] = [()]
    for level in range(1, depth + 1):
        entries = []
        for i, path in enumerate(opened):
            inside = F.lit(True)
            for d, segment in path:
                inside = inside & F.col(f"`{d}`").cast("string").eqNullSafe(F.lit(segment).cast("string"))
            left = [d for d in dims if d not in dict(path)]
            entries += [
                F.when(inside, F.struct(F.lit(i).alias("path"), F.lit(d).alias("dimension"), F.col(f"`{d}`").cast("string").alias("segment")))
                for d in left
            ]
        if not entries:
            break
        spread = tagged.withColumn("__e", F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())))
        by = [F.col(f"__e.{c}").alias(c) for c in ("path", "dimension", "segment")]
        sums = pivot_windows(spread, {"value": measured}, by).select(
            "path", "dimension", "segment",
            *[F.coalesce(f"value_{w}", F.lit(0.0)).alias(w) for w in ("current", "baseline")],
        ).withColumn("delta", F.col("current") - F.col("baseline"))
        order = W.partitionBy("path", "dimension").orderBy(F.abs("delta").desc(), F.col("segment").asc_nulls_first())
        rows = sums.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).collect()
        rows.sort(key=lambda r: (-abs(r["delta"]), r["path"], dims.index(r["dimension"]), r["place"]))
        for r in rows:
            path = " / ".join(f"{d}={'' if v is None else v}" for d, v in opened[r["path"]])
            share = r["delta"] / abs(moved) * 100 if moved else 0.0
            found.append((level, path, r["dimension"], r["segment"], r["place"], r["current"], r["baseline"], r["delta"], share))
        opened = [(*opened[r["path"]], (r["dimension"], r["segment"])) for r in rows[:top]]
    return df.sparkSession.createDataFrame(found, schema)
