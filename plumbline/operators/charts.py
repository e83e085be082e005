"""The rows behind each kind of chart."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import fixed_values as fixed
from plumbline.plans.scalars import one_row


def trend_rows(series: DataFrame, period: str, value: str) -> DataFrame:
    """G1: a series with its chart type: bars for a few periods, else a line."""
    # Read with its values, the series is counted from the shuffle that made it.
    facts = one_row(series.agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("top")))
    kind = F.when(facts["n"] <= fixed.FEW_PERIODS, "bar").otherwise("line")
    return series.select(F.col(period).alias("period"), F.col(value).alias("value"), kind.alias("chart_type"))


def top_and_other(
    rows: DataFrame, category: str, value: str, top: int = fixed.TOP_N, other: str = fixed.OTHER_LABEL
) -> DataFrame:
    """The largest categories and the rest summed as one; ties go by category.

    ``rows`` has one row per category. The top rows are cut inside each task, come in as one short
    array, and every other category folds into the rest before the shuffle.
    """
    ranked = (
        rows.select(F.col(category).alias("category"), F.col(value).alias("value"))
        .orderBy(F.col("value").desc_nulls_last(), F.col("category").asc_nulls_last())
        .limit(top)
    )
    best = one_row(ranked.agg(F.collect_list(F.struct("category")).alias("best")))["best"]
    kept = F.array_contains(best, F.struct(F.col(category).alias("category")))
    return (
        rows.withColumn("is_other", ~kept)
        .groupBy(
            F.when(kept, F.col(category).cast("string")).otherwise(other).alias("category"), "is_other"
        )
        .agg(F.sum(value).alias("value"), F.count(F.lit(1)).alias("categories"))
    )


def waterfall(change: DataFrame) -> DataFrame:
    """Baseline, change and current of a comparison as three steps."""
    return _rows(
        change,
        [
            (F.col("baseline_period"), F.col("baseline"), "absolute"),
            (F.lit("Change"), F.col("change"), "delta"),
            (F.col("current_period"), F.col("current"), "absolute"),
        ],
    )


def before_after(change: DataFrame) -> DataFrame:
    """Baseline and current of a comparison as two bars."""
    bars = [(F.col("baseline_period"), F.col("baseline"), ""), (F.col("current_period"), F.col("current"), "")]
    return _rows(change, bars).select("step", F.col("label").alias("period"), "value")


def _rows(df: DataFrame, rows: Sequence[tuple[Column, Column, str]]) -> DataFrame:
    steps = [
        F.struct(
            F.lit(i + 1).alias("step"),
            label.alias("label"),
            F.coalesce(value, F.lit(0.0)).alias("value"),
            F.lit(kind).alias("type"),
        )
        for i, (label, value, kind) in enumerate(rows)
    ]
    return df.select(F.explode(F.array(*steps)).alias("r")).select("r.*")


def composition(rows: DataFrame, category: str, value: str) -> DataFrame:
    """Absolute value and share per category; a pie for a few, else a stacked bar."""
    size = F.abs(F.col(value))
    facts = one_row(rows.agg(F.sum(size).alias("total"), F.count(F.lit(1)).alias("n")))
    kind = F.when(facts["n"] <= fixed.PIE_MAX_SEGMENTS, "pie").otherwise("stacked_bar")
    return rows.select(
        F.col(category).alias("category"),
        size.alias("value"),
        F.when(facts["total"] != 0, size / facts["total"]).alias("share"),
        kind.alias("chart_type"),
    )


def scatter_fit(df: DataFrame, x: str, y: str, keep: Sequence[str] = ()) -> DataFrame:
    """Points with the fitted value of the least-squares line through all of them."""
    line = one_row(
        df.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("base"))
    )
    return df.select(
        *keep,
        F.col(x).alias("x"),
        F.col(y).alias("y"),
        (line["base"] + line["slope"] * F.col(x)).alias("fitted"),
    )


def histogram(df: DataFrame, column: str, bins: int = fixed.MAX_BINS) -> DataFrame:
    """Rows per equal-width bin; the last bin is closed, a constant column has one bin."""
    value = F.col(f"`{column}`").cast("double")
    ends = one_row(df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    width = (ends["hi"] - ends["lo"]) / F.lit(float(bins))
    bin_of = F.when(width > 0, F.least(F.floor((value - ends["lo"]) / width) + 1, F.lit(bins))).otherwise(1)
    counted = df.where(value.isNotNull()).groupBy(bin_of.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    return counted.select(
        "bin",
        (ends["lo"] + (F.col("bin") - 1) * width).alias("bin_start"),
        (ends["lo"] + F.col("bin") * width).alias("bin_end"),
        "count",
    )


def series_cap(df: DataFrame, color: str) -> DataFrame:
    """How many series a colour field makes, and whether that is too many."""
    n = F.count_distinct(F.coalesce(F.col(f"`{color}`").cast("string"), F.lit("")))
    return df.agg(n.alias("series")).select(
        F.lit(color).alias("field"), "series", (F.col("series") > fixed.MAX_SERIES).alias("too_many")
    )


def labelled_fields(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Every numeric field of a record as a (label, value) row."""
    return df.select(*keys, *[F.col(f"`{f}`").cast("double").alias(f) for f in fields]).unpivot(
        list(keys), list(fields), "label", "value"
    )
