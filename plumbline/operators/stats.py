"""Guards that say whether a result can be trusted."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from plumbline import fixed_values as fixed
from plumbline.operators.analysis import Definitions, generic_metric
from plumbline.plans.predicates import metric_column, quoted_columns
from plumbline.plans.scalars import one_row
from plumbline.plans.selection import (
    RankTarget,
    cumulative_counts,
    exact_quantiles,
    null_safe_join,
    lookup,
    select_ranks,
)
from plumbline.plans.spec import AnalysisSpec


def benjamini_hochberg(
    df: DataFrame,
    p: str,
    family: Sequence[str],
    hypothesis: str,
    alpha: float = fixed.FDR_ALPHA,
    variant: str = "step_up",
) -> DataFrame:
    """``rejected`` per hypothesis, false discovery rate controlled within each family.

    ``step_up`` rejects every p up to the largest one under its own threshold. ``trailing``
    rejects only the unbroken run of passing p-values at the top of the ranking; equal p-values
    are ranked by ``hypothesis``, or by its hash if it is not a number. A NULL p-value is no test: it takes no rank and is not rejected.
    """
    keys = list(family)
    ranked = cumulative_counts(df, keys, p)

    def threshold(rank: Column) -> Column:
        return rank / F.col("family_rows") * F.lit(alpha)

    if variant == "step_up":
        # Equal p-values share the rank of the last of them.
        limits = ranked.where(F.col(p) <= threshold(F.col("rows_through"))).groupBy(*keys).agg(
            F.max(p).alias("__limit")
        )
        rows = lookup(df, limits, keys)
        return rows.withColumn(
            "rejected", F.coalesce(F.col(p) <= F.col("__limit"), F.lit(False))
        ).drop("__limit")
    if variant != "trailing":
        raise ValueError(f"unknown variant {variant!r}")

    # The ranks of one value run from rows_before + 1 to rows_through; the lower ones fail first.
    guess = F.ceil(F.col(p) / F.lit(alpha) * F.col("family_rows"))
    first_pass = (
        F.when(F.col(p) <= threshold(guess - 1), guess - 1)
        .when(F.col(p) <= threshold(guess), guess)
        .otherwise(guess + 1)
    )
    last_fail = F.least(F.col("rows_through"), first_pass - 1)
    fails = ranked.where(F.col(p) > threshold(F.col("rows_before") + 1))
    edge = fails.groupBy(*keys).agg(
        F.max_by(F.struct(F.col(p).alias("p"), (last_fail - F.col("rows_before")).alias("within")), p).alias("e")
    ).select(*keys, F.col("e.p").alias("__edge"), F.col("e.within").alias("__within"))
    numeric = isinstance(df.schema[hypothesis].dataType, T.NumericType)
    place = F.col(f"`{hypothesis}`") if numeric else F.xxhash64(F.col(f"`{hypothesis}`"))
    rows = lookup(df, edge, keys).withColumn("__id", place)
    # Only hypotheses that share the edge value are ranked among themselves.
    tied = cumulative_counts(rows.where(F.col(p) == F.col("__edge")), keys, "__id").select(
        *keys, "__id", F.col("rows_through").alias("__place")
    )
    return (
        null_safe_join(rows, tied, [*keys, "__id"], "left")
        .withColumn(
            "rejected",
            F.when(F.col(p).isNull(), F.lit(False))
            .when(F.col("__edge").isNull(), F.lit(True))
            .when(F.col(p) == F.col("__edge"), F.col("__place") > F.col("__within"))
            .otherwise(F.col(p) > F.col("__edge")),
        )
        .drop("__edge", "__within", "__place", "__id")
    )


def trend_class(series: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """``flat``, ``increasing``, ``decreasing`` or ``unknown`` per series, with its slope.

    A series is one value per period, so a window over it is as long as the calendar.
    """
    place = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    return (
        series.withColumn("__x", place.cast("double"))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("periods"),
            F.regr_slope(value, "__x").alias("slope"),
            F.stddev_pop(value).alias("spread"),
            F.count_if(F.col(value).isNull()).alias("__gaps"),
        )
        .withColumn("trend", trend_of(F.col("slope"), F.col("spread"), F.col("periods"), F.col("__gaps")))
        .drop("__gaps")
    )


def trend_of(slope: Column, spread: Column, periods: Column, gaps: Column) -> Column:
    return (
        F.when(periods < 2, "flat")
        .when(gaps > 0, "unknown")
        .when(spread == 0, "flat")
        .when(F.abs(slope) / spread < fixed.FLAT_SLOPE_RATIO, "flat")
        .when(slope > 0, "increasing")
        .otherwise("decreasing")
    )


def simpsons_paradox(
    df: DataFrame, metric: str, dimension: str, date_col: str, definitions: Definitions = None
) -> DataFrame:
    """Does the overall monthly trend differ from the trend most segments show?"""
    trends = trends_by_level(df, metric, dimension, date_col, definitions)
    votes = trends.groupBy("whole", "trend").agg(
        F.count("segment").alias("n"), F.min("segment").alias("first_segment")
    )
    of_segments = (F.col("whole") == 0) & (F.col("n") > 0)
    ballot = F.when(of_segments, F.struct(-F.col("n"), F.col("first_segment")))
    detected = (F.col("majority_trend") != F.col("overall_trend")) & (F.col("overall_trend") != "flat")
    return (
        votes.agg(
            F.max(F.when(F.col("whole") == 1, F.col("trend"))).alias("overall_trend"),
            F.min_by("trend", ballot).alias("majority_trend"),
            F.max(F.when(of_segments, F.col("n"))).alias("majority_segments"),
            F.sum(F.when(of_segments, F.col("n"))).alias("segments"),
        )
        .withColumn("detected", F.coalesce(detected, F.lit(False)))
        .withColumn(
            "description",
            F.when(
                F.col("detected"),
                F.format_string(
                    f"Potential Simpson's paradox: overall {metric} is %s, but most segments show "
                    "%s trend. Segment composition may be driving the aggregate result.",
                    "overall_trend",
                    "majority_trend",
                ),
            ).otherwise(""),
        )
        .select("detected", "overall_trend", "majority_trend", "majority_segments", "segments", "description")
    )


def trends_by_level(
    df: DataFrame, metric: str, dimension: str, date_col: str, definitions: Definitions = None
) -> DataFrame:
    """Monthly trend of the whole table (``whole`` = 1) and of each segment, from one scan."""
    month = F.date_trunc("month", F.col(f"`{date_col}`").cast("timestamp_ntz")).cast("date")
    rows = df.withColumns({"segment": F.col(f"`{dimension}`"), "period": month})
    monthly = rows.groupingSets(
        [[F.col("period")], [F.col("period"), F.col("segment")]], F.col("period"), F.col("segment")
    ).agg(
        metric_column(metric, definitions).cast("double").alias("value"),
        F.grouping("segment").cast("int").alias("whole"),
    )
    return trend_class(monthly, ["whole", "segment"], "period", "value")


def stability(daily: DataFrame) -> DataFrame:
    """T4: do the means of the two halves of a daily series lie within 20 %?"""
    numbered = daily.select(
        "value",
        F.row_number().over(W.orderBy("period_date")).alias("place"),
    )
    n = one_row(daily.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")))["n"]
    middle = F.floor(n / 2)
    first = F.avg(F.when(F.col("place") <= middle, F.col("value")))
    second = F.avg(F.when(F.col("place") > middle, F.col("value")))
    size = (F.abs(F.col("first_half")) + F.abs(F.col("second_half"))) / 2
    differs = F.abs(F.col("first_half") - F.col("second_half")) / size * 100 >= fixed.STABLE_PCT
    enough = F.col("periods") >= fixed.STABLE_MIN_PERIODS
    return (
        numbered.agg(
            F.count(F.lit(1)).alias("periods"), first.alias("first_half"), second.alias("second_half")
        )
        .withColumn("stable", ~(enough & (size != 0) & F.coalesce(differs, F.lit(True))))
        .select(
            "stable",
            F.when(enough, F.col("first_half")).alias("first_half"),
            F.when(enough, F.col("second_half")).alias("second_half"),
            F.when(~enough, "Insufficient periods").alias("note"),
        )
    )


def group_size(
    df: DataFrame,
    dimension: str,
    min_rows: int = fixed.GROUP_MIN_ROWS,
    min_share: float = fixed.GROUP_MIN_SHARE,
) -> DataFrame:
    """T5: groups large enough to report on, and why the others are not. NULL is no group."""
    groups = df.groupBy(F.col(f"`{dimension}`").alias("group")).agg(F.count(F.lit(1)).alias("row_count"))
    total = one_row(groups.agg(F.sum("row_count").alias("n")))["n"]
    return (
        # Asked of the counted groups, so that the total can use the same shuffle.
        groups.where(F.when(F.col("group").isNotNull(), F.col("row_count")) > 0)
        .withColumn("share", F.col("row_count") / total)
        .withColumn(
            "reason",
            F.when(F.col("row_count") < min_rows, "below min_rows").when(
                F.col("share") < min_share, "below min_share"
            ),
        )
        .withColumn("passed", F.col("reason").isNull())
    )


def outlier_sensitivity(
    df: DataFrame,
    metric: str,
    definitions: Definitions = None,
    raw_col: str | None = None,
    top_pct: float = fixed.OUTLIER_TOP_PCT,
    variant: str = "top",
) -> DataFrame:
    """The metric with all rows and without the outlying top of ``raw_col``.

    ``top`` leaves out rows above the (1 - top_pct) quantile. ``lowest`` cuts at the value
    ``n * (1 - top_pct)`` places from the top, which keeps only the lowest rows.
    """
    if variant not in ("top", "lowest"):
        raise ValueError(f"unknown variant {variant!r}")
    named = quoted_columns((definitions or {}).get(metric, f'"{metric}"'))
    column = raw_col or (named[0] if named else None)
    full = metric_column(metric, definitions).cast("double")
    threshold = None
    if column is not None and variant == "top":
        threshold = exact_quantiles(df, [("cut", column, 1 - top_pct)])["cut"]
    elif column is not None:
        offset = max(1, int(df.count() * (1 - top_pct)))
        threshold = kth_largest_value(df, column, offset)
    if threshold is None:
        both = df.agg(full.alias("with_outliers"), full.alias("without_outliers"))
    else:
        # A row is in the full set always, and in the reduced set when it is not an outlier.
        kept = F.col(f"`{column}`").cast("double") <= threshold
        tagged = df.withColumn("__set", F.explode(F.array(F.lit("all"), F.when(kept, "kept"))))
        sets = tagged.where(F.col("__set").isNotNull()).groupBy("__set").agg(full.alias("value"))
        both = sets.agg(
            *[
                F.max(F.when(F.col("__set") == s, F.col("value"))).alias(name)
                for s, name in (("all", "with_outliers"), ("kept", "without_outliers"))
            ]
        )
    a, b = F.col("with_outliers"), F.col("without_outliers")
    pct = F.coalesce(F.when(a != 0, F.abs(a - b) / F.abs(a) * 100), F.lit(0.0))
    return both.select(
        a,
        b,
        (pct > fixed.OUTLIER_SENSITIVE_PCT).alias("sensitive"),
        F.round(pct, 2).alias("difference_pct"),
    )


def kth_largest_value(df: DataFrame, column: str, offset: int) -> float | None:
    """K3: the value ``offset`` places below the largest (0 is the largest), or ``None``."""
    found = select_ranks(
        df, [RankTarget("kth", column, lambda n: n - 1 - offset, lambda n: n - 1 - offset)]
    )
    return found["kth"][1] if "kth" in found and found["kth"][0] > offset else None


def spec_agreement(
    df: DataFrame, spec_a: AnalysisSpec, spec_b: AnalysisSpec, definitions: Definitions = None
) -> DataFrame:
    """Do two readings of the same question agree within 10 %?"""
    a, b = (
        one_row(
            generic_metric(df, s.metric, definitions, s.date_col, s.current, s.filters).select("value")
        )["value"]
        for s in (spec_a, spec_b)
    )
    size = (F.abs(F.col("result_a")) + F.abs(F.col("result_b"))) / 2
    known = F.col("result_a").isNotNull() & F.col("result_b").isNotNull()
    return (
        df.sparkSession.range(1)
        .select(a.alias("result_a"), b.alias("result_b"))
        .withColumn(
            "divergence",
            F.when(known, F.when(size != 0, F.abs(F.col("result_a") - F.col("result_b")) / size * 100).otherwise(0.0)),
        )
        .select(
            F.coalesce(F.col("divergence") < fixed.AGREEMENT_PCT, F.lit(False)).alias("agrees"),
            "result_a",
            "result_b",
            F.round("divergence", 2).alias("divergence_pct"),
        )
    )
