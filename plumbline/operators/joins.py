"""What a join would do to keys, rows and measures, without running it."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline import fixed_values as fixed


def key_overlap(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, measures: Sequence[str] = ()
) -> DataFrame:
    """Both sides folded to one row per key and matched: the input of every check below.

    A key holding a third of either table is a single row here, and the fan-out of a join is the
    product of two counts instead of that many rows.
    """
    lefts = left.groupBy(F.col(f"`{left_key}`").alias("lk")).agg(
        F.count(F.lit(1)).alias("left_rows"),
        *[F.sum(F.col(f"`{m}`").cast("double")).alias(f"sum_{i}") for i, m in enumerate(measures)],
    )
    rights = right.groupBy(F.col(f"`{right_key}`").alias("rk")).agg(F.count(F.lit(1)).alias("right_rows"))
    return lefts.join(rights, _same_key(lefts.schema["lk"].dataType, rights.schema["rk"].dataType), "full")


def _same_key(left: T.DataType, right: T.DataType) -> Column:
    """Keys of one type, or both numbers, as they are; all others by their text, which never fails."""
    alike = left == right or (isinstance(left, T.NumericType) and isinstance(right, T.NumericType))
    return F.col("lk") == F.col("rk") if alike else F.col("lk").cast("string") == F.col("rk").cast("string")


def join_safety(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, measures: Sequence[str] = ()
) -> DataFrame:
    """One row of key, coverage, fan-out and measure checks with the verdict."""
    pairs = key_overlap(left, right, left_key, right_key, measures)
    matched = F.col("lk").isNotNull() & F.col("rk").isNotNull()
    # As doubles: the rows of a fan-out can outgrow a long.
    joined_rows = F.col("left_rows").cast("double") * F.col("right_rows")
    facts = pairs.agg(
        F.count("lk").alias("left_keys"),
        F.count("rk").alias("right_keys"),
        F.count_if(matched).alias("matched_keys"),
        F.coalesce(F.sum("left_rows"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("right_rows"), F.lit(0)).alias("right_rows"),
        F.coalesce(F.sum(F.when(matched, joined_rows)), F.lit(0.0)).alias("joined_rows"),
        *[F.sum(f"sum_{i}").alias(f"before_{i}") for i in range(len(measures))],
        *[
            F.sum(F.when(matched, F.col(f"sum_{i}") * F.col("right_rows"))).alias(f"after_{i}")
            for i in range(len(measures))
        ],
    )
    mismatch = left.schema[left_key].dataType != right.schema[right_key].dataType
    rate = F.when(F.col("left_keys") > 0, F.col("matched_keys") / F.col("left_keys")).otherwise(0.0)
    shifts = [measure_shift(F.col(f"before_{i}"), F.col(f"after_{i}")) for i in range(len(measures))]
    moved = [F.coalesce(s > fixed.JOIN_INVARIANCE_PCT, F.lit(False)) for s in shifts]
    texts = [
        F.when(
            m,
            F.format_string(fixed.MEASURE_CHANGED, F.lit(name), F.round(s, 1)),
        )
        for name, m, s in zip(measures, moved, shifts)
    ]
    inflated = F.lit(False)
    for m in moved:
        inflated = inflated | m
    failures = F.concat_ws("; ", *texts) if texts else F.lit("")
    return (
        facts.withColumns(
            {
                "raw_rate": rate,
                "left_unique": F.col("left_rows") == F.col("left_keys"),
                "right_unique": F.col("right_rows") == F.col("right_keys"),
            }
        )
        .withColumns({"invariant_failures": failures, "measure_changed": inflated})
        .select(
            (
                (F.col("raw_rate") >= fixed.JOIN_MATCH_RATE) & F.lit(not mismatch) & ~F.col("measure_changed")
            ).alias("safe"),
            F.round("raw_rate", 4).alias("match_rate"),
            "left_unique",
            "right_unique",
            F.lit(mismatch).alias("type_mismatch"),
            "invariant_failures",
            coverage_caveat(F.col("raw_rate")).alias("coverage_caveat"),
            F.when(F.col("left_rows") > 0, F.round(F.col("joined_rows") / F.col("left_rows"), 4)).alias(
                "fanout_factor"
            ),
            "joined_rows",
            *[F.col(f"before_{i}") for i in range(len(measures))],
            *[F.col(f"after_{i}") for i in range(len(measures))],
        )
    )


def measure_shift(before: Column, after: Column) -> Column:
    """Percent by which a measure's sum changes; NULL where a sum is 0 or unknown."""
    return F.when((before != 0) & (after != 0), F.abs(after - before) / F.abs(before) * 100)


def coverage_caveat(rate: Column) -> Column:
    return F.when(
        rate < 1.0,
        F.format_string(
            fixed.COVERAGE_CAVEAT,
            F.round((1 - rate) * 100, 1),
        ),
    ).otherwise("")
