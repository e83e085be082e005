"""Does a table hold what a question needs?"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import fixed_values as fixed


@dataclass(frozen=True)
class Requirements:
    roles: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    dimensions: tuple[str, ...] = ()
    time_expression: str | None = None
    min_rows: int = fixed.SUFFICIENT_MIN_ROWS


def requirement_checks(df: DataFrame, dictionary: DataFrame, needs: Requirements) -> DataFrame:
    """``(position, check_type, role_needed, satisfied, message)``, one row per requirement."""
    return request_checks(df, dictionary, {"": needs}).drop("request")


def request_checks(df: DataFrame, dictionary: DataFrame, requests: Mapping[str, Requirements]) -> DataFrame:
    """F1-F5 for any number of requests, each under its name ``request``.

    The dictionary has one row per column, so it folds to one row of role and name lists; with the number of rows it
    is found once for all requests.
    """
    known = dictionary.agg(
        F.collect_set("role").alias("roles"), F.collect_list("column").alias("names")
    ).withColumn("rows", df.agg(F.count(F.lit(1)).alias("n")).scalar())
    checks = [c for name, needs in requests.items() for c in _checks(name, needs)]
    return known.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def _checks(request: str, needs: Requirements) -> list[Column]:
    rows = F.col("rows")

    def has_role(role: str) -> Column:
        return F.array_contains("roles", role)

    def has_name(name: str) -> Column:
        return F.exists("names", lambda c: F.lower(c).contains(name.lower()))

    def size(sign: str) -> Column:
        return F.concat(F.lit("Row count "), rows.cast("string"), F.lit(f" {sign} minimum {needs.min_rows}."))

    checks: list[Column] = []

    def add(kind: str, needed: str, ok: Column, good: Column | str, bad: Column | str) -> None:
        text = F.when(ok, _text(good)).otherwise(_text(bad))
        checks.append(
            F.struct(
                F.lit(request).alias("request"),
                F.lit(len(checks)).alias("position"),
                F.lit(kind).alias("check_type"),
                F.lit(needed).alias("role_needed"),
                ok.alias("satisfied"),
                text.alias("message"),
            )
        )

    for role in needs.roles:
        add("presence", role, has_role(role), f"Role '{role}' present.", f"No column with role '{role}' found.")
    for m in needs.metrics:
        add("presence", m, has_name(m), f"Metric '{m}' available.", f"Required metric '{m}' not found.")
    add("sample_size", "rows", rows >= needs.min_rows, size("≥"), size("<"))
    for d in needs.dimensions:
        add("coverage", d, has_name(d), f"Dimension '{d}' available.", f"Dimension '{d}' not found.")
    if needs.time_expression:
        add(
            "time_span", "date", has_role("date"), "Date column present.",
            "No date column found for time-based analysis.",
        )
    return checks


def sufficiency(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """the verdict with what is missing, what to beware of and what can still be answered; one row, or one per
    ``by`` value."""
    failed = ~F.col("satisfied")
    presence = F.col("check_type") == "presence"

    def listed(keep: Column, column: str) -> Column:
        pairs = F.collect_list(F.when(keep, F.struct("position", column)))
        return F.concat_ws("; ", F.transform(F.sort_array(pairs), lambda p: p[column]))

    verdict = (
        F.when(F.max(failed & presence), "insufficient").when(F.max(failed), "partial").otherwise("sufficient")
    )
    return checks.groupBy(*by).agg(
        verdict.alias("verdict"),
        listed(failed & presence, "message").alias("missing"),
        listed(failed & ~presence, "message").alias("caveats"),
        listed(F.col("satisfied"), "role_needed").alias("passed"),
    ).select(
        *by,
        "verdict",
        "missing",
        "caveats",
        F.when(F.col("verdict") == "partial", F.col("passed")).otherwise("").alias("partial_answerable_parts"),
    )


def _text(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value
