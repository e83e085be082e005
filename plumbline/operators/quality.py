"""Q1-Q6: data quality issues as rows, and the verdict over them."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import fixed_values as fixed
from plumbline.operators.profile import (
    contains_any,
    duplicate_count,
    numeric_columns,
    sortable_columns,
    value_text,
    string_columns,
)
from plumbline.plans.selection import exact_quantiles

ALL_COLUMNS = "(all columns)"
ISSUE_SCHEMA = "column string, issue_type string, severity string, description string, affected_rows long"


class _Check:
    """Aggregates over the table and the issues that follow from their one-row result."""

    def __init__(self) -> None:
        self.aggregates: list[Column] = []
        self.issues: list[Column] = []

    def total(self, aggregate: Column) -> Column:
        name = f"a{len(self.aggregates)}"
        self.aggregates.append(aggregate.alias(name))
        return F.col(name)

    def issue(
        self, column: str, kind: str, severity: Column | str, description: Column, rows: Column, found: Column
    ) -> None:
        row = F.struct(
            F.lit(column).alias("column"),
            F.lit(kind).alias("issue_type"),
            (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
            description.alias("description"),
            rows.cast("long").alias("affected_rows"),
        )
        self.issues.append(F.when(found, row))

    def rows(self, df: DataFrame) -> DataFrame:
        """All issues found, from one pass over the table."""
        if not self.issues:
            return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)
        result = df.agg(*self.aggregates)
        listed = result.select(F.explode(F.array(*self.issues)).alias("i"))
        return listed.where(F.col("i").isNotNull()).select("i.*")


def _missing(check: _Check, df: DataFrame) -> None:
    rows = check.total(F.count(F.lit(1)))
    for c in df.columns:
        missing = rows - check.total(F.count(F.col(f"`{c}`")))
        pct = missing / rows * 100
        check.issue(
            c,
            "missing_values",
            F.when(pct > fixed.MISSING_ERROR_PCT, "error").otherwise("warning"),
            F.format_string("%d missing values (%.1f%%)", missing, F.round(pct, 1)),
            missing,
            missing > 0,
        )


def _outliers(check: _Check, df: DataFrame, measures: Sequence[str]) -> None:
    wanted = [(f"{c}__{q}", c, p) for c in measures for q, p in (("q1", 0.25), ("q3", 0.75))]
    found = exact_quantiles(df, wanted) if wanted else {}
    for c in measures:
        q1, q3 = found[f"{c}__q1"], found[f"{c}__q3"]
        if q1 is None or q3 is None:
            continue
        reach = fixed.EXTREME_IQR_FACTOR * (q3 - q1)
        lower, upper = F.lit(q1 - reach), F.lit(q3 + reach)
        value = F.col(f"`{c}`").cast("double")
        n = check.total(F.count_if((value < lower) | (value > upper)))
        text = "%d extreme outliers (beyond 3×IQR: [%.2f, %.2f])"
        description = F.format_string(text, n, F.round(lower, 2), F.round(upper, 2))
        check.issue(c, "outliers", "warning", description, n, n > 0)


def _negatives(check: _Check, measures: Sequence[str]) -> None:
    for c in measures:
        if contains_any(c.lower(), fixed.NON_NEGATIVE_WORDS):
            n = check.total(F.count_if(F.col(f"`{c}`").cast("double") < 0))
            text = "%d negative values in '%s' — verify if returns/credits are expected."
            check.issue(c, "suspicious_values", "warning", F.format_string(text, n, F.lit(c)), n, n > 0)


def _currencies(check: _Check, columns: Sequence[str], amounts_only: bool = False) -> None:
    """With ``amounts_only`` a column counts if most of its values read as numbers; prose may name any currency."""
    rows = check.total(F.count(F.lit(1)))
    for c in columns:
        amounts = F.lit(True)
        if amounts_only:
            digits = F.col(f"`{c}`").rlike(fixed.MEASURE_TEXT_PATTERN).cast("int")
            amounts = check.total(F.avg(digits)) > fixed.MEASURE_DIGIT_RATE
        marks = [
            F.when(check.total(F.max(F.col(f"`{c}`").contains(s))), F.lit(s)) for s in fixed.CURRENCY_SYMBOLS
        ]
        seen = F.concat_ws(", ", *marks)
        text = "Mixed currency symbols detected: %s. Values may not be comparable."
        check.issue(c, "mixed_currency", "error", F.format_string(text, seen), rows, amounts & seen.contains(", "))


def missing_issues(df: DataFrame) -> DataFrame:
    """Q1: columns with NULLs; more than 20 % is an error."""
    check = _Check()
    _missing(check, df)
    return check.rows(df)


def outlier_issues(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Q2: measures with values beyond 3 IQR of their quartiles.

    Exact quartiles of all measures come from rank selection; one more pass counts against them.
    """
    check = _Check()
    _outliers(check, df, measures)
    return check.rows(df)


def negative_issues(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Q3: negative values in measures whose name says they should not be."""
    check = _Check()
    _negatives(check, measures)
    return check.rows(df)


def currency_issues(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Q4: text columns that carry more than one currency symbol, over every row."""
    check = _Check()
    _currencies(check, list(columns or string_columns(df)))
    return check.rows(df)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and rows beyond the first of their kind.

    Copies fold inside each task before the shuffle, so one row repeated a billion times is cheap.
    """
    plain = sortable_columns(df)
    copies = df.groupBy(*[F.col(f"`{c}`") if c in plain else value_text(df, c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__copies"))
    return copies.agg(
        F.coalesce(F.sum("__copies"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def duplicate_issues(df: DataFrame) -> DataFrame:
    """Q5: rows beyond the first of their kind, counted by hashes, so that whole rows are not shuffled."""
    n = duplicate_count(df)
    one = df.sparkSession.range(0, 1, 1, 1).where(F.lit(n > 0))
    return one.select(
        F.lit(ALL_COLUMNS).alias("column"),
        F.lit("duplicates").alias("issue_type"),
        F.lit("warning").alias("severity"),
        F.lit(f"{n} duplicate rows detected.").alias("description"),
        F.lit(n).cast("long").alias("affected_rows"),
    )


def quality_issues(
    df: DataFrame, measures: Sequence[str] | None = None, dictionary: DataFrame | None = None
) -> DataFrame:
    """Q1-Q5 in one issue table.

    ``dictionary`` (``column, role, currency_symbol``, one row per column) says which columns are measures,
    unless ``measures`` does, and which of those have a currency declared: only the others are looked at for
    mixed symbols. Without it, texts are that mostly read as numbers. Apart from the quartiles and the
    duplicates, all checks share one pass over the table.
    """
    texts, numbers = string_columns(df), numeric_columns(df)
    if dictionary is not None:
        rows = dictionary.where("role = 'measure'").select("column", "currency_symbol").collect()
        symbols = {r["column"]: r["currency_symbol"] for r in rows}
        numbers = [c for c in numbers if c in symbols]
        texts = [c for c in texts if c in symbols and symbols[c] is None]
    names = list(measures if measures is not None else numbers)
    check = _Check()
    _missing(check, df)
    _outliers(check, df, names)
    _negatives(check, names)
    _currencies(check, texts, amounts_only=dictionary is None)
    return check.rows(df).unionByName(duplicate_issues(df))


def quality_report(df: DataFrame, issues: DataFrame) -> DataFrame:
    """Q6: totals and whether the table passed (no error-severity issue)."""
    errors = F.count_if(F.col("severity") == "error")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return issues.agg(
        F.count(F.lit(1)).alias("issue_count"),
        errors.alias("error_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
        (errors == 0).alias("passed"),
    ).select(
        total.alias("total_rows"),
        F.lit(len(df.columns)).cast("long").alias("total_columns"),
        "issue_count",
        "error_count",
        "warning_count",
        "passed",
    )
