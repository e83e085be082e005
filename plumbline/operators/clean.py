"""Turn an all-text table into typed columns, logging every step."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import or_
from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import fixed_values as fixed
from plumbline.operators.profile import duplicate_count, stacked, string_columns

LOG_SCHEMA = (
    "step int, step_type string, description string, rows_affected long, requires_approval boolean"
)


def trimmed_names(df: DataFrame) -> DataFrame:
    """Column names without surrounding blanks."""
    return df.toDF(*[c.strip() for c in df.columns])


def _any_cell(df: DataFrame, test: Callable[[Column], Column]) -> Column:
    """Whether some cell, as text, passes; a plain expression, which Spark compiles, unlike a function over an array."""
    return reduce(or_, [F.coalesce(test(F.col(f"`{c}`").cast("string")), F.lit(False)) for c in df.columns], F.lit(False))


def is_empty_row(df: DataFrame) -> Column:
    """Every cell is NULL or blank."""
    return ~_any_cell(df, lambda x: F.trim(x) != "")


def is_total_row(df: DataFrame) -> Column:
    """Some cell says total, subtotal, grand total or sum."""
    return _any_cell(df, lambda x: x.rlike(fixed.TOTAL_ROW_PATTERN))


def drop_empty(df: DataFrame) -> DataFrame:
    """Rows without a value and columns that are NULL throughout are dropped."""
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    kept = [c for i, c in enumerate(df.columns) if filled[f"c{i}"] > 0]
    rows = df.select(*[F.col(f"`{c}`") for c in kept])
    return trimmed_names(rows.where(~is_empty_row(rows)))


def drop_totals(df: DataFrame) -> DataFrame:
    """Without total rows, which would count every value twice."""
    return df.where(~is_total_row(df))


def period_headers(columns: Sequence[str]) -> list[str]:
    """C4: the headers that name a year or a month."""
    years = [c for c in columns if re.match(fixed.YEAR_HEADER_PATTERN, c.strip())]
    months = [c for c in columns if re.match(fixed.MONTH_HEADER_PATTERN, c.strip())]
    enough = len(years) >= fixed.WIDE_MIN_HEADERS or len(months) >= fixed.WIDE_MIN_HEADERS
    return [c for c in columns if c in years or c in months] if enough else []


def wide_to_long(df: DataFrame) -> DataFrame:
    """C4: a table with one column per period as rows of ``period`` and ``value``."""
    periods = period_headers(df.columns)
    if not periods:
        return df
    ids = [c for c in df.columns if c not in periods]
    return df.unpivot(ids, periods, "period", "value")


def _stripped(column: str) -> Column:
    bare = F.translate(F.trim(F.col(f"`{column}`")), fixed.CURRENCY_CLASS[1:-1], "")
    return F.trim(bare)


NUMBER_RATES = {
    "us_rate": fixed.US_NUMBER_PATTERN,
    "eu_rate": fixed.EU_NUMBER_PATTERN,
    "plain_rate": fixed.PLAIN_NUMBER_PATTERN,
}


def _bare(columns: Sequence[str]) -> list[Column]:
    """The texts without blanks and currency signs, computed once for all patterns."""
    return [_stripped(c).alias(f"{c}__bare") for c in columns]


def _number_rates(columns: Sequence[str]) -> list[Column]:
    return [
        F.avg(F.col(f"`{c}__bare`").rlike(p).cast("int")).alias(f"{c}__{r}")
        for c in columns
        for r, p in NUMBER_RATES.items()
    ]


def _chosen_numbers(rates: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = stacked(rates, columns, {r: "double" for r in NUMBER_RATES}).drop("position")
    high = {r: F.coalesce(F.col(r) > fixed.NUMBER_MATCH_RATE, F.lit(False)) for r in NUMBER_RATES}
    chosen = (
        F.when(high["us_rate"], "us")
        .when(high["eu_rate"] & ~high["plain_rate"], "eu")
        .when(high["plain_rate"], "plain")
    )
    return rows.withColumn("number_format", chosen)


def number_formats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How much of each text column reads as a US, EU or plain number, and the format chosen.

    One aggregate over all columns and all rows. The order of the rules is US, EU, plain.
    """
    names = list(columns or string_columns(df))
    return _chosen_numbers(df.select(*_bare(names)).agg(*_number_rates(names)), names)


def parsed_number(column: str, number_format: str, percent_as_fraction: bool = False) -> Column:
    """The column as a double; text that does not parse becomes NULL."""
    text = F.col(f"`{column}`")
    if number_format == "eu":
        bare = F.translate(text, "$€£¥₹.%", "")
        bare = F.replace(bare, F.lit(","), F.lit("."))
    else:
        bare = F.translate(text, "$€£¥₹,%" if number_format == "us" else "$€£¥₹%", "")
    # A cast would also read the suffixes of number literals.
    value = F.when(F.trim(bare).rlike(fixed.PLAIN_DOUBLE), F.trim(bare).try_cast("double"))
    return F.when(text.contains("%"), value / 100).otherwise(value) if percent_as_fraction else value


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SHAPED = ("0123456789" + _LETTERS + _LETTERS.upper(), "9" * 10 + "a" * 52)


def _shapes(columns: Sequence[str]) -> list[Column]:
    """The texts with 9 for every digit and a for every letter, found once for all formats; NULL if too long for any."""
    longest = max(len(x) for shapes in fixed.DATE_FORMATS.values() for x in shapes)
    return [
        F.when(F.length(F.col(f"`{c}`")) <= longest, F.translate(F.col(f"`{c}`"), *_SHAPED)).alias(f"{c}__shape")
        for c in columns
    ]


def _shape_rates(shaped: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Per column and format, as ``column__s0`` and so on, the share of values that have one of its shapes, which it
    cannot parse more than; None without values. Shapes fold in the tasks, those of no format to one."""
    known = sorted({x for shapes in fixed.DATE_FORMATS.values() for x in shapes})
    pairs = [
        F.when(
            F.col(f"`{c}`").isNotNull(),
            F.struct(F.lit(i).alias("c"), F.when(F.col(f"`{c}__shape`").isin(*known), F.col(f"`{c}__shape`")).alias("shape")),
        )
        for i, c in enumerate(columns)
    ]
    each = shaped.select(F.explode(F.filter(F.array(*pairs), lambda p: p.isNotNull())).alias("p")) if pairs else None
    counts = {(r["c"], r["shape"]): r["n"] for r in each.groupBy("p.c", "p.shape").agg(F.count(F.lit(1)).alias("n")).collect()} if pairs else {}
    rates: dict[str, float | None] = {}
    for i, c in enumerate(columns):
        values = sum(n for (column, _), n in counts.items() if column == i)
        for j, shapes in enumerate(fixed.DATE_FORMATS.values()):
            rates[f"{c}__s{j}"] = sum(counts.get((i, x), 0) for x in shapes) / values if values else None
    return rates


def _parses(c: str, date_format: str) -> Column:
    """Whether a value of the right shape is a date; a month above 12 is told without a failing parse."""
    value = F.col(f"`{c}`")
    separator = date_format[1]
    possible = F.lit(True)
    if separator in "/.-" and date_format[0] in "Md":
        month = F.split_part(value, F.lit(separator), F.lit(1 if date_format[0] == "M" else 2))
        possible = F.coalesce(month.try_cast("int") <= 12, F.lit(True))
    return F.when(possible, F.try_to_timestamp(value, F.lit(date_format)).isNotNull())


def _date_rates(shaped: DataFrame, columns: Sequence[str], seen: Mapping[str, float | None], least: float) -> DataFrame:
    """One row: per column the share that each format parses. Only formats that more than ``least`` of a column's
    values have the shape of are tried; the others count as 0."""
    tried, rates = [], []
    for c in columns:
        for i, (f, shapes) in enumerate(fixed.DATE_FORMATS.items()):
            name = f"{c}__f{i}"
            if (seen[f"{c}__s{i}"] or 0.0) > least:
                # Where all values have a shape of the format, none is looked at again.
                ok = _parses(c, f) if seen[f"{c}__s{i}"] == 1.0 else F.when(F.col(f"`{c}__shape`").isin(*shapes), _parses(c, f))
                tried.append(F.avg(F.when(F.col(f"`{c}`").isNotNull(), F.coalesce(ok, F.lit(False)).cast("int"))).alias(name))
                rates.append(F.col(f"`{name}`"))
            else:
                rates.append(F.lit(None if seen[f"{c}__s{i}"] is None else 0.0).cast("double").alias(name))
    return shaped.agg(F.count(F.lit(1)).alias("__rows"), *tried).select(*rates)


def _chosen_dates(rates: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The format that parses most, the first of equals. A field above 12 rules out one order of month and day, so
    the other order parses more; else month comes first, which is reported as a choice to be verified."""
    names = list(fixed.DATE_FORMATS)
    fields = {f"f{i}": "double" for i in range(len(names))}
    rows = stacked(rates, columns, fields).drop("position")
    best = F.greatest(*[F.col(r) for r in fields])
    chosen = F.coalesce(*[F.when(F.col(r) == best, F.lit(f)) for r, f in zip(fields, names)])
    month_first = F.col(f"f{names.index(fixed.AMBIGUOUS_DATE_FORMAT)}")
    unclear = (chosen == fixed.AMBIGUOUS_DATE_FORMAT) & (month_first > fixed.AMBIGUOUS_DATE_RATE)
    return rows.select(
        "column",
        best.alias("parse_rate"),
        F.when(best > fixed.DATE_PARSE_RATE, chosen).alias("date_format"),
        F.coalesce(unclear, F.lit(False)).alias("ambiguous"),
    )


def date_formats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The format that parses most of each text column, and whether day and month are unclear.

    One aggregate counts the shapes of all columns, another tries the formats that have these shapes. Rates are over
    all rows. Texts with a zone become the session's time.
    """
    names = list(columns or string_columns(df))
    shaped = df.select(*[F.col(f"`{c}`") for c in names], *_shapes(names))
    return _chosen_dates(_date_rates(shaped, names, _shape_rates(shaped, names), 0.0), names)


def parsed_date(column: str, date_format: str) -> Column:
    """The column as a timestamp; text that does not parse becomes NULL."""
    return F.try_to_timestamp(F.col(f"`{column}`"), F.lit(date_format)).cast("timestamp_ntz")


@dataclass
class Cleaned:
    """The typed table, and the log, whose counts are taken when it is first asked for."""

    table: DataFrame
    #: The log from the typed table or a stored copy of it.
    make_log: Callable[[DataFrame], DataFrame]

    @cached_property
    def log(self) -> DataFrame:
        return self.make_log(self.table)


def clean(
    df: DataFrame, remove_totals: bool = True, percent_as_fraction: bool = False
) -> Cleaned:
    """C1-C8 in order, in up to four passes over the rows.

    Column types depend on the values, so the first pass brings one row of counts and number rates to the driver, the
    second the counts of date shapes, the third, if there are any, one row of rates of the formats that have these
    shapes, and the last, only if the log is asked for, its counts. Table rows never leave Spark.
    """
    raw = trimmed_names(df)
    texts = string_columns(raw)
    marked = raw.withColumns({"__empty": is_empty_row(raw), "__total": is_total_row(raw)})
    dropped = F.col("__empty") | F.col("__total") if remove_totals else F.col("__empty")
    # Texts of dropped rows are hidden, so that they count for no rate.
    shown = marked.select(
        "__empty",
        "__total",
        *[F.col(f"`{c}`").isNotNull().alias(f"{c}__set") for c in raw.columns],
        *[F.when(~dropped, F.col(f"`{c}`")).alias(c) for c in texts],
    )
    shaped = shown.select("*", *_bare(texts), *_shapes(texts))
    first = shaped.agg(
        F.count_if("__empty").alias("empty"),
        F.count_if(~F.col("__empty") & F.col("__total")).alias("totals"),
        *[F.count_if(F.col(f"`{c}__set`")).alias(f"{c}__n") for c in raw.columns],
        *_number_rates(texts),
    )
    seen = first.first()
    rates = df.sparkSession.createDataFrame([seen], first.schema)
    kept = [c for c in raw.columns if seen[f"{c}__n"] > 0]
    found = _chosen_numbers(rates, texts).collect() if texts else []
    numbers = {r["column"]: r["number_format"] for r in found if r["number_format"]}
    rows = marked.where(~dropped)
    if not seen["empty"] and not (remove_totals and seen["totals"]):
        # No row is dropped, so the later passes need not test every cell for it again.
        rows, shaped = raw, raw.select(*[F.col(f"`{c}`") for c in texts], *_shapes(texts))
    # A format that too few values have the shape of cannot be chosen.
    open_texts = [c for c in texts if c not in numbers]
    shapes = _shape_rates(shaped, open_texts)
    open_texts = [c for c in open_texts if any((shapes[f"{c}__s{i}"] or 0.0) > fixed.DATE_PARSE_RATE for i in range(len(fixed.DATE_FORMATS)))]
    found = _chosen_dates(_date_rates(shaped, open_texts, shapes, fixed.DATE_PARSE_RATE), open_texts).collect() if open_texts else []
    dates = {r["column"]: r for r in found if r["date_format"] and r["column"] not in numbers}

    def typed_column(c: str) -> Column:
        if c in numbers:
            return parsed_number(c, numbers[c], percent_as_fraction).alias(c)
        if c in dates:
            return parsed_date(c, dates[c]["date_format"]).alias(c)
        return F.col(f"`{c}`")

    typed = rows.select(*[typed_column(c) for c in kept])
    return Cleaned(typed, lambda table: _log(table, seen, kept, numbers, dates))


def _log(typed: DataFrame, seen, kept: Sequence[str], numbers: Mapping[str, str], dates: Mapping) -> DataFrame:
    """The steps taken, with the rows that each touched."""
    changed = [c for c in kept if c in numbers or c in dates]
    second = typed.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in changed]).first() if changed else {}
    duplicates = duplicate_count(typed)

    log = []
    if seen["empty"]:
        log.append(("empty_rows_removed", fixed.EMPTY_ROWS_STEP.format(seen["empty"]), seen["empty"], False))
    if seen["totals"]:
        log.append(("total_rows_detected", fixed.TOTAL_ROWS_STEP.format(seen["totals"]), seen["totals"], True))
    if period_headers(kept):
        log.append(("wide_format_detected", fixed.WIDE_STEP, 0, False))
    for c in (c for c in changed if c in numbers):
        log.append(("numeric_parsed", fixed.NUMBER_STEP.format(c, fixed.NUMBER_STYLES[numbers[c]]), second[c], False))
    for c in (c for c in changed if c in dates):
        unclear = dates[c]["ambiguous"]
        note = fixed.AMBIGUOUS_DATE_NOTE if unclear else ""
        log.append(("date_parsed", fixed.DATE_STEP.format(c) + note, second[c], bool(unclear)))
    if duplicates:
        log.append(("duplicate_rows_detected", fixed.DUPLICATES_STEP.format(duplicates), duplicates, True))
    steps = [(i + 1, *entry) for i, entry in enumerate(log)]
    return typed.sparkSession.createDataFrame(steps, LOG_SCHEMA)
