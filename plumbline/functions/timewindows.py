"""M3: relative time expressions as date columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def relative_window(expression: Column, anchor: Column) -> Column:
    """Struct ``(start, end)`` of days for an expression, counted from the data's own last day.

    ``anchor`` is a struct as :func:`plumbline.operators.semantic.time_anchor` yields. Both ends
    are NULL for an expression that is not understood: an open window.
    """
    text = F.lower(F.regexp_replace(expression, r"^\s+|\s+$", ""))
    last = anchor["max_date"]
    this_month, this_year = F.trunc(last, "month"), F.trunc(last, "year")

    quarter = _number(text, r"^q([1-4])\s*\d{4}")
    quarter_year = _number(text, r"^q[1-4]\s*(\d{4})")
    quarter_start = F.make_date(quarter_year, (quarter - 1) * 3 + 1, F.lit(1))
    days = _number(text, r"^last (\d+) days?")
    months = _number(text, r"^last (\d+) months?")
    year = _number(text, r"^(\d{4})")

    def window(start: Column, end: Column) -> Column:
        return F.struct(start.cast("date").alias("start"), end.cast("date").alias("end"))

    return (
        F.when(
            text.isin("last month", "previous month"),
            window(anchor["last_complete_month_start"], anchor["last_complete_month_end"]),
        )
        .when(text == "this month", window(this_month, last))
        .when(
            text.isin("last quarter", "previous quarter", "last complete quarter"),
            window(anchor["last_complete_quarter_start"], anchor["last_complete_quarter_end"]),
        )
        .when(
            text.isin("last year", "previous year"),
            window(F.add_months(this_year, -12), F.date_sub(this_year, 1)),
        )
        .when(text.isin("ytd", "year to date", "this year"), window(this_year, last))
        .when(
            text == "last week",
            window(F.date_sub(F.trunc(last, "week"), 7), F.date_sub(F.trunc(last, "week"), 1)),
        )
        .when(quarter.isNotNull(), window(quarter_start, F.last_day(F.add_months(quarter_start, 2))))
        .when(days.isNotNull(), window(F.date_sub(last, days - 1), last))
        .when(months.isNotNull(), window(F.add_months(this_month, -months), last))
        .when(year.isNotNull(), window(_day(year, 1, 1), _day(year, 12, 31)))
        .otherwise(window(F.lit(None), F.lit(None)))
    )


def _number(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("int")


def _day(year: Column, month: int, day: int) -> Column:
    return F.make_date(year, F.lit(month), F.lit(day))
