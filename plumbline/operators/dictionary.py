"""A role and a currency for every column, proposed from names and values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline import fixed_values as fixed
from plumbline.operators.profile import contains_any, stacked, string_columns, value_counts

# The sketch has 512 registers. Up to 50 distinct values fill at most 50 of them, and it then
# reports 512 * ln(512 / 462), about 53, at most: more than that is more than 50 for certain.
SKETCH_ERROR = 0.05
SKETCH_LIMIT = 100
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def propose_dictionary(df: DataFrame, whole_words: bool = False) -> DataFrame:
    """``(position, column, role, currency_symbol)``; rows may be replaced by the user's own.

    One wide aggregate, whose single row comes back to the driver, settles most columns. Exact
    distinct counts are taken only where they can decide: of columns named like keys, and of text
    columns with few values. A sketch tells the others apart for certain (see ``SKETCH_LIMIT``),
    so long free text is never shuffled. Nested columns are ``other`` unless their name or values say more.
    """
    names = df.columns
    texts = string_columns(df)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    by_name = {c: _role_by_name(c, kinds[c], whole_words) for c in names}
    open_texts = [c for c in texts if by_name[c] is None and not _key_like(c, whole_words)]

    first = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[f.alias(n) for c in texts for n, f in _text_rates(c).items()],
        *[F.approx_count_distinct(F.col(f"`{c}`"), SKETCH_ERROR).alias(f"{c}__sketch") for c in open_texts],
    )
    facts = first.first()
    wide = df.sparkSession.createDataFrame([facts], first.schema)
    exact = [c for c in names if by_name[c] is None and _key_like(c, whole_words)]
    exact += [c for c in open_texts if facts[f"{c}__sketch"] <= SKETCH_LIMIT]
    counts = {f"{c}__distinct": value_counts(df, c).agg(F.count("value").alias("n")).scalar() for c in exact}
    for c in open_texts:
        counts.setdefault(f"{c}__distinct", F.lit(None).cast("long"))
    wide = wide.withColumns(counts) if counts else wide
    wide = wide.select(
        *[_role(c, by_name[c], kinds[c], c in texts, whole_words).alias(f"{c}__role") for c in names],
        *[_currency(c, c in texts).alias(f"{c}__currency_symbol") for c in names],
    )
    return stacked(wide, names, {"role": "string", "currency_symbol": "string"})


def with_overrides(proposed: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The proposal with the rows a user has confirmed (``column, role, currency_symbol``) in place."""
    theirs = confirmed.select(
        "column",
        F.col("role").alias("__role"),
        F.col("currency_symbol").alias("__currency"),
        F.lit(True).alias("is_confirmed"),
    )
    joined = proposed.join(theirs, "column", "left")
    known = F.coalesce("is_confirmed", F.lit(False))
    return joined.select(
        "position",
        "column",
        F.when(known, F.col("__role")).otherwise(F.col("role")).alias("role"),
        F.when(known, F.col("__currency")).otherwise(F.col("currency_symbol")).alias("currency_symbol"),
        known.alias("is_confirmed"),
    )


def _named(column: str, words: list[str], whole_words: bool) -> bool:
    if not whole_words:
        return contains_any(column.lower(), words)
    return bool(set(re.split(r"[^a-z]+", column.lower())) & set(words))


def _role_by_name(column: str, kind: T.DataType, whole_words: bool) -> str | None:
    is_date = isinstance(kind, _DATES) or _named(column, fixed.DATE_NAME_WORDS, whole_words)
    return "date" if is_date else None


def _key_like(column: str, whole_words: bool) -> bool:
    return _named(column, fixed.IDENTIFIER_NAME_WORDS, whole_words)


def _text_rates(column: str) -> dict[str, Column]:
    value = F.col(f"`{column}`")
    rates = {f"{column}__digits": F.avg(value.rlike(fixed.MEASURE_TEXT_PATTERN).cast("int"))}
    for i, s in enumerate(fixed.CURRENCY_SYMBOLS):
        rates[f"{column}__s{i}"] = F.avg(value.contains(s).cast("int"))
    return rates


def _role(column: str, known: str | None, kind: T.DataType, is_text: bool, whole_words: bool) -> Column:
    if known:
        return F.lit(known)
    rows, distinct = F.col("__rows"), F.col(f"`{column}__distinct`")
    rule = None
    if _key_like(column, whole_words):
        rule = F.when(distinct > rows * fixed.IDENTIFIER_DISTINCT_RATE, "identifier")
    if isinstance(kind, T.NumericType):
        return F.lit("measure") if rule is None else rule.otherwise("measure")
    if not is_text:
        return F.lit("other") if rule is None else rule.otherwise("other")
    measure = F.col(f"`{column}__digits`") > fixed.MEASURE_DIGIT_RATE
    few = distinct < F.least(F.lit(fixed.DIMENSION_MAX_DISTINCT), rows * fixed.DIMENSION_MAX_RATE)
    rule = F.when(measure, "measure") if rule is None else rule.when(measure, "measure")
    return rule.when(few, "dimension").otherwise("other")


def _currency(column: str, is_text: bool) -> Column:
    """The first symbol found in more than 30 % of the raw values."""
    if not is_text:
        return F.lit(None).cast("string")
    return F.coalesce(
        *[
            F.when(F.col(f"`{column}__s{i}`") > fixed.CURRENCY_RATE, F.lit(s))
            for i, s in enumerate(fixed.CURRENCY_SYMBOLS)
        ]
    )
