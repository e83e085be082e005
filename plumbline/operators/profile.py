"""Table and column profiles, sensitive columns, sample values."""

from __future__ import annotations

from functools import reduce
from typing import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline import fixed_values as fixed
from plumbline.plans.scalars import one_row
from plumbline.plans.selection import exact_quantiles

#: The most hashes that rows share for which these rows are picked out by a broadcast.
SHARED_HASHES = 100_000


def stacked(one: DataFrame, names: Sequence[str], fields: Mapping[str, str], key: str = "column") -> DataFrame:
    """Turn a one-row wide result into one row per name.

    Column ``f"{name}__{field}"`` of the wide row becomes ``field``, cast to the given type.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias(key),
                *[F.col(f"`{name}__{f}`").cast(kind).alias(f) for f, kind in fields.items()],
            )
            for i, name in enumerate(names)
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def sortable_columns(df: DataFrame) -> list[str]:
    nested = (T.ArrayType, T.MapType, T.StructType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]


def value_text(df: DataFrame, name: str) -> Column:
    """A column as text. Nested values are written as JSON, maps by their sorted entries."""
    column, dtype = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(dtype, T.MapType):
        column = F.map_entries(column)
        return F.to_json(F.sort_array(column) if isinstance(dtype.keyType, T.AtomicType) else column)
    return F.to_json(column) if isinstance(dtype, (T.ArrayType, T.StructType)) else column.cast("string")


def duplicate_count(df: DataFrame) -> int:
    """Rows beyond the first of their kind, exactly.

    Rows are counted by a 64-bit hash of their values, which folds in the tasks and shuffles 16 bytes per row at most.
    A hash that one row has tells that row apart from all others; only rows that share one are compared by
    their values. If many hashes are shared, all rows are grouped by their values, where copies fold in the tasks.
    """
    plain = sortable_columns(df)
    values = df.select(*[F.col(f"`{c}`") if c in plain else value_text(df, c).alias(c) for c in df.columns]) if df.columns else df
    zeroed = [
        F.when(F.col(f"`{f.name}`") == 0, F.lit(0).cast(f.dataType)).otherwise(F.col(f"`{f.name}`"))
        if isinstance(f.dataType, (T.FloatType, T.DoubleType))
        else F.col(f"`{f.name}`")
        for f in values.schema.fields
    ]
    # The place of a NULL counts, as the hash passes over it; both zeros are one value when rows are grouped.
    null_at = [F.col(f"`{c}`").isNull() for c in values.columns]
    hashed = values.withColumn("__hash", F.xxhash64(F.lit(0), *null_at, *zeroed))
    shared = hashed.groupBy("__hash").agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1")
    found = shared.agg(F.count(F.lit(1)).alias("hashes"), F.sum("__rows").alias("rows")).first()
    if not found["hashes"]:
        return 0
    if found["hashes"] > SHARED_HASHES:
        copies = values.groupBy(*[F.col(f"`{c}`") for c in values.columns]).agg(F.count(F.lit(1)).alias("__n"))
        return copies.agg(F.sum(F.col("__n") - 1)).first()[0]
    some = hashed.join(F.broadcast(shared.select("__hash")), "__hash", "left_semi")
    different = some.groupBy("__hash", *[F.col(f"`{c}`") for c in values.columns]).agg(F.count(F.lit(1)).alias("__n")).count()
    return found["rows"] - different


def contains_any(text: str, words: Sequence[str]) -> bool:
    return any(w in text for w in words)


def table_profile(df: DataFrame, date_col: str | None = None) -> DataFrame:
    """Rows, columns, types, range of the date column and sensitive columns, in one pass."""
    texts = string_columns(df)
    aggs = [F.count(F.lit(1)).alias("row_count")]
    if date_col:
        day = F.col(f"`{date_col}`").cast("date")
        aggs += [F.min(day).alias("date_min"), F.max(day).alias("date_max")]
    aggs += pii_rates(texts)
    flags = [pii_flag(c, c in texts) for c in df.columns]
    return df.agg(*aggs).select(
        "row_count",
        F.lit(len(df.columns)).cast("long").alias("column_count"),
        F.lit(", ".join(f"{n} {k}" for n, k in df.dtypes)).alias("column_types"),
        F.lit(date_col).alias("date_column"),
        *([F.col("date_min"), F.col("date_max")] if date_col else []),
        F.concat_ws(", ", *[F.when(f, F.lit(c)) for c, f in zip(df.columns, flags)]).alias("pii_columns"),
    )


def has_email(text: Column) -> Column:
    return text.contains("@") & text.rlike(fixed.EMAIL_PATTERN)


def has_phone(text: Column) -> Column:
    return text.rlike(fixed.PHONE_PATTERN)


def pii_rates(texts: Sequence[str]) -> list[Column]:
    """Share of non-null values that look like an e-mail address or a phone number."""
    return [
        F.avg(check(F.col(f"`{c}`")).cast("int")).alias(f"{c}__{kind}")
        for c in texts
        for kind, check in (("email_rate", has_email), ("phone_rate", has_phone))
    ]


def pii_flag(column: str, is_text: bool) -> Column:
    if contains_any(column.lower(), fixed.PII_NAME_WORDS):
        return F.lit(True)
    if not is_text:
        return F.lit(False)
    return F.coalesce(
        F.greatest(F.col(f"`{column}__email_rate`"), F.col(f"`{column}__phone_rate`")) > fixed.PII_RATE,
        F.lit(False),
    )


def pii_columns(df: DataFrame) -> DataFrame:
    """Every column with its e-mail and phone rates over the whole table and the verdict."""
    texts = string_columns(df)
    rates = df.agg(F.count(F.lit(1)).alias("rows"), *pii_rates(texts))
    missing = [c for c in df.columns if c not in texts]
    filled = rates.select(
        "*",
        *[F.lit(None).cast("double").alias(f"{c}__{k}_rate") for c in missing for k in ("email", "phone")],
        *[pii_flag(c, c in texts).alias(f"{c}__is_pii") for c in df.columns],
    )
    fields = {"email_rate": "double", "phone_rate": "double", "is_pii": "boolean"}
    return stacked(filled, df.columns, fields).drop("position")


def _value(df: DataFrame, name: str) -> Column:
    """A column by which equal values group; nested ones go by their text."""
    nested = isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType))
    value = F.col(f"`{name}`")
    return F.when(value.isNotNull(), value_text(df, name)) if nested else value


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """One row per different value of a column with its number of rows ``n``, NULL among them. The table is read for
    that column only, values keep their type, and one holding most rows is folded before the shuffle."""
    return df.groupBy(_value(df, column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Rows, missing values and distinct values of every column, nested ones included.

    Exact distinct counts are one narrow group-by per column, each reading only that column, so the bytes read and
    grouped are those of the table. ``exact=False`` uses sketches in one pass, without a shuffle of values.
    """
    names = df.columns
    if exact:
        return _with_missing(union_all([_distincts(df, c) for c in names]))
    counted = [F.count(F.lit(1)).alias("rows")] + [F.count(F.col(f"`{c}`")).alias(f"{c}__present") for c in names]
    counted += [F.approx_count_distinct(_value(df, c)).alias(f"{c}__unique_count") for c in names]
    wide = df.agg(*counted).select("*", *[F.col("rows").alias(f"{c}__total_rows") for c in names])
    fields = {"total_rows": "long", "present": "long", "unique_count": "long"}
    return _with_missing(stacked(wide, names, fields).drop("position"))


def _distincts(df: DataFrame, column: str) -> DataFrame:
    return value_counts(df, column).agg(
        F.lit(column).alias("column"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("present"),
        F.count("value").alias("unique_count"),
    )


def _with_missing(rows: DataFrame) -> DataFrame:
    missing = F.col("total_rows") - F.col("present")
    return rows.select(
        "column",
        "total_rows",
        missing.alias("missing_count"),
        F.when(F.col("total_rows") > 0, F.round(missing / F.col("total_rows") * 100, 2))
        .otherwise(0.0)
        .alias("missing_pct"),
        "unique_count",
    )


def measure_profile(df: DataFrame, columns: Sequence[str] | None = None, samples: int = 0) -> DataFrame:
    """Range, mean, exact median and spread of numeric columns; with ``samples`` also that many
    ``sample_values``, the smallest different ones.

    Everything but the median and the samples is one pass; the medians come from exact rank selection.
    """
    names = list(columns or numeric_columns(df))
    medians = exact_quantiles(df, [(c, c, 0.5) for c in names])
    value = {c: F.col(f"`{c}`").cast("double") for c in names}
    stats = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp}
    wide = df.agg(*[f(value[c]).alias(f"{c}__{s}") for c in names for s, f in stats.items()])
    wide = wide.select("*", *[F.lit(medians[c]).cast("double").alias(f"{c}__median") for c in names])
    fields = {s: "double" for s in ("min", "max", "mean", "median", "std")}
    if samples:
        lists = [F.sort_array(F.collect_list(F.when(F.col(f"`{c}`").isNotNull(), F.struct("__place", F.col(f"`{c}`").alias("v"))))) for c in names]
        texts = [F.transform(x, lambda e: e["v"].cast("string")).alias(f"{c}__sample_values") for c, x in zip(names, lists)]
        found = one_row(_lowest(df, names, samples).agg(*texts))
        wide = wide.select("*", *[found[f"{c}__sample_values"].alias(f"{c}__sample_values") for c in names])
        fields["sample_values"] = "array<string>"
    return stacked(wide, names, fields).drop("position")


def top_categories(df: DataFrame, columns: Sequence[str], top: int = fixed.TOP_CATEGORIES) -> DataFrame:
    """The most frequent values of each column; equal counts go by value.

    Each column is a grouped count cut to its top rows inside every task before merging.
    """
    parts = []
    for c in columns:
        counts = (
            df.where(F.col(f"`{c}`").isNotNull())
            .groupBy(F.col(f"`{c}`").cast("string").alias("value"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), "value")
            .limit(top)
        )
        parts.append(counts.select(F.lit(c).alias("column"), "value", "count"))
    return union_all(parts)


def date_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P5: first and last value of each date column."""
    wide = df.agg(
        *[f(F.col(f"`{c}`")).alias(f"{c}__{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    )
    return stacked(wide, list(columns), {"min": "timestamp_ntz", "max": "timestamp_ntz"}).drop("position")


def _lowest_values(schema: T.StructType, top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per column the ``top`` smallest distinct values of all batches, as rows padded with NULL."""
    names, types = schema.names, list(to_arrow_schema(schema).types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pa.array([], t) for t in types]
        for batch in batches:
            for i, have in enumerate(held):
                found = batch.column(i).drop_null()
                if len(have) == top and have[-1].as_py() == have[-1].as_py():
                    found = found.filter(pc.less(found, have[-1]))
                if len(found):
                    both = pc.unique(pa.concat_arrays([have, pc.unique(found)]))
                    held[i] = both.take(pc.array_sort_indices(both)[:top])
        padded = [pa.concat_arrays([h, pa.nulls(top - len(h), t)]) for h, t in zip(held, types)]
        yield pa.RecordBatch.from_arrays(padded, names=names)

    return run


def _lowest(df: DataFrame, columns: Sequence[str], top: int) -> DataFrame:
    """``top`` rows, the i-th of which has the i-th smallest distinct value of every column, and its ``__place``."""
    chosen = df.select(*[F.col(f"`{c}`") for c in columns])
    # Short columns are filled with NULL, whatever the table allows.
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in chosen.schema.fields])
    lowest = _lowest_values(schema, top)
    few = chosen.mapInArrow(lowest, schema).repartition(1).mapInArrow(lowest, schema)
    return few.withColumn("__place", F.monotonically_increasing_id())


def sample_values(df: DataFrame, columns: Sequence[str], top: int = fixed.SAMPLE_VALUES) -> DataFrame:
    """The smallest distinct non-null values of each column, so that samples never change.

    One scan for all columns: every task keeps ``top`` values per column, and only those are brought together.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return _lowest(df, columns, top).select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL")


def table_sample(df: DataFrame, rows: int = fixed.TABLE_SAMPLE_ROWS) -> DataFrame:
    """Rows of the table in the order of a hash of the whole row, so that the sample is spread and never changes.

    Every task keeps that many rows; nothing is sorted whole.
    """
    texts = [F.coalesce(value_text(df, c), F.lit("\x00")) for c in df.columns]
    return df.withColumn("__order", F.xxhash64(*texts)).orderBy("__order", *texts).limit(rows).drop("__order")
