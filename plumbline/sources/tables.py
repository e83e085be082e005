"""Parquet tables, their versions, pages of rows and the rows behind a finding."""

from __future__ import annotations

from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline import fixed_values as fixed
from plumbline.operators.profile import value_text
from plumbline.plans.predicates import matching_rows
from plumbline.plans.selection import RankTarget, literal, ordinal, select_ranks

# The most rows that every task keeps for a page; what lies before them is skipped by rank.
TOP_ROWS = 10_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """S6"""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def row_hash(texts: Sequence[Column]) -> Column:
    """60 bits of the SHA-256 of a row's texts, each with its length before it, so that no two rows
    are written alike; NULL and empty differ."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit("="), c), F.lit("~")) for c in texts]
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def fingerprint(df: DataFrame) -> DataFrame:
    """A content fingerprint that does not depend on row order or on files.

    The sum keeps copies of a row, which an exclusive or alone would cancel.
    """
    columns = [value_text(df, c) for c in df.columns]
    hashed = df.select(row_hash(columns).alias("h"))
    return hashed.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("long").alias("column_count"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
    )


def write_version(df: DataFrame, root: str, dataset_id: str, version_id: str, version_number: int, source: str) -> DataFrame:
    """Write a version of a table; the result is its manifest row."""
    path = f"{root}/dataset_id={dataset_id}/version_id={version_id}"
    df.write.mode("errorifexists").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    return fingerprint(stored).select(
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(version_id).alias("version_id"),
        F.lit(version_number).cast("long").alias("version_number"),
        F.lit(path).alias("path"),
        F.lit(source).alias("source"),
        "row_count",
        "column_count",
        "hash_xor",
        "hash_sum",
    )


def latest_versions(manifest: DataFrame, dataset: str, order: Sequence[str]) -> DataFrame:
    """The newest manifest row of every dataset.

    A maximum per dataset, so versions fold inside each task and a dataset with a third of all
    versions is no hot spot.
    """
    rest = [c for c in manifest.columns if c != dataset]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return (
        manifest.groupBy(dataset)
        .agg(newest.alias("r"), F.count(F.lit(1)).alias("versions"))
        .select(dataset, "r.*", "versions")
    )


def page(df: DataFrame, key: str, number: int, size: int, ascending: bool = True) -> DataFrame:
    """One page of rows in the order of ``key``, equal keys in the order of a hash of the whole row.

    NULL keys come first if ascending, else last; NaN is the largest number. The rule is the same at every
    depth, and the key may be of any type that has an order. A deep page is reached by finding the exact key, and among many equal
    keys the exact hash, at which it starts, so the rows before it are never sorted, gathered or shipped.
    """
    if not 1 <= size <= fixed.MAX_PAGE_SIZE or number < 1:
        raise ValueError(f"page {number} of size {size}")
    skip = (number - 1) * size
    marked = df.withColumn("__tie", row_hash([value_text(df, c) for c in df.columns]))
    tied, later = F.lit(True), F.lit(False)
    for name, up in ((key, ascending), ("__tie", True)):
        if skip + size <= TOP_ROWS:
            break
        group = marked.where(tied)
        value, dtype = ordinal(name, marked.schema[name].dataType)
        nulls = group.where(value.isNull()).count() if up else 0
        if skip < nulls:
            tied, later = tied & value.isNull(), later | (tied & value.isNotNull())
            continue
        skip -= nulls
        rank = (lambda n: skip) if up else (lambda n: n - 1 - skip)
        n, start, _ = select_ranks(group, [RankTarget("start", name, rank, rank)]).get("start", (0, None, None))
        if skip >= n:
            if up:
                return df.limit(0)
            # What is left of a descending order is its NULL keys.
            skip, tied = skip - n, tied & value.isNull()
            continue
        at = literal(start, dtype)
        after = value > at if up else (value < at) | value.isNull()
        skip -= group.where(value < at if up else value > at).count()
        tied, later = tied & (value == at), later | (tied & after)
    order = [F.col(f"`{key}`").asc() if ascending else F.col(f"`{key}`").desc(), F.col("__tie")]
    if skip + size <= TOP_ROWS:
        return marked.where(tied | later).orderBy(*order).offset(skip).limit(size).drop("__tie")
    # Beyond the hash only copies of one row are left to skip.
    copies = min(max(marked.where(tied).count() - skip, 0), size)
    rest = marked.where(later).orderBy(*order).limit(size - copies)
    return marked.where(tied).limit(copies).unionByName(rest).orderBy(*order).drop("__tie")


def drill_rows(
    df: DataFrame, filters: Mapping[str, Any], order: Sequence[str], limit: int = fixed.DRILL_ROWS
) -> DataFrame:
    """The rows behind a finding, in a fixed order."""
    return matching_rows(df, filters).orderBy(*order).limit(limit)
