"""What changed between two versions of a table, by a hash tree over buckets of keys.

Every version has one row per bucket of its keys, with the number of rows and two hashes of them; parents in the
tree add up their children. Two versions are compared from the root down, and only children of nodes that differ
are looked at, so two versions that are alike in nearly all buckets are compared by a few rows. Rows are read
again only in the buckets that differ.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.profile import value_text
from plumbline.sources.tables import row_hash

FAN_OUT, LEVELS = 64, 2
#: Buckets that may be sent to every task.
CHANGED_BUCKETS = 200_000


def bucket_of(df: DataFrame, keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a row's keys; equal keys of different types have the same, as their texts are equal."""
    return F.pmod(F.xxhash64(*[F.coalesce(value_text(df, k), F.lit("\x00")) for k in keys]), F.lit(buckets)).cast("long")


def _hashed(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    hashed = row_hash([value_text(df, c) for c in df.columns])
    return df.select(*[F.col(f"`{k}`") for k in keys], bucket_of(df, keys, buckets).alias("__bucket"), hashed.alias("__hash"))


def _folded(by: Sequence[str], rows: Column, xor: Column, total: Column) -> list[Column]:
    return [F.sum(rows).alias("rows"), F.bit_xor(xor).alias("hash_xor"), F.sum(total).cast("decimal(38,0)").alias("hash_sum")]


def bucket_hashes(df: DataFrame, keys: Sequence[str], fan_out: int = FAN_OUT, levels: int = LEVELS) -> DataFrame:
    """The leaves of the tree: ``node``, ``rows``, ``hash_xor``, ``hash_sum``. Store them with the version."""
    hashed = _hashed(df, keys, fan_out**levels)
    return hashed.groupBy(F.col("__bucket").alias("node")).agg(
        *_folded(["node"], F.lit(1), F.col("__hash"), F.col("__hash").cast("decimal(38,0)"))
    )


def changed_buckets(old: DataFrame, new: DataFrame, fan_out: int = FAN_OUT, levels: int = LEVELS) -> DataFrame:
    """``node``: the leaves in which two versions differ, found from the root down."""
    suspects = None
    for level in range(levels - 1, -1, -1):
        sides = []
        for side in (old, new):
            node = F.floor(F.col("node") / fan_out**level).cast("long")
            leaves = side.withColumn("up", node)
            if suspects is not None:
                parent = F.floor(F.col("node") / fan_out ** (level + 1)).cast("long")
                leaves = leaves.withColumn("parent", parent).join(suspects, "parent", "left_semi")
            sides.append(leaves.groupBy("up").agg(*_folded(["up"], F.col("rows"), F.col("hash_xor"), F.col("hash_sum"))))
        a, b = (s.alias(n) for s, n in zip(sides, "ab"))
        same = F.lit(True)
        for c in ("rows", "hash_xor", "hash_sum"):
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        differing = a.join(b, F.col("a.up") == F.col("b.up"), "full").where(~same)
        suspects = differing.select(F.coalesce("a.up", "b.up").alias("parent"))
    return suspects.select(F.col("parent").alias("node"))


def changed_rows(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    old_leaves: DataFrame | None = None,
    new_leaves: DataFrame | None = None,
    fan_out: int = FAN_OUT,
    levels: int = LEVELS,
) -> DataFrame:
    """The keys whose rows differ, with ``change`` (``added``, ``removed`` or ``changed``), ``rows_before`` and
    ``rows_after``. Rows that share a key are compared as a bag; NULL keys pair up. Leaves that were stored with a
    version spare a scan of it."""
    a = bucket_hashes(old, keys, fan_out, levels) if old_leaves is None else old_leaves
    b = bucket_hashes(new, keys, fan_out, levels) if new_leaves is None else new_leaves
    changed = changed_buckets(a, b, fan_out, levels).select(F.col("node").alias("__bucket"))

    def bags(df: DataFrame, name: str) -> DataFrame:
        rows = _hashed(df, keys, fan_out**levels).join(F.broadcast(changed) if fan_out**levels <= CHANGED_BUCKETS else changed, "__bucket", "left_semi")
        total = F.sum(F.col("__hash").cast("decimal(38,0)"))
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("__hash").alias("x"), total.alias("s")).alias(name)

    left, right = bags(old, "a"), bags(new, "b")
    on = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]
    both = left.join(right, on, "full")
    differ = ~(F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.x").eqNullSafe(F.col("b.x")) & F.col("a.s").eqNullSafe(F.col("b.s")))
    change = F.when(F.col("a.n").isNull(), "added").when(F.col("b.n").isNull(), "removed").otherwise("changed")
    return both.where(differ).select(
        *[F.coalesce(F.col(f"a.`{k}`"), F.col(f"b.`{k}`")).alias(k) for k in keys],
        change.alias("change"),
        F.coalesce("a.n", F.lit(0).cast("long")).alias("rows_before"),
        F.coalesce("b.n", F.lit(0).cast("long")).alias("rows_after"),
    )
