"""Exact order statistics and ranks without sorting a table into one task.

``select_ranks`` closes in on a rank with quantile sketches. Each round is one aggregate whose
single row of sketch points and counts comes back to the driver, the way ``approxQuantile`` does:
a sketch proposes two bounds around the wanted rank, the rows below, on and between them are
counted, and the counts tell in which of these parts the rank lies. A rank that falls on a bound is
answered, so a value holding half of a column leaves the search in one round. A rank outside of the
bounds goes on in the rows on that side. Every part has fewer rows than the one before, whatever
the sketch said, and at most ``SMALL_BRACKET`` rows are ordered in the end.

``cumulative_counts`` gives every distinct value of a family its exact rank. Values are grouped
first, so a value holding a third of all rows is one row. The values of all families are cut at
common quantiles into buckets of equal size, whose number grows with the rows, and each family is ordered bucket
by bucket: no group is larger than a bucket, however many of the values belong to one family.
"""

from __future__ import annotations

import decimal
import math
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce
from typing import Any, Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from plumbline.plans.scalars import one_row

GRID = 500
SMALL_BRACKET = 200_000
# Items that a sketch of numbers keeps at its top level; ranks are then off by about a quarter of a grid step.
SKETCH_SIZE = 4_000
SAMPLE = 2_000
# Grid steps that the rank of a sampled point may be off, by about three deviations.
SAMPLE_MARGIN = 15
#: The fewest buckets for ranks, and the values that a bucket has at most on average.
BUCKETS, BUCKET_ROWS = 256, 1_000_000
# Types without a quantile sketch; their bounds come from a random sample.
UNSKETCHED = (T.StringType, T.BinaryType, T.BooleanType)
EXACT_AS_DOUBLE = 1 << 53


@dataclass(frozen=True)
class RankTarget:
    """Two ranks (0-based, ascending, of the non-null values) wanted from a column.

    ``low`` and ``high`` compute them from the non-null count; they may be equal.
    """

    label: str
    column: str
    low: Callable[[int], int]
    high: Callable[[int], int]


@dataclass
class _Search:
    """The search for one rank: ``below`` rows are up to ``lo``, ``inside`` rows between ``lo`` and ``hi``."""

    column: str
    dtype: T.DataType
    rank: int
    inside: int
    least: Any
    most: Any
    below: int = 0
    lo: Any = None
    hi: Any = None
    left: Any = None
    right: Any = None
    found: Any = None

    def part(self) -> tuple:
        return (self.column, self.lo, self.hi)

    def rows(self) -> Column:
        c = F.col(self.column)
        bounds = [c.isNotNull()]
        bounds += [] if self.lo is None else [c > literal(self.lo, self.dtype)]
        bounds += [] if self.hi is None else [c < literal(self.hi, self.dtype)]
        return reduce(lambda a, b: a & b, bounds)

    def propose(self, grid: Sequence[Any], margin: int) -> None:
        """Take the grid points ``margin`` steps outside the rank, or the middle where the grid is too coarse."""
        step = max(self.inside - 1, 1) / GRID
        place = (self.rank - self.below) / step
        first, last = math.floor(place) - margin, math.ceil(place) + margin
        self.left = grid[first] if 0 < first <= GRID and self._new(grid[first]) else None
        self.right = grid[last] if 0 <= last < GRID and self._new(grid[last]) else None
        if self.left is None and self.right is None:
            self.left = self.right = self._middle()

    def _new(self, point: Any) -> bool:
        """Sketches work in doubles, so that a point of a wide number may lie outside of its part."""
        ends = self.least <= point <= self.most
        return ends and (self.lo is None or point > self.lo) and (self.hi is None or point < self.hi)

    def _middle(self) -> Any:
        """A value that has part of the rows on it or on each side: an end that is still open can be it."""
        low, high = (self.least if self.lo is None else self.lo), (self.most if self.hi is None else self.hi)
        scale = self.dtype.scale if isinstance(self.dtype, T.DecimalType) else 0
        unit = Fraction(1, 10**scale)
        halves = (Fraction(low) + Fraction(high)) / unit / 2
        whole = math.ceil(halves) if self.hi is None else math.floor(halves)
        return whole if isinstance(low, int) else decimal.Decimal(whole).scaleb(-scale, decimal.Context(prec=38))

    def counts(self) -> Column:
        c = F.col(self.column)
        asked = []
        for name, bound in (("left", self.left), ("right", self.right)):
            if bound is not None:
                at = literal(bound, self.dtype)
                asked += [F.count_if(c < at).alias(f"{name}_before"), F.count_if(c <= at).alias(f"{name}_through")]
        return F.struct(*asked)

    def settle(self, counted: Any) -> None:
        """Go on in the part that has the rank: before, on, between, on or after the two bounds."""
        end = self.below + self.inside
        left = (self.below, self.below) if self.left is None else (counted["left_before"], counted["left_through"])
        right = (end, end) if self.right is None else (counted["right_before"], counted["right_through"])
        if self.rank < left[0]:
            self.hi, end = self.left, left[0]
        elif self.rank < left[1]:
            self.found = self.left
        elif self.rank < right[0]:
            self.lo, self.below = (self.lo, self.below) if self.left is None else (self.left, left[1])
            self.hi, end = (self.hi, end) if self.right is None else (self.right, right[0])
        elif self.rank < right[1]:
            self.found = self.right
        else:
            self.lo, self.below = self.right, right[1]
        self.inside = end - self.below


def literal(value: Any, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast(dtype)
    return F.lit(value)


def ordinal(column: str, dtype: T.DataType) -> tuple[Column, T.DataType]:
    """A column in the form in which its values are compared: instants as microseconds, the rest as they are."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(F.col(f"`{column}`")), T.LongType()
    return F.col(f"`{column}`"), dtype


def select_ranks(df: DataFrame, targets: Sequence[RankTarget]) -> dict[str, tuple[int, Any, Any]]:
    """``label -> (non-null count, value at the low rank, value at the high rank)``.

    Values keep their type (instants are microseconds); NaN ranks above all numbers. Columns without values
    are left out. Runs a handful of jobs, each returning one row.
    """
    columns = list(dict.fromkeys(t.column for t in targets))
    forms = {f"v{i}": ordinal(c, df.schema[c].dataType) for i, c in enumerate(columns)}
    names = {c: f"v{i}" for i, c in enumerate(columns)}
    numbers = {v: _number(*form) for v, form in forms.items()}
    values = df.select(*[c.alias(v) for v, c in numbers.items()])
    first = df.agg(
        *[
            F.struct(
                F.count(forms[v][0]).alias("n"),
                F.count(c).alias("numbers"),
                F.min(c).alias("least"),
                F.max(c).alias("most"),
                *([] if isinstance(forms[v][1], UNSKETCHED) else [_grid(c, forms[v][1]).alias("grid")]),
            ).alias(v)
            for v, c in numbers.items()
        ]
    ).first()

    searches: dict[tuple[str, int], _Search] = {}
    answers: dict[tuple[str, int], Any] = {}
    wanted: dict[str, tuple[int, tuple[str, int], tuple[str, int]]] = {}
    for t in targets:
        v = names[t.column]
        n, inside, least, most = (first[v][k] for k in ("n", "numbers", "least", "most"))
        if not n:
            continue
        ranks = [min(max(int(rank(n)), 0), n - 1) for rank in (t.low, t.high)]
        wanted[t.label] = (n, (v, ranks[0]), (v, ranks[1]))
        for rank in ranks:
            if rank >= inside:
                answers[v, rank] = math.nan
            else:
                searches[v, rank] = _Search(v, forms[v][1], rank, inside, least, most)

    grids = {(v, None, None): first[v]["grid"] for v in names.values() if "grid" in first[v]}
    pending = [s for s in searches.values() if s.inside > SMALL_BRACKET]
    while pending:
        # Searches that are in the same part of a column share its sketch.
        parts = {s.part(): s for s in pending if s.part() not in grids}
        grids |= zip(parts, _grids(values, list(parts.values())))
        for s in pending:
            s.propose(grids[s.part()], SAMPLE_MARGIN if isinstance(s.dtype, UNSKETCHED) else 1)
        counted = values.agg(*[s.counts().alias(f"c{i}") for i, s in enumerate(pending)]).first()
        for i, s in enumerate(pending):
            s.settle(counted[f"c{i}"])
        pending = [s for s in pending if s.found is None and s.inside > SMALL_BRACKET]

    answers |= {k: s.found for k, s in searches.items() if s.found is not None}
    answers |= _pick(values, {k: s for k, s in searches.items() if s.found is None})
    return {label: (n, answers[low], answers[high]) for label, (n, low, high) in wanted.items()}


def _number(column: Column, dtype: T.DataType) -> Column:
    """The column without NaN, which no sketch can place."""
    return F.when(~F.isnan(column), column) if isinstance(dtype, (T.FloatType, T.DoubleType)) else column


def _sketch(column: str | Column, points: int = GRID) -> Column:
    """The values of ``column`` at evenly spaced quantiles, both ends included."""
    return F.percentile_approx(column, [i / points for i in range(points + 1)], 10 * points)


def _grid(column: Column, dtype: T.DataType) -> Column:
    """``GRID + 1`` values of ``column`` to propose bounds from. Numbers have a sketch that takes a fraction of the time;
    its points are values too, and as the counts decide, not the sketch, the ranks found are the same."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        kind, fold, quantile = "double", F.kll_sketch_agg_double, F.kll_sketch_get_quantile_double
    elif isinstance(dtype, T.IntegralType):
        kind, fold, quantile = "long", F.kll_sketch_agg_bigint, F.kll_sketch_get_quantile_bigint
    else:
        return _sketch(column)
    places = F.expr(f"array({', '.join(f'{i / GRID}D' for i in range(GRID + 1))})")
    return F.when(F.count(column) > 0, quantile(fold(column.cast(kind), SKETCH_SIZE), places))


def _grids(values: DataFrame, parts: Sequence[_Search]) -> list[Sequence[Any]]:
    """Per part ``GRID + 1`` of its values, about evenly spaced."""
    sketched = [i for i, s in enumerate(parts) if not isinstance(s.dtype, UNSKETCHED)]
    found: dict[int, Sequence[Any]] = {}
    if sketched:
        row = values.agg(
            *[_grid(F.when(parts[i].rows(), F.col(parts[i].column)), parts[i].dtype).alias(f"g{i}") for i in sketched]
        ).first()
        found = {i: row[f"g{i}"] for i in sketched}
    for i, s in enumerate(parts):
        if i not in found:
            rows = values.where(s.rows()).orderBy(F.rand(1)).limit(SAMPLE).select(s.column).collect()
            sample = sorted(r[0] for r in rows)
            found[i] = [sample[round(k * (len(sample) - 1) / GRID)] for k in range(GRID + 1)]
    return [found[i] for i in range(len(parts))]


def _pick(values: DataFrame, searches: dict[tuple[str, int], _Search]) -> dict[tuple[str, int], Any]:
    """Order the distinct values of each remaining part, at most ``SMALL_BRACKET``, and read off the rank.

    Entries are filtered after they are exploded. A filter before that would be moved below the projections, where the
    expression of a column is computed anew for each of its many comparisons.
    """
    answers = {}
    for dtype in {s.dtype for s in searches.values()}:
        same = {k: s for k, s in searches.items() if s.dtype == dtype}
        parts = list({s.part(): s for s in same.values()}.items())
        number = {part: i for i, (part, _) in enumerate(parts)}
        entries = [
            F.when(s.rows(), F.struct(F.lit(number[part]).alias("part"), F.col(s.column).alias("value")))
            for part, s in parts
        ]
        ranked = (
            values.select(F.explode(F.array(*entries)).alias("e"))
            .where(F.col("e").isNotNull())
            .groupBy(F.col("e.part").alias("part"), F.col("e.value").alias("value"))
            .agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("through", F.sum("rows").over(W.partitionBy("part").orderBy("value")))
        )
        reached = {
            k: (F.col("part") == number[s.part()]) & (F.col("through") > s.rank - s.below) for k, s in same.items()
        }
        row = ranked.agg(*[F.min(F.when(r, F.col("value"))).alias(f"a{i}") for i, r in enumerate(reached.values())]).first()
        answers |= dict(zip(reached, row))
    return answers


def exact_quantiles(
    df: DataFrame, wanted: Sequence[tuple[str, str, float]]
) -> dict[str, float | None]:
    """Continuous percentiles of ``(label, column, p)``, interpolated; ``None`` for no values."""
    columns = list(dict.fromkeys(column for _, column, _ in wanted))
    numeric = {c: isinstance(df.schema[c].dataType, T.NumericType) for c in columns}
    picked = select_ranks(
        df.select(*[F.col(f"`{c}`") if numeric[c] else F.col(f"`{c}`").cast("double").alias(c) for c in columns]),
        [
            RankTarget(
                label,
                column,
                lambda n, p=p: math.floor(p * (n - 1)),
                lambda n, p=p: math.ceil(p * (n - 1)),
            )
            for label, column, p in wanted
        ],
    )
    found: dict[str, float | None] = {}
    for label, _, p in wanted:
        if label not in picked:
            found[label] = None
            continue
        n, low, high = picked[label]
        place = p * (n - 1)
        found[label] = _between(low, high, place - math.floor(place))
    return found


def _between(low: Any, high: Any, share: float) -> float:
    """The value a ``share`` of the way up; rounded once where a double does not hold the ends."""
    if isinstance(low, float) or max(abs(low), abs(high)) <= EXACT_AS_DOUBLE:
        return float(low) + (float(high) - float(low)) * share
    return float(Fraction(low) + (Fraction(high) - Fraction(low)) * Fraction(share))


def cumulative_counts(
    df: DataFrame, family: Sequence[str], value: str, buckets: int | None = None
) -> DataFrame:
    """Per family and distinct value: ``rows``, ``rows_before``, ``rows_through``, ``family_rows``.

    NULL values are left out; NULL is a family like any other. ``buckets`` is a power of two; unless it is given it
    grows with the rows, so that no bucket outgrows a task.
    """
    keys = list(family)
    if buckets is None:
        buckets = max(BUCKETS, 1 << math.ceil(df.count() / BUCKET_ROWS - 1).bit_length())
    counted = df.where(F.col(value).isNotNull())
    distinct = counted.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("rows"))
    # The sketch reads the counts too, so that it uses the shuffle that made them.
    seen = distinct.select(F.when(F.col("rows") > 0, F.col(value)).alias("v"), "rows")
    cuts = one_row(seen.agg(_sketch("v", buckets).alias("cuts"), F.sum("rows").alias("rows")))["cuts"]
    bucketed = _with_bucket(distinct.withColumn("__cuts", cuts), value, buckets).drop("__cuts")
    of_family = W.partitionBy(*keys)
    offsets = (
        bucketed.groupBy(*keys, "__bucket")
        .agg(F.sum("rows").alias("__rows"))
        .select(
            *keys,
            "__bucket",
            (F.sum("__rows").over(of_family.orderBy("__bucket")) - F.col("__rows")).alias("__offset"),
            F.sum("__rows").over(of_family).alias("family_rows"),
        )
    )
    in_bucket = W.partitionBy(*keys, "__bucket").orderBy(value)
    return (
        null_safe_join(bucketed, offsets, [*keys, "__bucket"])
        .withColumn("rows_through", F.col("__offset") + F.sum("rows").over(in_bucket))
        .select(
            *keys,
            value,
            "rows",
            (F.col("rows_through") - F.col("rows")).alias("rows_before"),
            "rows_through",
            "family_rows",
        )
    )


def _with_bucket(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """Number of inner cut points below the value, found by halving: one comparison per step."""
    df = df.withColumn("__bucket", F.lit(0))
    step = buckets // 2
    while step:
        above = F.col("__cuts")[F.col("__bucket") + step] < F.col(value)
        df = df.withColumn("__bucket", F.col("__bucket") + F.when(above, step).otherwise(0))
        step //= 2
    return df


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that pairs NULL keys with NULL keys and keeps the left key columns."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`__right_{k}`")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"__right_{k}" for k in keys])


def lookup(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a one-row-per-key table onto a table whose keys may be skewed; NULL keys pair up.

    No side is repeated: a key that turns out heavy is split at run time by adaptive execution
    (``spark.sql.adaptive.skewJoin.enabled``), which repeats only the lookup rows of that partition.
    """
    return null_safe_join(big, small, keys, how)
