"""V4: is every number in a text backed by some evidence value?"""

from __future__ import annotations

import math
import sys
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import fixed_values as fixed
from plumbline.functions.text import number_tokens, number_value

# Largest number of rows the band table may have to be sent to every task.
BROADCAST_BANDS = 500_000
NOWHERE = 1 << 50
SPREAD = 1 << 20


def number_rows(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per number of a text: keys, place in the text, token and value."""
    return _token_rows(df, text, keys, F.posexplode).where(F.col("number").isNotNull())


def _token_rows(df: DataFrame, text: str, keys: list[str], explode: Callable[[Column], Column]) -> DataFrame:
    tokens = df.select(*keys, explode(number_tokens(F.col(f"`{text}`"))).alias("place", "token"))
    return tokens.withColumn("number", number_value(F.col("token")))


def evidence_bands(evidence: DataFrame, value: str, tolerance: float = fixed.NUMBER_TOLERANCE) -> DataFrame:
    """Evidence folded to one row per band it can ground: ``(sign, band, below, same, above)``.

    Bands are slightly narrower than the tolerance on a log scale, so two values of one band are
    always close enough, and a value can only reach two bands up or down. For each band it is
    enough to keep the nearest evidence on either side, so no pair of numbers is ever formed. The
    number of rows is bounded by the range of a double, not by the evidence.
    """
    v = F.col(f"`{value}`").cast("double")
    finite = evidence.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    folded = finite.groupBy(F.signum("v").alias("sign"), _band(F.abs("v"), tolerance).alias("own")).agg(
        F.min(F.abs("v")).alias("least"), F.max(F.abs("v")).alias("most")
    )
    reach = F.when(F.col("sign") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(-2), F.lit(2)))
    shifted = folded.withColumn("shift", F.explode(reach))
    return shifted.groupBy("sign", (F.col("own") + F.col("shift")).alias("band")).agg(
        F.max(F.when(F.col("shift") > 0, F.col("most"))).alias("below"),
        F.max(F.when(F.col("shift") == 0, F.col("least"))).alias("same"),
        F.min(F.when(F.col("shift") < 0, F.col("least"))).alias("above"),
    )


def grounded_numbers(
    numbers: DataFrame, evidence: DataFrame, value: str, tolerance: float = fixed.NUMBER_TOLERANCE
) -> DataFrame:
    """Add ``grounded`` to number rows. A percent is looked up as a fraction and as written."""
    bands = evidence_bands(evidence, value, tolerance)
    if band_bound(tolerance) <= BROADCAST_BANDS:
        bands = F.broadcast(bands)
    as_written = F.when(F.col("token").endswith("%"), F.col("number") * 100)
    found = _looked_up(numbers, bands, F.col("number"), tolerance, "__plain")
    found = _looked_up(found, bands, as_written, tolerance, "__percent")
    return found.withColumn("grounded", F.col("__plain") | F.col("__percent")).drop("__plain", "__percent")


def _looked_up(numbers: DataFrame, bands: DataFrame, number: Column, tolerance: float, flag: str) -> DataFrame:
    # Rows that look nothing up would all meet under NULL; they go to bands that no double has.
    nowhere = F.lit(NOWHERE) + F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in numbers.columns]), F.lit(SPREAD))
    keyed = numbers.withColumns(
        {
            "sign": F.coalesce(F.signum(number), F.lit(0.0)),
            "band": F.coalesce(_band(F.abs(number), tolerance), nowhere),
        }
    )
    same = F.when(number == 0, F.col("same").isNotNull())
    for c in ("below", "same", "above"):
        same = same.when(F.abs(F.abs(number) - F.col(c)) / F.col(c) <= tolerance, True)
    return (
        keyed.join(bands, ["sign", "band"], "left")
        .withColumn(flag, F.coalesce(same, F.lit(False)))
        .drop("sign", "band", "below", "same", "above")
    )


def number_lint(
    df: DataFrame,
    text: str,
    keys: list[str],
    evidence: DataFrame,
    value: str,
    tolerance: float = fixed.NUMBER_TOLERANCE,
) -> DataFrame:
    """V4: per text the count of grounded and ungrounded numbers and whether all are grounded.

    A text without numbers, or no text at all, passes.
    """
    checked = grounded_numbers(_token_rows(df, text, keys, F.posexplode_outer), evidence, value, tolerance)
    checked = checked.withColumn("grounded", F.when(F.col("number").isNotNull(), F.col("grounded")))
    return checked.groupBy(*keys).agg(
        F.count_if("grounded").alias("grounded"),
        F.count_if(~F.col("grounded")).alias("ungrounded"),
        F.coalesce(F.min("grounded"), F.lit(True)).alias("passed"),
    )


def band_bound(tolerance: float) -> int:
    """The most rows a band table can have: both signs over the exponent range of a double."""
    return 2 * math.ceil((math.log(sys.float_info.max) - math.log(5e-324)) / _width(tolerance)) + 8


def _width(tolerance: float) -> float:
    return math.log1p(tolerance) * 0.999


def _band(size: Column, tolerance: float) -> Column:
    scaled = F.floor(F.log(size) / F.lit(_width(tolerance)))
    return F.when(size > 0, scaled).when(size == 0, F.lit(0)).cast("long")
