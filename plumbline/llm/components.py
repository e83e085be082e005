"""Connected components of links, as joins and aggregates that repeat until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.llm.texts import stored


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (``a``, ``b`` long): root is the smallest reachable.

    Alternating stars: in the large-star step every node points its larger neighbours at the smallest
    neighbour, in the small-star step its smaller ones. Each step is one aggregate, which folds before
    the shuffle, and one join whose larger side adaptive execution may split, so the centre of a star
    with a third of all nodes is no hot spot. Every round is written to the shared folder.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = stored(pairs.distinct(), "links")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        pairs = stored(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        seen = pairs.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        if seen == before:
            break
        before = seen
    # No change means stars: every node points at the smallest of its component.
    tips = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return tips.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
