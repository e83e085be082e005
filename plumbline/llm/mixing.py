"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. Its documents get the whole copies that the target holds for all
of them; the rest of the target is a sample. Documents are ranked by random odds over inclusion odds,
``u / (1 - u) : l / (1 - l)``, and taken from the smallest on until the words are filled. The inclusion
odds are those of the source's remaining share, tilted by the square root of mean size over size: the
same words then come from more different documents. Last, one document after the cut closes the gap if
its size fits the gap better than nothing does.

The random number is a hash of the document, so every run makes the same choice. No source is sorted
whole: ranks are cut into bins of about ``BIN_ROWS`` rows, bins are summed, and only the bin in which
the words run out is ordered. Sources travel as one row each, never as rows of documents.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.llm.texts import small_side, stored

WEIGHTS = (5, 2, 1)
CAP = 3
BIN_ROWS = 2_000
#: Parts into which rows that are alike are dealt to be numbered.
SHARDS = 64
# Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(docs: DataFrame, source: str, size: str, weights: Sequence[int], cap: int) -> DataFrame:
    """One row per source: ``key``, ``source_size``, ``rows``, ``target``.

    Sources in code point order, NULL last, take the weights in turn. The level at which weights fill
    the whole is the largest that any number of full sources leaves for the rest.
    """
    sums = docs.groupBy(F.col(f"`{source}`").alias("s")).agg(
        F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(size) > 0).alias("sized")
    )
    turn = (F.row_number().over(W.orderBy(F.col("s").asc_nulls_last())) - 1) % len(weights)
    sums = sums.withColumn("w", F.array(*[F.lit(w) for w in weights])[turn]).withColumn("full", F.col("source_size") * cap)
    order = W.orderBy(F.col("full") / F.col("w"), F.col("s").asc_nulls_last())
    before = F.coalesce(F.sum("full").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    whole = W.partitionBy()
    levels = sums.withColumn("level", (F.sum("source_size").over(whole) - before) / ahead)
    return levels.select(
        source_key(F.col("s")).alias("key"),
        "source_size",
        "sized",
        F.least(F.col("full").cast("double"), F.max("level").over(whole) * F.col("w")).alias("target"),
    )


def source_key(source: Column) -> Column:
    """Sources as text that is never NULL."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def rank(doc_id: Column, size: Column, share: Column, mean: Column) -> Column:
    """Random odds over inclusion odds, as a number from 0 to 1 in the same order."""
    number = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("~"))), 1, 12), 16, 10).cast("double")
    u = (number + 0.5) / float(1 << 48)
    inclusion = share / (1 - share) * F.sqrt(mean / size)
    ratio = (u / (1 - u)) / inclusion
    return ratio / (1 + ratio)


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    size: str = "size",
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
    bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` (its source's), ``copies`` and ``taken`` (words).

    ``size`` is a column of counts. All sizes together are shared by weight; a target stops at ``cap``
    times its source's size and the excess is shared among the rest. Documents of size 0 get the whole
    copies and take nothing. Rows that repeat id, source and size are interchangeable: of those at the cut as many
    are taken as the words allow, by their place in the table. A NULL id counts as one id, a NULL source as one
    source. Other columns are kept, those named like a result are replaced; an empty table gives an empty result.
    Pass a stored table or one whose sizes are cheap: it is read several times.
    """
    taken_names = ["source_size", "target", "copies", "taken"]
    rest = docs.drop(*[c for c in docs.columns if c in taken_names])
    slim = docs.select(
        F.col(f"`{doc_id}`").alias("id"), source_key(F.col(f"`{source}`")).alias("key"), F.col(size).alias("size")
    )
    shares = targets(docs, source, size, weights, cap)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    shares = shares.withColumn("whole", copies.cast("long")).withColumn(
        "words", F.col("target") - F.col("whole") * F.col("source_size")
    )
    shares = stored(shares, "targets")
    share, mean = F.col("words") / F.col("source_size"), F.col("source_size") / F.col("sized")
    bins = F.ceil(F.col("sized") / bin_rows)
    sampled = small_side(
        shares.where("words > 0").select("key", "words", share.alias("share"), mean.alias("mean"), bins.alias("bins"))
    )
    ranked = slim.where("size > 0").join(sampled, "key").withColumn("p", rank(F.col("id"), F.col("size"), F.col("share"), F.col("mean")))
    ranked = ranked.withColumn("bin", F.floor(F.col("p") * F.col("bins"))).select("key", "id", "size", "p", "bin", "words")

    upward = W.partitionBy("key").orderBy("bin")
    crossed = (
        ranked.groupBy("key", "bin", "words")
        .agg(F.sum("size").alias("n"))
        .withColumn("before", F.sum("n").over(upward) - F.col("n"))
        .where("before <= words and words < before + n")
        .select("key", "bin", "before")
    )
    crossed = stored(crossed, "crossed")
    # Rows that are alike in all three are interchangeable and one step of the sum, of which a part may be taken.
    place = F.struct(*place_columns())
    steps = ranked.join(small_side(crossed), ["key", "bin"]).groupBy("key", "p", "id", "size", "words", "before").agg(F.count(F.lit(1)).alias("n"))
    upward = W.partitionBy("key").orderBy("p", F.col("id").asc_nulls_first(), "size")
    inside = steps.withColumn("through", F.col("before") + F.sum(F.col("size") * F.col("n")).over(upward))
    reached = F.col("through") <= F.col("words")
    left = F.col("words") - (F.col("through") - F.col("size") * F.col("n"))
    partly = F.struct(*place_columns(), F.floor(left / F.col("size")).cast("long").alias("k"))
    cut = inside.groupBy("key").agg(
        F.max(F.when(reached, place)).alias("last"),
        F.max(F.when(reached, F.col("through"))).alias("filled"),
        F.min(F.when(~reached & (left >= F.col("size")), partly)).alias("split"),
        F.first("words").alias("words"),
        F.first("before").alias("before"),
        F.min("p").alias("first_p"),
    )
    # Without a last one inside, the cut lies before the bin. Only the first step that is not reached can hold more.
    of_split = F.coalesce(F.col("split.k") * F.col("split.size"), F.lit(0))
    cut = stored(cut.withColumn("gap", F.col("words") - F.coalesce("filled", "before") - of_split), "cut")
    edges = small_side(cut.select("key", "gap", "last", "first_p"))
    after = F.when(F.col("last").isNull(), F.col("p") >= F.col("first_p")).otherwise(place > F.col("last"))
    closing = (
        ranked.join(edges, "key")
        .where(after & (F.abs(F.col("gap") - F.col("size")) < F.col("gap")))
        .groupBy("key")
        .agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("miss"), "p", "id", "size")).alias("c"))
        .select("key", F.struct("c.p", "c.id", "c.size").alias("closing"))
    )
    closing = stored(closing, "closing")
    # One that stands for several rows would overfill.
    alone = ranked.join(small_side(closing), "key").where(place.eqNullSafe(F.col("closing")))
    alone = alone.groupBy("key", "closing").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")

    decided = (
        shares.join(cut.select("key", "last", "first_p", "split", F.lit(True).alias("is_cut")), "key", "left")
        .join(alone, "key", "left")
        .select(
            F.col("key").alias("__key"),
            F.struct("source_size", "target", "whole", "words", share.alias("share"), mean.alias("mean"), "last", "first_p", "split", "is_cut", "closing").alias("__m"),
        )
    )
    decided = stored(decided, "decided")
    rows = rest.withColumns({"__key": source_key(F.col(f"`{source}`")), "__row": F.monotonically_increasing_id()})
    joined = rows.join(small_side(decided), "__key")
    m = F.col("__m")
    p = rank(F.col(f"`{doc_id}`"), F.col(size), m["share"], m["mean"])
    mine = F.struct(p.alias("p"), F.col(f"`{doc_id}`").alias("id"), F.col(size).alias("size"))
    within = F.when(m["last"].isNull(), p < m["first_p"]).otherwise(mine <= m["last"])
    # Without a cut the sample takes every document.
    chosen = F.when(m["is_cut"].isNull(), True).otherwise(within | mine.eqNullSafe(m["closing"]))
    if cut.where("split IS NOT NULL").take(1):
        is_split = m["split"].isNotNull() & mine.eqNullSafe(F.struct("__m.split.p", "__m.split.id", "__m.split.size"))
        joined = joined.withColumn("__split", F.coalesce(is_split, F.lit(False)))
        joined = joined.where("NOT __split").withColumn("__taken", F.lit(False)).unionByName(_some_of_each(joined.where("__split")))
        chosen = chosen | F.col("__taken")
    extra = F.when((m["words"] > 0) & (F.col(size) > 0) & F.coalesce(chosen, F.lit(False)), 1).otherwise(0)
    return (
        joined.withColumns({"source_size": m["source_size"], "target": m["target"], "copies": m["whole"] + extra})
        .withColumn("taken", F.col("copies") * F.col(size))
        .drop("__key", "__m", "__row", "__split", "__taken")
    )


def place_columns() -> list[Column]:
    return [F.col(c) for c in ("p", "id", "size")]


def _some_of_each(rows: DataFrame) -> DataFrame:
    """Rows that are alike, with ``__taken`` for as many per source as its split says.

    They are dealt into ``SHARDS`` by their place in the table and numbered within these, so that a source whose
    rows are all alike is not numbered in one task.
    """
    dealt = rows.withColumn("__shard", F.pmod(F.xxhash64("__row"), F.lit(SHARDS)).cast("int"))
    counts = stored(dealt.groupBy("__key", "__shard").agg(F.count(F.lit(1)).alias("__n")), "alike")
    before = F.sum("__n").over(W.partitionBy("__key").orderBy("__shard")) - F.col("__n")
    offsets = stored(counts.select("__key", "__shard", before.alias("__before")), "alike-offsets")
    number = F.row_number().over(W.partitionBy("__key", "__shard").orderBy("__row"))
    numbered = dealt.withColumn("__number", number).join(small_side(offsets), ["__key", "__shard"])
    taken = F.col("__before") + F.col("__number") <= F.col("__m.split.k")
    return numbered.withColumn("__taken", taken).drop("__shard", "__number", "__before")
