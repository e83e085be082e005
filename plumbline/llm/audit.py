"""How filters interact, from truth-table survival words.

With five filters there are 32 subsets of them. A document's survival word has one bit per subset: it is
set if the document passes every filter of that subset. Adding up the words bit by bit gives how many
documents survive each subset, and everything else follows from those 32 numbers: what is left after any
step of any order, what a step removes, what only one filter finds, and each filter's share of the removals
over all orders.

Bits are added by carry-save adders: three words become a word of sums and a word of carries at twice the
weight, until one word per power of two is left. Tasks add up their own rows by part and label; sums of
32 numbers are all that is shuffled. Whether an earlier document has the same text is one aggregate over
digests of texts, joined back only for texts that occur again.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.texts import small_side, stored

# The filters in the order of their bits, a word, and the limits.
FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 3
SUBSETS = 1 << len(FILTERS)
#: Parts whose sums a task holds before it hands them on.
PARTS_HELD = 4096


def survival_mask(filter_bit: int) -> int:
    """The bits of the subsets that hold the filter: those a document that fails it does not survive."""
    return sum(1 << s for s in range(SUBSETS) if s >> filter_bit & 1)


def survival_word(failures: list[Column]) -> Column:
    """One bit per subset of filters, as a 32-bit integer."""
    word = F.lit(-1)
    for i, failed in enumerate(failures):
        keep = ~survival_mask(i) & 0xFFFFFFFF
        signed = keep - (1 << 32) if keep >> 31 else keep
        word = word.bitwiseAND(F.when(failed, F.lit(signed)).otherwise(F.lit(-1)))
    return word.cast("int")


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of ``words`` (32 bits each) have each bit set, by carry-save adders."""
    counts = np.zeros(32, np.int64)
    places = np.arange(32, dtype=np.uint32)
    level, weight = np.asarray(words, np.uint32), 1
    while len(level):
        carries = []
        while len(level) > 1:
            if len(level) == 2:
                a, b, c = level[:1], level[1:], np.zeros(1, np.uint32)
            else:
                n = len(level) // 3
                a, b, c = level[:n], level[n : 2 * n], level[2 * n : 3 * n]
            half = a ^ b
            carries.append((a & b) | (c & half))
            level = np.concatenate([half ^ c, level[3 * len(a) :]])
        counts += weight * (level[0] >> places & 1).astype(np.int64)
        level, weight = np.concatenate(carries) if carries else np.zeros(0, np.uint32), weight * 2
    return counts


def failures_of_text(text: Column) -> list[Column]:
    """Filters A to D: few words, few different words, many capitals, a symbol."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return [
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < MIN_DISTINCT_PERCENT * F.size(words).cast("long"),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MAX_UPPER_PERCENT * F.length(text).cast("long"),
        text.rlike(SYMBOLS),
    ]


def survival_words(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """One row per document: ``part``, ``good``, ``toxic``, ``word``."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    slim = docs.select(
        F.col(f"`{doc_id}`").alias("id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"),
        *[f.alias(n) for f, n in zip(failures_of_text(whole), FILTERS)],
    )
    slim = stored(slim, "audit-documents")
    first = slim.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    again = stored(first.where("last > first").select("digest", "first"), "audit-repeated")
    told = (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").alias("id"))
        .agg(
            F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
            F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
        )
        .where("good OR toxic")
    )
    joined = slim.join(small_side(again), "digest", "left").join(small_side(stored(told, "audit-labels")), "id", "left")
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return joined.select(
        "part",
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
        survival_word([*[F.col(n) for n in FILTERS[:-1]], later]).alias("word"),
    )


def survivors(words: DataFrame) -> DataFrame:
    """``part`` and arrays of 32 counts, one per subset of filters: ``every``, ``good`` and ``toxic`` survivors."""
    columns = [f"s{i}" for i in range(SUBSETS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def flushed():
            keys, table = list(sums), np.array(list(sums.values()), np.int64).reshape(-1, SUBSETS)
            sums.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([bool(k[1] & 1) for k in keys], pa.bool_()),
                    pa.array([bool(k[1] & 2) for k in keys], pa.bool_()),
                    *[pa.array(table[:, i]) for i in range(SUBSETS)],
                ],
                names=["part", "good", "toxic", *columns],
            )

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            names = coded.dictionary.to_pylist()
            label = batch.column(1).to_numpy(zero_copy_only=False) + 2 * batch.column(2).to_numpy(zero_copy_only=False)
            key = coded.indices.to_numpy().astype(np.int64) * 4 + label
            word = batch.column(3).to_numpy().view(np.uint32)
            order = np.argsort(key, kind="stable")
            found, starts = np.unique(key[order], return_index=True)
            for k, own in zip(found.tolist(), np.split(word[order], starts[1:])):
                at = (names[k // 4], k % 4)
                sums[at] = sums.get(at, 0) + positional_popcount(own)
            if len(sums) > PARTS_HELD:
                yield flushed()
        yield flushed()

    schema = "part string, good boolean, toxic boolean, " + ", ".join(f"{c} long" for c in columns)
    added = words.select("part", "good", "toxic", "word").mapInArrow(run, schema)
    kinds = {"every": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    summed = added.groupBy("part").agg(
        *[
            F.coalesce(F.sum(F.when(chosen, F.col(c))), F.lit(0)).alias(f"{kind}_{c}")
            for kind, chosen in kinds.items()
            for c in columns
        ]
    )
    return summed.select("part", *[F.array(*[f"{kind}_{c}" for c in columns]).alias(kind) for kind in kinds])


def filter_audit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """One row per part, order of the filters and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``,
    ``good_lost``, ``toxic_lost``, ``shapley``.

    Filters: A few words, B few different words, C many capitals, D a symbol, E the same text under a smaller
    id. NULL texts are empty ones, and so alike; a NULL part counts as an empty one. A NULL id is neither smaller
    nor larger than another and has no label; rows repeating an id are documents of their own, of which none is
    earlier. A document is good or toxic if any of its label rows says so. Texts of any length are read whole, other
    columns are not read; an empty table gives an empty result.
    """
    per_part = survivors(survival_words(docs, labels, doc_id, text, part))
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)]))
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))
    rows = per_part.select("*", orders.alias("filter_order")).select("*", steps.alias("step"))

    def subset(letters: Column) -> Column:
        return sum((F.when(F.instr(letters, n) > 0, 1 << i).otherwise(0) for i, n in enumerate(FILTERS)), F.lit(0))

    letter = F.expr("substring(filter_order, step, 1)")
    rows = rows.withColumns(
        {
            "own": subset(letter),
            "before": subset(F.expr("substring(filter_order, 1, step - 1)")),
            "after": subset(F.expr("substring(filter_order, 1, step)")),
        }
    )

    def alive(kind: str, place: Column) -> Column:
        return F.get(F.col(kind), place)

    own, before, after, last = F.col("own"), F.col("before"), F.col("after"), SUBSETS - 1
    removed = {k: alive(k, before) - alive(k, after) for k in ("every", "good", "toxic")}
    failing = alive("every", F.lit(0)) - alive("every", own)
    # In how many orders exactly the filters of a subset come before one that it does not hold.
    n = len(FILTERS)
    orders_of = [factorial(s.bit_count()) * factorial(max(n - 1 - s.bit_count(), 0)) for s in range(SUBSETS)]
    shares = [
        F.when(own.bitwiseAND(F.lit(s)) == 0, (F.col("every")[s] - alive("every", own.bitwiseOR(F.lit(s)))) * orders_of[s]).otherwise(0)
        for s in range(last)
    ]
    return rows.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        alive("every", after).alias("kept"),
        removed["every"].alias("removed"),
        (failing - removed["every"]).alias("redundant"),
        (alive("every", F.lit(last).bitwiseXOR(own)) - alive("every", F.lit(last))).alias("unique_fails"),
        removed["good"].alias("good_lost"),
        removed["toxic"].alias("toxic_lost"),
        sum(shares, F.lit(0).cast("long")).cast("long").alias("shapley"),
    )
