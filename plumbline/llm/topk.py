"""Exact top-k search by whole-number inner products, pruned a block at a time.

Components become whole numbers, ``floor(64 x)``; a component is a term, its number the term's weight. Rows
are laid out so that similar ones are neighbours, and cut into ranges of ``BLOCK`` rows. A block has a forward
index, the weights of its rows, and for each term the smallest and the largest weight in it. Summed over a
query's terms, the largest weight for a positive one and the smallest for a negative one, these bound every
score in the block. A query takes the blocks by falling bound, scores each through its forward index, and stops
as soon as the bound falls below its k-th score.

Blocks are kept in shards, one per range of rows. A query first searches its own shard, which gives it a k-th
score; it then goes only to the shards whose own maxima reach that score. Shards meet queries in groups of
bounded size, and every task returns at most ``k`` rows per query. The layout is fitted on a bounded sample;
it decides how much is pruned, never what is found.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.llm.texts import stored

# Fixed value: components are multiplied by this before they are rounded down.
SCALE = 64
#: Weights saturate here either way, so that sums over 500 components fit into 64 bits.
LIMIT = 1 << 27
BLOCK = 256
#: Rows of a shard: a part of the table, but not fewer and not more than these.
SHARDS, SHARD_ROWS = 48, (4096, 131_072)
QUERY_ROWS = 32_768
QUERIES_AT_ONCE = 512
#: Rows that the layout is fitted on, the number of its centres, and its rounds.
SAMPLE_ROWS, CENTRES, ROUNDS = 4096, 64, 6
#: Bytes of all shards' maxima that may be sent to every task.
SUMMARY_BYTES = 64 << 20
NO_ID = np.iinfo(np.int64).max


def quantised(vector) -> F.Column:
    """Whole numbers from an array of numbers, within ``LIMIT``."""
    scaled = F.transform(vector, lambda x: F.least(F.greatest(x * SCALE, F.lit(-float(LIMIT))), F.lit(float(LIMIT))))
    return F.transform(scaled, lambda x: F.floor(x).cast("int"))


def matrix(rows: list, width: int | None = None) -> np.ndarray:
    """Lists of whole numbers as one table; what a shorter one lacks is zero."""
    width = max([len(r) for r in rows], default=0) if width is None else width
    table = np.zeros((len(rows), width), np.int32)
    for i, row in enumerate(rows):
        n = min(len(row), width)
        table[i, :n] = row[:n]
    return table


def fitted(query: np.ndarray, width: int) -> np.ndarray:
    return np.pad(query[:width], (0, max(0, width - len(query))))


def exact_type(peak: float, width: int):
    """Doubles hold every sum of the products exactly, or whole numbers are needed."""
    return np.float64 if peak * width < 2.0**53 else np.int64


def centres_of(sample: np.ndarray, count: int = CENTRES, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of groups of similar rows: spread-out rows, moved to the mean of what is nearest."""
    rows = sample.astype(np.float64)
    chosen, apart = [0], np.full(len(rows), np.inf)
    for _ in range(1, min(count, len(rows))):
        apart = np.minimum(apart, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
        if apart.max() == 0:
            break
        chosen.append(int(apart.argmax()))
    centres = rows[chosen]
    for _ in range(rounds):
        near = nearest_centre(rows, centres)
        for c in np.unique(near):
            centres[c] = rows[near == c].mean(axis=0)
    return centres


def nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


INDEX = "shard int, block int, width int, ids array<long>, weights binary, low binary, high binary"


def forward_index(usable: DataFrame, centres: np.ndarray, shards: int, block: int = BLOCK) -> DataFrame:
    """One row per block of ``usable`` (``id``, ``w``): its rows' weights and the bounds of every term."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(1).to_pylist(), centres.shape[1]).astype(np.float64)
            near = pa.array(nearest_centre(rows, centres).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, near], names=["id", "w", "row", "centre"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, shard, number = [], [], 0, 0

        def packed():
            table = matrix(rows)
            low, high = table.min(axis=0), table.max(axis=0)
            values = [[shard], [number], [table.shape[1]], [ids[:]], [table.tobytes()], [low.tobytes()], [high.tobytes()]]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            ids.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, types)], names=[c.split()[0] for c in INDEX.split(", ")]
            )

        for batch in batches:
            for i, w, shard in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(i)
                rows.append(w)
                if len(rows) >= block:
                    yield packed()
                    number += 1
        if rows:
            yield packed()

    numbered = usable.select("id", "w", F.monotonically_increasing_id().alias("row"))
    placed = numbered.mapInArrow(place, "id long, w array<int>, row long, centre int")
    # The number of the row keeps equal rows apart, so that no range is larger than the others.
    order = ["centre", "id", "row"]
    ranges = placed.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return ranges.select("id", "w", F.spark_partition_id().alias("shard")).mapInArrow(cut, INDEX)


class Blocks:
    """The blocks of a shard, ready to be searched."""

    def __init__(self, table: pa.Table):
        columns = {n: table.column(n).to_pylist() for n in table.column_names}
        order = sorted(range(len(table)), key=lambda i: columns["block"][i])
        self.width = max(columns["width"], default=0)
        self.ids, self.weights, self.low, self.high = [], [], [], []
        for i in order:
            own = columns["width"][i]
            ids = columns["ids"][i]
            self.ids.append(np.array([NO_ID if v is None else v for v in ids], np.int64))
            wide = ((0, 0), (0, self.width - own))
            self.weights.append(np.pad(np.frombuffer(columns["weights"][i], np.int32).reshape(len(ids), own), wide))
            for name, into in (("low", self.low), ("high", self.high)):
                into.append(np.pad(np.frombuffer(columns[name][i], np.int32), wide[1]))
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.peak = max((float(np.abs(t.astype(np.int64)).max()) for t in (self.low, self.high) if t.size), default=0.0)

    def prepared(self, queries: list[np.ndarray]):
        """The queries and the blocks in a type that adds up exactly."""
        table = np.array([fitted(q, self.width) for q in queries]).reshape(len(queries), self.width)
        most = float(np.abs(table.astype(np.int64)).max()) if table.size else 0.0
        kind = exact_type(self.peak * most, max(self.width, 1))
        return table.astype(kind), [w.astype(kind) for w in self.weights], kind

    def search(self, queries: list[np.ndarray], floors: list, own: list, k: int):
        """``(ids, scores)`` per query: its best ``k`` of those that come before its floor, the score and id of a
        k-th elsewhere (None: of all)."""
        table, weights, kind = self.prepared(queries)
        low, high = self.low.astype(kind), self.high.astype(kind)
        for at in range(0, len(queries), QUERIES_AT_ONCE):
            part = table[at : at + QUERIES_AT_ONCE]
            bounds = np.maximum(part, 0) @ high.T + np.minimum(part, 0) @ low.T
            for i, query in enumerate(part):
                yield self._one(query, floors[at + i], own[at + i], bounds[i], weights, k)

    def _one(self, query, floor, own, bounds, weights, k):
        ids, scores = np.zeros(0, np.int64), np.zeros(0, query.dtype)
        least, last = (-np.inf, NO_ID) if floor is None else floor
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] < least:
                break
            found = weights[b] @ query
            reach = (found > least) | ((found == least) & (self.ids[b] < last))
            if own is not None and own[0] == b:
                reach[own[1]] = False
            if not reach.any():
                continue
            ids, scores = np.concatenate([ids, self.ids[b][reach]]), np.concatenate([scores, found[reach]])
            order = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[order], scores[order]
            if len(ids) == k:
                least, last = scores[-1], ids[-1]
        return ids, scores.astype(np.int64)


def _ids(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NO_ID)


HOME = "q long, query_id long, home int, weights binary, floor long, last long, ids array<long>, scores array<long>"


def top_scores(
    rows: DataFrame,
    k: int = 20,
    every: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    block: int = BLOCK,
    shards: int | None = None,
    query_rows: int = QUERY_ROWS,
    summary_bytes: int = SUMMARY_BYTES,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` highest whole-number inner products.

    Queries are the rows whose ``vec_id`` is divisible by ``every``, candidates all rows but the query's own;
    ties go to the smaller ``vec_id``, a NULL one last. Rows that repeat an id are rows of their own: each is a
    candidate for the others, and each is a query with ranks of its own. Vectors that are NULL or hold a NULL or
    non-finite component take no part; zero and empty vectors score 0. Of two vectors of different length the
    shorter has zeros beyond its end. Weights beyond ``LIMIT`` count as ``LIMIT``. With fewer candidates than ``k``, all
    are returned. Other columns are not read; an empty table gives an empty result.
    """
    values = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), values.alias("v")).where(F.col("v").isNotNull() & finite)
    usable = usable.select("id", quantised(F.col("v")).alias("w"))
    sample = usable.orderBy(F.xxhash64("id", "w"), "id").limit(SAMPLE_ROWS).select("w").collect()
    schema = "query_id long, rank int, vec_id long, score long"
    if not sample:
        return rows.sparkSession.createDataFrame([], schema)
    n = usable.count()
    if shards is None:
        shards = -(-n // min(max(n // SHARDS, SHARD_ROWS[0]), SHARD_ROWS[1]))
    index = stored(forward_index(usable, centres_of(matrix([r["w"] for r in sample])), shards, block), "forward-index")

    def home(table: pa.Table) -> pa.Table:
        blocks = Blocks(table)
        shard = table.column("shard")[0].as_py()
        widths = {b: w for b, w in zip(table.column("block").to_pylist(), table.column("width").to_pylist())}
        places = [(b, i) for b, ids in enumerate(blocks.ids) for i in np.flatnonzero((ids % every == 0) & (ids != NO_ID)).tolist()]
        queries = [blocks.weights[b][i][: widths[b]] for b, i in places]
        found = list(blocks.search(queries, [None] * len(places), places, k))
        number = [shard << 32 | sum(map(len, blocks.ids[:b])) + i for b, i in places]
        return pa.table(
            {
                "q": pa.array(number, pa.int64()),
                "query_id": pa.array([int(blocks.ids[b][i]) for b, i in places], pa.int64()),
                "home": pa.array([shard] * len(places), pa.int32()),
                "weights": pa.array([q.astype(np.int32).tobytes() for q in queries], pa.binary()),
                "floor": pa.array([int(s[-1]) if len(s) == k else None for _, s in found], pa.int64()),
                "last": pa.array([int(i[-1]) if len(i) == k else None for i, _ in found], pa.int64()),
                "ids": pa.array([_ids(i).to_pylist() for i, _ in found], pa.list_(pa.int64())),
                "scores": pa.array([s.tolist() for _, s in found], pa.list_(pa.int64())),
            }
        )

    asked = stored(index.groupBy("shard").applyInArrow(home, HOME), "queries")
    chunks = max(1, -(-asked.count() // query_rows))
    visits = _visits(asked, index, shards, summary_bytes)
    visits = visits.withColumn("chunk", F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int"))
    copies = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def away(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [], [], [], []
        if len(left) and len(right):
            queries = [np.frombuffer(w, np.int32) for w in left.column("weights").to_pylist()]
            pairs = zip(left.column("floor").to_pylist(), left.column("last").to_pylist())
            floors = [None if score is None else (score, last) for score, last in pairs]
            found = Blocks(right).search(queries, floors, [None] * len(queries), k)
            for q, query_id, (ids, scores) in zip(left.column("q").to_pylist(), left.column("query_id").to_pylist(), found):
                for column, v in zip(parts, (np.full(len(ids), q), np.full(len(ids), query_id), ids, scores)):
                    column.append(v)
        columns = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]
        return pa.table({"q": columns[0], "query_id": columns[1], "vec_id": _ids(columns[2]), "score": columns[3]})

    met = visits.groupBy("shard", "chunk").cogroup(copies.groupBy("shard", "chunk"))
    others = met.applyInArrow(away, "q long, query_id long, vec_id long, score long")
    own = asked.select("q", "query_id", F.explode(F.arrays_zip("ids", "scores")).alias("e"))
    own = own.select("q", "query_id", F.col("e.ids").alias("vec_id"), F.col("e.scores").alias("score"))
    order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = own.union(others).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _visits(asked: DataFrame, index: DataFrame, shards: int, summary_bytes: int) -> DataFrame:
    """``shard`` and a query for every other shard whose maxima reach the query's k-th score."""
    columns = ["q", "query_id", "weights", "floor", "last"]
    width = index.agg(F.max("width")).first()[0]
    if shards * width * 8 > summary_bytes:
        spread = asked.select(*columns, "home", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
        return spread.where("shard <> home").select("shard", *columns)

    def summed(table: pa.Table) -> pa.Table:
        blocks = Blocks(table)
        low, high = (pa.array([v.astype(np.int32).tobytes()], pa.binary()) for v in (blocks.low.min(axis=0), blocks.high.max(axis=0)))
        return pa.table({"shard": table.column("shard")[:1], "low": low, "high": high})

    no_rows = [F.expr("array()").cast("array<long>").alias("ids"), F.unhex(F.lit("")).alias("weights")]
    light = index.select("shard", "block", "width", *no_rows, "low", "high")
    rows = light.groupBy("shard").applyInArrow(summed, "shard int, low binary, high binary").orderBy("shard").collect()
    names = np.array([r["shard"] for r in rows])
    low, high = (np.array([fitted(np.frombuffer(r[c], np.int32), width) for r in rows]) for c in ("low", "high"))
    peak = float(max(np.abs(low.astype(np.int64)).max(initial=0), np.abs(high.astype(np.int64)).max(initial=0)))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([fitted(np.frombuffer(w, np.int32), width) for w in batch.column(2).to_pylist()])
            kind = exact_type(peak * float(np.abs(table.astype(np.int64)).max(initial=0)), max(width, 1))
            table = table.astype(kind)
            bounds = np.maximum(table, 0) @ high.astype(kind).T + np.minimum(table, 0) @ low.astype(kind).T
            floors = batch.column(3).fill_null(np.iinfo(np.int64).min).to_numpy()
            far = names != batch.column(5).to_numpy()[:, None]
            query, shard = np.nonzero(far & (bounds >= floors[:, None]))
            for at in range(0, len(query), 16_384):
                some = pa.array(query[at : at + 16_384])
                chosen = [batch.column(i).take(some) for i in range(5)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[shard[at : at + 16_384]], pa.int32()), *chosen], names=["shard", *columns]
                )

    given = asked.select(*columns, "home")
    return given.mapInArrow(choose, "shard int, q long, query_id long, weights binary, floor long, last long")
