"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Vectors are centred on their mean and rotated by one random orthogonal matrix; a code keeps the sign of
every coordinate, packed into 64-bit words, with three scalars: the length of the centred vector, the
inner product ``f`` of the code's corner of the cube with the direction it stands for, and the part of
the inner product that the mean brings. An estimate of ``<q, x>`` then takes bit operations on packed
words and these scalars, and its error is at most about ``EPSILON * sqrt((1 - f^2) / (f^2 (D - 1)))``
times both lengths. In a block, the ``k`` best estimates are computed exactly first; every vector whose
estimate plus error reaches the k-th of them is computed exactly, too.

Queries meet vectors in blocks of bounded size: a task sees at most ``QUERIES`` queries and ``VECTORS``
vectors, and returns ``k`` rows per query. Every row is indexed and every block is searched, so the only
loss is an error beyond its bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.llm.texts import stored

QUERIES, VECTORS = 2048, 16_384
EPSILON = 2.5
PLANES = 6
AT_ONCE = 16
SEED = 7
#: Stands for a NULL id inside tasks; it sorts last.
NO_ID = np.iinfo(np.int64).max


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def pack(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    short = -signs.shape[1] % 64
    padded = np.pad(signs, ((0, 0), (0, short)))
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


class Codes:
    """The codes of a block of vectors."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        dim = vectors.shape[1]
        centred = vectors - centre
        self.length = np.linalg.norm(centred, axis=1)
        unit = centred @ turn / np.where(self.length > 0, self.length, 1.0)[:, None]
        self.bits = pack(unit > 0)
        self.fit = np.abs(unit).sum(axis=1) / np.sqrt(dim)
        self.fit = np.where(self.length > 0, self.fit, 1.0)
        self.spread = np.sqrt(np.maximum(1 - self.fit**2, 0) / max(dim - 1, 1)) / self.fit
        self.centre, self.turn, self.dim = centre, turn, dim

    def estimate(self, queries: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products and their error bounds, one row per query."""
        turned = queries @ self.turn
        low = turned.min(axis=1, keepdims=True)
        step = np.maximum(turned.max(axis=1, keepdims=True) - low, 1e-300) / ((1 << PLANES) - 1)
        levels = np.rint((turned - low) / step).astype(np.uint8)
        count = np.bitwise_count(self.bits).sum(axis=1, dtype=np.float64)
        inside = np.zeros((len(queries), len(self.bits)), dtype=np.uint32)
        for plane in range(PLANES):
            words = pack((levels >> plane) & 1 > 0)
            for w in range(words.shape[1]):
                common = np.bitwise_count(words[:, w, None] & self.bits[None, :, w])
                inside += np.left_shift(common, plane, dtype=np.uint16)
        # The sum of the query's coordinates where the code has a one.
        ones = inside * step + count * low
        corner = (2 * ones - turned.sum(axis=1, keepdims=True)) / np.sqrt(self.dim)
        size = np.linalg.norm(queries, axis=1)[:, None]
        rounding = step / np.sqrt(12)
        estimate = queries @ self.centre[:, None] + corner / self.fit * self.length
        error = epsilon * self.length * (size * self.spread + rounding / self.fit)
        return estimate, error


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added from the first coordinate to the last."""
    return np.add.accumulate(vectors * query, axis=1)[:, -1]


def search_block(q_rows, queries, v_rows, v_ids, vectors, centre, turn, k: int):
    """``(query row, vector id, score)`` arrays: the ``k`` nearest in the block for each query, its own row left out."""
    codes = Codes(vectors, centre, turn)
    found = ([], [], [])
    norms, dims = np.linalg.norm(queries, axis=1), vectors.shape[1]
    longest = np.linalg.norm(vectors, axis=1).max()
    for at in range(0, len(queries), AT_ONCE):
        part = queries[at : at + AT_ONCE]
        estimate, error = codes.estimate(part)
        for i, (q_row, query) in enumerate(zip(q_rows[at : at + AT_ONCE], part)):
            own = v_rows != q_row
            score = np.where(own, estimate[i], -np.inf)
            reach = min(k, int(own.sum()))
            if not reach:
                continue
            best = np.argpartition(-score, reach - 1)[:reach]
            floor = (vectors[best] @ query).min()
            score += error[i]
            score[best] = np.inf
            chosen = np.flatnonzero(score >= floor)
            # Only what may be among the k is added up in the defined order.
            close = vectors[chosen] @ query
            slack = 1e-12 * dims * norms[at + i] * longest
            chosen = chosen[close >= np.partition(close, len(close) - reach)[len(close) - reach] - slack]
            values = exact(query, vectors[chosen])
            order = np.lexsort((v_ids[chosen], -values))[:k]
            found[0].append(np.full(len(order), q_row))
            found[1].append(v_ids[chosen][order])
            found[2].append(values[order])
    types = (np.int64, np.int64, np.float64)
    return [np.concatenate(f) if f else np.zeros(0, t) for f, t in zip(found, types)]


def nearest(
    rows: DataFrame,
    k: int = 20,
    every: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    query_rows: int = QUERIES,
    vector_rows: int = VECTORS,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` nearest by largest inner product.

    Queries are the rows whose ``vec_id`` is divisible by ``every``, candidates all rows but the query's own; ties
    go to the smaller ``vec_id``, a NULL one last. Rows that repeat an id are rows of their own: each is a candidate
    for the others, and each is a query with ranks of its own. Vectors that are NULL, empty, zero or hold a NULL or
    non-finite component take no part, nor do those whose length is not the commonest (of equally common ones the
    greater). With fewer candidates than ``k``, all are returned. Other columns are not read; an empty table gives an
    empty result.
    """
    values = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), values.alias("v")).where(
        F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    )
    usable = stored(usable.withColumn("row", F.monotonically_increasing_id()), "vectors")
    lengths = usable.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    schema = "row long, query_id long, vec_id long, score double"
    if common is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = common["d"], common["n"]
    usable = usable.where(F.size("v") == dim)
    means = usable.agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(dim)]).first()
    centre, turn = np.array(list(means)), rotation(dim)

    queries = usable.where(F.col("id") % every == 0)
    v_blocks, q_blocks = -(-n // vector_rows), max(1, -(-queries.count() // query_rows))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
        known = F.coalesce("id", F.lit(NO_ID)).alias("id")
        return df.select("row", known, "v", block.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    def matrix(table: pa.Table) -> np.ndarray:
        flat = table.column("v").combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(table), dim)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        q_rows, q_ids = left.column("row").to_numpy(), left.column("id").to_numpy()
        if len(left) and len(right):
            rows, ids = right.column("row").to_numpy(), right.column("id").to_numpy()
            found = search_block(q_rows, matrix(left), rows, ids, matrix(right), centre, turn, k)
        row, vec_id, score = found
        order = np.argsort(q_rows)
        query_id = q_ids[order][np.searchsorted(q_rows, row, sorter=order)] if len(row) else row
        columns = [pa.array(row), pa.array(query_id), pa.array(vec_id, mask=vec_id == NO_ID), pa.array(score)]
        return pa.table(columns, names=["row", "query_id", "vec_id", "score"])

    left = dealt(queries, "qb", q_blocks, "vb", v_blocks).groupBy("qb", "vb")
    right = dealt(usable, "vb", v_blocks, "qb", q_blocks).groupBy("qb", "vb")
    pairs = left.cogroup(right).applyInArrow(search, schema)
    order = W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
