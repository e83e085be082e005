"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. Covering masks come from vectors: bit i gets a nonzero vector m(i) of
``radius + 1`` bits, and for every nonzero vector v of that length there is one table whose mask keeps
the bits with an odd inner product of m(i) and v. The at most ``radius`` bits in which two fingerprints
differ cannot span the whole space, so some v is orthogonal to all of them: in that table the two
collide. No pair within the radius is missed, whatever the data; no pair outside it is linked, because
every link is checked.

Equal fingerprints are one row before any table is built. Tables hold (table, masked bits, fingerprint)
rows and are counted first. Members of a bucket of up to ``BUCKET`` rows are compared in blocks of
numpy inside one task, which returns a spanning forest of the links, not the pairs. Fingerprints that
meet in a larger bucket take an exact way without comparisons: two lie within ``2 r`` bits if and only
if some point lies within ``r`` bits of both, so each lists the points around it and all that list
one point are linked to the smallest of them. That is a fixed number of rows per fingerprint and an
aggregate that folds before its shuffle, however large the bucket.
"""

from __future__ import annotations

from itertools import combinations
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.components import components
from plumbline.llm.texts import small_side, stored, with_columns

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
BUCKET = 16_384
CHUNK = 1 << 16
BLOCK = 1024


def fingerprint_of(text: str | None, size: int = SHINGLE) -> int:
    """The 64 bits as a signed integer; a text without words has 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    n = max(1, len(words) - size + 1)
    firsts, ends = starts[:n].tolist(), (starts[min(size, len(words)) :] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, CHUNK):
        pairs = zip(firsts[at : at + CHUNK], ends[at : at + CHUNK])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")
        ones += _bit_counts(hashes)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set, from how often each byte value occurs at each place."""
    of_byte = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    places = hashes.view(np.uint8).reshape(-1, 8) + np.arange(8) * 256
    return (np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ of_byte).ravel()


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a long column ``bits``."""

    def make():
        return lambda texts: [[fingerprint_of(t) for t in texts]]

    return with_columns(docs, text, make, [("bits", "long")])


def covering_masks(radius: int = RADIUS) -> list[int]:
    """One mask per nonzero vector of ``radius + 1`` bits, as signed 64-bit integers."""
    vectors = range(1, 1 << (radius + 1))
    bit_vectors = [vectors[i % len(vectors)] for i in range(BITS)]
    masks = [sum(1 << i for i, m in enumerate(bit_vectors) if (m & v).bit_count() % 2) for v in vectors]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def ball(radius: int) -> list[int]:
    """All 64-bit numbers with at most ``radius`` bits set, signed."""
    points = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(BITS), r)]
    return [p - (1 << BITS) if p >> (BITS - 1) else p for p in points]


def spanning_links(bits: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between distinct fingerprints.

    Breadth first: everything near the frontier and not yet reached is reached from it. Each
    fingerprint is compared as a frontier once, in blocks, so memory is one block.
    """
    left = np.sort(bits).view(np.uint64)
    parents, children = [], []
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            reached = []
            for at in range(0, len(frontier), BLOCK):
                part = frontier[at : at + BLOCK]
                near = np.bitwise_count(part[:, None] ^ left[None, :]) <= radius
                hit = near.any(axis=0)
                parents.append(part[near[:, hit].argmax(axis=0)])
                children.append(left[hit])
                reached.append(left[hit])
                left = left[~hit]
                if not len(left):
                    break
            frontier = np.concatenate(reached)
    if not parents:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(parents).view(np.int64), np.concatenate(children).view(np.int64)


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``a``, ``b``: links that connect what pairs within ``radius`` bits connect.

    ``distinct`` has one row per fingerprint in ``bits``. Two are within an odd radius if and only if some
    point lies within its smaller half of one and its larger half of the other; all that list a point are
    then linked to the smallest within the smaller half.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in covering_masks(radius)])
    tables = distinct.select("bits", F.posexplode(masks).alias("t", "mask")).select(
        "bits", "t", F.col("bits").bitwiseAND(F.col("mask")).alias("key")
    )
    sizes = stored(tables.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    members = stored(tables.join(small_side(sizes), ["t", "key"]).select("t", "key", "n", "bits"), "buckets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by bucket; at most one bucket waits for its end."""
        kept = [np.zeros(0, np.int64)] * 3

        def closed(columns):
            t, key, bits = columns
            edges = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            found = [spanning_links(part, radius) for part in np.split(bits, edges)]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)])) for i in (0, 1)], names=["a", "b"]
            )

        for batch in batches:
            now = [np.concatenate([k, batch.column(i).to_numpy()]) for i, k in enumerate(kept)]
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            whole = int(np.argmax(same))
            kept = [c[whole:] for c in now]
            if whole:
                yield closed([c[:whole] for c in now])
        if len(kept[0]):
            yield closed(kept)

    small = members.where(F.col("n") <= bucket).select("t", "key", "bits")
    by_bucket = small.repartition("t", "key").sortWithinPartitions("t", "key")
    compared = by_bucket.mapInArrow(compare, "a long, b long").distinct()

    around = F.array(*[F.lit(p).cast("long") for p in ball((radius + 1) // 2)])
    inner = F.when(F.bit_count(F.col("bits").bitwiseXOR(F.col("point"))) <= radius // 2, F.col("bits"))
    crowded = members.where(F.col("n") > bucket).select("bits").distinct()
    if not crowded.take(1):
        return compared
    points = crowded.select("bits", F.explode(around).alias("step")).select(
        "bits", F.col("bits").bitwiseXOR(F.col("step")).alias("point")
    )
    centres = points.groupBy("point").agg(F.min(inner).alias("a"))
    shared = points.join(centres, "point").select("a", F.col("bits").alias("b"))
    return compared.union(shared.where("a <> b").distinct())


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, bucket: int = BUCKET
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``bits``, ``component_id``, the smallest doc_id that links of
    at most ``radius`` differing bits reach, and ``root``, the smallest fingerprint that they reach. Components
    can share a component_id, if ids are NULL or repeated, but never a root.

    Texts without words, NULL ones included, have fingerprint 0 and are linked like any other.
    Repeated rows stay rows and share a component. A NULL doc_id is never a component's id unless no
    member has another. Other columns play no part; an empty table gives an empty result.
    """
    marked = fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("__text")), "__text")
    marked = stored(marked.select("doc_id", "bits"), "fingerprints")
    distinct = stored(marked.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    reached = components(links(distinct.select("bits"), radius, bucket))
    roots = distinct.join(reached.withColumnRenamed("node", "bits"), "bits", "left").withColumn(
        "root", F.coalesce("root", "bits")
    )
    smallest = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_bits = roots.select("bits", "root").join(smallest, "root").select("bits", "component_id", "root")
    return marked.join(of_bits, "bits").select("doc_id", "bits", "component_id", "root")


def hexadecimal(bits: str = "bits"):
    return F.lower(F.lpad(F.hex(F.col(bits)), 16, "0"))
