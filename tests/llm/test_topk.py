"""Exact top-k search against scoring every pair."""

import math
import random

import numpy as np
import pytest

from plumbline.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def slow(rows, k, every):
    usable = []
    for vec_id, v in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((vec_id, [math.floor(64 * float(np.float32(x))) for x in v]))
    out = []
    for q, (query_id, query) in enumerate(usable):
        if query_id is None or query_id % every:
            continue
        scored = [
            (-sum(a * b for a, b in zip(query, w)), vec_id is None, vec_id or 0, vec_id)
            for c, (vec_id, w) in enumerate(usable)
            if c != q
        ]
        for rank, (score, _, _, vec_id) in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1):
            out.append((query_id, rank, vec_id, -score))
    return sorted(out, key=str)


def vectors(rng, n, dims, spread=0.2):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [[c + rng.gauss(0, spread) for c in rng.choice(centres)] for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", None) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("options", [{}, {"shards": 5, "block": 8}, {"shards": 4, "block": 4, "query_rows": 7, "summary_bytes": 0}])
def test_same_as_all_pairs(spark, options):
    rng = random.Random(6)
    rows = list(enumerate(vectors(rng, 400, 12)))
    found = topk.top_scores(table(spark, rows), k=7, every=9, **options).collect()
    assert sorted(map(tuple, found), key=str) == slow(rows, 7, 9)


def test_awkward_rows(spark):
    rng = random.Random(7)
    good = vectors(rng, 60, 6)
    rows = [(i, v) for i, v in enumerate(good)]
    # Copies, repeated rows and ids, ties, no id, short, empty, zero, missing and endless components.
    rows += [(100 + i, good[0]) for i in range(40)] + [(0, good[0]), (0, good[1]), (10, good[10]), (-10, good[3])]
    rows += [(None, good[0]), (None, good[5]), (200, []), (210, [0.0] * 6), (220, good[2][:3]), (230, good[2] + [0.5, -0.5])]
    rows += [(240, None), (250, [None, 1.0]), (260, [float("nan")] * 6), (270, [float("inf")] * 6), (280, [1e6, -1e6])]
    for shards in (1, 4):
        found = topk.top_scores(table(spark, rows), k=20, every=10, shards=shards, block=8).collect()
        assert sorted(map(tuple, found), key=str) == slow(rows, 20, 10)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.25]), (20, [-1.0, 0.0])]
    found = topk.top_scores(table(spark, rows)).collect()
    assert sorted(map(tuple, found), key=str) == slow(rows, 20, 20)
    assert topk.top_scores(table(spark, []).limit(0)).count() == 0
    assert topk.top_scores(table(spark, [(3, [1.0]), (5, [2.0])])).count() == 0
    assert topk.top_scores(table(spark, [(0, [1.0])])).count() == 0


def test_blocks_below_the_bound_are_not_scored(monkeypatch):
    rng = np.random.default_rng(8)
    blocks = topk.Blocks.__new__(topk.Blocks)
    blocks.width = 4
    blocks.weights = [rng.integers(0, 8, (16, 4)).astype(np.int32) + 10 * b for b in range(50)]
    blocks.ids = [np.arange(16) + 16 * b for b in range(50)]
    blocks.low = np.array([w.min(axis=0) for w in blocks.weights])
    blocks.high = np.array([w.max(axis=0) for w in blocks.weights])
    blocks.peak = float(blocks.high.max())
    scored = []
    monkeypatch.setattr(np, "lexsort", lambda keys, _sort=np.lexsort: scored.append(1) or _sort(keys))
    ids, scores = next(blocks.search([np.array([3, 1, 2, 5])], [None], [None], 5))
    assert len(scored) == 1 and ids.min() >= 16 * 49
    assert scores.tolist() == sorted((blocks.weights[49] @ [3, 1, 2, 5]).tolist(), reverse=True)[:5]
