"""The filter audit against applying every order of the filters row by row."""

import random
import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import audit

SCHEMA = "doc_id long, text string, lang string, kept string, word int"
LABELS = "doc_id long, quality int, toxic int, part string"


def test_carry_save_counts_every_position():
    rng = np.random.default_rng(4)
    for n in [0, 1, 2, 3, 4, 5, 7, 64, 1000, 4097]:
        words = rng.integers(0, 2**32, n, dtype=np.uint32)
        expected = [int(((words >> i) & 1).sum()) for i in range(32)]
        assert audit.positional_popcount(words).tolist() == expected


def slow(rows, labels):
    texts = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            texts[text or ""] = min(doc_id, texts.get(text or "", doc_id))
    good = {d for d, q, *_ in labels if q == 1}
    toxic = {d for d, _, t, *_ in labels if t == 1}

    def fails(doc_id, text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and doc_id > texts[text],
        }

    docs = [(r[0], r[2] or "", fails(r[0], r[1])) for r in rows]
    out, shares = {}, {}
    for part in {p for _, p, _ in docs}:
        own = [(d, f) for d, p, f in docs if p == part]
        for order in map("".join, permutations("ABCDE")):
            alive = own
            for step, letter in enumerate(order, 1):
                here = [(d, f) for d, f in alive if f[letter]]
                alive = [(d, f) for d, f in alive if not f[letter]]
                earlier = [f for _, f in own if f[letter] and any(f[x] for x in order[: step - 1])]
                alone = [f for _, f in own if f[letter] and sum(f.values()) == 1]
                shares[part, letter] = shares.get((part, letter), 0) + len(here)
                out[part, order, step] = [
                    len(alive), len(here), len(earlier), len(alone),
                    sum(d in good for d, _ in here if d is not None), sum(d in toxic for d, _ in here if d is not None),
                ]
    return {(p, o, s): (*v, shares[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_every_order_step_and_part(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]

    def text():
        parts = [rng.choice(words[: rng.choice([20, 400])]) for _ in range(rng.choice([3, 199, 200, 260]))]
        joined = " ".join(parts)
        if rng.random() < 0.3:
            joined = joined.upper()
        return joined + rng.choice(["", " 5%", "\t\n", " É"])

    made = [None, "", " ", *[text() for _ in range(40)], "very long " * 60_000]
    rows = [(i, rng.choice(made), rng.choice(["en", "de", "", None]), "x", 1) for i in range(160)]
    rows += [(7, rows[7][1], rows[7][2], "x", 1), (None, made[5], "en", None, None), (None, made[5], "en", None, None), (200, made[5], "en", "x", 1)]
    labels = [(rng.randrange(210), rng.choice([0, 1, None]), rng.choice([0, 1, None]), "q") for _ in range(150)]
    labels += [(None, 1, 1, None)]
    docs, told = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    found = audit.filter_audit(docs, told).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found} == slow(rows, labels)
    assert len(found) == 600 * 3
    assert audit.filter_audit(docs.limit(0), told).count() == 0
    alone = audit.filter_audit(docs, told.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(alone) == (0, 0)


def test_many_parts_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(audit, "PARTS_HELD", 3)
    rows = [(i, "same text", f"lang{i % 50}", "x", 1) for i in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = audit.filter_audit(docs, spark.createDataFrame([], LABELS)).where("filter_order = 'EABCD' AND step = 1")
    assert found.agg(F.sum("kept"), F.sum("removed")).first() == (1, 499)
    assert found.count() == 50
