"""Contracts of the queries, written out plainly, against whole tables."""

import hashlib
import pickle
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import decontaminate, mixing, pii, queries, secrets, toxicity

SF = "/root/testdata/sf0.01"


def texts_of(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def listed(kinds, found):
    spans = sorted((a, kinds.index(k), b, k) for k, a, b in found)
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


def plain_secrets(text):
    found = [
        ("assign", m.start(), m.end())
        for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
        if len(m[2]) >= 6
    ]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return found + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_personal(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [
        ("ip", *m.span())
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
        if all(int(part) <= 255 for part in m[0].split("."))
    ]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


@pytest.mark.parametrize(
    "query, plain, kinds",
    [
        ("op9_secrets", plain_secrets, ["assign", "access", "hex"]),
        ("op10_pii", plain_personal, ["email", "ip", "card", "phone"]),
    ],
)
def test_base_spans_of_every_document(spark, query, plain, kinds):
    texts = texts_of(spark)
    rows = queries.QUERIES[query](spark, SF).collect()
    assert len(rows) == len(texts)
    total = 0
    for r in rows:
        found = plain(texts[r["doc_id"]])
        total += len(found)
        assert [r[f"n_{k}"] for k in kinds] == [sum(f[0] == k for f in found) for k in kinds]
        assert r["base_sha256"] == listed(kinds, found)
        spans = set(filter(None, r["spans"].split(",")))
        assert {f"{k}:{a}:{b}" for k, a, b in found} <= spans
    assert total > 10


def test_key_blocks_take_time_in_proportion():
    spans = secrets.scanner()
    for line in ("a:-----BEGIN PRIVATE KEY-----\n", "-----BEGIN PRIVATE KEY-----\nAAAA", "a: b\n-----BEGIN "):
        start = time.perf_counter()
        assert not spans(line * (1_000_000 // len(line)))
        assert time.perf_counter() - start < 2


def test_broadcasts_do_not_need_the_library(spark, monkeypatch):
    sent, context = [], spark.sparkContext
    broadcast = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda value: sent.append(pickle.dumps(value)) or broadcast(value))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(300)
    pii.find_pii(docs).count()
    decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count()
    toxicity.toxicity_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).count()
    assert len(sent) >= 3 and not any(b"plumbline" in s for s in sent)


def test_toxic_rows_that_were_not_learned_from(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = queries.QUERIES["op6_toxicity"](spark, SF).where("held_out").join(labels, "doc_id")
    counts = {(r["toxic"], r["predicted"]): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert counts.get((0, 1), 0) == 0
    # A third of the rows labelled toxic hold no toxic word.
    assert counts[1, 1] >= 0.6 * (counts[1, 1] + counts.get((1, 0), 0))


def test_whole_pipeline_step_by_step(spark):
    """What ``run`` returns, against plain loops over what each stage was given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = toxicity.toxicity_scores(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r["doc_id"]: r["text"] or "" for r in scored.where("predicted = 0").select("doc_id", "text").collect()}

    from tests.llm.test_operators import hamming_components, slow_fingerprint

    bits = {i: slow_fingerprint(t) for i, t in kept.items()}
    groups = hamming_components_fast(bits, 4)
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    some = dict(sorted(bits.items())[:60])
    assert hamming_components(some, 4) == hamming_components_fast(some, 4)

    items = [r["text"] or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {w for t in items for w in decontaminate.windows_of(decontaminate.words_of(t))}
    short = {w for w in windows if w.count(" ") < decontaminate.WINDOW - 1}

    def dirty(text):
        words = decontaminate.words_of(text)
        sizes = {decontaminate.WINDOW, *(w.count(" ") + 1 for w in short)}
        return any(" ".join(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1))

    kept = {i: t for i, t in kept.items() if not dirty(t)}
    stage = spark.createDataFrame(sorted(kept.items()), "doc_id long, text string")
    trained = pii.train(stage, "text")
    redacted = {i: pii.redacted(t, pii.select_spans(t, trained)[1]) for i, t in kept.items()}

    known = {r["doc_id"]: r for r in docs.select("doc_id", "lang", "source").collect()}
    sized = [(i, known[i]["source"], len(re.findall(r"[^\x20\x09-\x0D]+", t))) for i, t in redacted.items()]
    mixed = mixing.mix(spark.createDataFrame(sized, "doc_id long, source string, size long")).where("copies > 0")
    want = {r["doc_id"]: (r["copies"], r["taken"], r["target"]) for r in mixed.collect()}

    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: (r["copies"], r["taken"], r["target"]) for r in got} == want
    assert all(r["text"] == redacted[r["doc_id"]] and r["lang"] == known[r["doc_id"]]["lang"] for r in got)
    assert len(got) == len(want)


def hamming_components_fast(bits, radius):
    """All pairs, with the smallest id of each component."""
    ids = sorted(bits)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (bits[i] ^ bits[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
