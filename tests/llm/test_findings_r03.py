"""What the findings of round 3 brought to light in the operators on texts."""

import random

import numpy as np
import pyarrow as pa

from plumbline.llm import pii, toxicity


def test_toxicity_tasks_hold_a_bounded_piece_of_a_batch(monkeypatch):
    texts = pa.array([f"some words of text {i} come twice twice" for i in range(200)] + [None, "", "x" * 5000])
    keys = np.sort(np.array([toxicity.key_of(g) for w in ("some", "twice") for g in toxicity.expressions(w)], np.int64).view(np.uint64))

    class Sent:
        value = (keys, np.arange(1, len(keys) + 1, dtype=np.int64)[:, None])

    uses, earlier, held, split = pa.array(["all"] * len(texts)), pa.nulls(len(texts), pa.list_(pa.int64())), [], toxicity.words_of

    def watched(part):
        held.append((len(part), sum(len(t or "") for t in part.to_pylist())))
        return split(part)

    monkeypatch.setattr(toxicity, "words_of", watched)
    whole = toxicity._measuring(Sent, ["all"], True)()(texts, uses, earlier)[0].to_pylist()
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 1000)
    held.clear()
    assert toxicity._measuring(Sent, ["all"], True)()(texts, uses, earlier)[0].to_pylist() == whole
    assert sum(n for n, _ in held) == len(texts) and all(n == 1 or size <= 1000 for n, size in held)
    sums = toxicity._measuring(Sent, ["all"], False)()(texts, uses, earlier)[0]
    assert len(sums) == len(texts)


def _card(rng):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    last = next(d for d in "0123456789" if pii.luhn(digits + d))
    return digits + last


def _numbers(rng, n):
    names = ["alder", "birch", "cedar", "dogwood", "elm", "fir", "gorse", "hazel"]
    words = lambda: " ".join(rng.choice(names) for _ in range(12))
    return [f"{words()} card {_card(rng)} or call +49 30 {rng.randrange(10**7, 10**8)} {words()} on 2021-0{i % 9 + 1}-1{i % 9} {words()}" for i in range(n)]


def test_numbers_in_other_forms_are_selected(spark):
    rng = random.Random(3)
    texts = _numbers(rng, 400)
    hidden = [pii.pointed(_card(rng)), "0049 30 55512345"]
    harmless = ["2021.03.14", "3.141592653", "1999-2004"]
    texts += [f"elm fir hazel card or call {h} cedar birch alder" for h in hidden + harmless]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = [r.redacted_text for r in pii.find_pii(docs, redact=True).orderBy("doc_id").collect()][400:]
    assert [h in t for h, t in zip(hidden + harmless, got)] == [False, False, True, True, True]


def test_trees_learn_from_all_different_texts(spark):
    texts = _numbers(random.Random(4), 300)
    docs = spark.createDataFrame([(t,) for t in texts + texts[:100] + [None, ""]], "text string")
    want = sum(len(pii._vectors(t, 0)) // (pii.N_FEATURES + 4) for t in texts)
    assert pii.folded_proposals(docs, "text").agg({"n": "sum"}).first()[0] == want
    model, limits = pii.train(docs, "text")
    again, same = pii.train(docs.repartition(7), "text")
    assert limits == same and all((a == b).all() for a, b in zip((model.feature, model.cut, model.value), (again.feature, again.cut, again.value)))
