"""Fill-in-middle against plain string cutting, and its exact inverse."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from plumbline.llm import fim


def slow(doc_id, text):
    text = text or ""
    found = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(found)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(part) for part in (found[:a], found[a:b], found[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@given(st.text(max_size=60), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.integers(0, 99), st.integers(0, 99))
@settings(max_examples=400, deadline=None)
def test_restores_exactly_from_output_and_form(text, first, second, third, fourth):
    _, form, _, _, output = fim.rearranged_text(text.encode(), first, second, third, fourth)
    assert fim.restored_text(output, form) == text.encode()


@pytest.mark.parametrize("scratch", [1, 2, 3, 65536])
def test_exchange_is_a_rotation(monkeypatch, scratch):
    monkeypatch.setattr(fim, "SCRATCH", scratch)
    rng = random.Random(2)
    for _ in range(200):
        whole = bytes(rng.randrange(256) for _ in range(rng.randrange(30)))
        a, b, c = sorted(rng.randrange(len(whole) + 1) for _ in range(3))
        buffer = bytearray(whole)
        fim.exchange(buffer, a, b, c)
        assert bytes(buffer) == whole[:a] + whole[b:c] + whole[a:b] + whole[c:]


def test_awkward_table(spark):
    rng = random.Random(3)
    letters = "abZ <>PSM\n\x00é日𝒳"
    texts = [None, "", " ", "a", "<P", "x<M>y", "<S>", "\x00", "ß" * 40_000 + " word" * 30_000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(300)]
    rows = [(i, t, "mine", 3) for i, t in enumerate(texts)] + [(5, texts[5], "mine", 3), (None, "no id at all", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, extra int")
    found = fim.restored(fim.rearranged(docs)).select(
        "doc_id", "text", "n", "form", "prefix_chars", "middle_chars", F.decode("output", "UTF-8").alias("output"), "restored", "extra"
    )
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == slow(r["doc_id"], r["text"])
        assert bytes(r["restored"]) == (r["text"] or "").encode()
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    empty = fim.restored(fim.rearranged(docs.limit(0)))
    assert empty.count() == 0 and "restored" in empty.columns
