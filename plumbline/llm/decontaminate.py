"""Benchmark decontamination: one automaton over all windows of the benchmark, one scan of each text.

Texts and items are normalised alike, to ASCII-lowered words joined by one space. The windows of all
items go into one Aho-Corasick automaton; a normalised text is scanned once, and where a window ends
its words are looked up by offset, which also gives their place in the original text.

The windows are sent to every task, so their size is checked first. Beyond ``PART_BYTES`` they are dealt out
in parts by a hash, and the texts pass one automaton after the other, stored in between, so that a task
never holds two of them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.texts import release, stored, with_columns

WINDOW = 10
#: Bytes of windows in one automaton, which takes some 35 times as much.
PART_BYTES = 8 << 20
# Fixed value: a word, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = {c: c + 32 for c in range(65, 91)}
_RANGES = "array<struct<first:long,end:long>>"
FIELDS = [("n_words", "long"), ("hit_words", _RANGES), ("hit_spans", _RANGES), ("hit_items", "array<string>")]


def words_of(text: str | None) -> list[str]:
    return re.findall(WORD, text.translate(_LOWER)) if text else []


def windows_of(words: list[str], size: int = WINDOW) -> list[str]:
    """Windows of consecutive words; fewer words than a window are one window, none are none."""
    if not words:
        return []
    return [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def windows_table(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``window``, ``n`` (its words) and ``ids`` (of the items that have it, sorted) from ``id`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (window, window.count(" ") + 1, item_id)
                for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for window in dict.fromkeys(windows_of(words_of(text), size))
            ]
            for at in range(0, len(rows), 10_000):
                columns = zip(*rows[at : at + 10_000])
                arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["window", "n", "id"])

    found = items.select("id", "text").mapInArrow(run, "window string, n int, id string")
    return found.groupBy("window", "n").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def automaton_of(windows: list[tuple[str, int, list[str]]]) -> ahocorasick.Automaton:
    """Windows to ``(number of words, ids of their items)``; a border of spaces keeps words whole."""
    automaton = ahocorasick.Automaton()
    for window, n, ids in windows:
        automaton.add_word(f" {window} ", (n, ids))
    automaton.make_automaton()
    return automaton


def occurrences(automaton, words: list[str]):
    """``(first word, end word, item ids)`` of every window that occurs."""
    if not words or not len(automaton):
        return
    starts = np.cumsum([1, *[len(w) + 1 for w in words]]).tolist()
    for last, (n, ids) in automaton.iter(f" {' '.join(words)} "):
        end = bisect_right(starts, last)
        yield end - n, end, ids


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_words`` (ranges of words), ``hit_spans`` (the same as ranges of
    code points of the original text) and ``hit_items`` (sorted ids as strings).

    NULL texts and texts without words have no hits, items without words no windows; items that share
    an id are one item, one whose id is NULL has the id ``''``. Texts of any length are scanned whole. Repeated
    rows are each scanned; other columns are kept, those named like a result are replaced. An empty benchmark hits
    nothing, an empty table gives an empty result.
    """
    items = benchmark.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{item_text}`").alias("text")
    )
    windows = stored(windows_table(items, window), "windows")
    bytes_of = F.octet_length("window") + F.aggregate("ids", F.lit(0), lambda total, i: total + F.octet_length(i))
    size = windows.agg(F.sum(bytes_of)).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    found, before = docs, None
    for part in range(parts):
        chosen = windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)
        shared = docs.sparkSession.sparkContext.broadcast([(r["window"], r["n"], r["ids"]) for r in chosen.collect()])
        found = _scan(found, text, shared, first=part == 0)
        if part < parts - 1:
            found = stored(found, "hits")
            if before is not None:
                release(before)
            before = found
    return found


def _scan(docs: DataFrame, text: str, shared, first: bool) -> DataFrame:
    """Add the occurrences of one part's windows; every part but the first sees what others found."""

    def make():
        automaton = automaton_of(shared.value)

        def compute(values):
            columns = [[], [], [], []]
            for value in values:
                t, ranges, items = (value, [], set()) if first else _earlier(value)
                words = words_of(t)
                for start, end, owners in occurrences(automaton, words):
                    ranges.append((start, end))
                    items.update(owners)
                merged = merged_ranges(ranges)
                places = [m.span() for m in re.finditer(WORD, t.translate(_LOWER))] if merged else []
                columns[0].append(len(words))
                columns[1].append([{"first": a, "end": b} for a, b in merged])
                columns[2].append([{"first": places[a][0], "end": places[b - 1][1]} for a, b in merged])
                columns[3].append(sorted(items))
            return columns

        return compute

    if first:
        return with_columns(docs, text, make, FIELDS)
    packed = docs.withColumn("__packed", F.struct(F.col(f"`{text}`").alias("text"), "hit_words", "hit_items"))
    return with_columns(packed, "__packed", make, FIELDS).drop("__packed")


def _earlier(value: dict):
    return value["text"], [(r["first"], r["end"]) for r in value["hit_words"]], set(value["hit_items"])


def merged_ranges(ranges: list[tuple[int, int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for first, end in sorted(ranges):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([first, end])
    return merged


def digest(found: DataFrame) -> DataFrame:
    """``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` from the columns of ``contamination``."""
    covered = F.aggregate("hit_words", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["first"])
    return found.withColumns(
        {
            "n_hit": covered,
            "n_items": F.size("hit_items").cast("long"),
            "items_sha256": F.sha2(F.array_join("hit_items", ",").cast("binary"), 256),
            "contaminated": F.size("hit_words") > 0,
        }
    )
