"""Substring deduplication: words inside a window of words that starts anywhere else are removed.

1. Anchors. In every window the eight-word phrase with the smallest hash is its anchor. Equal windows have
   equal anchors, and one anchor serves about fourteen windows, so counting anchors finds where anything
   can recur. Anchors seen twice set bits of a filter of at most ``FILTER_BITS`` bits, which goes to every
   task; what it lets through by chance costs time and changes nothing.
2. Segments. For every anchor that passes, the words of its windows. Equal segments are one row with a
   count. Their windows are counted by hash; those seen twice are confirmed, each with one witness.
3. Automata. Runs of confirmed windows of a witness are passages. Segments and passages are dealt by
   anchor to shards, and within a shard to parts of bounded size, so that a phrase that a third of the
   documents share fills many parts. Each part compiles the tiles of its passages, pieces so short that
   every window holds one whole, into an Aho-Corasick automaton and streams its segments through it; the
   windows around a hit are compared word by word with the passage that has a window of that hash.
4. Occurrences go back to documents as ranges of words.

Ranges are compared as text; hashes only choose what is compared and count it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import accumulate, groupby
from operator import itemgetter
from typing import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.texts import release, stored, with_columns

WINDOW = 35
PHRASE = 8
TILE = 18
FILTER_BITS = 1 << 27
FILTER_SHARE = 32
SHARD_SEGMENTS = 4_000
PART_ROWS = 8_000
FOLD = 50_000
GROUP_WORDS = 50_000
GROUP_BYTES = 1 << 18
PLACE_BITS, CHUNK = 20, 1 << 19
#: Ranges of words that may be sent to every task, two numbers each.
BROADCAST_RANGES = 1_000_000
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_IN_WORD = np.array([c not in b" \t\n\v\f\r" for c in range(256)], dtype=np.int8)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive words."""
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    return sequence_hashes(np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words)), size)


def _mixed(found: np.ndarray) -> np.ndarray:
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(32))


def sequence_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive hashes, from sums of hashes times powers."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * _powers(_ODD, n), out=sums[1:])
    return _mixed((sums[size:] - sums[:-size]) * _powers(_INVERSE, n - size + 1))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of ``text`` start and end, and a hash of each, from sums of bytes times powers."""
    buffer = np.frombuffer(text, dtype=np.uint8)
    inside = np.zeros(len(buffer) + 2, dtype=np.int8)
    inside[1:-1] = _IN_WORD[buffer]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    found = [np.zeros(0, np.uint64)]
    for at in range(0, len(starts), GROUP_WORDS):
        first, last = starts[at : at + GROUP_WORDS], ends[at : at + GROUP_WORDS]
        part = buffer[first[0] : last[-1]]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part + np.uint64(1)) * _powers(_ODD, len(part)), out=sums[1:])
        a, b = first - first[0], last - first[0]
        found.append(_mixed((sums[b] - sums[a]) * _powers(_INVERSE, len(part))[a]))
    return starts, ends, np.concatenate(found)


def windows_of_all(lists: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The window hashes of many short lists at once, with the list and the place of each."""
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    found = window_hashes([w for x in lists for w in x], size)
    counts = np.maximum(sizes - size + 1, 0)
    owner = np.repeat(np.arange(len(lists)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return found[(np.cumsum(sizes) - sizes)[owner] + at].view(np.int64), owner, at


def anchors_of(phrases: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """The place of each window's anchor, from the hash of the phrase at every place.

    Of equal hashes the leftmost is meant. A place takes the low bits of a hash, chunk by chunk, so the
    smallest of a window is found by doubling.
    """
    width = window - phrase + 1
    n = len(phrases) - width + 1
    low = np.uint64((1 << PLACE_BITS) - 1)
    found = [np.zeros(0, np.int64)]
    for at in range(0, n, CHUNK):
        part = phrases[at : at + CHUNK + width - 1]
        least = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        found.append((least & low).astype(np.int64) + at)
    return np.concatenate(found)


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, in runs of about ``GROUP_BYTES``, each with the number of its first text."""
    first, group, size = 0, [], 0
    for i, text in enumerate(texts):
        group.append(text.encode("utf-8", "surrogatepass") if text else b"")
        size += len(group[-1])
        if size >= GROUP_BYTES:
            yield first, group
            first, group, size = i + 1, [], 0
    if group:
        yield first, group


class Segments:
    """Runs of windows that share an anchor, of many texts at once. No run goes on into the next text.

    ``owner`` is the text, ``first`` and ``last`` are the places of a run's windows in it, ``anchors`` the
    hashes of the anchors.
    """

    def __init__(self, texts: list[bytes], window: int, phrase: int):
        self.joined, self.window = b"\n".join(texts), window
        self.starts, self.ends, hashes = word_hashes(self.joined)
        to = np.searchsorted(self.starts, np.cumsum([len(t) + 1 for t in texts]))
        sizes = np.diff(to, prepend=0)
        phrases = sequence_hashes(hashes, phrase)
        places = anchors_of(phrases, window, phrase)
        whole = np.flatnonzero(np.repeat(to, sizes)[: len(places)] - np.arange(len(places)) >= window)
        places = places[whole]
        new = np.flatnonzero(places[1:] != places[:-1]) + 1
        self.from_word = whole[np.concatenate([[0], new])] if len(whole) else whole
        self.to_word = whole[np.concatenate([new - 1, [len(whole) - 1]])] + window if len(whole) else whole
        self.anchors = phrases[places[np.concatenate([[0], new])]] if len(whole) else np.zeros(0, np.uint64)
        self.owner = np.searchsorted(to, self.from_word, side="right")
        before = (to - sizes)[self.owner]
        self.first, self.last = self.from_word - before, self.to_word - window - before

    def words(self, i: int) -> bytes:
        """The words of a run's windows, joined by one space."""
        return b" ".join(self.joined[self.starts[self.from_word[i]] : self.ends[self.to_word[i] - 1]].split())


def _anchor_rows(texts: DataFrame, window: int, phrase: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            found += [Segments(group, window, phrase).anchors for _, group in _groups(batch.column(0).to_pylist())]
            # Counts within a batch travel as one row per anchor.
            anchors, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(counts)], names=["anchor", "n"])

    return texts.mapInArrow(run, "anchor long, n long")


def _filter_of(anchors: DataFrame, limit_bits: int) -> np.ndarray:
    """Bits of the anchors seen twice, gathered word by word: at most ``limit_bits`` / 64 numbers."""
    seen = stored(anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "anchors")
    bits = 1 << 16
    while bits < min(limit_bits, FILTER_SHARE * seen.count()):
        bits *= 2
    place = F.col("anchor").bitwiseAND(F.lit(bits - 1).cast("long"))
    words = seen.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(anchor & 63 AS INT))")).alias("bits")
    )
    table = words.toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint64)


def _passes(bits: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    place = anchors & np.uint64(64 * len(bits) - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def _segments(texts: DataFrame, shared, window: int, phrase: int) -> DataFrame:
    """Two kinds of rows about segments that may recur, told apart by ``n``.

    Occurrences have ``anchor``, ``h`` (hash of the words), ``k1``, ``k2`` and ``first``. Contents have
    ``anchor``, ``h``, ``n`` and ``words``: what a task has met ``n`` times, so that a segment's words
    leave a task once for up to ``FOLD`` segments.
    """
    names = ["anchor", "h", "k1", "k2", "first", "n", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        met: dict[tuple[int, int], list] = {}

        def batch_of(columns):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if i == 6 else pa.int64()) for i, c in enumerate(columns)], names=names
            )

        def contents():
            nothing = [None] * len(met)
            rows = [[k[0] for k in met], [k[1] for k in met], nothing, nothing, nothing]
            out = batch_of([*rows, [v[0] for v in met.values()], [v[1].decode("utf-8", "surrogatepass") for v in met.values()]])
            met.clear()
            return out

        for batch in batches:
            rows = [[] for _ in range(5)]
            k1, k2 = (batch.column(i).to_pylist() for i in (1, 2))
            for place, group in _groups(batch.column(0).to_pylist()):
                found = Segments(group, window, phrase)
                kept = np.flatnonzero(_passes(bits, found.anchors))
                owners, starts = found.owner[kept].tolist(), found.first[kept].tolist()
                for at, i, a, anchor in zip(kept.tolist(), owners, starts, found.anchors[kept].view(np.int64).tolist()):
                    segment = found.words(at)
                    h = xxhash.xxh64_intdigest(segment)
                    h = h - (1 << 64) if h >> 63 else h
                    known = met.setdefault((anchor, h), [0, segment])
                    known[0] += 1
                    for column, value in zip(rows, (anchor, h, k1[place + i], k2[place + i], a)):
                        column.append(value)
                if len(met) >= FOLD:
                    yield contents()
            nothing = [None] * len(rows[0])
            yield batch_of([*rows, nothing, nothing])
        yield contents()

    return texts.mapInArrow(run, "anchor long, h long, k1 long, k2 long, first long, n long, words string")


def _window_rows(distinct: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, n = (batch.column(i).to_numpy() for i in range(2))
            hashes, owner, _ = windows_of_all([words_of(t) for t in batch.column(2).to_pylist()], window)
            columns = [hashes, sid[owner], n[owner]]
            for at in range(0, len(hashes), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 200_000]) for c in columns], names=["w", "sid", "n"])

    return distinct.select("sid", "n", "words").mapInArrow(run, "w long, sid long, n long")


def runs_of(starts: list[int]) -> list[tuple[int, int]]:
    """Consecutive numbers as ``(first, last)``."""
    out: list[list[int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1] + 1:
            out[-1][1] = s
        else:
            out.append([s, s])
    return [tuple(r) for r in out]


def locate(sources: list[str], confirmed: np.ndarray, segments: list[str], window: int, tile: int) -> list[list[tuple[int, int]]]:
    """Per segment the ranges of words whose windows are among the ``confirmed`` ones that ``sources`` hold.

    Of equal windows one is kept, and runs of those are the passages whose tiles the automaton holds.
    What a hit tells is which windows to look up and compare, so its cost does not depend on how many
    passages share a tile.
    """
    found: list[list[tuple[int, int]]] = [[] for _ in segments]
    listed = [words_of(t) for t in sources]
    hashes, owner, at = windows_of_all(listed, window)
    recurs = np.flatnonzero(np.isin(hashes, confirmed))
    known, first = np.unique(hashes[recurs], return_index=True)
    if not len(known):
        return found
    owner, at = owner[recurs[first]], at[recurs[first]]
    automaton = ahocorasick.Automaton()
    for i, starts in groupby(sorted(zip(owner.tolist(), at.tolist())), key=itemgetter(0)):
        for a, b in runs_of([s for _, s in starts]):
            for p in range(a, b + window - tile + 1, tile):
                automaton.add_word(f" {b' '.join(listed[i][p : p + tile]).decode('utf-8', 'surrogatepass')} ", True)
    automaton.make_automaton()

    words = [words_of(t) for t in segments]
    theirs, of, _ = windows_of_all(words, window)
    place = np.minimum(np.searchsorted(known, theirs), len(known) - 1)
    alike = known[place] == theirs
    bounds = np.searchsorted(of, np.arange(len(segments) + 1)).tolist()
    for i, text in enumerate(segments):
        a, b = bounds[i], bounds[i + 1]
        if not alike[a:b].any():
            continue
        ends = list(accumulate((len(w) + 1 for w in text.split(" ")), initial=0))
        hit = np.zeros(b - a, dtype=bool)
        for last, _ in automaton.iter(f" {text} "):
            end = bisect_left(ends, last)
            hit[max(0, end - window) : end - tile + 1] = True
        here = np.flatnonzero(hit & alike[a:b])
        source, start = owner[place[a + here]], at[place[a + here]]
        cuts = np.flatnonzero((np.diff(here) != 1) | (np.diff(source) != 0) | (np.diff(start) != 1)) + 1
        for run in np.split(np.arange(len(here)), cuts):
            if len(run):
                left, right = int(here[run[0]]), int(here[run[-1]]) + window
                other, s = listed[source[run[0]]], int(start[run[0]])
                if words[i][left:right] == other[s : s + right - left]:
                    found[i].append((left, right))
                else:
                    places = range(right - left - window + 1)
                    same = (p for p in places if words[i][left + p : left + p + window] == other[s + p : s + p + window])
                    found[i] += [(left + p, left + p + window) for p in same]
    return found


def repeated_ranges(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    phrase: int = PHRASE,
    filter_bits: int = FILTER_BITS,
    shard_segments: int = SHARD_SEGMENTS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """``k1``, ``k2`` (the document, see ``document_keys``) and ``ranges`` of words to remove, flat."""
    tile = min(TILE, (window + 1) // 2)
    phrase = min(phrase, window)
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"), *document_keys(doc_id, text))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(_filter_of(_anchor_rows(texts.select("text"), window, phrase), filter_bits))
    segments = stored(_segments(texts, shared, window, phrase), "segments")

    contents = segments.where(F.col("n").isNotNull()).groupBy("anchor", "h")
    distinct = contents.agg(F.sum("n").alias("n"), F.max("words").alias("words"))
    distinct = stored(distinct.withColumn("sid", F.xxhash64("anchor", "h")), "distinct-segments")
    confirmed = (
        _window_rows(distinct, window).groupBy("w").agg(F.sum("n").alias("n"), F.min("sid").alias("sid")).where("n > 1")
    )
    witnesses = confirmed.groupBy("sid").agg(F.collect_list("w").alias("windows"))
    passages = stored(witnesses.join(distinct.select("sid", "anchor", "h"), "sid"), "passages")

    total = distinct.count()
    shards = max(1, -(-total // shard_segments))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard")
    sizes = distinct.groupBy(shard).agg(F.count(F.lit(1)).alias("rows"))
    counts = passages.groupBy(shard).agg(F.count(F.lit(1)).alias("passages"))
    plan = stored(
        sizes.join(counts, "shard").select(
            "shard", F.ceil(F.col("rows") / part_rows).alias("cuts"), F.ceil(F.col("passages") / part_rows).alias("parts")
        ),
        "shards",
    )
    own = lambda n: F.pmod(F.xxhash64("h", F.lit(1)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    left = distinct.withColumn("shard", shard).join(plan, "shard")
    left = left.select("shard", own(F.col("cuts")).alias("cut"), every(F.col("parts")).alias("part"), "anchor", "h", "words")
    right = passages.withColumn("shard", shard).join(plan, "shard")
    # In a shard of one part a passage's words are those of a segment beside it.
    whole = right.where("cuts * parts = 1").withColumn("words", F.lit(None).cast("string"))
    split = right.where("cuts * parts > 1").join(distinct.select("anchor", "h", "words"), ["anchor", "h"])
    right = whole.unionByName(split, allowMissingColumns=True).select(
        "shard", every(F.col("cuts")).alias("cut"), own(F.col("parts")).alias("part"), "anchor", "h", "words", "windows"
    )

    def scan(segs: pa.Table, pats: pa.Table) -> pa.Table:
        ids = list(zip(segs.column("anchor").to_pylist(), segs.column("h").to_pylist()))
        texts_here = segs.column("words").to_pylist()
        here = dict(zip(ids, texts_here))
        rows = pats.select(["anchor", "h", "words"]).to_pylist()
        owned = [row["words"] or here.get((row["anchor"], row["h"]), "") for row in rows]
        # Any confirmed window counts here, whoever is its witness.
        confirmed = pats.column("windows").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        found = locate(owned, confirmed, texts_here, window, tile)
        hit = [i for i, r in enumerate(found) if r]
        taken = segs.select(["anchor", "h"]).take(pa.array(hit, pa.int64()))
        return taken.append_column("ranges", pa.array([[x for r in found[i] for x in r] for i in hit], pa.list_(pa.int64())))

    keys = ["shard", "cut", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "anchor long, h long, ranges array<long>")
    shifted = F.transform("ranges", lambda x: x + F.col("first"))
    occurrences = segments.where(F.col("n").isNull()).select("anchor", "h", "k1", "k2", "first")
    of_documents = occurrences.join(found, ["anchor", "h"]).groupBy("k1", "k2")
    loose = of_documents.agg(F.flatten(F.collect_set(shifted)).alias("loose"))
    merged = with_columns(loose, "loose", lambda: lambda rows: [[merge(r) for r in rows]], [("ranges", "array<long>")])
    merged = stored(merged.drop("loose"), "ranges")
    release(segments, distinct, passages)
    return merged


def merge(ranges: list[int]) -> list[int]:
    """Flat ranges, sorted and with overlapping ones as one."""
    out: list[int] = []
    for first, end in sorted(zip(ranges[::2], ranges[1::2])):
        if out and first <= out[-1]:
            out[-1] = max(end, out[-1])
        else:
            out += [first, end]
    return out


def document_keys(doc_id: str, text: str):
    """128 bits of id and text; rows that repeat both have one key and one result."""
    columns = [F.col(f"`{doc_id}`"), F.col(f"`{text}`")]
    return F.xxhash64(*columns).alias("k1"), F.xxhash64(*reversed(columns), F.lit(1)).alias("k2")


def kept_words(words: list[bytes], ranges: list[int] | None) -> list[bytes]:
    if not ranges:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(gone, ranges[::2], 1)
    np.add.at(gone, ranges[1::2], -1)
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist()) if not g]


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, **options: int
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by one space), ``kept_sha256``.

    Words are what ASCII white space separates, unchanged. NULL and empty texts have none; texts of fewer
    words than a window keep all. Rows are documents: rows that repeat a text lose all windows of it. Other
    columns are kept unless they carry one of these names; an empty table gives an empty result.
    """
    ranges = repeated_ranges(docs, doc_id, text, window, **options)
    size = ranges.agg(F.sum(F.size("ranges") + 2)).first()[0] or 0
    side = F.broadcast(ranges) if size <= 2 * BROADCAST_RANGES else ranges
    names = ["n_words", "n_removed", "kept_text", "kept_sha256"]
    rest = docs.drop(*[c for c in docs.columns if c in names and c not in (doc_id, text)])
    k1, k2 = document_keys(doc_id, text)
    side = side.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("ranges").alias("__ranges"))
    keyed = rest.withColumns({"__a": k1, "__b": k2})
    joined = keyed.join(side, (F.col("__a") == F.col("__k1")) & (F.col("__b") == F.col("__k2")), "left")
    packed = joined.withColumn("__packed", F.struct(F.col(f"`{text}`").cast("string").alias("text"), F.col("__ranges").alias("ranges")))
    packed = packed.drop("__a", "__b", "__k1", "__k2", "__ranges")

    def make():
        def compute(values):
            columns = [[], [], [], []]
            for value in values:
                words = words_of(value["text"])
                kept = kept_words(words, value["ranges"])
                joined_words = b" ".join(kept)
                columns[0].append(len(words))
                columns[1].append(len(words) - len(kept))
                columns[2].append(joined_words.decode("utf-8", "surrogatepass"))
                columns[3].append(hashlib.sha256(joined_words).hexdigest())
            return columns

        return compute

    return with_columns(packed, "__packed", make, list(zip(names, ["long", "long", "string", "string"]))).drop("__packed")
