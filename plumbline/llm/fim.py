"""Fill-in-middle by rotating blocks in place.

A text is cut into prefix, middle and suffix at units: a run of ASCII letters is one unit, every other
code point is one. The cuts are found in one scan over the UTF-8 bytes. The text is copied once, into a
buffer that has room for three sentinels, as ``<P>prefix<M>middle<S>suffix``; exchanging two neighbouring
blocks then gives either form. Blocks are exchanged in place by three reversals, each with a small fixed
scratch, so a text of any length needs its own size and no second copy. The inverse finds the sentinels,
rotates the same blocks back and takes the sentinels out.

Units, cuts and forms come from a hash of the document's id, so every run makes the same choice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.texts import with_columns

# The sentinels, and the shares of plain texts and of the suffix-first form in percent.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
SCRATCH = 1 << 16
FIELDS = [("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "binary")]


def draws(doc_id: Column) -> list[Column]:
    """Four numbers of 32 bits from the id; a NULL id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def reverse(view: np.ndarray, start: int, end: int) -> None:
    """Turn ``view[start:end]`` round in place, from both ends inwards."""
    while end - start > 1:
        n = min(SCRATCH, (end - start) // 2)
        kept = view[start : start + n].copy()
        view[start : start + n] = view[end - n : end][::-1]
        view[end - n : end] = kept[::-1]
        start, end = start + n, end - n


def exchange(buffer: bytearray, start: int, between: int, end: int) -> None:
    """``buffer[start:between]`` and ``buffer[between:end]`` change places."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, start, between)
    reverse(view, between, end)
    reverse(view, start, end)


def units(text: bytes) -> np.ndarray:
    """Where each unit of a UTF-8 text starts, in bytes."""
    view = np.frombuffer(text, np.uint8)
    lower = view | 0x20
    letter = (lower >= ord("a")) & (lower <= ord("z"))
    starts = (view & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(starts)


def code_points(text: bytes | memoryview) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def rearranged_text(text: bytes, first: int, second: int, third: int, fourth: int):
    """``n``, ``form``, ``prefix_chars``, ``middle_chars`` and the output as UTF-8."""
    starts = units(text)
    n = len(starts)
    plain = not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or third % 100 >= PLAIN_FROM
    if plain:
        return n, "plain", None, None, text
    cuts = sorted((first % (n + 1), second % (n + 1)))
    a, b = (int(starts[c]) if c < n else len(text) for c in cuts)
    counts = code_points(text[:a]), code_points(text[a:b])
    buffer = bytearray(len(text) + len(PREFIX) + len(MIDDLE) + len(SUFFIX))
    at = 0
    for sentinel, block in ((PREFIX, (0, a)), (MIDDLE, (a, b)), (SUFFIX, (b, len(text)))):
        buffer[at : at + len(sentinel)] = sentinel
        at += len(sentinel)
        buffer[at : at + block[1] - block[0]] = memoryview(text)[block[0] : block[1]]
        at += block[1] - block[0]
    middle_at = len(PREFIX) + a
    suffix_at = middle_at + len(MIDDLE) + b - a
    form = "spm" if fourth % 100 < SPM_BELOW else "psm"
    exchange(buffer, 0 if form == "spm" else middle_at, suffix_at, len(buffer))
    return n, form, *counts, bytes(buffer)


def restored_text(output: bytes, form: str) -> bytes:
    """The text again, from the output and its form alone."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    if form == "spm":
        exchange(buffer, 0, buffer.find(PREFIX), len(buffer))
    else:
        exchange(buffer, buffer.find(SUFFIX), buffer.find(MIDDLE), len(buffer))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.find(sentinel)
        del buffer[at : at + len(sentinel)]
    return bytes(buffer)


def rearranged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n`` (units), ``form`` (``plain``, ``psm`` or ``spm``), ``prefix_chars`` and
    ``middle_chars`` (code points, NULL if plain) and ``output`` (UTF-8 bytes).

    NULL texts are empty ones; empty texts and texts that contain a sentinel are plain. A NULL id draws
    like an empty one; repeated rows come out alike. Texts of any length are handled whole. Other columns
    are kept, those that carry one of these names are replaced; an empty table gives an empty result.
    """
    numbers = [f"__draw_{i}" for i in range(4)]
    rest = docs.drop(*[n for n, _ in FIELDS]).withColumns(dict(zip(numbers, draws(F.col(f"`{doc_id}`")))))

    def make():
        def compute(texts, *drawn):
            rows = [
                rearranged_text(t or b"", *numbers)
                for t, *numbers in zip(texts.view(pa.binary()).to_pylist(), *(d.to_pylist() for d in drawn))
            ]
            return list(zip(*rows)) if rows else [[] for _ in FIELDS]

        return compute

    return with_columns(rest, [text, *numbers], make, FIELDS, raw=True).drop(*numbers)


def restored(found: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``found`` with ``restored``, the text as UTF-8 bytes, from ``output`` and ``form``.

    A NULL output stays NULL. A column named ``restored`` is replaced, the others are kept.
    """

    def make():
        def compute(outputs, forms):
            return [[o if o is None else restored_text(o, f) for o, f in zip(outputs, forms)]]

        return compute

    return with_columns(found, [output, form], make, [("restored", "binary")])
