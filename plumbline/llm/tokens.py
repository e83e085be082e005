"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are packed into encoder calls of about equal bytes. A text longer than a piece is cut at safe
boundaries, places that no token can span, so that the encoder's working memory is bounded by the
piece and not by the text. For a ``.model`` file a safe boundary is one space after a character that
is neither a space nor the space mark, provided that no entry of the vocabulary has a space mark
after another character; the encoder puts that space back before the next piece, which must not be
empty, so a space that ends the text is no boundary. A vocabulary without that property, and
``.json`` files, get no cuts.
"""

from __future__ import annotations

import re
from typing import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.texts import with_columns

PIECE_CHARS = 16_384
CALL_BYTES = 1 << 20
LIMIT = 4096
MARK = "▁"


def _sentencepiece(model: bytes) -> tuple[Callable[[list[str]], list[int]], bool]:
    import sentencepiece

    encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = (encoder.id_to_piece(i) for i in range(encoder.vocab_size()))
    separable = not any(MARK in p.lstrip(MARK) for p in pieces)
    separable &= encoder.encode("a  b c") == encoder.encode("a") + encoder.encode(" b") + encoder.encode("c")
    return lambda texts: [len(x) for x in encoder.encode(texts, num_threads=1)], separable


def _tokenizers(model: bytes) -> tuple[Callable[[list[str]], list[int]], bool]:
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_str(model.decode())
    encoder.no_truncation()
    encoder.no_padding()
    return lambda texts: [len(x) for x in encoder.encode_batch(texts, add_special_tokens=False)], False


def pieces_of(text: str, size: int = PIECE_CHARS) -> list[str]:
    """``text`` cut at the first safe boundary after every ``size`` characters, without that space."""
    safe = re.compile(f"(?<=[^ {MARK}]) (?=.)", re.DOTALL)
    cut, start = [], 0
    while len(text) - start > size and (m := safe.search(text, start + size)):
        cut.append(text[start : m.start()])
        start = m.end()
    return [*cut, text[start:]]


def token_counts(
    docs: DataFrame,
    path: str,
    text: str = "text",
    limit: int = LIMIT,
    piece_chars: int = PIECE_CHARS,
    call_bytes: int = CALL_BYTES,
) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``path`` names a ``.model`` or ``.json`` vocabulary the driver can read; its bytes travel to the
    tasks. Nothing is added or truncated; special strings inside texts are handled as the library
    does by default. NULL and empty texts have 0 tokens; other columns, repeated rows and their
    order of arrival do not matter; an empty table gives an empty result.
    """
    with open(path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    load = _sentencepiece if path.endswith(".model") else _tokenizers

    def make():
        lengths, separable = load(model.value)

        def compute(texts: list[str | None]):
            counts = np.zeros(len(texts), dtype=np.int64)
            waiting, owners, size = [], [], 0

            def flush():
                np.add.at(counts, owners, lengths(waiting))

            for i, t in enumerate(texts):
                if not t:
                    continue
                for piece in pieces_of(t, piece_chars) if separable else [t]:
                    waiting.append(piece)
                    owners.append(i)
                    size += len(piece.encode())
                    if size >= call_bytes:
                        flush()
                        waiting, owners, size = [], [], 0
            if waiting:
                flush()
            return [counts]

        return compute

    counted = with_columns(docs, text, make, [("n_tokens", "long")])
    return counted.withColumns(
        {
            "n_bytes": F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"),
            "over_limit": F.col("n_tokens") > limit,
        }
    )
