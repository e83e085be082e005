"""Secret scans: a keyword automaton finds where to look, anchored expressions match there, checksums confirm.

One Aho-Corasick pass over the ASCII-lowered text gives the keyword hits; an expression is tried only
at a hit, anchored to it. Long runs of hexadecimal digits have no keyword, so a run is looked for
directly. Tokens with an embedded checksum (a prefix, 30 characters, then the CRC-32 of those in base
62) are reported only if the checksum holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame

from plumbline.llm.texts import with_columns

# The kinds of secrets, in the order in which they are listed, and their formats.
KINDS = ["assign", "access", "hex", "checked", "key_block"]
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN_REST = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
CHECKED_WORDS = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"]
CHECKED_REST = r"[0-9A-Za-z]{36}(?![0-9A-Za-z])"
KEY_BLOCK_WORD = "-----begin "
KEY_BLOCK = r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----(?:[\x20\t]*+\r?\n[A-Za-z][A-Za-z0-9-]*+:(?:(?!-----)[^\r\n])*+)*+[A-Za-z0-9+/=\s]*+-----END ([A-Z]+ )*PRIVATE KEY-----"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_ASSIGN, MIN_ACCESS = 6, 20

FIELDS = [
    ("n_assign", "long"),
    ("n_access", "long"),
    ("n_hex", "long"),
    ("base_sha256", "string"),
    ("spans", "string"),
]


def checksum_holds(body: str) -> bool:
    """The last 6 of 36 characters are the CRC-32 of the first 30, in base 62."""
    value, digits = zlib.crc32(body[:30].encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits == body[30:]


def scanner():
    """A function from a text to its ``(kind, start, end)`` spans, sorted by start and then kind."""
    words = {w: "assign" for w in ASSIGN_WORDS}
    words |= {w: "checked" for w in CHECKED_WORDS}
    words |= {"akia": "access", KEY_BLOCK_WORD: "key_block"}
    automaton = ahocorasick.Automaton()
    for word, kind in words.items():
        automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    assign, access, run = re.compile(ASSIGN_REST), re.compile(ACCESS), re.compile(HEX)
    checked, block = re.compile(CHECKED_REST), re.compile(KEY_BLOCK)

    def spans(text: str) -> list[tuple[str, int, int]]:
        lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        hits = sorted((last - size + 1, last + 1, kind) for last, (kind, size) in automaton.iter(lowered))
        found, ends = [], dict.fromkeys(KINDS, 0)
        for start, end, kind in hits:
            if start < ends[kind]:
                continue
            if kind == "assign":
                m = assign.match(text, end)
                good = m and len(m[1]) >= MIN_ASSIGN
            elif kind == "access":
                m = access.match(text, start)
                good = m and m.end() - start >= MIN_ACCESS
            elif kind == "checked":
                m = checked.match(text, end) if text[start:end] == lowered[start:end] else None
                good = m and checksum_holds(m[0])
            else:
                m = good = block.match(text, start)
            if m:
                ends[kind] = m.end()
            if good:
                found.append((kind, start, m.end()))
        found += [("hex", m.start(), m.end()) for m in run.finditer(text)]
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))

    return spans


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts per base kind, ``base_sha256`` over the base spans, and all ``spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind in the order of
    ``KINDS``. Per kind, matches are leftmost and do not overlap; one that fails its length or checksum
    is dropped and not tried again. NULL and empty texts have no spans. Repeated rows are each scanned;
    other columns are kept; an empty table gives an empty result.
    """

    def make():
        spans_of = scanner()

        def compute(texts):
            rows = []
            for t in texts:
                found = spans_of(t) if t else []
                base = [s for s in found if s[0] in KINDS[:3]]
                kinds = [s[0] for s in base]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*[kinds.count(k) for k in KINDS[:3]], digest, joined(found)))
            return list(zip(*rows)) if rows else [[] for _ in FIELDS]

        return compute

    return with_columns(docs, text, make, FIELDS)
