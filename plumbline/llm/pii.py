"""Personal data: generators propose spans, boosted trees rate them, calibrated thresholds select redactions.

Four kinds have strict rules; their spans are always taken. Generators with loose rules propose further,
overlapping spans: addresses with spelled-out signs, groups of digits with any separators, addresses of
the longer protocol. Gradient boosted trees rate a proposal by its format and by what stands around it.
They learn from all proposals of all different texts. Right are those that a strict span meets, and those that
read as an address or number when they are parsed (``reads_as_right``), which strict spans have no part in. So
that both are known whatever the texts hold, texts are learned again with a strict span rewritten into another
form, and with made-up addresses and look-alikes (times, device numbers, prices, dates) between their words. What
the strict rules test for (check digits, the plus sign, ranges) is kept from the features, so that the trees learn
what such data looks like and where it stands. The texts of one half teach the trees, those of the other set, per
generator, the threshold from which proposals are right in at least ``PRECISION`` of the cases; only proposals that
no strict span meets count there, as only these are selected, and those of rewritten texts together weigh as much as
those of real ones.

Features are whole numbers up to ``TOP``, so that proposals fold to different vectors with their number; these stay
on the cluster. A level of a tree is one job, in which tasks add up whole parts of the gradients by node, feature and
value; sums do not depend on the order of rows. Only they, and the numbers of proposals by rate, come to the driver.
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.texts import release, stored, with_columns

# Kinds in the order in which they are listed, and the rules of the strict ones.
STRICT = ["email", "ip", "card", "phone"]
LOOSE = ["email_like", "ip_like", "number_like"]
KINDS = STRICT + LOOSE
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)

SPELLED = r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}){1,6}"
GROUPS = r"\(?[0-9][0-9().\x20/-]{4,22}[0-9]"
LONG_IP = r"(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}"
CUES = ("call", "tel", "phone", "fax", "mobile", "mail", "contact", "write", "card", "visa", "account", "ip", "host", "ssn", "id")

#: Characters on each side of a rewritten or made-up span that are learned with it.
AROUND = 120

ROUNDS, DEPTH, RATE, LEAF = 30, 3, 0.2, 20
PRECISION = 0.98
#: The largest value of a feature; gradients are whole numbers of this part, and rates of that one.
TOP, PART, RATES = 255, 1 << 20, 10_000
FIELDS = [(f"n_{k}", "long") for k in STRICT] + [("base_sha256", "string"), ("spans", "string")]


def luhn(digits: str) -> bool:
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(twice[d] for d in back[1::2])) % 10 == 0


def _emails(text: str, domain) -> list[tuple[int, int]]:
    """Leftmost matches of a local part, an at sign and a domain, found from the at signs."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = domain.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def strict_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the strict kinds, by start and then kind."""
    found = [("email", a, b) for a, b in _emails(text, re.compile(DOMAIN))]
    for m in re.finditer(IP, text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(CARD, text):
        digits = re.sub("[^0-9]", "", m[0])
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in re.finditer(PHONE, text):
            if PHONE_DIGITS[0] <= len(re.sub("[^0-9]", "", m[0])) <= PHONE_DIGITS[1]:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Spans of the generators; those of different generators may overlap."""
    found = []
    if "@" in text or "(at)" in text or "[at]" in text:
        signs = [m.start() for m in re.finditer(r"@|\(at\)|\[at\]", text)]
        rule, free = re.compile(SPELLED), 0
        for sign in signs:
            start = sign - 1 if sign and text[sign - 1] == " " else sign
            end = start
            while start > max(free, end - 64) and text[start - 1] in LOCAL_CHARS:
                start -= 1
            m = rule.match(text, start) if start < end else None
            if m:
                found.append(("email_like", *m.span()))
                free = m.end()
    if ":" in text:
        found += [("ip_like", *m.span()) for m in re.finditer(LONG_IP, text)]
    found += [("number_like", *m.span()) for m in re.finditer(GROUPS, text)]
    return found


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and what stands around it."""
    span = text[start:end]
    digits = sum(c.isdigit() for c in span)
    letters = sum(c.isalpha() for c in span)
    groups = re.findall("[0-9]+", span)
    before = re.findall(r"[^\W\d_]+", text[max(0, start - 40) : start].lower())[-3:]
    previous, following = text[start - 1 : start], text[end : end + 1]
    return [
        float(LOOSE.index(kind)),
        float(end - start),
        float(digits),
        float(letters),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(span.count(".")),
        float(span.count("-")),
        float(span.count(" ")),
        float(span.count("(") + span.count(")")),
        float(span.count("@")),
        float(any(w in CUES for w in before)),
        float(previous.isalnum()),
        float(following.isalnum()),
        float(previous == "\n" or not previous),
        float(span.count(":")),
        float(span.count("[")),
        float(previous == ":" or following == ":"),
        float(span[-1].isalpha()),
        float(span.lstrip("(").startswith("00")),
    ]


N_FEATURES = 21


def reads_as_right(text: str, kind: str, start: int, end: int) -> bool:
    """Whether a proposal is a whole address of the longer protocol, an email address with other signs, a card number
    in groups with points, or an international phone number that begins with two zeros."""
    span, near = text[start:end], text[start - 1 : start] + text[end : end + 1]
    if any(c.isalnum() or c == ":" for c in near):
        return False
    if kind == "ip_like":
        try:
            return ipaddress.ip_address(span).version == 6
        except ValueError:
            return False
    if kind == "number_like":
        if re.fullmatch(r"[0-9]{3,6}(\.[0-9]{3,7}){2,4}", span):
            digits = span.replace(".", "")
            return CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits)
        digits = re.sub("[^0-9]", "", span)
        return bool(re.match(r"\(?00[1-9]", span)) and PHONE_DIGITS[0] <= len(digits) - 2 <= PHONE_DIGITS[1]
    if kind == "email_like":
        plain = re.sub(r"\x20?(?:\(dot\)|\[dot\])\x20?", ".", re.sub(r"\x20?(?:@|\(at\)|\[at\])\x20?", "@", span))
        return bool(re.fullmatch(rf"[A-Za-z0-9._%+-]*[A-Za-z][A-Za-z0-9._%+-]*@{DOMAIN}", plain) and re.search(r"\.[A-Za-z]{2,24}$", plain))
    return False


def spelled(email: str, rng: random.Random) -> str:
    """``email`` with other signs; one of them differs from the strict form at least."""
    name, _, host = email.partition("@")
    at = rng.choice([" @ ", " (at) ", " [at] ", "(at)", "[at]"])
    dot = rng.choice([".", " (dot) ", " [dot] ", "(dot)", "[dot]"])
    return name + at + host.replace(".", dot)


def pointed(card: str) -> str:
    """A card number in groups of four with points."""
    digits = re.sub("[^0-9]", "", card)
    cuts = [0, 4, 8, 12, len(digits)]
    return ".".join(digits[a:b] for a, b in zip(cuts, cuts[1:]))


def long_address(rng: random.Random) -> str:
    return ":".join(f"{rng.randrange(16 ** rng.choice([1, 2, 3, 4, 4, 4])):x}" for _ in range(8))


def variants(text: str, strict: list[tuple[str, int, int]]) -> list[str]:
    """Parts of ``text`` with strict spans in other forms, and with made-up addresses and look-alikes in them."""
    rng, out = random.Random(zlib.crc32(text.encode())), []

    def put(start: int, end: int, what: str) -> None:
        out.append(text[max(0, start - AROUND) : start] + what + text[end : end + AROUND])

    forms = {"email": lambda s: spelled(s, rng), "ip": lambda s: long_address(rng), "card": pointed, "phone": lambda s: "00" + s[1:].lstrip()}
    for kind, form in forms.items():
        mine = [s for s in strict if s[0] == kind]
        if mine:
            _, a, b = rng.choice(mine)
            put(a, b, form(text[a:b]))
    gaps = [m.start() for m in re.finditer(" ", text)]
    if gaps and rng.random() < 0.5:
        letters = "abcdefghijklmnopqrstuvwxyz"
        word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 11)))
        two = lambda n: f"{rng.randrange(n):02d}"
        email = f"{word()}{rng.choice(['', '.' + word(), str(rng.randrange(100))])}@{word()}{rng.choice(['', '.' + word()])}.{word()[:3]}"
        device = ":".join(f"{rng.randrange(256):02x}" for _ in range(rng.choice([4, 6, 6, 16, 20])))
        price = f"{word()} @ {rng.randrange(100)}.{two(100)}"
        made = [
            long_address(rng),
            spelled(email, rng),
            rng.choice([device, f"{two(24)}:{two(60)}:{two(60)}:{two(60)}"]),
            rng.choice([f"{two(24)}.{two(12)}.20{two(30)}", f"20{two(30)}/{two(12)}/{two(28)} {two(24)}", f"{rng.randrange(1000)}.{rng.randrange(10**9):09d}", f"00{rng.randrange(10**6)}-{two(100)}"]),
            rng.choice([price, f"{word()} @ {word()}. {word().title()}", f"{word()} @ {rng.randrange(9)}.{rng.randrange(30)}.{rng.randrange(9)}"]),
        ]
        for what in made:
            at = rng.choice(gaps)
            put(at, at, " " + what)
    return out


@dataclass
class Trees:
    """Boosted regression trees of one depth, as arrays; a row goes right where the feature exceeds the cut."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            total += value[node - len(feature)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))

    def rate(self, x: np.ndarray) -> np.ndarray:
        """Probabilities in whole steps, of which there are few enough to count."""
        return np.floor(self.probability(x) * RATES) / RATES


def place(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row among those of ``depth`` in the tree that is being grown."""
    node = np.zeros(len(x), dtype=np.int64)
    for _ in range(depth):
        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
    return node - (2**depth - 1)


def histograms(x: np.ndarray, y: np.ndarray, n: np.ndarray, model: Trees, feature, cut, depth: int, bins: int) -> np.ndarray:
    """Numbers of rows, gradients and weights by node of ``depth``, feature and value, the latter two in parts."""
    p = model.probability(x)
    node, sums = place(x, feature, cut, depth), np.zeros((2**depth, 3, x.shape[1], bins), np.int64)
    parts = n, np.round((y - p) * PART).astype(np.int64) * n, np.round(p * (1 - p) * PART).astype(np.int64) * n
    for f in range(x.shape[1]):
        slot = node * bins + x[:, f].astype(np.int64)
        for i, part in enumerate(parts):
            # Doubles hold whole numbers up to 2**53, far more than a batch adds up to.
            sums[:, i, f] = np.bincount(slot, part, 2**depth * bins).astype(np.int64).reshape(2**depth, bins)
    return sums


def grow(base_rate: float, summed: Callable, rounds: int = ROUNDS) -> Trees:
    """Second-order boosting of the logistic loss with splits between whole values; ``summed(model, feature, cut, depth)``
    gives the histograms of all rows."""
    rate = min(max(base_rate, 1e-3), 1 - 1e-3)
    model = Trees(float(np.log(rate / (1 - rate))), *[np.zeros((0, n)) for n in (2**DEPTH - 1, 2**DEPTH - 1, 2**DEPTH)])
    model.feature = model.feature.astype(np.int64)
    for _ in range(rounds):
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        value = np.zeros(2**DEPTH)
        for depth in range(DEPTH):
            sums = summed(model, feature, cut, depth)
            for i, node in enumerate(range(2**depth - 1, 2 ** (depth + 1) - 1)):
                feature[node], cut[node] = _best_split(sums[i])
                if depth == DEPTH - 1:
                    of = sums[i, 1:, feature[node]] / PART
                    right = np.arange(of.shape[1]) > cut[node]
                    for side, mine in ((0, ~right), (1, right)):
                        value[2 * i + side] = RATE * of[0, mine].sum() / (of[1, mine].sum() + 1.0)
        model.feature = np.vstack([model.feature, feature])
        model.cut = np.vstack([model.cut, cut])
        model.value = np.vstack([model.value, value])
    return model


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Trees:
    """Trees from rows of whole numbers at hand."""
    n = np.ones(len(x), np.int64)
    return grow(y.mean(), lambda model, *tree: histograms(x, y, n, model, *tree, int(x.max()) + 1), rounds)


def _best_split(sums: np.ndarray) -> tuple[int, float]:
    """The feature and the cut that gain most, the first of equals; no cut where nothing is gained."""
    n, gradient, weight = np.cumsum(sums, axis=2)
    enough = (n >= LEAF) & (n[:, -1:] - n >= LEAF)
    gradient, weight = gradient / PART, weight / PART
    left = gradient**2 / (weight + 1.0)
    right = (gradient[:, -1:] - gradient) ** 2 / (weight[:, -1:] - weight + 1.0)
    gains = np.where(enough, left + right - left[:, -1:], 0.0)
    f, value = np.unravel_index(int(gains.argmax()), gains.shape)
    return (int(f), float(value) + 0.5) if gains[f, value] > 1e-9 else (0, np.inf)


def thresholds(probability: np.ndarray, y: np.ndarray, kind: np.ndarray, precision: float, weight: np.ndarray | None = None) -> list[float]:
    """Per generator, the lowest rate from which at least ``precision`` of the proposals, by weight, are right; else
    none passes."""
    out = []
    weight = np.ones(len(y)) if weight is None else weight
    for k in range(len(LOOSE)):
        mine = np.flatnonzero(kind == k)
        order = mine[np.argsort(-probability[mine], kind="stable")]
        right = np.cumsum(y[order] * weight[order]) / np.cumsum(weight[order])
        last = np.flatnonzero((right >= precision) & np.append(np.diff(probability[order]) < 0, True)[: len(order)])
        out.append(float(probability[order[last[-1]]]) if len(last) else 2.0)
    return out


class Ranges:
    """Stretches of a text that do not overlap, in order, so that asking takes a binary search."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, span) -> bool:
        i = bisect_right(self.ends, span[1])
        return i < len(self.starts) and self.starts[i] < span[2]

    def add(self, span) -> None:
        """``span`` meets none of them."""
        i = bisect_right(self.starts, span[1])
        self.starts.insert(i, span[1])
        self.ends.insert(i, span[2])


def _vectors(text: str, half: int) -> bytes:
    """A vector per proposal of a text and of its variants: features, right, met by a strict span, made up, half."""
    out = bytearray()
    spans = strict_spans(text)
    for i, part in enumerate([text, *variants(text, spans)]):
        strict = Ranges(strict_spans(part) if i else spans)
        for span in proposals(part):
            met = strict.meets(span)
            out += bytes(min(int(v), TOP) for v in features(part, *span))
            out += bytes((met or reads_as_right(part, *span), met, i > 0, half))
    return bytes(out)


def _rows_of(vectors: pa.Array, numbers: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, what follows them, and the number of every vector."""
    table = np.frombuffer(b"".join(vectors.to_pylist()), np.uint8).reshape(len(vectors), N_FEATURES + 4).astype(float)
    return table[:, :N_FEATURES], table[:, N_FEATURES:].T, numbers.to_numpy().astype(np.int64)


def folded_proposals(docs: DataFrame, text: str) -> DataFrame:
    """``v``, a vector, and ``n``, how many proposals of different texts have it. A text that many rows repeat is
    learned once; its rows meet by 128 bits of hashes, as the texts themselves are not shuffled."""
    t = F.col(f"`{text}`").cast("string")
    rows = docs.select(t.alias("text")).where(F.length("text") > 0).select(
        "text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("i")
    )

    def make():
        return lambda texts, seeds: [[_vectors(t, i % 2) for t, i in zip(texts, seeds)]]

    found = with_columns(rows, ["text", "i"], make, [("rows", "binary")]).where(F.length("rows") > 0)
    different = found.groupBy("h", "i").agg(F.min("rows").alias("rows"))
    width = N_FEATURES + 4

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), f"V{width}")
            vectors, n = np.unique(all_rows, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(vectors.tolist(), pa.binary()), pa.array(n, pa.int64())], names=["v", "n"])

    return different.select("rows").mapInArrow(fold, "v binary, n long").groupBy("v").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str, precision: float = PRECISION):
    """Trees and thresholds from the proposals of all different texts."""
    table = stored(folded_proposals(docs, text), "proposals")
    teaches = table.where(F.expr(f"substring(v, {N_FEATURES + 4}, 1) = X'00'"))
    right = F.expr(f"substring(v, {N_FEATURES + 1}, 1) = X'01'")
    seen = teaches.agg(F.sum("n").alias("n"), F.sum(F.when(right, F.col("n"))).alias("right")).first()
    if not seen["n"] or not seen["right"] or seen["right"] == seen["n"]:
        return None

    def summed(model: Trees, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
        shape, packed = (2**depth, 3, N_FEATURES, TOP + 1), (model.base, model.feature, model.cut, model.value)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, total = Trees(*packed), np.zeros(shape, np.int64)
            for batch in batches:
                if batch.num_rows:
                    x, (y, *_), n = _rows_of(batch.column(0), batch.column(1))
                    total += histograms(x, y, n, trees, feature, cut, depth, TOP + 1)
            places = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total.ravel()[places])], names=["at", "s"])

        sums, found = np.zeros(int(np.prod(shape)), np.int64), teaches.mapInArrow(run, "at long, s long").toArrow()
        np.add.at(sums, found.column("at").to_numpy(), found.column("s").to_numpy())
        return sums.reshape(shape)

    model = grow(seen["right"] / seen["n"], summed)
    packed = model.base, model.feature, model.cut, model.value

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees(*packed)
        for batch in batches:
            if batch.num_rows:
                x, (y, _, made, _), n = _rows_of(batch.column(0), batch.column(1))
                columns = [x[:, 0], made, np.round(trees.rate(x) * RATES), y, n]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["k", "made", "step", "y", "n"])

    told = table.where(F.expr(f"substring(v, {N_FEATURES + 4}, 1) = X'01' AND substring(v, {N_FEATURES + 2}, 1) = X'00'"))
    counted = told.mapInArrow(rated, "k long, made long, step long, y long, n long").groupBy("k", "made", "step", "y").agg(F.sum("n").alias("n"))
    rows = np.array(sorted(tuple(r) for r in counted.collect()), np.int64).reshape(-1, 5)
    release(table)
    kind, made, step, y, n = rows.T
    weight = n.astype(float)
    for k in range(len(LOOSE)):
        real, rewritten = (n[(kind == k) & (made == m)].sum() for m in (0, 1))
        if real and rewritten:
            weight[(kind == k) & (made == 1)] *= real / rewritten
    return model, thresholds(step / RATES, y, kind, precision, weight)


def select_spans(text: str, trained) -> tuple[list, list]:
    """The strict spans, and all spans: with the proposals that pass and do not overlap one taken before."""
    strict = strict_spans(text)
    spans, taken = list(strict), Ranges(strict)
    proposed = [] if trained is None else [s for s in proposals(text) if not taken.meets(s)]
    if proposed:
        model, limits = trained
        rates = model.rate(np.minimum(np.array([features(text, *s) for s in proposed]), TOP))
        passed = sorted((-r, s) for r, s in zip(rates.tolist(), proposed) if r >= limits[LOOSE.index(s[0])])
        for _, span in passed:
            if not taken.meets(span):
                spans.append(span)
                taken.add(span)
    return strict, sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, text: str = "text", redact: bool = False, **options) -> DataFrame:
    """``docs`` with counts per strict kind, ``base_sha256`` over the strict spans, and all ``spans``.

    With ``redact`` there is ``redacted_text``, too, in which every span gives way to its kind's name;
    overlapping spans become one. Spans are ``kind:start:end`` in code points, end exclusive. Matches of a
    strict kind are leftmost and do not overlap; one that fails its check is dropped and not tried again.
    NULL and empty texts have no spans (a NULL text stays NULL); repeated rows are each scanned; other
    columns are kept unless they carry one of these names; an empty table gives an empty result.
    """
    trained = train(docs, text, **options)
    # Broadcasts are pickled by reference, so only arrays travel and the trees are put together where they are used.
    packed = None if trained is None else (trained[0].base, trained[0].feature, trained[0].cut, trained[0].value, trained[1])
    sent = docs.sparkSession.sparkContext.broadcast(packed)

    def make():
        model = None if sent.value is None else (Trees(*sent.value[:4]), sent.value[4])

        def compute(texts):
            rows = []
            for t in texts:
                strict, spans = select_spans(t, model) if t else ([], [])
                kinds = [s[0] for s in strict]
                digest = hashlib.sha256(joined(strict).encode()).hexdigest()
                rows.append((*[kinds.count(k) for k in STRICT], digest, joined(spans), redacted(t, spans) if t else t))
            return list(zip(*rows))[: len(fields)] if rows else [[] for _ in fields]

        return compute

    fields = FIELDS + ([("redacted_text", "string")] if redact else [])
    return with_columns(docs, text, make, fields)
