"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

An expression is a character with up to four before it in its word. Its probability in a class is the
discounted count of that class plus the mass taken off, spread by the shared model: an interpolated
Kneser-Ney model over the counts of all documents, whose lower orders count how many different
characters come before an expression. An expression that a class has hardly seen thus takes the shared
value, and its ratio between the classes nears one; one seen in neither class says nothing.

Tasks fold their words into expressions before anything is shuffled. Counting, discounting and backing off
are aggregates and joins over the table of expressions, which grows with the corpus; all of them keep their
log ratio. What the classes have not seen after a context has the same ratio whatever the character, so a
ratio is that of its context plus what the expression itself adds, and only what differs from zero is kept.
These numbers are dealt into parts of at most ``PART_EXPRESSIONS`` by key; one part at a time is sent to the
tasks, which add what it holds to the sums of every document's words, so no row per word and expression is
ever shuffled. Scores come from the log ratio per character of a document and of its worst words, calibrated
by logistic regression on learning rows, each scored by a model that was learned from the other half.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.texts import release, small_side, stored, with_columns

ORDER = 5
DISCOUNT = 0.75
#: Log ratios are whole numbers of this part, so that their sums do not depend on the order.
UNIT = 1e-9
MODELS = ["a", "b", "all"]
#: At most about so many expressions and contexts, of 32 bytes each, are sent to every task at once.
PART_EXPRESSIONS = 2_000_000
CALIBRATION_ROWS = 20_000
#: A task folds so many different words, of so many characters, at once, and hands on so many expressions.
FOLD_WORDS, FOLD_CHARS, HELD = 80_000, 600_000, 500_000
#: A task splits so many bytes of texts into words at once; a longer text is split alone.
PIECE_BYTES = 4 << 20
WORST = 3
THRESHOLD = 0.7
#: Class and half of the learning rows, as the column of counts that a row adds to; 0 is neither.
TAGS = ["neither", "toxic_a", "plain_a", "toxic_b", "plain_b"]
FEATURES = ["per_char", "worst", "worst_few", "log_chars"]
#: Stands for the character after a context in the context's own key; no text holds it.
ANY = 0x110000


def expressions(word: str, order: int = ORDER) -> list[str]:
    """Each character of ``word`` and its end, with up to ``order - 1`` characters before it."""
    marked = f"\x02{word}\x03"
    return [marked[max(0, i - order + 1) : i + 1] for i in range(1, len(marked))]


def _mixed(keys: np.ndarray, points: np.ndarray) -> np.ndarray:
    """64-bit keys of sequences that are one code point longer."""
    mixed = (keys ^ (np.uint64(1) + points) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def keys_of(words: list[str]):
    """Every expression of ``words``, in order: its key, its context's key, and its place and length in the
    marked words put together. Also the number of expressions of each word and that text."""
    text = "".join(f"\x02{w}\x03" for w in words)
    points = code_points(text)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(points)) - np.repeat(starts, sizes)
    keys = np.zeros(len(points), np.uint64)
    contexts = keys
    for back in range(ORDER - 1, -1, -1):
        if not back:
            contexts = _mixed(keys, np.full(1, ANY, np.uint64))
        moved = keys.copy()
        moved[back:] = _mixed(keys[back:], points[: max(0, len(points) - back)])
        keys = np.where(place >= back, moved, keys)
    ends = np.flatnonzero(place)
    return keys[ends], contexts[ends], ends + 1 - np.minimum(place[ends] + 1, ORDER), ends + 1, sizes - 1, text


def key_of(text: str, context: bool = False) -> int:
    """The key of one expression or context, as a signed number."""
    key = np.zeros(1, np.uint64)
    points = np.append(code_points(text), np.full(int(context), ANY, np.uint64))
    for i in range(len(points)):
        key = _mixed(key, points[i : i + 1])
    return int(key.view(np.int64)[0])


def _chunks(words: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of ``words`` of bounded rows and characters."""
    start = chars = 0
    for i, word in enumerate(words):
        if i > start and (i - start >= FOLD_WORDS or chars + len(word) > FOLD_CHARS):
            yield start, i
            start, chars = i, 0
        chars += len(word)
    if start < len(words):
        yield start, len(words)


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of bounded bytes, so that what a task holds does not grow with the batches it is sent."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + PIECE_BYTES, side="right")))
        yield start, end
        start = end


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words of lower-cased texts, and for every word of every text its place among them and its text."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(full).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), owner[full.to_numpy(zero_copy_only=False)].astype(np.int64)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every key the number of its group, and for every group the place of one of its keys."""
    group, unique = pd.factorize(keys)
    where = np.empty(len(unique), np.int64)
    where[group[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return group, where


class _Folded:
    """Counts of expressions, a column per tag."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)
        self.grams = np.zeros(0, object)
        self.counts = np.zeros((0, len(TAGS)), np.int64)

    def add(self, words: list[str], table: np.ndarray) -> None:
        for start, end in _chunks(words):
            keys, _, firsts, ends, sizes, text = keys_of(words[start:end])
            group, where = _grouped(keys)
            owner = np.repeat(np.arange(start, end), sizes)
            counts = np.zeros((len(where), len(TAGS)), np.int64)
            for tag in np.flatnonzero(table[start:end].any(axis=0)):
                counts[:, tag] = np.bincount(group, table[owner, tag], len(where))
            grams = [text[a:b] for a, b in zip(firsts[where].tolist(), ends[where].tolist())]
            self._merge(keys[where], np.array(grams, object), counts)

    def _merge(self, keys, grams, counts) -> None:
        keys, grams = np.concatenate([self.keys, keys]), np.concatenate([self.grams, grams])
        counts = np.concatenate([self.counts, counts])
        group, where = _grouped(keys)
        self.keys, self.grams, self.counts = keys[where], grams[where], np.zeros((len(where), len(TAGS)), np.int64)
        np.add.at(self.counts, group, counts)


def count_expressions(tagged: DataFrame) -> DataFrame:
    """``g``, a count per tag and their sum ``c``, from ``text`` and ``tag``; folded by task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = _Folded()

        def handed_on():
            for at in range(0, len(folded.grams), FOLD_WORDS):
                columns = [folded.grams[at : at + FOLD_WORDS], *folded.counts[at : at + FOLD_WORDS].T]
                arrays = [pa.array(columns[0], pa.string()), *[pa.array(np.ascontiguousarray(c)) for c in columns[1:]]]
                yield pa.RecordBatch.from_arrays(arrays, names=["g", *TAGS])
            folded.__init__()

        for batch in batches:
            for start, end in pieces(batch.column(0)):
                words, place, owner = words_of(batch.column(0)[start:end])
                tags = batch.column(1)[start:end].to_numpy().astype(np.int64)[owner]
                counts = np.bincount(place * len(TAGS) + tags, minlength=len(words) * len(TAGS))
                folded.add(words, counts.reshape(-1, len(TAGS)))
                if len(folded.grams) > HELD:
                    yield from handed_on()
        yield from handed_on()

    schema = ", ".join(["g string", *[f"{t} long" for t in TAGS]])
    counted = tagged.select("text", "tag").mapInArrow(run, schema)
    summed = counted.groupBy("g").agg(*[F.sum(t).alias(t) for t in TAGS])
    return summed.withColumn("c", sum((F.col(t) for t in TAGS[1:]), F.col(TAGS[0])))


def _context() -> Column:
    return F.expr("substring(g, 1, length(g) - 1)")


def _shorter() -> Column:
    return F.expr("substring(g, 2)")


def shared_model(grams: DataFrame) -> DataFrame:
    """``g``, ``p``: the interpolated Kneser-Ney probability of every expression over all documents."""
    starts = F.col("g").startswith("\x02")
    levels = {ORDER: grams.select("g", "c")}
    for k in range(ORDER - 1, 0, -1):
        # Types one longer, with those that start a word, each count once for what follows the first.
        longer = levels[k + 1].where(F.length("g") == k + 1).select("g")
        if k + 1 < ORDER:
            longer = longer.union(grams.where(starts & (F.length("g") == k + 1)).select("g"))
        levels[k] = stored(longer.groupBy(_shorter().alias("g")).agg(F.count(F.lit(1)).alias("c")), f"order-{k}")
    total = levels[1].agg(F.sum("c")).first()[0] or 1
    known = levels[1].select("g", (F.col("c") / total).alias("p"))
    for k in range(2, ORDER + 1):
        of_context = levels[k].groupBy(_context().alias("h")).agg(F.sum("c").alias("ch"), F.count(F.lit(1)).alias("th"))
        # At the top, those that start a word are shorter; they back off to what their length has.
        found = (
            levels[k]
            .withColumn("h", _context())
            .join(of_context, "h")
            .withColumn("s", _shorter())
            .join(known.select(F.col("g").alias("s"), F.col("p").alias("lower")), "s")
            .select("g", ((F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("th") * F.col("lower")) / F.col("ch")).alias("p"))
        )
        known = found if k == ORDER else known.union(found)
    found = stored(known, "shared")
    release(*[levels[k] for k in range(1, ORDER)])
    return found


def _context_value(context: Column, types: Column) -> Column:
    """What a class makes of an unseen character after the context, against the shared model."""
    return F.when(context > 0, DISCOUNT * types / context).otherwise(1.0)


def _class_probability(count: Column, context: Column, types: Column, shared: Column) -> Column:
    seen = (F.greatest(count - DISCOUNT, F.lit(0.0)) + DISCOUNT * types * shared) / context
    return F.when(context > 0, seen).otherwise(shared)


def log_ratios(grams: DataFrame, shared: DataFrame) -> DataFrame:
    """``g``, its context ``h``, and by model (``a``, ``b``: learned from that half; ``all``) its log ratio and,
    as ``a_of_context`` and so on, that of what the classes have not seen after the context."""
    with_p = grams.join(shared, "g").withColumn("h", _context())
    with_p = with_p.withColumns(
        {"toxic_all": F.col("toxic_a") + F.col("toxic_b"), "plain_all": F.col("plain_a") + F.col("plain_b")}
    )
    names = [f"{c}_{m}" for m in MODELS for c in ("toxic", "plain")]
    contexts = with_p.groupBy("h").agg(
        *[F.sum(n).alias(f"{n}_ch") for n in names], *[F.count_if(F.col(n) > 0).alias(f"{n}_th") for n in names]
    )

    def ratio(model: str) -> Column:
        p = {
            c: _class_probability(F.col(f"{c}_{model}"), F.col(f"{c}_{model}_ch"), F.col(f"{c}_{model}_th"), F.col("p"))
            for c in ("toxic", "plain")
        }
        return (F.log(p["toxic"]) - F.log(p["plain"])).alias(model)

    def of_context(model: str) -> Column:
        toxic, plain = (_context_value(F.col(f"{c}_{model}_ch"), F.col(f"{c}_{model}_th")) for c in ("toxic", "plain"))
        return (F.log(toxic) - F.log(plain)).alias(f"{model}_of_context")

    return with_p.join(contexts, "h").select("g", "h", *[ratio(m) for m in MODELS], *[of_context(m) for m in MODELS])


def value_table(ratios: DataFrame) -> DataFrame:
    """``key`` and a value in units by model: of every context, and of every expression what it adds to its context's."""
    units = [F.round(F.col(m) / UNIT).cast("long") for m in MODELS]
    base = [F.round(F.col(f"{m}_of_context") / UNIT).cast("long") for m in MODELS]
    own = ratios.select("g", F.lit(False).alias("is_context"), *[(u - b).alias(m) for u, b, m in zip(units, base, MODELS)])
    contexts = ratios.groupBy(F.col("h").alias("g")).agg(
        F.lit(True).alias("is_context"), *[F.first(b).alias(m) for b, m in zip(base, MODELS)]
    )
    matters = " OR ".join(f"`{m}` <> 0" for m in MODELS)
    schema = "key long, " + ", ".join(f"`{m}` long" for m in MODELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [key_of(g, c) for g, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *batch.columns[2:]], names=["key", *MODELS])

    return own.union(contexts.select(own.columns)).where(matters).mapInArrow(run, schema)


def word_sums(words: list[str], keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values of each word's expressions and contexts, a row per word, a column per model."""
    sums = np.zeros((len(words), values.shape[1]), np.int64)
    if not len(keys):
        return sums
    for start, end in _chunks(words):
        of_expression, of_context, _, _, sizes, _ = keys_of(words[start:end])
        # An expression has one context, so both are looked up once per different expression.
        group, where = _grouped(of_expression)
        found = np.zeros((len(where), values.shape[1]), np.int64)
        for probe in (of_expression[where], of_context[where]):
            at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
            hit = keys[at] == probe
            found[hit] += values[at[hit]]
        sums[start:end] = np.add.reduceat(found[group], np.cumsum(sizes) - sizes)
    return sums


def with_features(df: DataFrame, text: str, model: Column, table: DataFrame, models: list[str], part_rows: int) -> DataFrame:
    """``df`` with ``__features``, an array in the order of ``FEATURES``, by the model (one of ``models``) that
    ``model`` names. ``table`` is stored. With several parts every row carries the sums of its words between them,
    in the order in which the words first occur."""
    parts = max(1, -(-table.count() // part_rows))
    context = df.sparkSession.sparkContext
    found, before = df.withColumns({"__use": model, "__sums": F.lit(None).cast("array<long>")}), None
    for part in range(parts):
        chosen = table.where(F.pmod("key", F.lit(parts)) == part).select("key", *models).toArrow()
        keys = chosen.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        values = np.column_stack([chosen.column(m).to_numpy()[order] for m in models])
        sent, last = context.broadcast((keys[order], values)), part == parts - 1
        make, field = _measuring(sent, models, last), ("__features", "array<double>") if last else ("__sums", "array<long>")
        if not last:
            found = with_columns(found.withColumnRenamed("__sums", "__earlier"), [text, "__use", "__earlier"], make, [field], raw=True)
            found = stored(found.drop("__earlier"), "word-sums")
            if before is not None:
                release(before)
            before = found
    return with_columns(found, [text, "__use", "__sums"], make, [field], raw=True).drop("__use", "__sums")


def _measuring(sent, models: list[str], last: bool):
    def make():
        keys, values = sent.value

        def compute(texts, uses, earlier):
            found = [measured(texts[a:b], uses[a:b], earlier[a:b]) for a, b in pieces(texts)]
            return [pa.concat_arrays(found)] if found else [pa.array([], pa.list_(pa.float64() if last else pa.int64()))]

        def measured(texts, uses, earlier):
            words, place, owner = words_of(texts)
            # The different words of each text, in the order in which they first occur.
            pairs, first, times = np.unique(owner * max(len(words), 1) + place, return_index=True, return_counts=True)
            order = np.argsort(first)
            pairs, times = pairs[order], times[order]
            row, word = pairs // max(len(words), 1), pairs % max(len(words), 1)
            model = np.array([models.index(u) for u in uses.to_pylist()], np.int64)
            own = word_sums(words, keys, values)[word, model[row]] if len(words) else np.zeros(0, np.int64)
            if earlier.null_count < len(earlier):
                own = own + earlier.flatten().to_numpy()
            ends = np.searchsorted(row, np.arange(len(texts)), side="right")
            if not last:
                return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(own))
            sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
            sums = [np.append(0, np.cumsum(v))[ends] for v in (own * times, (sizes[word] if len(words) else times) * times)]
            total, size = (np.diff(v, prepend=0) for v in sums)
            worst, most = _worst(row, own, times, ends)
            size = size.astype(float)
            table = np.column_stack([total * UNIT / np.maximum(size, 1), most * UNIT, worst * UNIT / WORST, np.log1p(size)])
            offsets = np.arange(0, table.size + 1, len(FEATURES)).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.ravel()))

        return compute

    return make


def _worst(row: np.ndarray, own: np.ndarray, times: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sum of its ``WORST`` largest word values, a repeated word counting as often as it occurs, and
    the largest; 0 without words."""
    order = np.lexsort((-own, row))
    starts = np.append(0, ends[:-1])
    taken, total, most = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    for i in range(WORST):
        has = starts + i < ends
        at = order[(starts + i)[has]]
        more = np.minimum(times[at], WORST - taken[has])
        total[has] += own[at] * more
        taken[has] += more
        if not i:
            most[has] = own[at]
    return total, most


def _score(calibration) -> Column:
    """The calibrated probability from the features."""
    centre, scale, weights = ([float(v) for v in part] for part in calibration)
    z = F.lit(weights[0])
    for i, (c, s, w) in enumerate(zip(centre, scale, weights[1:])):
        z = z + (F.col("__features")[i] - c) / s * w
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50):
    """Newton steps on standardised features with a small ridge."""
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    z = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    weights = np.zeros(z.shape[1])
    penalty = ridge * np.eye(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ weights)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, weights


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    threshold: float = THRESHOLD,
    calibration_rows: int = CALIBRATION_ROWS,
    part_expressions: int = PART_EXPRESSIONS,
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Learning uses the labels of rows whose CRC-32 of the doc_id as text, modulo 3, is not 1; the two
    other remainders are the halves. Counts cover all documents; only the calibration is fitted on a
    sample, of about ``calibration_rows`` learning rows chosen by a hash of the id (at most twice as many).
    NULL texts are empty ones, texts of any length are read whole; a NULL doc_id is never held out and has no
    label; NULL labels do not count; an id with several labels has the largest. Without labels of both classes
    every score is the share of label 1 (0 without labels). Repeated rows are scored alike, other columns are
    kept, those named like a result are replaced, empty tables give empty results.
    """
    added = {"held_out", "score", "predicted"}
    half = F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 3
    known = (
        labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__y"))
        .where(F.col("__y").isNotNull() & F.col("__id").isNotNull())
        .groupBy("__id")
        .agg(F.max("__y").alias("__y"))
        .where(F.crc32(F.col("__id").cast("string").cast("binary")) % 3 != 1)
    )
    known = stored(known, "learning-labels")
    plain = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("text"))
    tag = F.when(F.col("__y").isNull(), 0).otherwise(
        2 - F.col("__y") + F.when(F.crc32(F.col("__id").cast("string").cast("binary")) % 3 == 2, 2).otherwise(0)
    )
    labelled = plain.join(small_side(known), "__id", "left")
    shares = known.agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("toxic")).first()
    rest = docs.drop(*[c for c in docs.columns if c in added])

    def finish(scored: DataFrame) -> DataFrame:
        return scored.withColumns(
            {"held_out": F.coalesce(half == 1, F.lit(False)), "predicted": (F.col("score") >= threshold).cast("int")}
        )

    if not shares["n"] or shares["toxic"] in (0, shares["n"]):
        return finish(rest.withColumn("score", F.lit(shares["toxic"] / shares["n"] if shares["n"] else 0.0)))

    half_of = F.crc32(F.col("__id").cast("string").cast("binary")) % 3
    counts = stored(count_expressions(labelled.select("text", tag.cast("int").alias("tag"))), "expressions")
    shared = shared_model(counts)
    table = stored(value_table(log_ratios(counts, shared)), "log-ratios")
    release(counts, shared)
    part = min(1.0, calibration_rows / shares["n"])
    chosen = known.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < part * 1_000_000)
    sample = plain.join(small_side(chosen), "__id")
    model = F.when(half_of == 2, "a").otherwise("b")
    measured = with_features(sample, "text", model, table, ["a", "b"], part_expressions)
    # Texts that share an id could be any number; repeated ones count once.
    drawn = measured.select("__id", "__y", "__features").distinct()
    rows = drawn.orderBy(F.xxhash64("__id", "__features"), "__id", "__features").limit(2 * calibration_rows).collect()
    if len({r["__y"] for r in rows}) < 2:
        return finish(rest.withColumn("score", F.lit(shares["toxic"] / shares["n"])))
    x = np.array([r["__features"] for r in rows])
    calibration = fit_logistic(x, np.array([float(r["__y"]) for r in rows]))
    measured = with_features(rest, text, F.lit("all"), table, ["all"], part_expressions)
    return finish(measured.withColumn("score", _score(calibration)).drop("__features"))
