"""Text checks as columns, evaluated inside the scan that reads the text."""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import fixed_values as fixed
from plumbline.plans.scalars import one_row

# A word that starts with a letter is consumed whole, so its digits are never taken for a number.
NUMBER_TOKEN = (
    r"(?i)[a-z][a-z0-9]*"
    r"|([-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
    r"(?:%|\s*(?:million|billion|thousand|bn|k|m)\b|\b))"
)
#: About so many different beginnings of names are sent to the tasks at most; lengths of beginnings that are tried, and
#: letters that they are taken to have; questions of a task.
MENTION_HEADS, HEAD_CHARS, HEAD_LETTERS, TASK_QUESTIONS = 20_000, (3, 4, 6, 8, 12, 16, 24), 26, 20_000


def causal_phrases(text: Column) -> Column:
    """V1: the causal phrases a text contains, in the order of the list.

    The text is lowered once and searched plainly; only hits are checked for word bounds.
    """

    def found(low: Column) -> Column:
        hits = [F.when(low.contains(p) & low.rlike(rf"\b{p}\b"), F.lit(p)) for p in fixed.CAUSAL_REWRITES]
        return F.array_compact(F.array(*hits))

    return F.transform(F.array(F.lower(text)), found)[0]


def causal_texts(text: Column) -> Column:
    """V1: for each causal phrase in the order of the list, the text that first matches it, as written."""

    def found(t: Column) -> Column:
        hits = [
            F.when(t["low"].contains(p) & t["low"].rlike(rf"\b{p}\b"), F.regexp_extract(t["text"], rf"(?i)\b{p}\b", 0))
            for p in fixed.CAUSAL_REWRITES
        ]
        return F.array_compact(F.array(*hits))

    return F.transform(F.array(F.struct(text.alias("text"), F.lower(text).alias("low"))), found)[0]


def causal_violations(found: Column) -> Column:
    """V1: one sentence per causal text found."""
    return F.transform(found, lambda t: F.format_string(fixed.CAUSAL_VIOLATION, t))


def associational(text: Column) -> Column:
    """V2: causal phrases replaced in list order, a leading capital kept.

    The text runs through one step per phrase; a step without its phrase costs a plain search.
    """
    steps = F.array(text)
    for phrase, wording in fixed.CAUSAL_REWRITES.items():
        steps = F.transform(steps, _replacement(phrase, wording))
    return steps[0]


def _replacement(phrase: str, wording: str) -> Callable[[Column], Column]:
    head, tail = phrase[0], phrase[1:]
    capital = wording[0].upper() + wording[1:]

    def replace(text: Column) -> Column:
        upper = F.regexp_replace(text, rf"\b{head.upper()}(?i:{tail})\b", capital)
        both = F.regexp_replace(upper, rf"\b{head}(?i:{tail})\b", wording)
        return F.when(F.lower(text).contains(phrase), both).otherwise(text)

    return replace


def _word(pattern: str) -> str:
    return rf"(?i)\b(?:{pattern})\b"


def number_tokens(text: Column, variant: str = "whole") -> Column:
    """V3: the number texts of a string, left to right."""
    if variant == "narrow":
        return F.regexp_extract_all(text, F.lit(fixed.NARROW_NUMBER), F.lit(0))
    return F.filter(F.regexp_extract_all(text, F.lit(NUMBER_TOKEN), F.lit(1)), lambda t: t != "")


def number_value(token: Column) -> Column:
    """V3: a number text as a double, its suffix applied."""
    clean = F.lower(F.trim(token))
    suffix = F.regexp_extract(clean, r"(%|[a-z]+)$", 1)
    factor = F.lit(1.0)
    for name, size in fixed.NUMBER_SUFFIXES.items():
        factor = F.when(suffix == name, F.lit(size)).otherwise(factor)
    return F.regexp_replace(clean, r"[^0-9.+-]", "").try_cast("double") * factor


def _any_of(text: Column, words: Sequence[str]) -> Column:
    return text.rlike(_word("|".join(words)))


def word_count(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def request_tier(question: Column) -> Column:
    """REPORT, INVESTIGATION, ANALYSIS or LOOKUP, the heaviest signal first."""
    words = word_count(question)
    return (
        F.when(_any_of(question, fixed.REPORT_WORDS), "REPORT")
        .when(_any_of(question, fixed.INVESTIGATION_WORDS), "INVESTIGATION")
        .when(_any_of(question, fixed.ANALYSIS_WORDS), "ANALYSIS")
        .when(_any_of(question, fixed.LOOKUP_WORDS) & (words <= fixed.LOOKUP_MAX_WORDS), "LOOKUP")
        .when(words > fixed.INVESTIGATION_MIN_WORDS, "INVESTIGATION")
        .otherwise("ANALYSIS")
    )


def is_why_question(question: Column) -> Column:
    return _any_of(question, fixed.WHY_WORDS)


def asks_comparison(question: Column) -> Column:
    return _any_of(question, fixed.COMPARISON_WORDS)


def time_expression(question: Column) -> Column:
    """R2: the first match of the first time pattern that occurs; NULL if none does."""
    text = F.lower(question)
    found = [F.regexp_extract(text, rf"({p})", 1) for p in fixed.TIME_EXPRESSION_PATTERNS]
    return F.coalesce(*[F.when(m != "", m) for m in found])


def mentioned(question: Column, columns: Sequence[str]) -> Column:
    """R2: the column names a question mentions, in dictionary order."""
    text = F.lower(question)
    hits = [F.when(text.contains(c.lower()), F.lit(c)) for c in columns]
    if not hits:
        return F.array().cast("array<string>")
    return F.filter(F.array(*hits), lambda c: c.isNotNull())


def mentions(
    questions: DataFrame, dictionary: DataFrame, question_id: str, question: str, name: str, heads_sent: int = MENTION_HEADS
) -> DataFrame:
    """R2 against a dictionary of any size: ``question_id`` and the rows of ``dictionary`` whose ``name`` the question
    contains, in any case.

    Names fold to their first characters, as many as leave about ``heads_sent`` different heads at most, which are sent
    to every task with the lengths of their names. Only where a question has a head is a part of it cut out, and these
    parts meet the names by equality in a shuffle: the plan does not grow with the dictionary, no question is compared
    with every name, and neither the names nor the parts are gathered in one place. Empty and NULL names are not
    mentioned.
    """
    names = dictionary.where(F.length(F.col(f"`{name}`")) > 0).withColumn("__name", F.lower(F.col(f"`{name}`")))
    sizes = names.agg(*[F.approx_count_distinct(F.substring("__name", 1, k)).alias(f"k{k}") for k in HEAD_CHARS]).first()
    # Short heads need few looks at a question, but so many of them that any text has some tell nothing.
    told = [k for k in HEAD_CHARS if sizes[f"k{k}"] < min(heads_sent, HEAD_LETTERS**k / 100)]
    chars = told[0] if told else max((k for k in HEAD_CHARS if sizes[f"k{k}"] < heads_sent), default=HEAD_CHARS[0])
    heads = names.groupBy(F.substring("__name", 1, chars).alias("__head")).agg(F.collect_set(F.length("__name")).alias("__lengths"))
    heads = F.broadcast(heads) if heads.limit(2 * heads_sent + 1).count() <= 2 * heads_sent else heads
    # Heads of one length are looked for at every start of a question, those of shorter names by their own length.
    cuts = one_row(names.agg(F.collect_set(F.least(F.length("__name"), F.lit(chars))).alias("n")))["n"]
    # Questions are few bytes and much work, so that their files make too few tasks.
    tasks = max(1, -(-questions.count() // TASK_QUESTIONS))
    asked = questions.select(F.col(f"`{question_id}`").alias(question_id), F.lower(F.col(f"`{question}`")).alias("__text"))
    asked = asked.repartition(tasks, question_id, "__text").where(F.length("__text") > 0).withColumn("__cut", F.explode(cuts))
    starts = asked.where(F.col("__cut") <= F.length("__text")).withColumn(
        "__start", F.explode(F.sequence(F.lit(1), F.length("__text") - F.col("__cut") + 1))
    )
    met = starts.withColumn("__head", F.expr("substring(__text, __start, __cut)")).join(heads, "__head")
    parts = met.withColumn("__length", F.explode("__lengths"))
    parts = parts.withColumn("__name", F.expr("substring(__text, __start, __length)"))
    # A part that a question has several times counts where it stands first.
    first = (F.length("__name") == F.col("__length")) & (F.expr("locate(__name, __text)") == F.col("__start"))
    # Left to its estimates Spark would gather the parts at the driver, as it knows nothing of their number.
    return parts.where(first).select(question_id, "__name").hint("merge").join(names, "__name").drop("__name")


def claim_for_change(
    metric: Column, current: Column, baseline: Column, pct: Column, now: Column, then: Column
) -> Column:
    """One sentence on a period comparison."""
    moved = F.format_string(
        "%s %s by %.1f%% from %s to %s (%.2f → %.2f).",
        metric,
        F.when(pct > 0, "increased").otherwise("decreased"),
        _one(F.abs(pct)),
        then,
        now,
        F.round(baseline, 2),
        F.round(current, 2),
    )
    plain = F.concat(
        metric, F.lit(" was "), _two(current), F.lit(" in "), now, F.lit(" vs "), _two(baseline),
        F.lit(" in "), then, F.lit("."),
    )
    return F.when(pct.isNotNull(), moved).otherwise(plain)


def claim_for_anomalies(metric: Column, count: Column) -> Column:
    return F.format_string("%d anomalies detected in %s.", count, metric)


def claim_for_contributor(metric: Column, segment: Column, delta: Column) -> Column:
    return F.format_string(
        "%s is the largest contributor to change in %s (Δ%+.2f).", segment, metric, F.round(delta, 2)
    )


def claim_for_value(metric: Column, value: Column, unit: Column) -> Column:
    number = F.format_number(F.round(value, 2), 2)
    return F.concat(F.trim(F.concat_ws(" ", metric, F.lit("is"), number, unit)), F.lit("."))


def _one(value: Column) -> Column:
    """One decimal, half up. A quotient like 30.35 comes out a last bit lower, which its tenfold no longer shows."""
    return F.round(value * 10) / 10


def _two(value: Column) -> Column:
    return F.coalesce(F.format_string("%.2f", F.round(value, 2)), F.lit("unknown"))
