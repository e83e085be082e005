"""Any number of requests over one table in one scan, as a join with a table of requests.

Rows fold to one per day, filter pattern and segment with the sums and counts that the metrics need; a day is the
shortest interval that a window can start or end with, so every window is a union of days. Requests are rows, too
(one per window and dimension, NULL for none), and meet the folded days by equality of dimension and a range of
days. What is scanned does not depend on the number of requests, what is joined not on the number of rows.
Metrics that are not plain sums or counts cannot be added up over days and run on their own.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
import re
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators import analysis
from plumbline.operators.chain import distinct_requests
from plumbline.operators.evidence import evidence_id, run_specs
from plumbline.plans.predicates import filter_predicate, metric_column
from plumbline.plans.spec import AnalysisSpec

ADDITIVE_TYPES = ("compare_periods", "contribution")
_ADDITIVE = re.compile(r"^\s*(SUM|COUNT)\s*\((?!\s*DISTINCT\b)(.*)\)\s*$", re.IGNORECASE | re.DOTALL)
#: Different filters that one pass can tell apart; beyond them requests go in several passes.
FILTERS_AT_ONCE = 60
SCHEMA = "evidence_id string, spec_id string, analysis_type string, metric string, dimension string, item string, field string, value double, rows_used long"


def is_additive(metric: str, definitions: analysis.Definitions = None) -> bool:
    """A sum or a count of rows, whose value over a window is the sum of its values over the days."""
    sql = (definitions or {}).get(metric)
    if not sql:
        return True
    found, depth = _ADDITIVE.match(sql), 0
    if not found:
        return False
    # The bracket that is opened first must be the one that closes last.
    for c in found[2]:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    return depth == 0


def _is_plain(s: AnalysisSpec) -> bool:
    return s.analysis_type not in (*ADDITIVE_TYPES, "anomaly_detection", "volume_price_decomp")


def run_requests(df: DataFrame, specs: Sequence[AnalysisSpec], definitions: analysis.Definitions = None) -> DataFrame:
    """The outputs of all requests, long form, with ``dimension``: a contribution has every one of its dimensions.

    ``rows_used`` are the rows behind an item. Requests that are the same are answered once.
    """
    asked = distinct_requests(specs)
    added = [s for s in asked if (s.analysis_type in ADDITIVE_TYPES or _is_plain(s)) and is_additive(s.metric, definitions)]
    rest = [s for s in asked if s not in added]
    groups: dict[tuple, list[AnalysisSpec]] = {}
    for date_col in dict.fromkeys(s.date_col for s in added):
        mine = [s for s in added if s.date_col == date_col]
        patterns = list(dict.fromkeys(_filters(s) for s in mine))
        for at in range(0, len(patterns), FILTERS_AT_ONCE):
            some = set(patterns[at : at + FILTERS_AT_ONCE])
            groups[date_col, at] = [s for s in mine if _filters(s) in some]
    parts = [_together(df, group, definitions) for group in groups.values()]
    # A contribution by several dimensions that cannot be added up is several contributions.
    for s in rest:
        for name in s.dimensions if s.analysis_type == "contribution" else (None,):
            one = s if name is None else dataclasses.replace(s, dimensions=(name,))
            found = run_specs(df, [one], definitions, spread=True)
            found = found.withColumns({"evidence_id": F.lit(evidence_id(s)), "dimension": F.lit(name).cast("string")})
            parts.append(found.select(*[f.split()[0] for f in SCHEMA.split(", ")]))
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)
    return result


def _filters(s: AnalysisSpec) -> str:
    return json.dumps(sorted(s.filters.items()), default=str)


def _slots(specs: Sequence[AnalysisSpec], metrics: list[str], patterns: list[str]) -> list[tuple]:
    """One row per request, window and dimension."""
    rows = []
    for i, s in enumerate(specs):
        windows = [("current", s.current)] if _is_plain(s) else [("current", s.current), ("baseline", s.baseline)]
        for dimension in s.dimensions if s.analysis_type == "contribution" else (None,):
            for tag, w in windows:
                first, last = (dt.date.fromisoformat(end) if end and s.date_col else None for end in (w.start, w.end))
                rows.append((i, dimension or "", tag, first, last, metrics.index(s.metric), 1 << patterns.index(_filters(s))))
    return rows


def _together(df: DataFrame, specs: Sequence[AnalysisSpec], definitions: analysis.Definitions) -> DataFrame:
    spark, date_col = df.sparkSession, specs[0].date_col
    metrics = list(dict.fromkeys(s.metric for s in specs))
    patterns = list(dict.fromkeys(_filters(s) for s in specs))
    dims = list(dict.fromkeys(d for s in specs if s.analysis_type == "contribution" for d in s.dimensions))
    slots = _slots(specs, metrics, patterns)
    day = F.col(f"`{date_col}`").cast("date") if date_col else F.lit(None).cast("date")
    # Rows outside of every window are not read.
    rows, firsts, lasts = df, [s[3] for s in slots], [s[4] for s in slots]
    rows = rows if None in firsts else rows.where(day >= F.lit(min(firsts)))
    rows = rows if None in lasts else rows.where(day <= F.lit(max(lasts)))
    by_text = {_filters(s): filter_predicate(df, s.filters) for s in specs}
    pattern = F.lit(0).cast("long")
    for i, p in enumerate(patterns):
        passed = F.lit(1 << i).cast("long")
        pattern = pattern + (passed if by_text[p] is None else F.when(by_text[p], passed).otherwise(F.lit(0).cast("long")))
    entries = [F.struct(F.lit("").alias("dimension"), F.lit(None).cast("string").alias("item"))]
    entries += [F.struct(F.lit(d).alias("dimension"), F.col(f"`{d}`").cast("string").alias("item")) for d in dims]
    wanted = [e for e, d in zip(entries, ["", *dims]) if any(s[1] == d for s in slots)]
    # A metric may read any column, so the columns stay until the fold.
    spread = rows.withColumns({"__day": day, "__pattern": pattern}).withColumn("__e", F.explode(F.array(*wanted)))
    folded = spread.where("__pattern > 0").groupBy("__day", "__pattern", F.col("__e.dimension").alias("dimension"), F.col("__e.item").alias("item")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[metric_column(m, definitions).alias(f"m{i}") for i, m in enumerate(metrics)],
    )
    table = spark.createDataFrame(slots, "request int, dimension string, tag string, first date, last date, measure int, bit long")
    inside = F.col("__pattern").bitwiseAND(F.col("bit")) != 0
    for end, ok in (("first", F.col("__day") >= F.col("first")), ("last", F.col("__day") <= F.col("last"))):
        inside = inside & (F.col(end).isNull() | ok)
    met = folded.join(F.broadcast(table), "dimension").where(inside)
    # Every metric is added up in its own type, so that decimals stay exact.
    tags = ("current", "baseline")
    sums = met.groupBy("request", "dimension", "item", "measure").agg(
        *[F.sum(F.when(F.col("tag") == t, F.col(f"m{i}"))).alias(f"{t}{i}") for t in tags for i in range(len(metrics))],
        F.sum("rows").alias("rows_used"),
    )
    chosen = {t: F.coalesce(*[F.when(F.col("measure") == i, F.col(f"{t}{i}").cast("double")) for i in range(len(metrics))]) for t in tags}
    sums = sums.select("request", "dimension", "item", *[c.alias(t) for t, c in chosen.items()], "rows_used")
    return _outputs(spark, sums, specs)


def _outputs(spark, sums: DataFrame, specs: Sequence[AnalysisSpec]) -> DataFrame:
    kinds = ["plain" if _is_plain(s) else s.analysis_type for s in specs]
    names = [(i, evidence_id(s), s.spec_id, s.analysis_type, s.metric, k) for i, (s, k) in enumerate(zip(specs, kinds))]
    known = spark.createDataFrame(names, "request int, evidence_id string, spec_id string, analysis_type string, metric string, kind string")
    # Totals of a request's dimension are sums over its segments.
    totals = sums.groupBy("request", "dimension").agg(F.sum("current").alias("all_current"), F.sum("baseline").alias("all_baseline"))
    rows = known.join(sums, "request", "left").join(totals, ["request", "dimension"], "left")
    now, then = F.coalesce("current", F.lit(0.0)), F.coalesce("baseline", F.lit(0.0))
    all_now, all_then = F.coalesce("all_current", F.lit(0.0)), F.coalesce("all_baseline", F.lit(0.0))
    moved = all_now - all_then
    fields: dict[str, dict[str, Column]] = {
        "plain": {"value": F.col("current")},
        "compare_periods": {
            "current": F.col("current"),
            "baseline": F.col("baseline"),
            "change": F.col("current") - F.col("baseline"),
            "change_pct": analysis.change_pct(F.col("current"), F.col("baseline")),
        },
        "contribution": {
            "current": now,
            "baseline": then,
            "delta": now - then,
            "baseline_share_pct": F.when(all_then != 0, then / all_then * 100).otherwise(0.0),
            "contribution_pct": F.when(moved != 0, (now - then) / F.abs(moved) * 100).otherwise(0.0),
        },
    }
    long = [
        F.when(F.col("kind") == kind, F.struct(F.lit(name).alias("field"), value.cast("double").alias("value")))
        for kind, values in fields.items()
        for name, value in values.items()
    ]
    # A contribution without rows has no segments; the others have their fields, without a value.
    kept = rows.where("kind <> 'contribution' OR rows_used IS NOT NULL")
    each = kept.select("*", F.explode(F.filter(F.array(*long), lambda e: e.isNotNull())).alias("e"))
    return each.select(
        "evidence_id", "spec_id", "analysis_type", "metric", F.nullif("dimension", F.lit("")).alias("dimension"), "item",
        F.col("e.field").alias("field"), F.col("e.value").alias("value"), F.coalesce("rows_used", F.lit(0).cast("long")).alias("rows_used"),
    )
