"""Evidence tables, findings drawn from them, and their validation."""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline import fixed_values as fixed
from plumbline.functions import text as texts
from plumbline.operators import analysis
from plumbline.operators.profile import union_all
from plumbline.plans.predicates import matching_rows, metric_column
from plumbline.plans.scalars import one_row
from plumbline.plans.selection import lookup
from plumbline.plans.spec import AnalysisSpec, TimeWindow
from plumbline.plans.tagged import pivot_windows, tag_windows


def request_text(spec: AnalysisSpec) -> str:
    """A10: what a request asks, in one canonical form; names and assumptions are not part of it."""
    asked = {
        "analysis_type": spec.analysis_type,
        "baseline": [spec.baseline.start, spec.baseline.end],
        "current": [spec.current.start, spec.current.end],
        "date_col": spec.date_col,
        "dimensions": list(spec.dimensions),
        "filters": dict(sorted(spec.filters.items())),
        "metric": spec.metric,
    }
    return json.dumps(asked, sort_keys=True, separators=(",", ":"), default=str)


def request_of(text: str, spec_id: str = "") -> AnalysisSpec:
    """The request that ``request_text`` wrote."""
    asked = json.loads(text)
    return AnalysisSpec(
        spec_id,
        asked["analysis_type"],
        asked["metric"],
        asked["date_col"],
        TimeWindow(*asked["current"]),
        TimeWindow(*asked["baseline"]),
        tuple(asked["dimensions"]),
        asked["filters"],
    )


def evidence_id(spec: AnalysisSpec) -> str:
    """The same request always has the same id, so both sides of a link can compute it."""
    return hashlib.sha256(request_text(spec).encode()).hexdigest()


def linked_id(*parts: Column) -> Column:
    """A deterministic id for rows computed from their identifying columns."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def run_specs(
    df: DataFrame, specs: Sequence[AnalysisSpec], definitions: analysis.Definitions = None, spread: bool = False
) -> DataFrame:
    """Evidence for every request, long form: ``(item, field, value)`` under each evidence id.

    With ``spread``, anomaly requests also have the spread of their series and the number of its anomalies,
    so that one that finds nothing has evidence, too. Requests for plain metrics over the same rows share one aggregate, and so do comparisons of
    the same two windows; unknown types are plain metrics.
    """
    plain, compared, rest = defaultdict(list), defaultdict(list), []
    for s in specs:
        filters = json.dumps(sorted(s.filters.items()), default=str)
        if s.analysis_type == "compare_periods":
            compared[s.date_col, s.current, s.baseline, filters].append(s)
        elif s.analysis_type in ("contribution", "anomaly_detection", "volume_price_decomp"):
            rest.append(s)
        else:
            plain[s.date_col, s.current, filters].append(s)
    parts = [_plain(df, group, definitions) for group in plain.values()]
    parts += [_compared(df, group, definitions) for group in compared.values()]
    parts += [_single(df, s, definitions, spread) for s in rest]
    return union_all(parts)


def _rows(wide: DataFrame, spec: AnalysisSpec, item: Column, fields: dict[str, Column], rows: Column) -> Column:
    return F.transform(
        F.array(
            *[F.struct(F.lit(f).alias("field"), v.cast("double").alias("value")) for f, v in fields.items()]
        ),
        lambda fv: F.struct(
            F.lit(evidence_id(spec)).alias("evidence_id"),
            F.lit(spec.spec_id).alias("spec_id"),
            F.lit(spec.analysis_type).alias("analysis_type"),
            F.lit(spec.metric).alias("metric"),
            item.cast("string").alias("item"),
            fv["field"].alias("field"),
            fv["value"].alias("value"),
            rows.cast("long").alias("rows_used"),
            F.array(*[F.lit(a) for a in spec.assumption_ids]).cast("array<string>").alias("assumption_ids"),
        ),
    )


def _long(wide: DataFrame, rows: Sequence[Column]) -> DataFrame:
    together = rows[0] if len(rows) == 1 else F.concat(*rows)
    return wide.select(F.explode(together).alias("r")).select("r.*")


def _plain(df: DataFrame, specs: Sequence[AnalysisSpec], definitions: analysis.Definitions) -> DataFrame:
    s = specs[0]
    wide = matching_rows(df, s.filters, s.date_col, s.current).agg(
        F.count(F.lit(1)).alias("rows"),
        *[metric_column(x.metric, definitions).cast("double").alias(f"m{i}") for i, x in enumerate(specs)],
    )
    whole = F.lit(None).cast("string")
    return _long(
        wide, [_rows(wide, x, whole, {"value": F.col(f"m{i}")}, F.col("rows")) for i, x in enumerate(specs)]
    )


def _compared(df: DataFrame, specs: Sequence[AnalysisSpec], definitions: analysis.Definitions) -> DataFrame:
    s = specs[0]
    measures = {f"m{i}": metric_column(x.metric, definitions).cast("double") for i, x in enumerate(specs)}
    measures["rows"] = F.count(F.lit(1))
    wide = pivot_windows(tag_windows(df, s.date_col, s.current, s.baseline, s.filters), measures)
    rows = F.coalesce("rows_current", F.lit(0)) + F.coalesce("rows_baseline", F.lit(0))
    out = []
    for i, x in enumerate(specs):
        now, then = F.col(f"m{i}_current"), F.col(f"m{i}_baseline")
        fields = {
            "current": now,
            "baseline": then,
            "change": now - then,
            "change_pct": analysis.change_pct(now, then),
        }
        out.append(_rows(wide, x, F.lit(None).cast("string"), fields, rows))
    return _long(wide, out)


def _single(df: DataFrame, s: AnalysisSpec, definitions: analysis.Definitions, spread: bool) -> DataFrame:
    whole = F.lit(None).cast("string")
    if s.analysis_type == "anomaly_detection":
        inside = matching_rows(df, s.filters, s.date_col, s.current)
        daily = analysis.daily_values(inside, s.metric, s.date_col, definitions)
        found = analysis.anomalies(daily)
        days = _long(found, [_rows(found, s, F.col("period_date"), {"value": F.col("value")}, F.col("rows_used"))])
        if not spread:
            return days
        count = one_row(found.agg(F.count(F.lit(1)).alias("n")))["n"]
        stats = analysis.series_spread(daily).withColumn("anomaly_count", count)
        fields = {c: F.col(c) for c in stats.columns if c != "rows_used"}
        return days.unionByName(_long(stats, [_rows(stats, s, whole, fields, F.col("rows_used"))]))
    if s.analysis_type == "volume_price_decomp":
        split = analysis.volume_price(df, s.date_col, s.current, s.baseline, definitions, s.filters)
        tagged = tag_windows(df, s.date_col, s.current, s.baseline, s.filters)
        counts = one_row(pivot_windows(tagged, {"rows": F.count(F.lit(1))}))
        rows = F.coalesce(counts["rows_current"], F.lit(0)) + F.coalesce(counts["rows_baseline"], F.lit(0))
        fields = {c: F.col(c) for c in split.columns}
        counted = split.withColumn("rows", rows)
        return _long(counted, [_rows(counted, s, whole, fields, F.col("rows"))])
    segments = analysis.contribution(
        df, s.metric, s.date_col, s.current, s.baseline, s.dimensions[0], definitions, s.filters
    )
    fields = {
        c: F.col(c) for c in ("current", "baseline", "delta", "baseline_share_pct", "contribution_pct")
    }
    return _long(segments, [_rows(segments, s, F.col("segment"), fields, F.col("rows_used"))])


def claim_text(kind: Column, row: dict[str, Column]) -> Column:
    """The sentence for an evidence summary row; NULL parts leave it out of its branch."""
    return (
        F.when(
            kind == "compare",
            texts.claim_for_change(
                row["metric"], row["current"], row["baseline"], row["change_pct"],
                row["current_period"], row["baseline_period"],
            ),
        )
        .when(kind == "anomaly", texts.claim_for_anomalies(row["metric"], row["anomaly_count"]))
        .when(kind == "contribution", texts.claim_for_contributor(row["metric"], row["segment"], row["delta"]))
        .when(kind == "scalar", texts.claim_for_value(row["metric"], row["value"], F.lit(None).cast("string")))
        .otherwise(F.concat(F.lit("Analysis of "), row["metric"], F.lit(" complete.")))
    )


def findings_from_evidence(evidence: DataFrame) -> DataFrame:
    """One finding per evidence summary that has a value.

    Expects ``evidence_id, kind, metric, has_value`` and the columns of :func:`claim_text`.
    """
    row = {
        c: F.col(c)
        for c in (
            "metric", "current", "baseline", "change_pct", "current_period", "baseline_period",
            "anomaly_count", "segment", "delta", "value",
        )
    }
    return evidence.where("has_value").select(
        linked_id(F.lit("finding"), F.col("evidence_id")).alias("finding_id"),
        "evidence_id",
        claim_text(F.col("kind"), row).alias("claim"),
        F.when(F.col("kind") == "compare", "comparative").otherwise("factual").alias("claim_type"),
        F.lit("moderate").alias("strength"),
        "metric",
    )


def with_evidence(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings with their evidence; findings without any are kept.

    Evidence is unique by id. Many findings may share one id, so the findings of an id are spread.
    """
    return lookup(findings, evidence, ["evidence_id"])


def stale_by_assumption(findings: DataFrame, evidence: DataFrame, changed: DataFrame) -> DataFrame:
    """Add ``stale``: the finding's evidence rests on a changed assumption."""
    used = evidence.select("evidence_id", F.explode("assumption_ids").alias("assumption_id"))
    flags = changed.select("assumption_id").distinct().withColumn("hit", F.lit(True))
    touched = (
        lookup(used, flags, ["assumption_id"], "inner")
        .groupBy("evidence_id")
        .agg(F.lit(True).alias("stale"))
    )
    joined = lookup(findings, touched, ["evidence_id"])
    return joined.withColumn("stale", F.coalesce("stale", F.lit(False)))


def stale_by_version(findings: DataFrame, latest: DataFrame) -> DataFrame:
    """Add ``stale``: the finding was drawn from a version that is no longer the latest.

    ``latest`` has one row per ``dataset_id`` with ``latest_version``.
    """
    joined = lookup(findings, latest, ["dataset_id"])
    old = F.col("version_id") != F.col("latest_version")
    return joined.withColumn("stale", F.coalesce(old, F.lit(False))).drop("latest_version")


def recompute(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """V5: compare stored evidence rows with a fresh run, row by row, within 0.1 %.

    Values that are not numbers on both sides match if their texts are equal, and so do two missing values. A row
    missing on either side does not match. NULL keys pair with NULL keys.
    """
    a, b = stored.withColumn("__a", F.lit(True)).alias("a"), fresh.withColumn("__b", F.lit(True)).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.join(b, on, "full").select(
        *[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys],
        F.col(f"a.{value}").alias("original"),
        F.col(f"b.{value}").alias("recomputed"),
        F.col("__a").isNotNull().alias("__a"),
        F.col("__b").isNotNull().alias("__b"),
    )
    texts_too = any(isinstance(d.schema[value].dataType, T.StringType) for d in (stored, fresh))
    same = (same_text if texts_too else same_value)(F.col("original"), F.col("recomputed"))
    both_missing = F.col("original").isNull() & F.col("recomputed").isNull()
    return both.withColumn("matched", F.col("__a") & F.col("__b") & (same | both_missing)).drop("__a", "__b")


def same_value(original: Column, recomputed: Column) -> Column:
    room = fixed.RECOMPUTE_TOLERANCE * F.greatest(F.abs(original), F.lit(1e-9))
    return F.coalesce(F.abs(original - recomputed) <= room, F.lit(False))


def same_text(original: Column, recomputed: Column) -> Column:
    """V5 for texts: numbers within the tolerance, anything else by its text."""
    numbers = [c.cast("string").try_cast("double") for c in (original, recomputed)]
    equal = F.coalesce(original.cast("string") == recomputed.cast("string"), F.lit(False))
    return F.when(numbers[0].isNotNull() & numbers[1].isNotNull(), same_value(*numbers)).otherwise(equal)


def issue_list(issues: DataFrame) -> Column:
    """The (column, severity) pairs of an issue table as one array; a few per table column."""
    pairs = F.collect_set(F.struct("column", "severity"))
    return one_row(issues.agg(pairs.alias("pairs")))["pairs"]


def column_used(column: Column, query: Column, metric: Column, calculation: Column) -> Column:
    """V7: is a table column used by an evidence record?"""
    return (
        F.coalesce(query.contains(F.concat(F.lit('"'), column, F.lit('"'))), F.lit(False))
        | F.coalesce(F.lower(metric).contains(F.lower(column)), F.lit(False))
        | F.coalesce(calculation.contains(column), F.lit(False))
    )


def evidence_status(
    claim_type: Column,
    has_evidence: Column,
    rows_used: Column,
    recomputed: Column,
    issues: Column,
    query: Column,
    metric: Column,
    calculation: Column,
    coverage: Column,
    columns: Column | None = None,
) -> Column:
    """V6: the first rule that applies decides.

    With ``columns``, the columns that the evidence reads, an issue counts only for exactly those; else for those
    whose name occurs in its texts.
    """

    def used(column: Column) -> Column:
        if columns is None:
            return column_used(column, query, metric, calculation)
        return F.coalesce(F.array_contains(columns, column), F.lit(False))

    def touched(severity: str) -> Column:
        return F.exists(issues, lambda i: (i["severity"] == severity) & used(i["column"]))

    return (
        F.when(claim_type.isin(fixed.NON_EMPIRICAL_CLAIMS), "not_applicable")
        .when(~has_evidence, "insufficient_evidence")
        .when(rows_used < fixed.EVIDENCE_MIN_ROWS, "insufficient_evidence")
        .when(~recomputed, "insufficient_evidence")
        .when(touched("error"), "insufficient_evidence")
        .when(coverage < fixed.COVERAGE_MIN, "partially_supported")
        .when(touched("warning"), "partially_supported")
        .otherwise("supported")
    )


def validate_findings(findings: DataFrame, evidence: DataFrame, fresh: DataFrame, issues: DataFrame) -> DataFrame:
    """V8: rewrite causal claims, re-check the evidence value and set the status of each finding.

    ``evidence`` and ``fresh`` have ``evidence_id`` and ``value``; evidence also carries
    ``rows_used, query, metric, calculation``, and may have ``coverage`` (else 1) and ``columns``, the
    columns it reads (else their names are looked for in its texts). Other columns of the findings are kept.
    """
    again = fresh.select("evidence_id", F.col("value").alias("fresh_value"), F.lit(True).alias("was_run"))
    checked = evidence.join(again, "evidence_id", "left")
    both_missing = F.col("was_run") & F.col("value").isNull() & F.col("fresh_value").isNull()
    matched = same_value(F.col("value"), F.col("fresh_value")) | F.coalesce(both_missing, F.lit(False))
    checked = checked.withColumns({"recomputed": matched, "has_evidence": F.lit(True)}).drop("fresh_value", "was_run")
    kept = [c for c in findings.columns if c not in ("finding_id", "evidence_id", "claim", *checked.columns)]
    joined = with_evidence(findings.select("finding_id", "evidence_id", "claim", *kept), checked)
    joined = joined.withColumn("issues", issue_list(issues))
    phrases = texts.causal_phrases(F.col("claim"))
    status = evidence_status(
        F.col("claim_type"),
        F.coalesce("has_evidence", F.lit(False)),
        F.col("rows_used"),
        F.coalesce("recomputed", F.lit(False)),
        F.col("issues"),
        F.col("query"),
        F.col("metric"),
        F.col("calculation"),
        F.coalesce("coverage", F.lit(1.0)) if "coverage" in evidence.columns else F.lit(1.0),
        F.col("columns") if "columns" in evidence.columns else None,
    )
    return joined.select(
        "finding_id",
        "evidence_id",
        texts.associational(F.col("claim")).alias("claim"),
        F.concat_ws(", ", phrases).alias("causal_phrases"),
        F.coalesce("recomputed", F.lit(False)).alias("recompute_matched"),
        status.alias("evidence_status"),
        *kept,
    )
