"""A10, J9, S10, V5, V7, V8 as one chain: requests, evidence that can be run again, findings, proofs, statuses.

Evidence is two tables: one row per request with everything needed to run it again, and the long table of its
outputs. A proof decodes the stored requests, runs all of them together and compares output by output.
"""

from __future__ import annotations

import json
from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from plumbline import fixed_values as fixed
from plumbline.operators import analysis
from plumbline.operators.evidence import (
    evidence_id,
    findings_from_evidence,
    recompute,
    request_of,
    request_text,
    run_specs,
    validate_findings,
)
from plumbline.operators.profile import stacked
from plumbline.plans.predicates import all_of, filter_predicate, matching_rows, metric_column, window_predicate
from plumbline.plans.spec import AnalysisSpec

KINDS = {"compare_periods": "compare", "contribution": "contribution", "anomaly_detection": "anomaly", "volume_price_decomp": "split"}
#: Requests whose coverage is counted in one aggregate.
TOGETHER = 100


def used_columns(df: DataFrame, metric: str, definitions: analysis.Definitions = None) -> list[str]:
    """The columns of ``df`` that a metric reads, from its analysed expression."""
    node = df.agg(metric_column(metric, definitions).alias("value"))._jdf.queryExecution().analyzed()
    names, each = set(), node.references().iterator()
    while each.hasNext():
        names.add(each.next().name())
    return [c for c in df.columns if c in names]


def metric_sql(metric: str, definitions: analysis.Definitions = None) -> str:
    return (definitions or {}).get(metric) or f'SUM("{metric}")'


def request_sql(spec: AnalysisSpec, definitions: analysis.Definitions = None, table: str = "data") -> str:
    """A10: what a request asks, written as SQL for people; it is never run."""

    def text(v) -> str:
        return "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)

    parts = [f'"{c}" IN ({", ".join(map(text, v))})' if isinstance(v, (list, tuple)) else f'"{c}" = {text(v)}' for c, v in spec.filters.items()]
    windows = [w for w in (spec.current, spec.baseline) if w.start or w.end]
    if spec.date_col and windows:
        ranges = [
            " AND ".join(f"\"{spec.date_col}\" {op} DATE '{day}'" for op, day in ((">=", w.start), ("<=", w.end)) if day) for w in windows
        ]
        parts.append(ranges[0] if len(ranges) == 1 else "(" + " OR ".join(f"({r})" for r in ranges) + ")")
    names = [f'"{d}"' for d in spec.dimensions]
    query = f"SELECT {', '.join([*names, metric_sql(spec.metric, definitions)])} AS value FROM {table}"
    query += f" WHERE {' AND '.join(parts)}" if parts else ""
    return query + (f" GROUP BY {', '.join(names)}" if names else "")


def distinct_requests(specs: Sequence[AnalysisSpec]) -> list[AnalysisSpec]:
    return list({evidence_id(s): s for s in reversed(specs)}.values())[::-1]


def request_table(
    df: DataFrame, specs: Sequence[AnalysisSpec], definitions: analysis.Definitions, dataset_id: str, version_id: str
) -> DataFrame:
    """A10: one row per request, with all that is known before it runs."""
    rows = [
        (
            evidence_id(s), s.spec_id, s.analysis_type, s.metric, dataset_id, version_id, fixed.ENGINE_VERSION,
            json.dumps(dict(sorted(s.filters.items())), default=str), request_text(s), request_sql(s, definitions, dataset_id),
            metric_sql(s.metric, definitions), used_columns(df, s.metric, definitions), list(s.assumption_ids),
            s.current.text, s.baseline.text,
        )
        for s in distinct_requests(specs)
    ]
    schema = (
        "evidence_id string, spec_id string, analysis_type string, metric string, dataset_id string, version_id string, "
        "engine_version string, filters string, request string, query string, calculation string, columns array<string>, "
        "assumption_ids array<string>, current_period string, baseline_period string"
    )
    return df.sparkSession.createDataFrame(rows, schema)


def coverage(df: DataFrame, specs: Sequence[AnalysisSpec], definitions: analysis.Definitions = None) -> DataFrame:
    """V6: per request the share of its rows in which every column of its metric has a value; one scan for
    many requests."""
    found = None
    asked = distinct_requests(specs)
    for at in range(0, len(asked), TOGETHER):
        counts = []
        for i, s in enumerate(asked[at : at + TOGETHER]):
            inside = window_predicate(s.date_col, s.current)
            before = window_predicate(s.date_col, s.baseline)
            either = inside if before is None else before if inside is None else inside | before
            pred = all_of([either, filter_predicate(df, s.filters)])
            pred = F.lit(True) if pred is None else pred
            known = all_of([F.col(f"`{c}`").isNotNull() for c in used_columns(df, s.metric, definitions)])
            counts.append(F.count_if(pred).alias(f"{evidence_id(s)}__rows"))
            counts.append(F.count_if(pred if known is None else pred & known).alias(f"{evidence_id(s)}__known"))
        ids = [evidence_id(s) for s in asked[at : at + TOGETHER]]
        part = stacked(df.agg(*counts), ids, {"rows": "long", "known": "long"}, key="evidence_id")
        found = part if found is None else found.union(part)
    share = F.when(F.col("rows") > 0, F.col("known") / F.col("rows"))
    return found.select("evidence_id", share.alias("coverage"))


def outputs_of(df: DataFrame, specs: Sequence[AnalysisSpec], definitions: analysis.Definitions = None) -> DataFrame:
    """The outputs of all requests, long form; a request that is asked twice runs once."""
    return run_specs(df, distinct_requests(specs), definitions, spread=True)


def summaries(outputs: DataFrame) -> DataFrame:
    """One row per evidence: its headline ``value``, the parts of its claim, and ``rows_used``."""
    whole = F.col("item").isNull()

    def field(name: str):
        return F.max(F.when(whole & (F.col("field") == name), F.col("value"))).alias(name)

    part = F.when(F.col("field") == "delta", F.struct("value", "item"))
    ahead = F.min(F.when(F.col("field") == "delta", F.struct((-F.col("value")).alias("order"), "item", "value")))
    folded = outputs.groupBy("evidence_id").agg(
        *[field(n) for n in ("value", "current", "baseline", "change_pct", "anomaly_count", "total_delta")],
        ahead.alias("top"),
        F.max(F.when(whole, F.col("rows_used"))).alias("whole_rows"),
        F.sum(F.when(part.isNotNull(), F.col("rows_used"))).alias("part_rows"),
    )
    return folded.select(
        "evidence_id",
        F.coalesce("value", "current", "anomaly_count", "total_delta", "top.value").alias("value"),
        "current",
        "baseline",
        "change_pct",
        F.col("anomaly_count").cast("long").alias("anomaly_count"),
        F.col("top.item").alias("segment"),
        F.col("top.value").alias("delta"),
        F.coalesce("whole_rows", "part_rows", F.lit(0)).alias("rows_used"),
    )


def evidence_records(requests: DataFrame, outputs: DataFrame, covered: DataFrame) -> DataFrame:
    """A10: the requests with what they found; one that found nothing keeps its row, without a value."""
    return requests.join(summaries(outputs), "evidence_id", "left").join(covered, "evidence_id", "left")


def findings_of(records: DataFrame) -> DataFrame:
    """One finding per evidence with a value."""
    kind = F.lit("scalar")
    for analysis_type, name in KINDS.items():
        kind = F.when(F.col("analysis_type") == analysis_type, name).otherwise(kind)
    return findings_from_evidence(records.withColumns({"kind": kind, "has_value": F.col("value").isNotNull()}))


def run_again(df: DataFrame, records: DataFrame, definitions: analysis.Definitions = None) -> DataFrame:
    """V5: fresh outputs of stored evidence, from its requests alone. Requests come to the driver, rows do not."""
    stored = records.select("spec_id", "request").collect()
    return outputs_of(df, [request_of(r["request"], r["spec_id"]) for r in stored], definitions)


def proofs(outputs: DataFrame, fresh: DataFrame) -> DataFrame:
    """V5: per evidence how many of its outputs there are, and how many do not come out again."""
    rows = recompute(outputs, fresh, ["evidence_id", "item", "field"])
    return rows.groupBy("evidence_id").agg(
        F.count(F.lit(1)).alias("compared"),
        F.count_if(~F.col("matched")).alias("mismatched"),
        F.min("matched").alias("proven"),
    )


def validated(findings: DataFrame, records: DataFrame, fresh: DataFrame, issues: DataFrame) -> DataFrame:
    """V8: the findings against a fresh run, the issues of the columns they read, and their coverage."""
    again = summaries(fresh).select("evidence_id", "value")
    return validate_findings(findings, records, again, issues)


def rows_behind(
    df: DataFrame,
    findings: DataFrame,
    records: DataFrame,
    finding_id: str,
    order: Sequence[str],
    limit: int = fixed.DRILL_ROWS,
    within_windows: bool = False,
) -> DataFrame:
    """Rows behind a finding, by its id: those its evidence's filters let through, if asked also its windows."""
    found = findings.where(F.col("finding_id") == finding_id).join(records, "evidence_id").select("request").first()
    if found is None:
        return df.limit(0)
    spec = request_of(found["request"])
    rows = matching_rows(df, spec.filters)
    if within_windows:
        inside = [p for p in (window_predicate(spec.date_col, w) for w in (spec.current, spec.baseline)) if p is not None]
        rows = rows.where(inside[0] if len(inside) == 1 else inside[0] | inside[1]) if inside else rows
    return rows.orderBy(*order).limit(limit)
