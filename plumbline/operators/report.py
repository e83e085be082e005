"""H1: the tables a report is written from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline import fixed_values as fixed

ANOMALY_WORD = "anomal"
KEY_FINDINGS = 10


def findings_rollup(findings: DataFrame) -> DataFrame:
    """Findings counted by type, strength and status, with those that speak of anomalies."""
    return findings.groupBy("claim_type", "strength", "evidence_status").agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(F.lower("claim").contains(ANOMALY_WORD)).alias("anomaly_findings"),
    )


def anomaly_findings(findings: DataFrame) -> DataFrame:
    return findings.where(F.lower("claim").contains(ANOMALY_WORD))


def report_lines(
    findings: DataFrame,
    manifest: DataFrame,
    assumptions: DataFrame,
    transformations: DataFrame,
    key_findings: int = KEY_FINDINGS,
    evidence: DataFrame | None = None,
) -> DataFrame:
    """``(section, line)``: the texts of a report, section by section.

    The summary counts all findings; the key findings are the first ``key_findings`` by id; anomalies,
    datasets, assumptions and transformations are listed in full. With ``evidence`` the detailed analysis
    names the metrics of the first ``key_findings`` evidence records.
    """
    summary = findings.agg(F.count(F.lit(1)).alias("n")).select(
        F.format_string("Analysis complete. %d findings identified.", "n").alias("line")
    )
    key = findings.orderBy("finding_id").limit(key_findings).select(F.col("claim").alias("line"))
    datasets = manifest.select(
        F.format_string(
            "%s: %d rows, %d columns", F.col("dataset_id").cast("string"), "row_count", "column_count"
        ).alias("line")
    )
    steps = transformations.select(F.concat_ws(": ", "step_type", "description").alias("line"))
    sections = {
        "executive_summary": summary,
        "dataset_overview": datasets,
        "key_findings": key,
        "anomalies": anomaly_findings(findings).select(F.col("claim").alias("line")),
        "assumptions_definitions": assumptions.select(F.col("text").alias("line")),
        "transformations": steps,
    }
    if evidence is not None:
        first = evidence.orderBy("evidence_id").limit(key_findings)
        sections["detailed_analysis"] = first.select(F.format_string(fixed.EVIDENCE_LINE, F.substring(F.col("evidence_id").cast("string"), 1, 8), "metric").alias("line"))
    rows = [df.select(F.lit(name).alias("section"), "line") for name, df in sections.items()]
    lines = rows[0]
    for more in rows[1:]:
        lines = lines.unionByName(more)
    return lines
