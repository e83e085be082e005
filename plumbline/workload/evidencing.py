"""Evidence, findings and reports: A8-A9, J7-J8, V5-V8, H1, S8-S10."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.operators import analysis, chain, evidence, quality, report
from plumbline.operators.profile import union_all
from plumbline.sources import tables
from plumbline.workload.inputs import (
    CLAIMS,
    CUSTOMER_EVIDENCE,
    EVENT_METRICS,
    LINE_METRICS,
    MESSY_LINEITEM,
    REVENUE_SQL,
    Y1996,
    Y1997,
    claims,
    customer_evidence,
    messy_lineitem,
)
from plumbline.plans.spec import AnalysisSpec, TimeWindow
from plumbline.workload.core import IN_1996, IN_1997
from plumbline.workload.registry import Tables, query, rounded


def _summaries(t: Tables) -> DataFrame:
    """One evidence summary per supplier, the daily anomalies, the top part and a total."""
    compared = analysis.compare_periods(
        t.lineitem, "units", "l_shipdate", Y1997, Y1996, LINE_METRICS, by=["l_suppkey"]
    ).select(
        F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("evidence_id"),
        F.lit("compare").alias("kind"),
        F.lit("units").alias("metric"),
        "current",
        "baseline",
        "change_pct",
        "current_period",
        "baseline_period",
        F.lit(True).alias("has_value"),
    )
    daily = analysis.daily_values(t.events, "value", "ts", EVENT_METRICS)
    spikes = analysis.anomalies(daily).agg(F.count(F.lit(1)).alias("anomaly_count")).select(
        F.lit("events").alias("evidence_id"),
        F.lit("anomaly").alias("kind"),
        F.lit("value").alias("metric"),
        "anomaly_count",
        F.lit(True).alias("has_value"),
    )
    top = (
        analysis.ordered_segments(
            analysis.contribution(t.lineitem, "units", "l_shipdate", Y1997, Y1996, "l_partkey", LINE_METRICS)
        )
        .limit(1)
        .select(
            F.lit("parts").alias("evidence_id"),
            F.lit("contribution").alias("kind"),
            F.lit("units").alias("metric"),
            F.col("segment").cast("string").alias("segment"),
            "delta",
            F.lit(True).alias("has_value"),
        )
    )
    total = analysis.generic_metric(t.lineitem, "revenue", LINE_METRICS).select(
        F.lit("revenue").alias("evidence_id"),
        F.lit("scalar").alias("kind"),
        F.lit("revenue").alias("metric"),
        "value",
        F.col("value").isNotNull().alias("has_value"),
    )
    return union_all([compared, spikes, top, total])


@query(
    "a8_claim_text",
    f"""
      with s as (select l_suppkey, sum(l_quantity) filter ({IN_1997}) as c, sum(l_quantity) filter ({IN_1996}) as b
                 from lineitem where {IN_1996} or {IN_1997} group by 1),
      d as (select ts::date as day, sum(cast(value as decimal(18,2)))::double as v from events group by 1),
      q as (select quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3, avg(v) as m, stddev_samp(v) as sd from d),
      n as (select count(*) as n from d, q where v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)
              or (sd > 0 and abs((v - m) / sd) > 2.5)),
      p as (select l_partkey as seg, coalesce(sum(l_quantity) filter ({IN_1997}), 0)
              - coalesce(sum(l_quantity) filter ({IN_1996}), 0) as delta
            from lineitem where {IN_1996} or {IN_1997} group by 1 order by 2 desc, 1 limit 1)
      select 'supplier-' || l_suppkey as evidence_id, printf('units %s by %.1f%% from 1996 to 1997 (%.2f → %.2f).',
          case when c > b then 'increased' else 'decreased' end, round(abs((c - b) / abs(b) * 100), 1), b, c) as claim,
        'comparative' as claim_type, 'moderate' as strength, 'units' as metric from s
      union all select 'events', printf('%d anomalies detected in value.', n), 'factual', 'moderate', 'value' from n
      union all select 'parts', printf('%d is the largest contributor to change in units (Δ%+.2f).', seg, delta),
        'factual', 'moderate', 'units' from p
      union all select 'revenue', 'revenue is ' || format('{{:,.2f}}', round({REVENUE_SQL}, 2)) || '.', 'factual',
        'moderate', 'revenue' from lineitem""",
)
def a8(t: Tables) -> DataFrame:
    return evidence.findings_from_evidence(_summaries(t)).drop("finding_id")


@query(
    "j7_finding_evidence",
    f"""select f.finding_id, f.evidence_id, f.claim_type, e.metric, round(e.value, 2) as value, e.rows_used
        from {CLAIMS} f left join {CUSTOMER_EVIDENCE} e on f.evidence_id = e.evidence_id""",
)
def j7(t: Tables) -> DataFrame:
    joined = evidence.with_evidence(claims(t.orders), customer_evidence(t.orders))
    return rounded(
        joined.select("finding_id", "evidence_id", "claim_type", "metric", "value", "rows_used"), 2, "value"
    )


@query(
    "j8_stale_findings",
    f"""select f.finding_id, f.evidence_id, coalesce(list_contains(e.assumption_ids, '1-URGENT'), false)
          or coalesce(list_contains(e.assumption_ids, '5-LOW'), false) as stale
        from {CLAIMS} f left join {CUSTOMER_EVIDENCE} e on f.evidence_id = e.evidence_id""",
)
def j8(t: Tables) -> DataFrame:
    priorities = t.orders.select(F.col("o_orderpriority").alias("assumption_id"))
    changed = priorities.where(F.col("assumption_id").isin("1-URGENT", "5-LOW"))
    marked = evidence.stale_by_assumption(claims(t.orders), customer_evidence(t.orders), changed)
    return marked.select("finding_id", "evidence_id", "stale")


@query(
    "j8_stale_versions",
    """select o_orderkey as finding_id, o_custkey as dataset_id,
         o_orderkey <> max(o_orderkey) over (partition by o_custkey) as stale from orders""",
)
def j8_versions(t: Tables) -> DataFrame:
    drawn = t.orders.select(
        F.col("o_orderkey").alias("finding_id"),
        F.col("o_custkey").alias("dataset_id"),
        F.col("o_orderkey").alias("version_id"),
    )
    latest = drawn.groupBy("dataset_id").agg(F.max("version_id").alias("latest_version"))
    return evidence.stale_by_version(drawn, latest).drop("version_id")


@query(
    "s8_manifest_latest",
    """select o_custkey, o_orderkey, o_orderdate, o_orderstatus, versions from (
         select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as i,
           count(*) over (partition by o_custkey) as versions from orders) where i = 1""",
)
def s8(t: Tables) -> DataFrame:
    manifest = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return tables.latest_versions(manifest, "o_custkey", ["o_orderdate", "o_orderkey"])


@query(
    "s9_page_rows",
    """select o_orderkey, o_custkey, o_totalprice, (select count(*) from orders) as total
       from orders order by o_orderkey limit 50 offset 100""",
)
def s9(t: Tables) -> DataFrame:
    total = t.orders.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = tables.page(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 3, 50)
    return rows.withColumn("total", total)


@query(
    "s9_deep_page",
    "select o_orderkey, o_custkey, o_totalprice from orders order by o_orderkey desc limit 25 offset 12500",
)
def s9_deep(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return tables.page(rows, "o_orderkey", 501, 25, ascending=False)


@query(
    "s10_drill_rows",
    """select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem
       where l_returnflag in ('A', 'N') and l_linenumber = 1
       order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice limit 100""",
)
def s10(t: Tables) -> DataFrame:
    filters = {"l_returnflag": ["A", "N"], "l_linenumber": "1"}
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return tables.drill_rows(t.lineitem, filters, order).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"
    )


@query(
    "s7_content_fingerprint",
    """with h as (select ('0x' || substr(sha256(array_to_string(list_transform([o_orderkey::varchar, o_custkey::varchar,
           o_orderstatus, cast(o_totalprice as decimal(18,2))::varchar, strftime(o_orderdate, '%Y-%m-%d'),
           o_orderpriority], lambda x: coalesce(length(x) || '=' || x, '~')), '|')), 1, 15))::bigint as h from orders)
       select count(*) as row_count, 6::bigint as column_count, bit_xor(h) as hash_xor,
         sum(h)::varchar as hash_sum from h""",
)
def s7(t: Tables) -> DataFrame:
    typed = t.orders.withColumns(
        {
            "o_totalprice": F.col("o_totalprice").cast("decimal(18,2)"),
            "o_orderdate": F.col("o_orderdate").cast("date"),
        }
    )
    return tables.fingerprint(typed)


# Stored evidence: values kept to whole numbers, those of one segment off by one percent.
STORED_SQL = f"""
  select l_suppkey as item, 'revenue' as metric,
    case when l_suppkey < 10 then round({REVENUE_SQL}, 0) * 1.01 else round({REVENUE_SQL}, 0) end as value
  from lineitem where l_suppkey <> 3 group by 1"""


@query(
    "v5_recompute",
    f"""with a as ({STORED_SQL}), b as (select l_suppkey as item, {REVENUE_SQL} as value from lineitem group by 1)
        select coalesce(a.item, b.item) as item, round(a.value, 1) as original, round(b.value, 4) as recomputed,
          coalesce(abs(a.value - b.value) <= 0.001 * greatest(abs(a.value), 1e-9), false) as matched
        from a full join b on a.item = b.item""",
)
def v5(t: Tables) -> DataFrame:
    fresh = t.lineitem.groupBy(F.col("l_suppkey").alias("item")).agg(
        F.expr(LINE_METRICS["revenue"].replace('"', "`")).cast("double").alias("value")
    )
    kept = F.round("value", 0)
    stored = fresh.where("item <> 3").withColumn(
        "value", F.when(F.col("item") < 10, kept * 1.01).otherwise(kept)
    )
    checked = evidence.recompute(stored, fresh, ["item"])
    return rounded(rounded(checked, 1, "original"), 4, "recomputed")




def _issues(t: Tables) -> DataFrame:
    """Issues of the orders table when cheap orders lose their price and priorities are absent."""
    rows = t.orders.select(
        F.when(F.col("o_totalprice") > 150000, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("spending"),
        F.when(F.col("o_orderkey") > 0, F.col("o_custkey")).alias("customer"),
    )
    return quality.missing_issues(rows)


_ISSUE_SQL = """(select 'o_totalprice' as c,
      case when avg((o_totalprice <= 150000)::int) * 100 > 20 then 'error' else 'warning' end as severity,
      count(*) filter (o_totalprice <= 150000) as n from orders
    union all select 'spending', case when avg((o_orderstatus = 'P')::int) * 100 > 20 then 'error' else 'warning' end,
      count(*) filter (o_orderstatus = 'P') from orders
    union all select 'customer', case when avg((o_orderkey <= 0)::int) * 100 > 20 then 'error' else 'warning' end,
      count(*) filter (o_orderkey <= 0) from orders)"""


def _used_sql(severity: str) -> str:
    return f"""exists (select 1 from {_ISSUE_SQL} i where i.n > 0 and i.severity = '{severity}'
        and (contains(e.query, '"' || i.c || '"') or contains(lower(e.metric), lower(i.c))
             or contains(e.calculation, i.c)))"""


STATUS_SQL = f"""case when f.claim_type in ('definition', 'suggestion', 'question') then 'not_applicable'
    when e.evidence_id is null then 'insufficient_evidence'
    when e.rows_used < 5 then 'insufficient_evidence'
    when not matched then 'insufficient_evidence'
    when {_used_sql('error')} then 'insufficient_evidence'
    when {_used_sql('warning')} then 'partially_supported' else 'supported' end"""


# Evidence is known for customers with a low priority order; the value of some has moved since.
def _evidence_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    stored = customer_evidence(t.orders).where(F.array_contains("assumption_ids", "5-LOW"))
    moved = F.when(F.col("rows_used") > 14, F.col("value") * 1.5).otherwise(F.col("value"))
    return stored, stored.select("evidence_id", moved.alias("value"))


_JOINED = f"""
  from {CLAIMS} f left join (select *, rows_used <= 14 as matched from {CUSTOMER_EVIDENCE}
    where list_contains(assumption_ids, '5-LOW')) e on f.evidence_id = e.evidence_id"""


def _validated(t: Tables) -> DataFrame:
    stored, fresh = _evidence_sides(t)
    return evidence.validate_findings(claims(t.orders), stored, fresh, _issues(t))


def rewrite_sql(text: str) -> str:
    from plumbline.fixed_values import CAUSAL_REWRITES

    for phrase, wording in CAUSAL_REWRITES.items():
        for first, new in ((phrase[0].upper(), wording[0].upper() + wording[1:]), (phrase[0], wording)):
            text = f"regexp_replace({text}, '\\b{first}(?i:{phrase[1:]})\\b', '{new}', 'g')"
    return text


def phrases_sql(text: str) -> str:
    from plumbline.fixed_values import CAUSAL_REWRITES

    parts = ", ".join(
        f"case when regexp_matches({text}, '(?i)\\b(?:{p})\\b') then '{p}' end" for p in CAUSAL_REWRITES
    )
    return f"concat_ws(', ', {parts})"


@query(
    "v6_evidence_status",
    f"""select evidence_status, claim_type, count(*) as findings
        from (select {STATUS_SQL} as evidence_status, f.claim_type {_JOINED}) group by all""",
)
def v6(t: Tables) -> DataFrame:
    return _validated(t).groupBy("evidence_status", "claim_type").agg(F.count(F.lit(1)).alias("findings"))


@query(
    "v8_validate_findings",
    f"""select f.finding_id, f.evidence_id, {rewrite_sql('f.claim')} as claim, {phrases_sql('f.claim')} as causal_phrases,
          coalesce(matched, false) as recompute_matched, {STATUS_SQL} as evidence_status {_JOINED}""",
)
def v8(t: Tables) -> DataFrame:
    return _validated(t).select("finding_id", "evidence_id", "claim", "causal_phrases", "recompute_matched", "evidence_status")


@query(
    "h1_report_rollup",
    f"""select claim_type, strength, evidence_status, count(*) as findings,
          count(*) filter (contains(lower(claim), 'anomal')) as anomaly_findings
        from (select f.claim_type, f.strength, f.claim, {STATUS_SQL} as evidence_status {_JOINED}) group by 1, 2, 3""",
)
def h1(t: Tables) -> DataFrame:
    return report.findings_rollup(_validated(t))


@query(
    "h1_report_lines",
    """
      with f as (select 1000000 + l_suppkey as finding_id, 'Anomalies in supplier ' || l_suppkey || ': ' || count(*)
              || ' returns.' as claim from lineitem where l_returnflag = 'R' group by l_suppkey
            union all
            select o_custkey, 'Customer ' || o_custkey || ' placed ' || count(*) || ' orders.' from orders
            group by o_custkey)
      select 'executive_summary' as section, 'Analysis complete. ' || count(*) || ' findings identified.' as line from f
      union all select 'dataset_overview', 'orders: ' || count(*) || ' rows, 6 columns' from orders
      union all select 'dataset_overview', 'lineitem: ' || count(*) || ' rows, 11 columns' from lineitem
      union all select 'key_findings', claim from (select claim from f order by finding_id limit 10)
      union all select 'anomalies', claim from f where contains(lower(claim), 'anomal')
      union all select 'assumptions_definitions', 'Priority ' || o_orderpriority || ' is final.' from orders group by
        o_orderpriority
      union all select 'transformations', 'empty_rows_removed: status ' || o_orderstatus || ', ' || count(*) || ' rows'
        from orders group by o_orderstatus
      union all select 'detailed_analysis', 'Evidence [' || substr(evidence_id::varchar, 1, 8) || ']: ' || metric
        from (select * from """
    + CUSTOMER_EVIDENCE
    + """ order by evidence_id limit 10)""",
)
def h1_lines(t: Tables) -> DataFrame:
    returned = t.lineitem.where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    placed = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    findings = returned.select(
        (F.col("l_suppkey") + 1000000).alias("finding_id"),
        F.format_string("Anomalies in supplier %d: %d returns.", "l_suppkey", "n").alias("claim"),
    ).unionByName(
        placed.select(
            F.col("o_custkey").alias("finding_id"),
            F.format_string("Customer %d placed %d orders.", "o_custkey", "n").alias("claim"),
        )
    )
    manifest = union_all(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("dataset_id"), "row_count", F.lit(len(df.columns)).alias("column_count")
            )
            for name, df in (("orders", t.orders), ("lineitem", t.lineitem))
        ]
    )
    assumptions = (
        t.orders.select("o_orderpriority")
        .distinct()
        .select(F.format_string("Priority %s is final.", "o_orderpriority").alias("text"))
    )
    steps = (
        t.orders.groupBy("o_orderstatus")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.lit("empty_rows_removed").alias("step_type"),
            F.format_string("status %s, %d rows", "o_orderstatus", "n").alias("description"),
        )
    )
    return report.report_lines(findings, manifest, assumptions, steps, evidence=customer_evidence(t.orders))


CHAIN_METRICS = LINE_METRICS | {"tax": 'SUM(CAST("l_tax" AS DECIMAL(18,2)))'}
CHAIN = [
    AnalysisSpec("revenue", "compare_periods", "revenue", "l_shipdate", Y1997, Y1996, filters={"l_returnflag": ["A", "N"]}),
    AnalysisSpec("units by status", "contribution", "units", "l_shipdate", Y1997, Y1996, ("l_linestatus",)),
    AnalysisSpec("returned orders", "generic", "orders", "l_shipdate", Y1997, filters={"l_returnflag": "R"}),
    AnalysisSpec("tax", "generic", "tax", "l_shipdate", Y1996),
    AnalysisSpec("all orders", "generic", "orders"),
]

_CHAIN_SQL = f"""
  m as (select * from {MESSY_LINEITEM}),
  r as (select coalesce(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) filter ({IN_1997}), 0)::double as c,
          coalesce(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) filter ({IN_1996}), 0)::double as b,
          count(*) as n from m where l_returnflag in ('A', 'N') and ({IN_1996} or {IN_1997})),
  u as (select l_linestatus as seg, coalesce(sum(l_quantity) filter ({IN_1997}), 0) - coalesce(sum(l_quantity) filter ({IN_1996}), 0)
          as delta, count(*) as n, count(l_quantity) as known from m where {IN_1996} or {IN_1997} group by 1),
  e as (
    select '{{"analysis_type":"compare_periods","baseline":["1996-01-01","1996-12-31"],"current":["1997-01-01","1997-12-31"],"date_col":"l_shipdate","dimensions":[],"filters":{{"l_returnflag":["A","N"]}},"metric":"revenue"}}' as request,
      c as value, printf('revenue %s by %.1f%% from 1996 to 1997 (%.2f → %.2f).', case when c > b then 'increased' else 'decreased' end,
        round(abs((c - b) / abs(b) * 100), 1), round(b, 2), round(c, 2)) as claim,
      'comparative' as claim_type, n as rows_used, 1.0::double as coverage, 'l_extendedprice,l_discount' as columns from r
    union all select '{{"analysis_type":"contribution","baseline":["1996-01-01","1996-12-31"],"current":["1997-01-01","1997-12-31"],"date_col":"l_shipdate","dimensions":["l_linestatus"],"filters":{{}},"metric":"units"}}',
      (select delta from u order by delta desc, seg limit 1), (select printf('%s is the largest contributor to change in units (Δ%+.2f).', seg, round(delta, 2))
        from u order by delta desc, seg limit 1), 'factual', (select sum(n) from u), (select sum(known)::double / sum(n) from u), 'l_quantity'
    union all select '{{"analysis_type":"generic","baseline":[null,null],"current":["1997-01-01","1997-12-31"],"date_col":"l_shipdate","dimensions":[],"filters":{{"l_returnflag":"R"}},"metric":"orders"}}',
      count(distinct l_orderkey), 'orders is ' || format('{{:,.2f}}', count(distinct l_orderkey)::double) || '.', 'factual', count(*), 1.0, 'l_orderkey'
      from m where l_returnflag = 'R' and {IN_1997}
    union all select '{{"analysis_type":"generic","baseline":[null,null],"current":["1996-01-01","1996-12-31"],"date_col":"l_shipdate","dimensions":[],"filters":{{}},"metric":"tax"}}',
      sum(cast(l_tax as decimal(18,2)))::double, 'tax is ' || format('{{:,.2f}}', sum(cast(l_tax as decimal(18,2)))::double) || '.', 'factual', count(*),
      count(l_tax)::double / count(*), 'l_tax' from m where {IN_1996}
    union all select '{{"analysis_type":"generic","baseline":[null,null],"current":[null,null],"date_col":null,"dimensions":[],"filters":{{}},"metric":"orders"}}',
      count(distinct l_orderkey), 'orders is ' || format('{{:,.2f}}', count(distinct l_orderkey)::double) || '.', 'factual', count(*), 1.0, 'l_orderkey' from m
  ),
  i as (select count(*) - count(l_quantity) as missing, count(*) as n from m)"""


def _chain(t: Tables):
    """Requests over the messy lines, their stored evidence (one output of which is off), and the findings."""
    rows = messy_lineitem(t.lineitem)
    outputs = chain.outputs_of(rows, CHAIN, CHAIN_METRICS)
    off = (F.col("spec_id") == "all orders") & (F.col("field") == "value")
    kept = outputs.withColumn("value", F.when(off, F.col("value") * 1.01).otherwise(F.col("value")))
    requests = chain.request_table(rows, CHAIN, CHAIN_METRICS, "lineitem", "v1")
    records = chain.evidence_records(requests, kept, chain.coverage(rows, CHAIN, CHAIN_METRICS))
    return rows, kept, records, chain.findings_of(records)


@query(
    "a10_evidence_chain",
    f"""with {_CHAIN_SQL}
        select sha256('finding|' || sha256(request)) as finding_id, sha256(request) as evidence_id,
          case when contains(request, '"current":[null') then 'orders is ' || format('{{:,.2f}}', round(value * 1.01, 2)) || '.' else claim end as claim,
          claim_type, not contains(request, '"current":[null') as recompute_matched, rows_used::bigint as rows_used,
          round(coverage, 6) as coverage, columns,
          case when contains(request, '"current":[null') then 'insufficient_evidence'
               when coverage < 0.8 then 'partially_supported'
               when columns = 'l_quantity' and (select missing > 0 and missing * 100.0 / n <= 20 from i) then 'partially_supported'
               else 'supported' end as evidence_status
        from e""",
)
def a10(t: Tables) -> DataFrame:
    """From requests to validated findings: ids, a value that does not come out again, and a coverage below 0.8."""
    rows, _, records, findings = _chain(t)
    fresh = chain.run_again(rows, records, CHAIN_METRICS)
    issues = quality.missing_issues(rows.select("l_quantity", "l_extendedprice"))
    checked = chain.validated(findings, records, fresh, issues)
    known = records.select("evidence_id", "rows_used", F.round("coverage", 6).alias("coverage"), F.array_join("columns", ",").alias("columns"))
    return checked.join(known, "evidence_id").select(
        "finding_id", "evidence_id", "claim", "claim_type", "recompute_matched", "rows_used", "coverage", "columns", "evidence_status"
    )


@query(
    "v5_proofs",
    f"""with {_CHAIN_SQL}
        select sha256(request) as evidence_id,
          case when contains(request, 'compare_periods') then 4 when contains(request, 'contribution') then 5 * (select count(*) from u)
            else 1 end::bigint as compared,
          contains(request, '"current":[null')::bigint as mismatched, not contains(request, '"current":[null') as proven from e""",
)
def v5_proofs(t: Tables) -> DataFrame:
    rows, kept, records, _ = _chain(t)
    return chain.proofs(kept, chain.run_again(rows, records, CHAIN_METRICS))


@query(
    "s10_rows_of_finding",
    f"""select l_orderkey, l_linenumber, l_returnflag from {MESSY_LINEITEM} where l_returnflag = 'R'
        order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice limit 100""",
)
def s10_finding(t: Tables) -> DataFrame:
    rows, _, records, findings = _chain(t)
    wanted = findings.join(records.where("spec_id = 'returned orders'"), "evidence_id").select("finding_id").first()[0]
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return chain.rows_behind(rows, findings, records, wanted, order).select("l_orderkey", "l_linenumber", "l_returnflag")
