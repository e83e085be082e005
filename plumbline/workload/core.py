"""Analysis core: A, M, K."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from plumbline import fixed_values as fixed
from plumbline.functions.timewindows import relative_window
from plumbline.operators import analysis, evidence, requests, semantic, stats
from plumbline.plans.predicates import matching_rows
from plumbline.plans.scalars import one_row
from plumbline.plans.spec import AnalysisSpec, TimeWindow
from plumbline.workload.inputs import (
    EVENT_METRICS,
    LINE_METRICS,
    ORDER_METRICS,
    REVENUE_SQL,
    Y1996,
    Y1997,
)
from plumbline.workload.registry import Tables, query, rounded

IN_1996 = "l_shipdate::date between date '1996-01-01' and date '1996-12-31'"
IN_1997 = "l_shipdate::date between date '1997-01-01' and date '1997-12-31'"


@query(
    "a1_generic_metric",
    f"""select round({REVENUE_SQL}, 4) as value, count(*) as rows_used from lineitem
        where {IN_1997} and l_returnflag in ('A', 'R') and l_linestatus = 'F'""",
)
def a1(t: Tables) -> DataFrame:
    filters = {"l_returnflag": ["A", "R"], "l_linestatus": "F"}
    return rounded(
        analysis.generic_metric(t.lineitem, "revenue", LINE_METRICS, "l_shipdate", Y1997, filters), 4, "value"
    )


@query(
    "a2_compare_periods",
    f"""select round(c, 4) as current, round(b, 4) as baseline, round(c - b, 4) as change,
          round((c - b) / abs(nullif(b, 0)) * 100, 6) as change_pct,
          '1997' as current_period, '1996' as baseline_period, n as rows_used
        from (select sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) filter ({IN_1997})::double as c,
                sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) filter ({IN_1996})::double as b,
                count(*) filter ({IN_1996} or {IN_1997}) as n
              from lineitem)""",
)
def a2(t: Tables) -> DataFrame:
    change = analysis.compare_periods(t.lineitem, "revenue", "l_shipdate", Y1997, Y1996, LINE_METRICS)
    return rounded(rounded(change, 4, "current", "baseline", "change"), 6, "change_pct")


@query(
    "a2_compare_orders_overlap",
    """with w as (select 'c' as tag, * from lineitem where l_shipdate::date >= date '1997-01-01'
                    and l_returnflag = 'R'
                  union all
                  select 'b', * from lineitem where l_shipdate::date <= date '1998-06-30' and l_returnflag = 'R'),
       g as (select l_suppkey, count(distinct l_orderkey) filter (tag = 'c')::double as c,
               count(distinct l_orderkey) filter (tag = 'b')::double as b,
               count(*) filter (tag = 'c') as nc, count(*) filter (tag = 'b') as nb from w group by 1)
       select l_suppkey, case when nc > 0 then c end as current, case when nb > 0 then b end as baseline,
         case when nc > 0 and nb > 0 then c - b end as change,
         case when nc > 0 and nb > 0 then round((c - b) / abs(nullif(b, 0)) * 100, 6) end as change_pct,
         'since 1997' as current_period, 'None to 1998-06-30' as baseline_period, nc + nb as rows_used from g""",
)
def a2_overlap(t: Tables) -> DataFrame:
    change = analysis.compare_periods(
        t.lineitem,
        "orders",
        "l_shipdate",
        TimeWindow(start="1997-01-01", label="since 1997"),
        TimeWindow(end="1998-06-30"),
        LINE_METRICS,
        {"l_returnflag": "R"},
        by=["l_suppkey"],
    )
    return rounded(change, 6, "change_pct")


def _contribution_sql(dimension: str) -> str:
    return f"""
      with g as (select {dimension} as segment,
          coalesce(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) filter ({IN_1997}), 0)::double as c,
          coalesce(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) filter ({IN_1996}), 0)::double as b,
          count(*) as n
        from lineitem where {IN_1996} or {IN_1997} group by 1),
      t as (select sum(c) as tc, sum(b) as tb from g)
      select segment, round(c, 4) as current, round(b, 4) as baseline, round(c - b, 4) as delta,
        case when tb <> 0 then round(b / tb * 100, 6) else 0.0 end as baseline_share_pct,
        case when tc - tb <> 0 then round((c - b) / abs(tc - tb) * 100, 4) else 0.0 end as contribution_pct,
        n as rows_used
      from g, t"""


def _contribution(t: Tables, dimension: str) -> DataFrame:
    segments = analysis.contribution(
        t.lineitem, "revenue", "l_shipdate", Y1997, Y1996, dimension, LINE_METRICS
    )
    segments = rounded(rounded(segments, 6, "baseline_share_pct"), 4, "contribution_pct")
    return analysis.ordered_segments(rounded(segments, 4, "current", "baseline", "delta"))


@query("a3_contribution", _contribution_sql("l_returnflag"))
def a3(t: Tables) -> DataFrame:
    return _contribution(t, "l_returnflag")


@query("a3_contribution_parts", _contribution_sql("l_partkey"))
def a3_parts(t: Tables) -> DataFrame:
    return _contribution(t, "l_partkey")


@query(
    "a4_volume_price",
    f"""with g as (select
          coalesce(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) filter ({IN_1997}), 0)::double as r1,
          coalesce(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) filter ({IN_1996}), 0)::double as r0,
          coalesce(sum(l_quantity) filter ({IN_1997}), 0) as u1,
          coalesce(sum(l_quantity) filter ({IN_1996}), 0) as u0 from lineitem),
        p as (select *, case when u1 <> 0 then r1 / u1 else 0 end as p1,
          case when u0 <> 0 then r0 / u0 else 0 end as p0 from g)
        select round(r1, 4) as revenue_current, u1 as units_current, round(p1, 6) as price_current,
          round(r0, 4) as revenue_baseline, u0 as units_baseline, round(p0, 6) as price_baseline,
          round(r1 - r0, 4) as total_delta, round((u1 - u0) * p0, 2) as volume_effect,
          round((p1 - p0) * u1, 2) as price_effect,
          round(abs(r1 - r0 - (u1 - u0) * p0 - (p1 - p0) * u1), 2) as mix_effect from p""",
)
def a4(t: Tables) -> DataFrame:
    split = analysis.volume_price(t.lineitem, "l_shipdate", Y1997, Y1996, LINE_METRICS)
    split = rounded(split, 4, "revenue_current", "revenue_baseline", "total_delta")
    split = rounded(rounded(split, 2, "volume_effect", "price_effect"), 6, "price_current", "price_baseline")
    # The mix of an undivided table is 0 up to rounding, whose sign carries no meaning.
    return split.withColumn("mix_effect", F.round(F.abs("mix_effect"), 2))


@query(
    "a4_price_by_segment",
    f"""with g as (select l_suppkey,
          coalesce(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) filter ({IN_1997}), 0)::double as r1,
          coalesce(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) filter ({IN_1996}), 0)::double as r0,
          coalesce(sum(l_quantity) filter ({IN_1997}), 0) as u1,
          coalesce(sum(l_quantity) filter ({IN_1996}), 0) as u0
          from lineitem where {IN_1996} or {IN_1997} group by 1),
        p as (select *, case when u1 <> 0 then r1 / u1 else 0 end as p1,
          case when u0 <> 0 then r0 / u0 else 0 end as p0,
          sum(u1) over () / nullif(sum(u0) over (), 0) as growth from g)
        select round(sum(r1) - sum(r0), 4) as total_delta,
          round(sum((growth - 1) * u0 * p0), 2) as volume_effect,
          round(sum((p1 - p0) * u1), 2) as price_effect,
          round(sum((u1 - u0 * growth) * p0), 2) as mix_effect from p""",
)
def a4_segments(t: Tables) -> DataFrame:
    split = analysis.volume_price_by_segment(
        t.lineitem, "l_shipdate", Y1997, Y1996, "l_suppkey", LINE_METRICS
    )
    return rounded(rounded(split, 4, "total_delta"), 2, "volume_effect", "price_effect", "mix_effect")


def _daily_sql(table: str, day: str, money: str) -> str:
    return f"""
      with d as (select {day}::date as period_date, sum(cast({money} as decimal(18,2)))::double as value,
          count(*) as rows_used from {table} group by 1),
      s as (select count(*) as total_periods, avg(value) as mean, stddev_samp(value) as std,
          quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from d),
      b as (select *, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as iqr_lower, q3 + 1.5 * (q3 - q1) as iqr_upper from s)"""


def _anomalies_sql(table: str, day: str, money: str) -> str:
    return (
        _daily_sql(table, day, money)
        + """select period_date, round(value, 2) as value, rows_used from d, b
          where value < iqr_lower or value > iqr_upper or (std > 0 and abs((value - mean) / std) > 2.5)"""
    )


@query("a5_anomalies", _anomalies_sql("events", "ts", "value"))
def a5(t: Tables) -> DataFrame:
    daily = analysis.daily_values(t.events, "value", "ts", EVENT_METRICS)
    return rounded(analysis.anomalies(daily), 2, "value").orderBy("period_date")


@query("a5_anomalies_orders", _anomalies_sql("orders", "o_orderdate", "o_totalprice"))
def a5_orders(t: Tables) -> DataFrame:
    daily = analysis.daily_values(t.orders, "total", "o_orderdate", ORDER_METRICS)
    return rounded(analysis.anomalies(daily), 2, "value").orderBy("period_date")


@query(
    "a5_anomaly_stats",
    _daily_sql("orders", "o_orderdate", "o_totalprice")
    + """select total_periods, round(mean, 4) as mean, round(std, 4) as std, round(q1, 4) as q1,
           round(q3, 4) as q3, round(iqr, 4) as iqr, round(iqr_lower, 4) as iqr_lower,
           round(iqr_upper, 4) as iqr_upper from b""",
)
def a5_stats(t: Tables) -> DataFrame:
    found = analysis.anomaly_stats(analysis.daily_values(t.orders, "total", "o_orderdate", ORDER_METRICS))
    return rounded(found, 4, *[c for c in found.columns if c != "total_periods"])


SPECS = [
    AnalysisSpec("revenue 1997", "scalar", "revenue", "l_shipdate", Y1997),
    AnalysisSpec("units 1997", "scalar", "units", "l_shipdate", Y1997),
    AnalysisSpec("orders of A", "scalar", "orders", filters={"l_returnflag": "A"}),
    AnalysisSpec("l_tax", "scalar", "l_quantity"),
    AnalysisSpec("units change", "compare_periods", "units", "l_shipdate", Y1997, Y1996),
    AnalysisSpec("orders change", "compare_periods", "orders", "l_shipdate", Y1997, Y1996),
    AnalysisSpec("units by status", "contribution", "units", "l_shipdate", Y1997, Y1996, ("l_linestatus",)),
]


@query(
    "a6_spec_batch",
    f"""
      with y as (select {REVENUE_SQL} as revenue, sum(l_quantity) as units, count(*) as n from lineitem
                 where {IN_1997}),
      c as (select sum(l_quantity) filter ({IN_1997}) as u1, sum(l_quantity) filter ({IN_1996}) as u0,
              count(distinct l_orderkey) filter ({IN_1997})::double as o1,
              count(distinct l_orderkey) filter ({IN_1996})::double as o0,
              count(*) filter ({IN_1996} or {IN_1997}) as n from lineitem),
      s as (select l_linestatus as seg, sum(l_quantity) filter ({IN_1997}) as c,
              sum(l_quantity) filter ({IN_1996}) as b, count(*) filter ({IN_1996} or {IN_1997}) as n
            from lineitem group by 1),
      st as (select sum(c) as tc, sum(b) as tb from s),
      r as (
        select 'revenue 1997' as spec_id, 'scalar' as analysis_type, 'revenue' as metric, null::varchar as item,
          'value' as field, revenue as value, n as rows_used from y
        union all select 'units 1997', 'scalar', 'units', null, 'value', units, n from y
        union all select 'orders of A', 'scalar', 'orders', null, 'value', count(distinct l_orderkey), count(*)
          from lineitem where l_returnflag = 'A'
        union all select 'l_tax', 'scalar', 'l_quantity', null, 'value', sum(l_quantity), count(*) from lineitem
        union all select 'units change', 'compare_periods', 'units', null, f, v, n from (select n,
          unnest(['current', 'baseline', 'change', 'change_pct']) as f,
          unnest([u1, u0, u1 - u0, (u1 - u0) / abs(u0) * 100]) as v from c)
        union all select 'orders change', 'compare_periods', 'orders', null, f, v, n from (select n,
          unnest(['current', 'baseline', 'change', 'change_pct']) as f,
          unnest([o1, o0, o1 - o0, (o1 - o0) / abs(o0) * 100]) as v from c)
        union all select 'units by status', 'contribution', 'units', seg, f, v, n from (select seg, n,
          unnest(['current', 'baseline', 'delta', 'baseline_share_pct', 'contribution_pct']) as f,
          unnest([c, b, c - b, b / tb * 100, (c - b) / abs(tc - tb) * 100]) as v from s, st))
      select spec_id, analysis_type, metric, item, field, round(value, 4) as value, rows_used from r""",
)
def a6(t: Tables) -> DataFrame:
    found = evidence.run_specs(t.lineitem, SPECS, LINE_METRICS)
    return rounded(found, 4, "value").drop("evidence_id", "assumption_ids")


@query(
    "a7_insight_tree",
    f"""
      with w as (select * from lineitem where {IN_1996} or {IN_1997}),
      g as (
        select 1 as depth, 'l_returnflag' as split_by, l_returnflag, null as l_suppkey,
          coalesce(sum(l_quantity) filter ({IN_1997}), 0) as c, coalesce(sum(l_quantity) filter ({IN_1996}), 0) as b
          from w group by all
        union all
        select 1, 'l_suppkey', null, l_suppkey, coalesce(sum(l_quantity) filter ({IN_1997}), 0),
          coalesce(sum(l_quantity) filter ({IN_1996}), 0) from w group by all
        union all
        select 2, 'l_returnflag / l_suppkey', l_returnflag, l_suppkey,
          coalesce(sum(l_quantity) filter ({IN_1997}), 0), coalesce(sum(l_quantity) filter ({IN_1996}), 0)
          from w group by all),
      r as (select *, row_number() over (partition by split_by order by abs(c - b) desc,
              l_returnflag asc nulls first, l_suppkey asc nulls first) as place from g),
      m as (select sum(c) - sum(b) as moved from g where split_by = 'l_returnflag')
      select depth, split_by, l_returnflag, l_suppkey, place, c as current, b as baseline, c - b as delta,
        round((c - b) / abs(moved) * 100, 6) as contribution_pct from r, m where place <= 3""",
)
def a7(t: Tables) -> DataFrame:
    tree = analysis.insight_tree(
        t.lineitem, "units", "l_shipdate", Y1997, Y1996, ["l_returnflag", "l_suppkey"], LINE_METRICS, top=3
    )
    return rounded(tree, 6, "contribution_pct")


TREE_DIMS = ["l_returnflag", "l_linestatus", "l_linenumber"]
TREE_SETS = [[d] for d in TREE_DIMS] + [TREE_DIMS[:2], TREE_DIMS[::2], TREE_DIMS[1:]]
TREE_LEVELS_SQL = " union all ".join(
    f"""select {len(s)} as depth, '{" / ".join(s)}' as split_by,
          {", ".join(d if d in s else f"null as {d}" for d in TREE_DIMS)},
          coalesce(sum(l_quantity) filter ({IN_1997}), 0) as c, coalesce(sum(l_quantity) filter ({IN_1996}), 0) as b
        from w group by {", ".join(s)}"""
    for s in TREE_SETS
)


@query(
    "a7_insight_pairs",
    f"""
      with w as (select * from lineitem where {IN_1996} or {IN_1997}), g as ({TREE_LEVELS_SQL}),
      r as (select *, row_number() over (partition by split_by order by abs(c - b) desc,
              {", ".join(f"{d} asc nulls first" for d in TREE_DIMS)}) as place from g),
      m as (select sum(c) - sum(b) as moved from g where split_by = 'l_returnflag')
      select depth, split_by, {", ".join(TREE_DIMS)}, place, c as current, b as baseline, c - b as delta,
        round((c - b) / abs(moved) * 100, 6) as contribution_pct from r, m where place <= 2""",
)
def a7_pairs(t: Tables) -> DataFrame:
    tree = analysis.insight_tree(t.lineitem, "units", "l_shipdate", Y1997, Y1996, TREE_DIMS, LINE_METRICS)
    return rounded(tree, 6, "contribution_pct")


def _level_sql(dimension: str, where: str = "true") -> str:
    return f"""select '{dimension}' as dimension, {dimension}::varchar as segment,
        coalesce(sum(l_quantity) filter ({IN_1997}), 0) as c, coalesce(sum(l_quantity) filter ({IN_1996}), 0) as b
        from w where {where} group by 2"""


@query(
    "a7_insight_levels",
    f"""
      with w as (select * from lineitem where {IN_1996} or {IN_1997}),
      m as (select abs(sum(case when {IN_1997} then l_quantity else -l_quantity end)) as moved from w),
      g as ({" union all ".join(_level_sql(d) for d in TREE_DIMS)}),
      r as (select *, row_number() over (partition by dimension order by abs(c - b) desc, segment asc nulls first) as place from g),
      o as (select dimension as d, segment as s, row_number() over (order by abs(c - b) desc,
              list_position({TREE_DIMS!r}, dimension), place) as i from r where place <= 2 qualify i <= 2),
      n as (select o.d || '=' || o.s as path, x.* from o, lateral (
              {" union all ".join(_level_sql(d, f"o.d <> '{d}' and (case o.d when 'l_returnflag' then l_returnflag when 'l_linestatus' then l_linestatus else l_linenumber::varchar end) = o.s") for d in TREE_DIMS)}) x),
      q as (select *, row_number() over (partition by path, dimension order by abs(c - b) desc, segment asc nulls first) as place from n)
      select 1 as depth, '' as path, dimension, segment, place::int as place, c as current, b as baseline, c - b as delta,
        round((c - b) / moved * 100, 6) as contribution_pct from r, m where place <= 2
      union all select 2, path, dimension, segment, place::int, c, b, c - b, round((c - b) / moved * 100, 6) from q, m where place <= 2""",
)
def a7_levels(t: Tables) -> DataFrame:
    """The two segments that moved the units most, opened and split by the other dimensions."""
    found = analysis.insight_levels(t.lineitem, "units", "l_shipdate", Y1997, Y1996, TREE_DIMS, LINE_METRICS)
    return rounded(found, 6, "contribution_pct")


def _month(i: int) -> TimeWindow:
    first = dt.date(1993 + i // 12, i % 12 + 1, 1)
    after = dt.date(first.year + first.month // 12, first.month % 12 + 1, 1)
    return TimeWindow(first.isoformat(), (after - dt.timedelta(days=1)).isoformat())


def _request_specs() -> list[AnalysisSpec]:
    """Each of 60 months against the one before, three years against the year before by two dimensions, and a
    plain sum per flag."""
    months = [
        AnalysisSpec(f"month {i}", "compare_periods", "revenue", "l_shipdate", _month(i), _month(i - 1)) for i in range(1, 61)
    ]
    years = [
        AnalysisSpec(
            f"year {y}", "contribution", "units", "l_shipdate", TimeWindow(f"{y}-01-01", f"{y}-12-31"),
            TimeWindow(f"{y - 1}-01-01", f"{y - 1}-12-31"), ("l_returnflag", "l_linenumber"),
        )
        for y in (1995, 1996, 1997)
    ]
    flags = [AnalysisSpec(f"flag {f}", "generic", "units", filters={"l_returnflag": f}) for f in ("A", "N", "R", "none")]
    return [*months, *years, *flags]


@query(
    "a6_request_table",
    """
      with d as (select date_trunc('month', l_shipdate)::date as m, sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4)))::double as v,
              count(*) as n from lineitem group by 1),
      p as (select unnest(range(1, 61)) as i, (date '1993-01-01' + to_months(i::int))::date as m),
      c as (select 'month ' || i as spec_id, 'compare_periods' as analysis_type, 'revenue' as metric, null::varchar as dimension,
              null::varchar as item, a.v as now, b.v as old, coalesce(a.n, 0) + coalesce(b.n, 0) as n
            from p left join d a on a.m = p.m left join d b on b.m = (p.m - to_months(1))::date),
      y as (select unnest([1995, 1996, 1997]) as y),
      s as (select y, 'l_returnflag' as dimension, l_returnflag as item, l_quantity as q, year(l_shipdate) = y as is_now from lineitem, y
              where year(l_shipdate) in (y, y - 1)
            union all select y, 'l_linenumber', l_linenumber::varchar, l_quantity, year(l_shipdate) = y from lineitem, y
              where year(l_shipdate) in (y, y - 1)),
      k as (select y, dimension, item, coalesce(sum(q) filter (is_now), 0) as now, coalesce(sum(q) filter (not is_now), 0) as old, count(*) as n
            from s group by all),
      t as (select *, sum(now) over (partition by y, dimension) as all_now, sum(old) over (partition by y, dimension) as all_old from k),
      f as (select 'flag ' || flag as spec_id, sum(l_quantity) as v, count(l_quantity) as n
            from (select unnest(['A', 'N', 'R', 'none']) as flag) left join lineitem on l_returnflag = flag group by 1)
      select spec_id, analysis_type, metric, dimension, item, field, round(value, 4) as value, n::bigint as rows_used from (
        select *, unnest(['current', 'baseline', 'change', 'change_pct']) as field,
          unnest([now, old, now - old, case when old <> 0 then (now - old) / abs(old) * 100 end]) as value from c)
      union all select 'year ' || y, 'contribution', 'units', dimension, item, field, round(value, 4), n from (
        select *, unnest(['current', 'baseline', 'delta', 'baseline_share_pct', 'contribution_pct']) as field,
          unnest([now, old, now - old, case when all_old <> 0 then old / all_old * 100 else 0 end,
                  case when all_now <> all_old then (now - old) / abs(all_now - all_old) * 100 else 0 end]) as value from t)
      union all select spec_id, 'generic', 'units', null, null, 'value', v, n from f""",
)
def a6_requests(t: Tables) -> DataFrame:
    found = requests.run_requests(t.lineitem, _request_specs(), LINE_METRICS)
    return rounded(found.drop("evidence_id"), 4, "value")


ORDER_LINE_PACK = {
    "revenue": ['SUM("net_sales")', 'SUM(CAST("O_TOTALPRICE" AS DECIMAL(18,2)))'],
    "orders": ['COUNT(DISTINCT "order_id")', 'COUNT(DISTINCT "o_orderkey")', "COUNT(*)"],
    "aov": [
        'CAST(SUM(CAST("o_totalprice" AS DECIMAL(18,2))) AS DOUBLE) / NULLIF(COUNT(DISTINCT "o_orderkey"), 0)',
    ],
    "gross_margin": fixed.SALES_METRIC_PACK["gross_margin"],
    "customers": ['COUNT(DISTINCT "customer_id")', 'COUNT(DISTINCT "o_custkey")'],
}


@query(
    "m1_metric_pack",
    """with v as (select sum(cast(o_totalprice as decimal(18,2)))::double as r,
          count(distinct o_orderkey)::double as n, count(distinct o_custkey)::double as c from orders)
       select unnest(['revenue', 'orders', 'aov', 'customers']) as metric,
         unnest(['SUM(CAST("o_totalprice" AS DECIMAL(18,2)))', 'COUNT(DISTINCT "o_orderkey")',
           'CAST(SUM(CAST("o_totalprice" AS DECIMAL(18,2))) AS DOUBLE) / NULLIF(COUNT(DISTINCT "o_orderkey"), 0)',
           'COUNT(DISTINCT "o_custkey")']) as expression,
         unnest([round(r, 2), n, round(r / n, 2), c]) as value from v""",
)
def m1(t: Tables) -> DataFrame:
    definitions = semantic.resolve_metrics(t.orders.columns, ORDER_LINE_PACK)
    return rounded(semantic.metric_table(t.orders, definitions), 2, "value")


ANCHOR_SQL = """select lo as min_date, hi as max_date,
    (date_trunc('month', hi) - interval 1 month)::date as last_complete_month_start,
    (date_trunc('month', hi) - interval 1 day)::date as last_complete_month_end,
    (date_trunc('quarter', hi) - interval 3 month)::date as last_complete_quarter_start,
    (date_trunc('quarter', hi) - interval 1 day)::date as last_complete_quarter_end,
    year(hi) > year(lo) as data_spans_years
  from (select min({day}::date) as lo, max({day}::date) as hi from {table})"""


@query("m2_time_anchor", ANCHOR_SQL.format(day="o_orderdate", table="orders"))
def m2(t: Tables) -> DataFrame:
    return semantic.time_anchor(t.orders, "o_orderdate")


EXPRESSIONS = [
    "last month", "Previous Month", "this month", " last quarter ", "last complete quarter",
    "last year", "YTD", "this year", "last week", "Q3 2023", "q1 1997", "last 30 days", "last 1 day",
    "last 6 months", "1998", "some day",
]


@query(
    "m3_relative_windows",
    f"""
      with a as ({ANCHOR_SQL.format(day="o_orderdate", table="orders")}),
      e as (select o_orderkey, case when o_orderstatus = 'P'
              then 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate)
              else ({EXPRESSIONS!r})[o_orderkey % {len(EXPRESSIONS)} + 1] end as expression from orders),
      x as (select *, lower(trim(expression)) as s, date_trunc('month', max_date)::date as m,
              date_trunc('year', max_date)::date as y, date_trunc('week', max_date)::date as w,
              try_cast(nullif(regexp_extract(lower(trim(expression)), '^q([1-4])', 1), '') as int) as q,
              try_cast(nullif(regexp_extract(lower(trim(expression)), '(\\d{{4}})$', 1), '') as int) as yr,
              try_cast(nullif(regexp_extract(lower(trim(expression)), '^last (\\d+)', 1), '') as int) as n
            from e, a)
      select o_orderkey, expression,
        (case when s in ('last month', 'previous month') then last_complete_month_start
              when s = 'this month' then m
              when s in ('last quarter', 'last complete quarter') then last_complete_quarter_start
              when s = 'last year' then y - interval 1 year
              when s in ('ytd', 'this year') then y
              when s = 'last week' then w - interval 7 day
              when q is not null then make_date(yr, (q - 1) * 3 + 1, 1)
              when s like 'last % day%' then max_date - cast(n - 1 as int)
              when s like 'last % months' then m - to_months(n)
              when yr is not null then make_date(yr, 1, 1) end)::date as start_day,
        (case when s in ('last month', 'previous month') then last_complete_month_end
              when s in ('last quarter', 'last complete quarter') then last_complete_quarter_end
              when s = 'last year' then y - interval 1 day
              when s in ('this month', 'ytd', 'this year') then max_date
              when s = 'last week' then w - interval 1 day
              when q is not null then make_date(yr, (q - 1) * 3 + 1, 1) + interval 3 month - interval 1 day
              when s like 'last % day%' or s like 'last % months' then max_date
              when yr is not null then make_date(yr, 12, 31) end)::date as end_day
      from x""",
)
def m3(t: Tables) -> DataFrame:
    anchor = one_row(semantic.time_anchor(t.orders, "o_orderdate"))
    words = F.array(*[F.lit(e) for e in EXPRESSIONS])
    quarter = F.concat(
        F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), F.year("o_orderdate").cast("string")
    )
    expression = F.when(F.col("o_orderstatus") == "P", quarter).otherwise(
        F.element_at(words, (F.col("o_orderkey") % len(EXPRESSIONS) + 1).cast("int"))
    )
    asked = t.orders.select("o_orderkey", expression.alias("expression"))
    window = relative_window(F.col("expression"), anchor)
    return asked.withColumn("w", window).select(
        "o_orderkey", "expression", F.col("w.start").alias("start_day"), F.col("w.end").alias("end_day")
    )


@query(
    "m6_filter_in",
    """select o_orderpriority, count(*) as orders, round(sum(cast(o_totalprice as decimal(18,2)))::double, 2) as total
       from orders where o_orderstatus in ('F', 'P') and o_orderpriority in ('1-URGENT', '2-HIGH') group by 1""",
)
def m6(t: Tables) -> DataFrame:
    filters = {"o_orderstatus": ["F", "P"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}
    return (
        matching_rows(t.orders, filters)
        .groupBy("o_orderpriority")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("total"),
        )
    )


@query(
    "m8_rows_used",
    """select round(sum(cast(value as decimal(18,2)))::double, 2) as value, count(*) as rows_used from events
       where ts::date >= date '2024-01-10' and event_type = 'purchase'""",
)
def m8(t: Tables) -> DataFrame:
    window = TimeWindow(start="2024-01-10")
    found = analysis.generic_metric(
        t.events, "value", EVENT_METRICS, "ts", window, {"event_type": "purchase"}
    )
    return rounded(found, 2, "value")


@query(
    "k3_kth_value",
    """select 100 as offset_from_top, (select o_totalprice from orders order by o_totalprice desc
         limit 1 offset 100) as value, count(*) as rows_above
       from orders where o_totalprice > (select o_totalprice from orders order by o_totalprice desc
         limit 1 offset 100)""",
)
def k3(t: Tables) -> DataFrame:
    kth = stats.kth_largest_value(t.orders, "o_totalprice", 100)
    return t.orders.where(F.col("o_totalprice") > kth).agg(
        F.lit(100).alias("offset_from_top"), F.lit(kth).alias("value"), F.count(F.lit(1)).alias("rows_above")
    )
