"""Chart data: G1-G9."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.operators import analysis, charts
from plumbline.workload.core import IN_1996, IN_1997
from plumbline.workload.inputs import EVENT_METRICS, LINE_METRICS, REVENUE_SQL, Y1996, Y1997
from plumbline.workload.registry import Tables, query, rounded


@query(
    "g1_trend_rows",
    f"""select date_trunc('month', l_shipdate)::date as period, round({REVENUE_SQL}, 4) as value,
          case when count(*) over () <= 6 then 'bar' else 'line' end as chart_type from lineitem group by 1""",
)
def g1(t: Tables) -> DataFrame:
    monthly = t.lineitem.groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("month")).agg(
        F.expr(LINE_METRICS["revenue"].replace('"', "`")).cast("double").alias("revenue")
    )
    return rounded(charts.trend_rows(monthly, "month", "revenue"), 4, "value").orderBy("period")


def _top_sql(category: str) -> str:
    return f"""
      with g as (select {category} as k, sum(l_quantity) as v from lineitem group by 1),
      r as (select *, row_number() over (order by v desc, k) as i from g)
      select case when i <= 10 then k::varchar else 'Other' end as category, i > 10 as is_other, sum(v) as value,
        count(*) as categories from r group by 1, 2"""


@query("g2_topn_other", _top_sql("l_partkey"))
def g2(t: Tables) -> DataFrame:
    units = t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("units"))
    return charts.top_and_other(units, "l_partkey", "units")


@query("g2_topn_few", _top_sql("l_linenumber"))
def g2_few(t: Tables) -> DataFrame:
    units = t.lineitem.groupBy("l_linenumber").agg(F.sum("l_quantity").alias("units"))
    return charts.top_and_other(units, "l_linenumber", "units")


_CHANGE = f"""(select sum(l_quantity) filter ({IN_1997}) as c, sum(l_quantity) filter ({IN_1996}) as b from lineitem)"""


def _units_change(t: Tables) -> DataFrame:
    return analysis.compare_periods(t.lineitem, "units", "l_shipdate", Y1997, Y1996, LINE_METRICS)


@query(
    "g3_waterfall",
    f"""select unnest([1, 2, 3]) as step, unnest(['1996', 'Change', '1997']) as label,
          unnest([b, c - b, c]) as value, unnest(['absolute', 'delta', 'absolute']) as type from {_CHANGE}""",
)
def g3(t: Tables) -> DataFrame:
    return charts.waterfall(_units_change(t))


@query(
    "g7_before_after",
    f"""select unnest([1, 2]) as step, unnest(['1996', '1997']) as period, unnest([b, c]) as value from {_CHANGE}""",
)
def g7(t: Tables) -> DataFrame:
    return charts.before_after(_units_change(t))


def _composition_sql(category: str) -> str:
    return f"""
      with g as (select {category} as category, abs(sum(case when l_linestatus = 'F' then l_quantity else -l_quantity end))
        as value from lineitem group by 1)
      select category, value, round(value / sum(value) over (), 8) as share,
        case when count(*) over () <= 5 then 'pie' else 'stacked_bar' end as chart_type from g"""


def _composition(t: Tables, category: str) -> DataFrame:
    signed = F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    rows = t.lineitem.groupBy(category).agg(F.sum(signed).alias("balance"))
    return rounded(charts.composition(rows, category, "balance"), 8, "share")


@query("g4_composition", _composition_sql("l_returnflag"))
def g4(t: Tables) -> DataFrame:
    return _composition(t, "l_returnflag")


@query("g4_composition_suppliers", _composition_sql("l_suppkey"))
def g4_suppliers(t: Tables) -> DataFrame:
    return _composition(t, "l_suppkey")


@query(
    "g5_scatter_fit",
    """with f as (select regr_slope(l_extendedprice, l_quantity) as m, regr_intercept(l_extendedprice, l_quantity) as b
                 from lineitem)
       select l_orderkey, l_linenumber, l_quantity as x, l_extendedprice as y, round(b + m * l_quantity, 3) as fitted
       from lineitem, f""",
)
def g5(t: Tables) -> DataFrame:
    fitted = charts.scatter_fit(t.lineitem, "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber"])
    return rounded(fitted, 3, "fitted")


@query(
    "g6_histogram",
    """with e as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem),
       b as (select case when hi > lo then least(floor((l_extendedprice - lo) / ((hi - lo) / 20.0)) + 1, 20) else 1 end::int
               as bin, lo, (hi - lo) / 20.0 as w from lineitem, e)
       select bin, round(max(lo + (bin - 1) * w), 6) as bin_start, round(max(lo + bin * w), 6) as bin_end,
         count(*) as count from b group by 1""",
)
def g6(t: Tables) -> DataFrame:
    return rounded(charts.histogram(t.lineitem, "l_extendedprice"), 6, "bin_start", "bin_end").orderBy("bin")


@query(
    "g8_series_cap",
    """select 'l_suppkey' as field, count(distinct l_suppkey) as series, count(distinct l_suppkey) > 10 as too_many
       from lineitem""",
)
def g8(t: Tables) -> DataFrame:
    return charts.series_cap(t.lineitem, "l_suppkey")


@query(
    "g9_unpivot_fields",
    """with g as (select event_type, count(*)::double as events, sum(cast(value as decimal(18,2)))::double as total,
          max(value) as highest from events group by 1)
       select event_type, unnest(['events', 'total', 'highest']) as label,
         unnest([round(events, 2), round(total, 2), round(highest, 2)]) as value from g""",
)
def g9(t: Tables) -> DataFrame:
    records = t.events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.expr(EVENT_METRICS["value"].replace('"', "`")).cast("double").alias("total"),
        F.max("value").alias("highest"),
    )
    return rounded(charts.labelled_fields(records, ["event_type"], ["events", "total", "highest"]), 2, "value")
