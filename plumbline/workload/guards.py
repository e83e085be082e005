"""Statistical guards, join safety and sufficiency: T, J1-J5, F."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.operators import analysis, dictionary, joins, stats, sufficiency
from plumbline.operators.profile import union_all
from plumbline.plans.spec import AnalysisSpec, TimeWindow
from plumbline.workload.inputs import (
    EVENT_METRICS,
    LINE_METRICS,
    ORDER_METRICS,
    P_VALUES,
    p_values,
)
from plumbline.workload.registry import Tables, query, rounded


@query(
    "t1_bh_fdr",
    f"""with r as (select *, count(*) over (partition by family order by p) as rk,
            count(*) over (partition by family) as n from {P_VALUES}),
        l as (select family, max(p) as lim from r where p <= (rk::double / n) * 0.05 group by 1)
        select r.family, r.hypothesis_id, r.p, coalesce(r.p <= l.lim, false) as rejected
        from r left join l on r.family = l.family""",
)
def t1(t: Tables) -> DataFrame:
    return stats.benjamini_hochberg(p_values(t.part), "p", ["family"], "hypothesis_id")


@query(
    "t1_bh_trailing",
    f"""with r as (select *, row_number() over (partition by family order by p, hypothesis_id) as rk,
            count(*) over (partition by family) as n from {P_VALUES}),
        q as (select *, p <= (rk::double / n) * 0.3 as pass from r)
        select family, hypothesis_id, p, min(pass) over (partition by family order by p, hypothesis_id
          rows between current row and unbounded following) as rejected from q""",
)
def t1_trailing(t: Tables) -> DataFrame:
    return stats.benjamini_hochberg(
        p_values(t.part), "p", ["family"], "hypothesis_id", alpha=0.3, variant="trailing"
    )


def _trend_sql(value: str, table: str, day: str, segment: str) -> str:
    return f"""
      m as (select {segment} as segment, 0 as whole, date_trunc('month', {day})::date as period,
              {value} as value from {table} group by all
            union all select null, 1, date_trunc('month', {day})::date, {value} from {table} group by all),
      x as (select *, (row_number() over (partition by whole, segment order by period) - 1)::double as i from m),
      k as (select whole, segment, count(*) as periods, regr_slope(value, i) as slope,
              stddev_pop(value) as spread from x group by all),
      c as (select *, case when periods < 2 or spread = 0 or abs(slope) / spread < 0.1 then 'flat'
              when slope > 0 then 'increasing' else 'decreasing' end as trend from k)"""


@query(
    "t3_trend_class",
    "with "
    + _trend_sql("sum(l_quantity)", "lineitem", "l_shipdate", "l_suppkey")
    + """ select whole, segment, periods, round(slope, 6) as slope, round(spread, 6) as spread, trend from c""",
)
def t3(t: Tables) -> DataFrame:
    trends = stats.trends_by_level(t.lineitem, "units", "l_suppkey", "l_shipdate", LINE_METRICS)
    return rounded(trends, 6, "slope", "spread")


def _simpson(table: str, day: str, value: str, segment: str) -> str:
    return (
        "with "
        + _trend_sql(value, table, day, segment)
        + """, v as (select trend, count(*) as n, min(segment) as s from c where whole = 0
               and segment is not null group by 1),
             o as (select max(trend) as overall from c where whole = 1),
             w as (select trend as majority, n, (select sum(n) from v)::bigint as total from v
                   order by n desc, s limit 1)
             select majority <> overall and overall <> 'flat' as detected, overall as overall_trend,
               majority as majority_trend, n as majority_segments, total as segments from w, o"""
    )


@query("t2_simpson", _simpson("lineitem", "l_shipdate", "sum(l_quantity)", "l_returnflag"))
def t2(t: Tables) -> DataFrame:
    found = stats.simpsons_paradox(t.lineitem, "units", "l_returnflag", "l_shipdate", LINE_METRICS)
    return found.drop("description")


@query(
    "t2_simpson_customers",
    _simpson("orders", "o_orderdate", "sum(cast(o_totalprice as decimal(18,2)))::double", "o_custkey"),
)
def t2_customers(t: Tables) -> DataFrame:
    found = stats.simpsons_paradox(t.orders, "total", "o_custkey", "o_orderdate", ORDER_METRICS)
    return found.drop("description")


@query(
    "t4_stability",
    """with d as (select o_orderdate::date as day, sum(cast(o_totalprice as decimal(18,2)))::double as v
                  from orders group by 1),
       r as (select v, row_number() over (order by day) as i, count(*) over () as n from d),
       h as (select avg(v) filter (i <= n // 2) as a, avg(v) filter (i > n // 2) as b, max(n) as n from r)
       select not (n >= 4 and (abs(a) + abs(b)) <> 0
           and abs(a - b) / ((abs(a) + abs(b)) / 2) * 100 >= 20) as stable,
         round(case when n >= 4 then a end, 4) as first_half, round(case when n >= 4 then b end, 4) as second_half,
         case when n < 4 then 'Insufficient periods' end as note from h""",
)
def t4(t: Tables) -> DataFrame:
    daily = analysis.daily_values(t.orders, "total", "o_orderdate", ORDER_METRICS)
    return rounded(stats.stability(daily), 4, "first_half", "second_half")


@query(
    "t5_group_size",
    """with g as (select l_suppkey as "group", count(*) as row_count from lineitem group by 1),
       s as (select *, row_count / (select sum(row_count) from g)::double as share from g)
       select "group", row_count, round(share, 8) as share,
         case when row_count < 30 then 'below min_rows' when share < 0.01 then 'below min_share' end as reason,
         not (row_count < 30 or share < 0.01) as passed from s""",
)
def t5(t: Tables) -> DataFrame:
    return rounded(stats.group_size(t.lineitem, "l_suppkey"), 8, "share")


def _outlier_sql(cut: str) -> str:
    return f"""
      with c as (select {cut} as cut),
      v as (select sum(cast(o_totalprice as decimal(18,2)))::double as a,
              sum(cast(o_totalprice as decimal(18,2))) filter (o_totalprice <= cut)::double as b from orders, c)
      select round(a, 2) as with_outliers, round(b, 2) as without_outliers,
        abs(a - b) / abs(a) * 100 > 10 as sensitive, round(abs(a - b) / abs(a) * 100, 2) as difference_pct from v"""


@query("t6_outlier_sensitivity", _outlier_sql("(select quantile_cont(o_totalprice, 0.99) from orders)"))
def t6(t: Tables) -> DataFrame:
    found = stats.outlier_sensitivity(t.orders, "total", ORDER_METRICS)
    return rounded(found, 2, "with_outliers", "without_outliers")


@query(
    "t6_outlier_lowest",
    _outlier_sql(
        """(select o_totalprice from (select o_totalprice, row_number() over (order by o_totalprice desc) - 1 as i,
             count(*) over () as n from orders) where i = greatest(1, cast(floor(n * (1 - 0.01)) as bigint)))"""
    ),
)
def t6_lowest(t: Tables) -> DataFrame:
    found = stats.outlier_sensitivity(t.orders, "total", ORDER_METRICS, variant="lowest")
    return rounded(found, 2, "with_outliers", "without_outliers")


FIRST_HALF = TimeWindow("2024-01-01", "2024-01-15")
SECOND_HALF = TimeWindow("2024-01-16", "2024-01-30")


@query(
    "t7_spec_agreement",
    """with v as (select
          sum(cast(value as decimal(18,2))) filter (ts::date between date '2024-01-01' and date '2024-01-15')::double as a,
          sum(cast(value as decimal(18,2))) filter (ts::date between date '2024-01-16' and date '2024-01-30')::double as b
          from events)
       select coalesce(abs(a - b) / ((abs(a) + abs(b)) / 2) * 100 < 10, false) as agrees, round(a, 2) as result_a,
         round(b, 2) as result_b, round(abs(a - b) / ((abs(a) + abs(b)) / 2) * 100, 2) as divergence_pct from v""",
)
def t7(t: Tables) -> DataFrame:
    a = AnalysisSpec("first half", "scalar", "value", "ts", FIRST_HALF)
    b = AnalysisSpec("second half", "scalar", "value", "ts", SECOND_HALF)
    return rounded(stats.spec_agreement(t.events, a, b, EVENT_METRICS), 2, "result_a", "result_b")


def _pairs(t: Tables) -> dict[str, tuple]:
    billed = t.orders.where(F.col("o_orderstatus") != "P")
    return {
        "lines to orders": (t.lineitem, t.orders, "l_orderkey", "o_orderkey", ["l_extendedprice", "l_quantity"]),
        "lines to billed": (t.lineitem, billed, "l_orderkey", "o_orderkey", ["l_extendedprice", "l_quantity"]),
        "events to customers": (t.events, t.customer, "user_id", "c_custkey", ["value"]),
        "documents to labels": (t.documents, t.labels, "doc_id", "doc_id", ["n_chars"]),
        "orders to suppliers": (t.orders, t.lineitem, "o_custkey", "l_suppkey", ["o_totalprice"]),
        "nations by wrong type": (t.customer, t.supplier, "c_nationkey", "s_suppkey", ["c_acctbal"]),
    }


_PAIR_SQL = {
    "lines to orders": ("lineitem", "orders", "l_orderkey", "o_orderkey", ["l_extendedprice", "l_quantity"]),
    "lines to billed": (
        "lineitem", "(select * from orders where o_orderstatus <> 'P')", "l_orderkey", "o_orderkey",
        ["l_extendedprice", "l_quantity"],
    ),
    "events to customers": ("events", "customer", "user_id", "c_custkey", ["value"]),
    "documents to labels": ("documents", "labels", "doc_id", "doc_id", ["n_chars"]),
    "orders to suppliers": ("orders", "lineitem", "o_custkey", "l_suppkey", ["o_totalprice"]),
    "nations by wrong type": ("customer", "supplier", "c_nationkey", "s_suppkey", ["c_acctbal"]),
}


def _safety_sql(name: str, columns: str) -> str:
    left, right, lk, rk, measures = _PAIR_SQL[name]
    sums = ", ".join(f"(select sum({m}::double) from l) as before_{i}" for i, m in enumerate(measures))
    after = ", ".join(f"sum({m}::double) as after_{i}" for i, m in enumerate(measures))
    shift = [f"(abs(after_{i} - before_{i}) / abs(before_{i}) * 100)" for i in range(len(measures))]
    moved = " or ".join(f"coalesce({s} > 1.0, false)" for s in shift)
    texts = ", ".join(
        f"case when coalesce({s} > 1.0, false) "
        f"then printf('SUM({m}) changed by %.1f%% after join', round({s}, 1)) end"
        for s, m in zip(shift, measures)
    )
    return f"""
      select '{name}' as pair, {columns} from (
      select match_rate >= 0.9 and not type_mismatch and not ({moved}) as safe, round(match_rate, 4) as match_rate,
        left_unique, right_unique, type_mismatch, concat_ws('; ', {texts}) as invariant_failures,
        case when match_rate < 1 then printf('%.1f%% of left keys have no match in the right dataset. Rows will be dropped in an inner join.', round((1 - match_rate) * 100, 1)) else '' end as coverage_caveat,
        round(joined_rows::double / left_rows, 4) as fanout_factor, joined_rows::double as joined_rows,
        round(before_0, 0) as before_0, round(after_0, 0) as after_0
      from (with l as (select * from {left}), r as (select * from {right})
        select (select count(*) from l) as left_rows,
          (select count(*) = count(distinct {lk}) from l) as left_unique,
          (select count(*) = count(distinct {rk}) from r) as right_unique,
          (select count(distinct {lk}) from l) as left_keys,
          count(distinct l.{lk})::double / (select count(distinct {lk}) from l) as match_rate,
          (select max(typeof({lk})) from l) <> (select max(typeof({rk})) from r) as type_mismatch,
          count(*) as joined_rows, {sums}, {after}
        from l join r on l.{lk} = r.{rk}))"""


def _safety(t: Tables, names: list[str], columns: list[str]) -> DataFrame:
    pairs = _pairs(t)
    parts = []
    for name in names:
        found = rounded(joins.join_safety(*pairs[name]), 0, "before_0", "after_0")
        parts.append(found.select(F.lit(name).alias("pair"), *columns))
    return union_all(parts)


def _register(key: str, names: list[str], columns: list[str]) -> None:
    sql = " union all ".join(_safety_sql(n, ", ".join(columns)) for n in names)
    query(key, sql)(lambda t: _safety(t, names, columns))


_register("j1_match_rate", ["lines to billed", "documents to labels"], ["match_rate", "coverage_caveat"])
_register("j2_key_unique", ["documents to labels", "orders to suppliers"], ["left_unique", "right_unique"])
_register("j3_key_type", ["nations by wrong type", "lines to orders"], ["type_mismatch"])
_register(
    "j4_measure_invariance",
    ["lines to billed", "orders to suppliers"],
    ["before_0", "after_0", "invariant_failures", "fanout_factor"],
)
_register(
    "j5_join_safety",
    list(_PAIR_SQL),
    [
        "safe", "match_rate", "left_unique", "right_unique", "type_mismatch", "invariant_failures",
        "coverage_caveat", "fanout_factor", "joined_rows",
    ],
)

NEEDS = {
    "enough": sufficiency.Requirements(("measure", "date"), ("l_quantity",), ("returnflag",), "last month", 5),
    "too small": sufficiency.Requirements(("measure",), ("price",), ("colour",), None, 10_000_000_000),
    "no metric": sufficiency.Requirements(("identifier",), ("margin",), ("l_suppkey",), "ytd", 30),
}

_FACTS = """with d as (select count(*) as n, count(distinct l_orderkey) > count(*) * 0.8 as okey,
    count(distinct l_partkey) > count(*) * 0.8 as pkey, count(distinct l_suppkey) > count(*) * 0.8 as skey,
    count(distinct l_linenumber) > count(*) * 0.8 as num from lineitem)"""


@query(
    "f_sufficiency",
    _FACTS
    + """
      select 'enough' as request, case when n >= 5 then 'sufficient' else 'partial' end as verdict, '' as missing,
        case when n < 5 then 'Row count ' || n || ' < minimum 5.' else '' end as caveats,
        case when n < 5 then 'measure; date; l_quantity; returnflag; date' else '' end as partial_answerable_parts from d
      union all
      select 'too small', 'partial', '', 'Row count ' || n || ' < minimum 10000000000.; Dimension ''colour'' not found.',
        'measure; price' from d
      union all
      select 'no metric', 'insufficient', case when not (okey or pkey or skey or num)
          then 'No column with role ''identifier'' found.; ' else '' end || 'Required metric ''margin'' not found.',
        '', '' from d""",
)
def f_verdicts(t: Tables) -> DataFrame:
    roles = dictionary.propose_dictionary(t.lineitem)
    checks = sufficiency.request_checks(t.lineitem, roles, NEEDS)
    return sufficiency.sufficiency(checks, ["request"])


@query(
    "f_requirement_checks",
    _FACTS
    + """
      select 0 as position, 'presence' as check_type, 'measure' as role_needed, true as satisfied,
        'Role ''measure'' present.' as message from d
      union all select 1, 'presence', 'date', true, 'Role ''date'' present.' from d
      union all select 2, 'presence', 'l_quantity', true, 'Metric ''l_quantity'' available.' from d
      union all select 3, 'sample_size', 'rows', n >= 5, 'Row count ' || n ||
        case when n >= 5 then ' ≥' else ' <' end || ' minimum 5.' from d
      union all select 4, 'coverage', 'returnflag', true, 'Dimension ''returnflag'' available.' from d
      union all select 5, 'time_span', 'date', true, 'Date column present.' from d""",
)
def f_checks(t: Tables) -> DataFrame:
    roles = dictionary.propose_dictionary(t.lineitem)
    return sufficiency.requirement_checks(t.lineitem, roles, NEEDS["enough"])
