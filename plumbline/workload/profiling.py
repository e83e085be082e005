"""Profiles, quality and dictionary: P, S11, Q, D."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline import fixed_values as fixed
from plumbline.operators import dictionary, profile, quality
from plumbline.workload.inputs import AMOUNTS, MESSY_LINEITEM, amounts, messy_lineitem
from plumbline.workload.registry import Tables, query, rounded

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "p1_table_profile",
    """select count(*) as row_count, 6::bigint as column_count,
         'o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string' as column_types,
         'o_orderdate' as date_column, min(o_orderdate::date) as date_min, max(o_orderdate::date) as date_max,
         '' as pii_columns from orders""",
)
def p1(t: Tables) -> DataFrame:
    return profile.table_profile(t.orders, "o_orderdate")


def _column_sql(table: str, columns: list[str]) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", count(*) as total_rows, count(*) - count({c}) as missing_count,
              round((count(*) - count({c}))::double / count(*) * 100, 2) as missing_pct,
              count(distinct {c}) as unique_count from {table}"""
        for c in columns
    )


LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *MEASURES, "l_returnflag", "l_linestatus",
    "l_shipdate",
]


@query("p2_column_profile", _column_sql(MESSY_LINEITEM, LINE_COLUMNS))
def p2(t: Tables) -> DataFrame:
    return profile.column_profile(messy_lineitem(t.lineitem))


@query(
    "p3_measure_profile",
    " union all ".join(
        f"""select '{c}' as "column", min({c})::double as min, max({c})::double as max, round(avg({c}), 6) as mean,
              round(median({c}), 6) as median, round(stddev_samp({c}), 6) as std from {MESSY_LINEITEM}"""
        for c in MEASURES
    ),
)
def p3(t: Tables) -> DataFrame:
    found = profile.measure_profile(messy_lineitem(t.lineitem), MEASURES)
    return rounded(found, 6, "mean", "median", "std")


@query(
    "p3_measure_samples",
    " union all ".join(
        f"""select '{c}' as "column", array_to_string(list(v::integer order by v), ',') as samples
              from (select distinct {c} as v from {MESSY_LINEITEM} where {c} is not null order by v limit 5)"""
        for c in ("l_orderkey", "l_quantity", "l_linenumber")
    ),
)
def p3_samples(t: Tables) -> DataFrame:
    found = profile.measure_profile(messy_lineitem(t.lineitem), ["l_orderkey", "l_quantity", "l_linenumber"], samples=5)
    whole = F.transform("sample_values", lambda v: v.cast("double").cast("int").cast("string"))
    return found.select("column", F.array_join(whole, ",").alias("samples"))


@query(
    "s11_table_sample",
    "select count(*) as rows, true as all_from_table from (select * from orders limit 200)",
)
def s11_table(t: Tables) -> DataFrame:
    sample = profile.table_sample(t.orders)
    missing = sample.join(t.orders, sample.columns, "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    return sample.agg(F.count(F.lit(1)).alias("rows")).withColumn("all_from_table", missing == 0)


@query(
    "p2_nested_columns",
    """select 'words' as "column", count(*) as total_rows, 0::bigint as missing_count, 0.0::double as missing_pct,
         count(distinct list_slice(string_split(text, ' '), 1, 2)) as unique_count from documents
       union all select 'origin', count(*), count(*) filter (lang = 'en'), round(count(*) filter (lang = 'en')::double / count(*) * 100, 2),
         count(distinct (lang, source)) filter (lang <> 'en') from documents""",
)
def p2_nested(t: Tables) -> DataFrame:
    """The first words of a text as an array, and its origin as a structure that English texts lack."""
    origin = F.when(F.col("lang") != "en", F.struct("lang", "source"))
    return profile.column_profile(t.documents.select(F.slice(F.split("text", " "), 1, 2).alias("words"), origin.alias("origin")))


@query(
    "p4_top_categories",
    """(select 'l_partkey' as "column", l_partkey::varchar as value, count(*) as count from lineitem group by 2
         order by 3 desc, 2 limit 10)
       union all (select 'l_returnflag', l_returnflag, count(*) from lineitem group by 2 order by 3 desc, 2 limit 10)
       union all (select 'l_shipdate', strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'), count(*) from lineitem group by 2
         order by 3 desc, 2 limit 10)""",
)
def p4(t: Tables) -> DataFrame:
    return profile.top_categories(t.lineitem, ["l_partkey", "l_returnflag", "l_shipdate"])


@query("p5_date_range", """select 'l_shipdate' as "column", min(l_shipdate) as min, max(l_shipdate) as max from lineitem""")
def p5(t: Tables) -> DataFrame:
    return profile.date_ranges(t.lineitem, ["l_shipdate"])


def _pii_sql(table: str, texts: list[str], others: list[str]) -> str:
    def flag(c: str, rates: str) -> str:
        return "true" if any(w in c for w in fixed.PII_NAME_WORDS) else rates

    rows = [
        f"""select '{c}' as "column", round(avg(regexp_matches({c}, '{fixed.EMAIL_PATTERN}')::int), 8) as email_rate,
              round(avg(regexp_matches({c}, '{fixed.PHONE_PATTERN}')::int), 8) as phone_rate,
              {flag(c, f"greatest(avg(regexp_matches({c}, '{fixed.EMAIL_PATTERN}')::int), avg(regexp_matches({c}, '{fixed.PHONE_PATTERN}')::int)) > 0.3")} as is_pii
            from {table}"""
        for c in texts
    ]
    rows += [f"select '{c}', null, null, {flag(c, 'false')}" for c in others]
    return " union all ".join(rows)


@query("p6_pii_columns", _pii_sql("documents", ["text", "lang", "source"], ["doc_id", "n_chars"]))
def p6(t: Tables) -> DataFrame:
    return rounded(profile.pii_columns(t.documents), 8, "email_rate", "phone_rate")


@query(
    "p6_pii_columns_customer",
    _pii_sql("customer", ["c_name", "c_mktsegment"], ["c_custkey", "c_nationkey", "c_acctbal"]),
)
def p6_customer(t: Tables) -> DataFrame:
    return rounded(profile.pii_columns(t.customer), 8, "email_rate", "phone_rate")


@query(
    "p6_pii_rows",
    f"""select lang, count(*) as documents,
          count(*) filter (regexp_matches(text, '{fixed.EMAIL_PATTERN}')) as with_email,
          count(*) filter (regexp_matches(text, '{fixed.PHONE_PATTERN}')) as with_phone
        from documents group by 1""",
)
def p6_rows(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(profile.has_email(F.col("text"))).alias("with_email"),
        F.count_if(profile.has_phone(F.col("text"))).alias("with_phone"),
    )


@query(
    "s11_sample_values",
    """select 'l_partkey' as "column", v::varchar as value
         from (select distinct l_partkey as v from lineitem order by v limit 5)
       union all select 'l_shipdate', strftime(v, '%Y-%m-%d %H:%M:%S')
         from (select distinct l_shipdate as v from lineitem order by v limit 5)
       union all select 'l_returnflag', v
         from (select distinct l_returnflag as v from lineitem order by v limit 5)""",
)
def s11(t: Tables) -> DataFrame:
    return profile.sample_values(t.lineitem, ["l_partkey", "l_shipdate", "l_returnflag"])


MISSING = f"""
  with n as ({" union all ".join(f"select '{c}' as c, count(*) as total, count(*) - count({c}) as missing from {MESSY_LINEITEM}" for c in LINE_COLUMNS)})
  select c as "column", 'missing_values' as issue_type,
    case when missing / total::double * 100 > 20 then 'error' else 'warning' end as severity,
    printf('%d missing values (%.1f%%)', missing, round(missing / total::double * 100, 1)) as description,
    missing as affected_rows from n where missing > 0"""


@query("q1_missing", MISSING)
def q1(t: Tables) -> DataFrame:
    return quality.missing_issues(messy_lineitem(t.lineitem))


def _outliers(c: str) -> str:
    return f"""
      select "column", 'outliers' as issue_type, 'warning' as severity,
        printf('%d extreme outliers (beyond 3×IQR: [%.2f, %.2f])', n, round(lo, 2), round(hi, 2)) as description,
        n as affected_rows
      from (select '{c}' as "column", count(*) as n, max(lo) as lo, max(hi) as hi from {MESSY_LINEITEM},
          (select q1 - 3 * (q3 - q1) as lo, q3 + 3 * (q3 - q1) as hi from
             (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {MESSY_LINEITEM}))
        where {c} < lo or {c} > hi) where n > 0"""


OUTLIERS = " union all ".join(_outliers(c) for c in MEASURES)


@query("q2_outliers_3iqr", OUTLIERS)
def q2(t: Tables) -> DataFrame:
    return quality.outlier_issues(messy_lineitem(t.lineitem), MEASURES)


NEGATIVE = " union all ".join(
    f"""select * from (select '{c}' as "column", 'suspicious_values' as issue_type, 'warning' as severity,
          printf('%d negative values in ''{c}'' — verify if returns/credits are expected.', count(*)) as description,
          count(*) as affected_rows from {MESSY_LINEITEM} where {c} < 0) where affected_rows > 0"""
    for c in ("l_quantity", "l_extendedprice")
)


@query("q3_negative", NEGATIVE)
def q3(t: Tables) -> DataFrame:
    return quality.negative_issues(messy_lineitem(t.lineitem), MEASURES)


@query(
    "q4_mixed_currency",
    f"""select 'mixed' as "column", 'mixed_currency' as issue_type, 'error' as severity,
          'Mixed currency symbols detected: $, £. Values may not be comparable.' as description,
          count(*) as affected_rows from {AMOUNTS}
        having bool_or(contains(mixed, '$')) and bool_or(contains(mixed, '£'))""",
)
def q4(t: Tables) -> DataFrame:
    return quality.currency_issues(amounts(t.orders))


@query(
    "q5_duplicates",
    """select sum(n)::bigint as total_rows, count(*) as distinct_rows, sum(n - 1)::bigint as duplicate_rows
       from (select count(*) as n from (select * from lineitem union all
         select * from lineitem where l_returnflag = 'A') l group by l)""",
)
def q5(t: Tables) -> DataFrame:
    return quality.duplicate_rows(t.lineitem.unionByName(t.lineitem.where("l_returnflag = 'A'")))


@query(
    "q5_duplicate_vectors",
    """select sum(n)::bigint as total_rows, count(*) as distinct_rows, sum(n - 1)::bigint as duplicate_rows
       from (select count(*) as n from (select * from embeddings union all select * from embeddings) e group by e)""",
)
def q5_vectors(t: Tables) -> DataFrame:
    return quality.duplicate_rows(t.embeddings.unionByName(t.embeddings))


@query(
    "q5_duplicate_documents",
    """select sum(n)::bigint as total_rows, count(*) as distinct_rows, sum(n - 1)::bigint as duplicate_rows
       from (select count(*) as n from documents group by text)""",
)
def q5_documents(t: Tables) -> DataFrame:
    return quality.duplicate_rows(t.documents.select("text"))


DUPLICATE_LINES = f"""
  select '(all columns)' as "column", 'duplicates' as issue_type, 'warning' as severity,
    printf('%d duplicate rows detected.', d) as description, d as affected_rows
  from (select sum(n - 1)::bigint as d from (select count(*) as n from {MESSY_LINEITEM} group by {", ".join(LINE_COLUMNS)}))
  where d > 0"""
ALL_ISSUES = " union all ".join(f"select * from ({s})" for s in (MISSING, OUTLIERS, NEGATIVE, DUPLICATE_LINES))


@query("q6_quality_issues", ALL_ISSUES)
def q6_issues(t: Tables) -> DataFrame:
    return quality.quality_issues(messy_lineitem(t.lineitem), MEASURES)


@query(
    "q6_quality_report",
    f"""select (select count(*) from lineitem) as total_rows, 11::bigint as total_columns, count(*) as issue_count,
          count(*) filter (severity = 'error') as error_count,
          count(*) filter (severity = 'warning') as warning_count,
          count(*) filter (severity = 'error') = 0 as passed from ({ALL_ISSUES})""",
)
def q6_report(t: Tables) -> DataFrame:
    rows = messy_lineitem(t.lineitem)
    return quality.quality_report(rows, quality.quality_issues(rows, MEASURES))


def _role_sql(table: str, columns: dict[str, str]) -> str:
    """Columns by kind: date, number, key number, text or key text."""
    rows = []
    for i, (c, kind) in enumerate(columns.items()):
        key = f"when count(distinct {c}) > count(*) * 0.8 then 'identifier'" if "key" in kind else ""
        if kind == "date":
            role = "'date'"
        elif "number" in kind:
            role = f"case {key} else 'measure' end" if key else "'measure'"
        else:
            role = f"""case {key} when avg(regexp_matches(regexp_replace({c}, '[$€£¥₹,. %]', '', 'g'), '^\\d+$')::int) > 0.8
                then 'measure' when count(distinct {c}) < least(50, count(*) * 0.5) then 'dimension' else 'other' end"""
        symbols = "null::varchar"
        if "text" in kind:
            symbols = "case " + " ".join(
                f"when avg(contains({c}, '{s}')::int) > 0.3 then '{s}'" for s in fixed.CURRENCY_SYMBOLS
            ) + " end"
        if role in ("'date'", "'measure'"):
            rows.append(f"""select {i} as position, '{c}' as "column", {role} as role, null::varchar as currency_symbol
                from (select count(*) as n from {table})""")
            continue
        rows.append(
            f"""select {i} as position, '{c}' as "column", {role} as role, {symbols} as currency_symbol from {table}"""
        )
    return " union all ".join(rows)


@query(
    "d1_column_roles",
    _role_sql(
        "customer",
        {
            "c_custkey": "key number",
            "c_name": "text",
            "c_nationkey": "key number",
            "c_acctbal": "number",
            "c_mktsegment": "text",
        },
    ),
)
def d1(t: Tables) -> DataFrame:
    return dictionary.propose_dictionary(t.customer)


@query(
    "d1_confirmed_roles",
    "select position, \"column\", case when \"column\" = 'c_nationkey' then 'dimension' else role end as role, "
    "case when \"column\" = 'c_nationkey' then '$' else currency_symbol end as currency_symbol, "
    "\"column\" = 'c_nationkey' as is_confirmed from ("
    + _role_sql(
        "customer",
        {
            "c_custkey": "key number",
            "c_name": "text",
            "c_nationkey": "key number",
            "c_acctbal": "number",
            "c_mktsegment": "text",
        },
    )
    + ")",
)
def d1_confirmed(t: Tables) -> DataFrame:
    proposed = dictionary.propose_dictionary(t.customer)
    confirmed = proposed.where("column = 'c_nationkey'").select(
        "column", F.lit("dimension").alias("role"), F.lit("$").alias("currency_symbol")
    )
    return dictionary.with_overrides(proposed, confirmed)


@query(
    "d1_column_roles_events",
    _role_sql(
        "events",
        {
            "event_id": "key number",
            "ts": "date",
            "user_id": "key number",
            "event_type": "text",
            "value": "number",
            "props": "text",
        },
    ),
)
def d1_events(t: Tables) -> DataFrame:
    return dictionary.propose_dictionary(t.events)


@query(
    "d2_currency",
    _role_sql(
        AMOUNTS,
        {
            "row_id": "key number",
            "us": "text",
            "eu": "text",
            "plain": "text",
            "mixed": "text",
            "iso_day": "date",
            "us_day": "date",
            "priority": "text",
        },
    ),
)
def d2(t: Tables) -> DataFrame:
    return dictionary.propose_dictionary(amounts(t.orders))
