"""Inputs derived from the tables, in Spark and as SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.plans.spec import TimeWindow

Y1996 = TimeWindow("1996-01-01", "1996-12-31", "1996")
Y1997 = TimeWindow("1997-01-01", "1997-12-31", "1997")

# Money is summed as decimals so that results do not depend on the order of rows.
REVENUE = 'SUM(CAST("l_extendedprice" * (1 - "l_discount") AS DECIMAL(18,4)))'
LINE_METRICS = {
    "revenue": REVENUE,
    "units": 'SUM("l_quantity")',
    "orders": 'COUNT(DISTINCT "l_orderkey")',
    "aov": f'CAST({REVENUE} AS DOUBLE) / NULLIF(COUNT(DISTINCT "l_orderkey"), 0)',
}
ORDER_METRICS = {"total": 'SUM(CAST("o_totalprice" AS DECIMAL(18,2)))'}
EVENT_METRICS = {"value": 'SUM(CAST("value" AS DECIMAL(18,2)))'}

REVENUE_SQL = "sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4)))::double"


def messy_lineitem(lineitem: DataFrame) -> DataFrame:
    """Missing quantities, mostly missing taxes, some inflated and some negative prices."""
    price, number = F.col("l_extendedprice"), F.col("l_linenumber")
    inflated = (F.col("l_quantity") == 50) & (F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.08)
    return lineitem.withColumns(
        {
            "l_quantity": F.when(number != 3, F.col("l_quantity")),
            "l_tax": F.when(F.col("l_tax") < 0.06, F.col("l_tax")),
            "l_extendedprice": F.when(inflated, price * 50)
            .when((number == 7) & (F.col("l_returnflag") == "R"), -price)
            .otherwise(price),
        }
    )


MESSY_LINEITEM = """(
  select l_orderkey, l_partkey, l_suppkey, l_linenumber,
    case when l_linenumber <> 3 then l_quantity end as l_quantity,
    case when l_quantity = 50 and l_discount = 0.1 and l_tax = 0.08 then l_extendedprice * 50
         when l_linenumber = 7 and l_returnflag = 'R' then -l_extendedprice
         else l_extendedprice end as l_extendedprice,
    l_discount, case when l_tax < 0.06 then l_tax end as l_tax,
    l_returnflag, l_linestatus, l_shipdate
  from lineitem)"""


def amounts(orders: DataFrame) -> DataFrame:
    """Order totals written as text the ways people write them."""
    price = F.col("o_totalprice")
    us = F.format_number(price, 2)
    eu = F.translate(us, ",.", ".,")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return orders.select(
        F.col("o_orderkey").alias("row_id"),
        F.concat(F.lit("$"), us).alias("us"),
        F.concat(eu, F.lit(" €")).alias("eu"),
        F.floor(price).cast("string").alias("plain"),
        F.concat(F.when(urgent, "£").otherwise("$"), us).alias("mixed"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso_day"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("us_day"),
        F.col("o_orderpriority").alias("priority"),
    )


AMOUNTS = """(
  select o_orderkey as row_id,
    '$' || format('{:,.2f}', o_totalprice) as us,
    translate(format('{:,.2f}', o_totalprice), ',.', '.,') || ' €' as eu,
    cast(cast(floor(o_totalprice) as bigint) as varchar) as plain,
    case when o_orderpriority = '1-URGENT' then '£' else '$' end || format('{:,.2f}', o_totalprice) as mixed,
    strftime(o_orderdate, '%Y-%m-%d') as iso_day,
    strftime(o_orderdate, '%m/%d/%Y') as us_day,
    o_orderpriority as priority
  from orders)"""


def with_totals(customer: DataFrame) -> DataFrame:
    """Account balances per market segment and nation with subtotal and total rows mixed in."""
    balance = F.sum(F.col("c_acctbal").cast("decimal(18,2)"))
    return customer.rollup("c_mktsegment", "c_nationkey").agg(
        balance.alias("amount"),
        F.grouping("c_mktsegment").alias("all_segments"),
        F.grouping("c_nationkey").alias("all_nations"),
    ).select(
        F.when(F.col("all_segments") == 1, "Grand Total").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("all_nations") == 1, " subtotal ").otherwise(F.col("c_nationkey").cast("string")).alias(
            "nation"
        ),
        F.col("amount").cast("string").alias("amount"),
    )


WITH_TOTALS = """(
  select case when grouping(c_mktsegment) = 1 then 'Grand Total' else c_mktsegment end as segment,
    case when grouping(c_nationkey) = 1 then ' subtotal ' else cast(c_nationkey as varchar) end as nation,
    cast(sum(cast(c_acctbal as decimal(18,2))) as varchar) as amount
  from customer group by rollup (c_mktsegment, c_nationkey))"""


def with_blanks(customer: DataFrame) -> DataFrame:
    """Customers as text, every cell blank where the balance is negative."""
    owes = F.col("c_acctbal") < 0
    return customer.select(
        F.when(owes, " ").otherwise(F.col("c_name")).alias(" name "),
        F.when(owes, "").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(~owes, F.col("c_nationkey").cast("string")).alias("nation"),
        F.lit(None).cast("string").alias("notes"),
    )


WITH_BLANKS = """(
  select case when c_acctbal < 0 then ' ' else c_name end as name,
    case when c_acctbal < 0 then '' else c_mktsegment end as segment,
    case when not c_acctbal < 0 then cast(c_nationkey as varchar) end as nation
  from customer)"""


def wide_years(lineitem: DataFrame) -> DataFrame:
    """Units per supplier with one column per year."""
    year = F.year("l_shipdate")
    return lineitem.groupBy("l_suppkey").agg(
        *[F.sum(F.when(year == y, F.col("l_quantity"))).alias(str(y)) for y in range(1995, 2002)]
    )


P_VALUES = """(
  select p_type as family, p_partkey as hypothesis_id, ((p_partkey * 7919) % 1000 + 1) / 40000.0::double as p
  from part)"""


def p_values(part: DataFrame) -> DataFrame:
    """One hypothesis per part, in the family of its type; many share a p-value."""
    return part.select(
        F.col("p_type").alias("family"),
        F.col("p_partkey").alias("hypothesis_id"),
        ((F.col("p_partkey") * 7919 % 1000 + 1) / F.lit(40000.0)).alias("p"),
    )


# One phrase per order, the last one not causal.
PHRASES = [
    "caused", "because", "due to", "led to", "driven by", "resulted in", "responsible for",
    "proved that", "confirms that", "shows that", "demonstrates that", "therefore", "consequently",
    "explains why", "alongside",
]


def claims(orders: DataFrame) -> DataFrame:
    """One claim per order, its evidence one record per customer."""
    words = F.array(*[F.lit(p) for p in PHRASES])
    pick = F.element_at(words, (F.col("o_orderkey") % len(PHRASES) + 1).cast("int"))
    shown = F.when(F.col("o_orderstatus") == "P", F.concat(F.upper(F.substring(pick, 1, 1)), F.substring(pick, 2, 40))).otherwise(pick)
    kind = (
        F.when(F.col("o_orderpriority") == "5-LOW", "suggestion")
        .when(F.col("o_orderpriority") == "2-HIGH", "comparative")
        .otherwise("factual")
    )
    return orders.select(
        F.col("o_orderkey").alias("finding_id"),
        F.col("o_custkey").alias("evidence_id"),
        F.concat(
            F.lit("Spending of customer "), F.col("o_custkey").cast("string"), F.lit(" rose "), shown,
            F.lit(" an unledto sale of "), F.format_string("%.2f", "o_totalprice"), F.lit("."),
        ).alias("claim"),
        kind.alias("claim_type"),
        F.when(F.col("o_orderstatus") == "F", "strong").otherwise("moderate").alias("strength"),
    )


_PHRASE_LIST = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
CLAIMS = f"""(
  select o_orderkey as finding_id, o_custkey as evidence_id,
    'Spending of customer ' || o_custkey || ' rose ' ||
      case when o_orderstatus = 'P' then upper(substr(phrase, 1, 1)) || substr(phrase, 2) else phrase end ||
      ' an unledto sale of ' || printf('%.2f', o_totalprice) || '.' as claim,
    case o_orderpriority when '5-LOW' then 'suggestion' when '2-HIGH' then 'comparative' else 'factual' end
      as claim_type,
    case when o_orderstatus = 'F' then 'strong' else 'moderate' end as strength
  from (select *, ({_PHRASE_LIST})[o_orderkey % {len(PHRASES)} + 1] as phrase from orders))"""


def customer_evidence(orders: DataFrame) -> DataFrame:
    """Evidence per customer: what they spent, with the assumptions it rests on."""
    return orders.groupBy(F.col("o_custkey").alias("evidence_id")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"),
        F.count(F.lit(1)).alias("rows_used"),
        F.collect_set("o_orderpriority").alias("assumption_ids"),
        F.max("o_orderkey").alias("last_order"),
    ).select(
        "evidence_id",
        F.when(F.col("last_order") % 2 == 0, "o_totalprice").otherwise("spending").alias("metric"),
        "value",
        "rows_used",
        F.when(F.col("last_order") % 3 == 0, 'SELECT SUM("o_totalprice")').otherwise("SELECT COUNT(*)").alias(
            "query"
        ),
        F.lit("spending of a customer").alias("calculation"),
        "assumption_ids",
    )


CUSTOMER_EVIDENCE = """(
  select o_custkey as evidence_id,
    case when max(o_orderkey) % 2 = 0 then 'o_totalprice' else 'spending' end as metric,
    sum(cast(o_totalprice as decimal(18,2)))::double as value, count(*) as rows_used,
    case when max(o_orderkey) % 3 = 0 then 'SELECT SUM("o_totalprice")' else 'SELECT COUNT(*)' end as query,
    'spending of a customer' as calculation,
    list(distinct o_orderpriority) as assumption_ids
  from orders group by o_custkey)"""

# Questions people ask, one template per customer.
TEMPLATES = [
    "What is the total balance of %?",
    "Why did revenue of % decline last quarter?",
    "Compare revenue of % with last year",
    "Write a full report on % for 2024",
    "Show me orders of % by region vs Q3 2023",
    "How many orders did % place this month?",
    "Growth of % year to date",
    "Tell me everything about the orders that % has placed with us in every single year since the account was opened please",
    "List accounts like % that opened on the same day",
    "% l_quantity by l_returnflag",
]


def questions(customer: DataFrame) -> DataFrame:
    words = F.array(*[F.lit(t) for t in TEMPLATES])
    pick = F.element_at(words, (F.col("c_custkey") % len(TEMPLATES) + 1).cast("int"))
    return customer.select(
        F.col("c_custkey").alias("question_id"), F.replace(pick, F.lit("%"), F.col("c_name")).alias("question")
    )


_TEMPLATE_LIST = "[" + ", ".join(f"'{t}'" for t in TEMPLATES) + "]"
QUESTIONS = f"""(
  select c_custkey as question_id,
    replace(({_TEMPLATE_LIST})[c_custkey % {len(TEMPLATES)} + 1], '%', c_name) as question
  from customer)"""
