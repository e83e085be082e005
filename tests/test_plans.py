"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from plumbline.operators import analysis, grounding, joins
from plumbline.workload.inputs import LINE_METRICS, Y1996, Y1997
from plumbline.workload import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{FOLDER}/lineitem.parquet")


def test_window_reaches_the_scan(lineitem):
    text = plan(analysis.generic_metric(lineitem, "revenue", LINE_METRICS, "l_shipdate", Y1997))
    assert "GreaterThanOrEqual(l_shipdate" in text
    assert "ReadSchema: struct<l_extendedprice:double,l_discount:double,l_shipdate" in text


def test_comparison_is_one_scan(lineitem):
    text = plan(analysis.compare_periods(lineitem, "revenue", "l_shipdate", Y1997, Y1996, LINE_METRICS))
    assert text.count("FileScan") == 1 and "Generate" not in text


def test_join_check_never_joins_the_rows(lineitem):
    text = plan(joins.join_safety(lineitem, lineitem, "l_suppkey", "l_suppkey", ["l_quantity"]))
    join = text.index("Join")
    assert text.count("HashAggregate", join) >= 4


def test_grounding_has_no_pairwise_join(spark, lineitem):
    numbers = lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_tax").alias("number"), F.lit("").alias("token"))
    text = plan(grounding.grounded_numbers(numbers, lineitem, "l_extendedprice"))
    assert "NestedLoop" not in text and "Cartesian" not in text


def executed(df):
    """The plan as it ran, without the plans it started from."""
    df.collect()
    kept, hidden = [], None
    for line in plan(df).splitlines():
        depth = len(line) - len(line.lstrip(" :|+-"))
        if hidden is not None and (depth > hidden or (depth == hidden and "==" not in line)):
            continue
        hidden = depth if "== Initial Plan ==" in line else None
        if hidden is None:
            kept.append(line)
    return "\n".join(kept)


@pytest.mark.parametrize(
    "name",
    ["a3_contribution_parts", "a5_anomalies", "a7_insight_tree", "t2_simpson", "t4_stability", "t5_group_size",
     "g1_trend_rows", "g2_topn_other", "g4_composition_suppliers", "a4_price_by_segment", "q1_missing"],
)
def test_totals_need_no_second_scan(spark, name):
    assert executed(QUERIES[name](spark, FOLDER)).count("FileScan") == 1


@pytest.mark.parametrize("name", ["a7_insight_tree", "s2_delimiter_sniff"])
def test_top_rows_are_cut_before_the_shuffle(spark, name):
    assert plan(QUERIES[name](spark, FOLDER)).count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_joins_and_no_python_rows(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert not re.search("NestedLoop|CartesianProduct|BatchEvalPython", text)
