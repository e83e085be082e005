"""Small hand-made tables for the rules that are easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as texts
from plumbline.functions.timewindows import relative_window
from plumbline.operators import (
    analysis, charts, clean, dictionary, evidence, grounding, joins, quality, semantic, stats, sufficiency,
)
from plumbline.plans.predicates import quoted_columns, spark_expression
from plumbline.plans.scalars import one_row
from plumbline.plans.spec import AnalysisSpec, TimeWindow

JAN, FEB = TimeWindow("2024-01-01", "2024-01-31", "Jan"), TimeWindow("2024-02-01", "2024-02-29", "Feb")


@pytest.fixture(scope="module")
def sales(spark):
    rows = [
        ("2024-01-05", "a", 100.0, 10.0), ("2024-01-31", "b", 50.0, 10.0), ("2024-01-09", None, 5.0, 1.0),
        ("2024-02-01", "a", 150.0, 10.0), ("2024-02-29", "c", 30.0, 5.0), ("2024-03-01", "a", 999.0, 9.0),
    ]
    df = spark.createDataFrame(rows, "day string, seg string, revenue double, units double")
    return df.withColumn("day", F.col("day").cast("timestamp_ntz"))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_expression_quoting():
    assert spark_expression("""SUM("a") / 'x "y"' """) == """SUM(`a`) / 'x "y"' """
    assert quoted_columns('SUM("revenue") - SUM("cogs")') == ["revenue", "cogs"]


def test_windows_are_closed_and_filters_typed(sales):
    got = one(analysis.generic_metric(sales, "revenue", None, "day", JAN, {"seg": ["a", "b"], "units": "10"}))
    assert (got["value"], got["rows_used"]) == (150.0, 2)


def test_compare(sales):
    got = one(analysis.compare_periods(sales, "revenue", "day", FEB, JAN))
    assert (got["current"], got["baseline"], got["change"], got["rows_used"]) == (180.0, 155.0, 25.0, 5)
    assert got["change_pct"] == pytest.approx(25 / 155 * 100)


def test_compare_with_an_empty_side(sales):
    empty = TimeWindow("2030-01-01", "2030-01-31")
    got = one(analysis.compare_periods(sales, "revenue", "day", empty, JAN))
    assert (got["current"], got["change"], got["change_pct"]) == (None, None, None)
    assert got["current_period"] == "2030-01-01 to 2030-01-31"


def test_contribution_keeps_null_segment_and_sums_up(sales):
    rows = {r["segment"]: r for r in analysis.contribution(sales, "revenue", "day", FEB, JAN, "seg").collect()}
    assert set(rows) == {"a", "b", "c", None}
    assert rows["c"]["baseline"] == 0.0 and rows[None]["delta"] == -5.0
    assert sum(r["contribution_pct"] for r in rows.values()) == pytest.approx(100)
    assert sum(r["baseline_share_pct"] for r in rows.values()) == pytest.approx(100)


def test_contribution_without_any_change(sales):
    rows = analysis.contribution(sales, "revenue", "day", JAN, JAN, "seg").collect()
    assert len(rows) == 3 and all(r["contribution_pct"] == 0 for r in rows)


def test_volume_price_adds_up(sales):
    for split in (
        analysis.volume_price(sales, "day", FEB, JAN),
        analysis.volume_price_by_segment(sales, "day", FEB, JAN, "seg"),
    ):
        r = one(split)
        assert r["volume_effect"] + r["price_effect"] + r["mix_effect"] == pytest.approx(r["total_delta"])


def test_anomalies_on_a_single_day(spark, sales):
    daily = analysis.daily_values(sales.limit(1), "revenue", "day")
    assert analysis.anomalies(daily).count() == 0


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.001, 0.01, 0.02, 0.9])], "f string, h int, p double")
    step_up = stats.benjamini_hochberg(df, "p", ["f"], "h").orderBy("h").collect()
    assert [r["rejected"] for r in step_up] == [True, True, True, False]
    trailing = stats.benjamini_hochberg(df, "p", ["f"], "h", variant="trailing").orderBy("h").collect()
    assert [r["rejected"] for r in trailing] == [False] * 4


def trailing_by_hand(ps, alpha):
    order = sorted(range(len(ps)), key=lambda i: (ps[i], i))
    rejected, ok = [False] * len(ps), True
    for rank in range(len(ps), 0, -1):
        ok = ok and ps[order[rank - 1]] <= rank / len(ps) * alpha
        rejected[order[rank - 1]] = ok
    return rejected


@pytest.mark.parametrize("seed", range(3))
def test_trailing_variant_with_ties(spark, seed):
    import random

    rng = random.Random(seed)
    ps = [rng.choice([0.01, 0.02, 0.03, 0.04, 0.045]) for _ in range(60)]
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate(ps)], "f string, h int, p double")
    got = stats.benjamini_hochberg(df, "p", ["f"], "h", alpha=0.05, variant="trailing").orderBy("h").collect()
    assert [r["rejected"] for r in got] == trailing_by_hand(ps, 0.05)


def test_trend_classes(spark):
    series = {
        "up": [1.0, 2.0, 3.0], "down": [3.0, 2.0, 1.0], "flat": [2.0, 2.0], "gap": [1.0, None, 9.0], "short": [4.0],
    }
    df = spark.createDataFrame([(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)], "k string, i int, v double")
    got = {r["k"]: r["trend"] for r in stats.trend_class(df, ["k"], "i", "v").collect()}
    assert got == {"up": "increasing", "down": "decreasing", "flat": "flat", "gap": "unknown", "short": "flat"}


def test_simpson(spark):
    # Each segment falls while the total rises, because the second one only joins late.
    rows = [(f"2024-0{m}-01", s, v) for s, vs in {
        "a": [10, 9, 8, 7], "b": [9, 8, 7, 6], "c": [0, 30, 60, 90]}.items() for m, v in enumerate(vs, 1) if v]
    df = spark.createDataFrame(rows, "day string, seg string, v int").withColumn("day", F.col("day").cast("timestamp_ntz"))
    got = one(stats.simpsons_paradox(df, "v", "seg", "day"))
    assert got["detected"] and got["overall_trend"] == "increasing" and got["majority_trend"] == "decreasing"


def test_stability_needs_four_days(spark, sales):
    got = one(stats.stability(analysis.daily_values(sales.limit(3), "revenue", "day")))
    assert got["stable"] and got["first_half"] is None and got["note"] == "Insufficient periods"


def test_outliers_and_kth(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)] + [(100000.0,)], "v double")
    got = one(stats.outlier_sensitivity(df, "v"))
    assert got["sensitive"] and got["without_outliers"] == 5050.0
    assert stats.kth_largest_value(df, "v", 0) == 100000.0
    assert stats.kth_largest_value(df, "v", 100) == 1.0
    assert stats.kth_largest_value(df, "v", 101) is None


def test_spec_agreement(sales):
    a = AnalysisSpec("a", "scalar", "revenue", "day", JAN)
    b = AnalysisSpec("b", "scalar", "revenue", "day", TimeWindow("2030-01-01", "2030-01-02"))
    got = one(stats.spec_agreement(sales, a, b))
    assert (got["agrees"], got["result_b"], got["divergence_pct"]) == (False, None, None)


def test_join_fanout_is_not_safe(spark):
    left = spark.createDataFrame([(1, 10.0), (1, 5.0), (2, 1.0), (None, 7.0)], "k int, m double")
    right = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    got = one(joins.join_safety(left, right, "k", "k", ["m"]))
    assert not got["safe"] and got["match_rate"] == 0.5 and got["joined_rows"] == 4
    assert got["after_0"] == left.join(right, "k").agg(F.sum("m")).first()[0]


def test_join_measure_loss_is_reported(spark):
    left = spark.createDataFrame([(1, 10.0), (1, 5.0), (2, 1.0)], "k int, m double")
    right = spark.createDataFrame([(1,)], "k int")
    got = one(joins.join_safety(left, right, "k", "k", ["m"]))
    assert got["invariant_failures"] == "SUM(m) changed by 6.3% after join"
    assert got["coverage_caveat"].startswith("50.0% of left keys")


def test_sufficiency(spark, sales):
    roles = dictionary.propose_dictionary(sales)
    needs = sufficiency.Requirements(("measure", "date"), ("revenue",), ("seg",), "ytd", 30)
    got = one(sufficiency.sufficiency(sufficiency.requirement_checks(sales, roles, needs)))
    assert got["verdict"] == "partial" and got["caveats"] == "Row count 6 < minimum 30."


def test_metric_pack_falls_back_and_keeps_case():
    got = semantic.resolve_metrics(["Revenue", "order_id", "cogs"])
    assert got["revenue"] == 'SUM("Revenue")'
    assert got["gross_margin"] == '(SUM("Revenue") - SUM("cogs")) / NULLIF(SUM("Revenue"), 0)'
    assert "units" not in got and got["orders"] == 'COUNT(DISTINCT "order_id")'
    assert semantic.resolve_metrics(["x"]) == {"orders": "COUNT(*)"}


def test_anchor_and_relative_windows(spark):
    days = spark.createDataFrame([("2023-11-03",), ("2024-02-15",), (None,)], "d string")
    anchor = semantic.time_anchor(days, "d")
    a = one(anchor)
    assert a["last_complete_quarter_start"] == dt.date(2023, 10, 1) and a["data_spans_years"]
    assert semantic.time_anchor(days.where("d is null"), "d").count() == 0
    wanted = {
        " Last Month ": ("2024-01-01", "2024-01-31"), "this month": ("2024-02-01", "2024-02-15"),
        "last quarter": ("2023-10-01", "2023-12-31"), "previous year": ("2023-01-01", "2023-12-31"),
        "YTD": ("2024-01-01", "2024-02-15"), "Q1 2024": ("2024-01-01", "2024-03-31"),
        "last 7 days": ("2024-02-09", "2024-02-15"), "last 14 months": ("2022-12-01", "2024-02-15"),
        "2022": ("2022-01-01", "2022-12-31"), "last week": ("2024-02-05", "2024-02-11"),
    }
    df = spark.createDataFrame([(e,) for e in [*wanted, "whenever"]], "e string")
    got = {r["e"]: r["w"] for r in df.withColumn("w", relative_window(F.col("e"), one_row(anchor))).collect()}
    for e, (start, end) in wanted.items():
        assert (str(got[e]["start"]), str(got[e]["end"])) == (start, end), e
    assert got["whenever"]["start"] is None and got["whenever"]["end"] is None


def values(spark, column, data):
    return [r[0] for r in spark.createDataFrame([(x,) for x in data], "t string").select(column).collect()]


def test_causal_rewrite_is_word_bounded(spark):
    got = values(spark, texts.associational(F.col("t")), ["Due to rain, unledto sales LED TO loss.", "becauses", None])
    assert got == ["Coinciding with rain, unledto sales Corresponds with loss.", "becauses", None]
    assert values(spark, texts.causal_phrases(F.col("t")), ["It was BECAUSE of x; therefore y"]) == [["because", "therefore"]]


def test_numbers(spark):
    text = "Q3 2024 rose 12.5% to -1,234.5 million (abc12) and 3k, 7 bn, 12abc, 5 kilos"
    got = values(spark, F.transform(texts.number_tokens(F.col("t")), texts.number_value), [text])[0]
    assert got == pytest.approx([2024, 0.125, -1234.5e6, 3000, 7e9, 5])
    narrow = values(spark, texts.number_tokens(F.col("t"), "narrow"), ["12345 Q3 2024"])[0]
    assert narrow == ["123", "45", "202", "4"]


def test_grounding_against_brute_force(spark):
    import random

    rng = random.Random(5)
    known = [rng.lognormvariate(0, 3) * rng.choice([-1, 1]) for _ in range(300)] + [0.0, 100.0]
    asked = [k * rng.uniform(0.98, 1.02) for k in known] + [k * 1.01 for k in known] + [k * 0.99 for k in known] + [0.0, 99.0, 99.02, 101.0, 101.1, 5e300]
    numbers = spark.createDataFrame([(i, x, "") for i, x in enumerate(asked)], "id int, number double, token string")
    store = spark.createDataFrame([(k,) for k in known + [None, float("nan")]], "v double")
    got = {r["id"]: r["grounded"] for r in grounding.grounded_numbers(numbers, store, "v").collect()}
    for i, x in enumerate(asked):
        assert got[i] == any((k == 0 and x == 0) or (k != 0 and abs(x - k) / abs(k) <= 0.01) for k in known), x


def test_percent_is_tried_at_both_scales(spark):
    df = spark.createDataFrame([(1, "up 12.5%"), (2, "up 13%")], "id int, t string")
    store = spark.createDataFrame([(12.5,), (0.13,)], "v double")
    got = grounding.number_lint(df, "t", ["id"], store, "v").collect()
    assert all(r["passed"] and r["grounded"] == 1 for r in got)


def test_routing(spark):
    asked = {
        "Generate report why": "REPORT", "Why is it": "INVESTIGATION", "compare a and b": "ANALYSIS",
        "what is the total": "LOOKUP", "hello": "ANALYSIS", " ".join(["word"] * 21): "INVESTIGATION",
        "what is " + "x " * 11: "ANALYSIS",
    }
    assert values(spark, texts.request_tier(F.col("t")), list(asked)) == list(asked.values())


def test_us_eu_plain_and_percent(spark):
    df = spark.createDataFrame(
        [("$1,234.50", "1.234,50 €", "12345", "12%"), ("-2", "3,5", "7.5", "5%"), ("x", "x", "x", "x")],
        "us string, eu string, plain string, pct string",
    )
    got = df.select(*[clean.parsed_number(c, c if c != "pct" else "us").alias(c) for c in df.columns],
                    clean.parsed_number("pct", "us", True).alias("fraction")).collect()
    assert [tuple(r) for r in got] == [(1234.5, 1234.5, 12345.0, 12.0, 0.12), (-2.0, 3.5, 7.5, 5.0, 0.05), (None,) * 5]


def test_wide_headers():
    assert clean.period_headers(["brand", "2021", "2022", "2023"]) == ["2021", "2022", "2023"]
    assert clean.period_headers(["Jan", "feb 2024", "March"]) == ["Jan", "feb 2024", "March"]
    assert clean.period_headers(["margin", "market", "decile", "2021"]) == []


def test_clean_everything(spark):
    rows = [("2024-01-0%d" % i, "1,00%d" % i, "n") for i in range(1, 9)] + [("", " ", ""), ("Total", "9,999", ""), ("2024-01-01", "1,001", "n")]
    done = clean.clean(spark.createDataFrame(rows, " day string, amount string, note string"))
    assert dict(done.table.dtypes) == {"day": "timestamp_ntz", "amount": "double", "note": "string"}
    assert done.table.count() == 9
    log = {r["step_type"]: r for r in done.log.collect()}
    assert log["empty_rows_removed"]["rows_affected"] == 1 and log["total_rows_detected"]["requires_approval"]
    assert log["duplicate_rows_detected"]["rows_affected"] == 1
    assert clean.clean(spark.createDataFrame(rows, "day string, amount string, note string"), remove_totals=False).table.count() == 10


def test_roles(spark):
    df = spark.createDataFrame([(i, f"n{i}", "x" if i % 2 else "y", f"${i}.50", float(i)) for i in range(200)],
                               "order_id int, label string, kind string, cost_text string, paid double")
    got = {r["column"]: (r["role"], r["currency_symbol"]) for r in dictionary.propose_dictionary(df).collect()}
    assert got == {"order_id": ("identifier", None), "label": ("other", None), "kind": ("dimension", None),
                   "cost_text": ("measure", "$"), "paid": ("identifier", None)}
    whole = {r["column"]: r["role"] for r in dictionary.propose_dictionary(df, whole_words=True).collect()}
    assert whole["paid"] == "measure"


def test_sketch_never_hides_a_dimension(spark):
    for n in (1, 10, 49, 50):
        df = spark.range(5000).select(F.concat(F.lit("v"), (F.col("id") % n).cast("string")).alias("t"))
        assert df.agg(F.approx_count_distinct("t", dictionary.SKETCH_ERROR)).first()[0] <= 53
        assert dictionary.propose_dictionary(df).first()["role"] == ("dimension" if n < 50 else "other")


def test_quality_of_a_clean_table(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "a int, price double")
    issues = quality.quality_issues(df)
    assert issues.count() == 0
    assert one(quality.quality_report(df, issues))["passed"]


def test_recompute_and_status(spark):
    a = spark.createDataFrame([("x", None, 100.0), ("x", "s", 5.0), ("gone", None, 1.0)], "id string, item string, value double")
    b = spark.createDataFrame([("x", None, 100.05), ("x", "s", 6.0), ("new", None, 1.0)], "id string, item string, value double")
    got = {(r["id"], r["item"]): r["matched"] for r in evidence.recompute(a, b, ["id", "item"]).collect()}
    assert got == {("x", None): True, ("x", "s"): False, ("gone", None): False, ("new", None): False}


def test_specs_recompute_to_themselves(sales):
    specs = [
        AnalysisSpec("m", "scalar", "revenue", "day", JAN), AnalysisSpec("c", "compare_periods", "units", "day", FEB, JAN),
        AnalysisSpec("s", "contribution", "revenue", "day", FEB, JAN, ("seg",)),
        AnalysisSpec("v", "volume_price_decomp", "revenue", "day", FEB, JAN),
        AnalysisSpec("a", "anomaly_detection", "revenue", "day"),
    ]
    first, second = evidence.run_specs(sales, specs), evidence.run_specs(sales, specs)
    checked = evidence.recompute(first, second, ["evidence_id", "item", "field"])
    assert checked.count() == 1 + 4 + 4 * 5 + 10 + 1
    assert checked.where("not matched and original is not null").count() == 0


def test_top_and_other_keeps_the_total(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 31)] + [(None, 500.0)], "k int, v double")
    rows = charts.top_and_other(df, "k", "v").collect()
    assert len(rows) == 11 and sum(r["value"] for r in rows) == 965.0
    assert {r["category"] for r in rows} >= {None, "30", "Other"}


def test_histogram_counts_every_row(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    rows = charts.histogram(df, "v").orderBy("bin").collect()
    assert sum(r["count"] for r in rows) == 101 and rows[-1]["bin"] == 20 and rows[-1]["bin_end"] == 100.0
    flat = charts.histogram(df.select(F.lit(3.0).alias("v")), "v").collect()
    assert [(r["bin"], r["count"]) for r in flat] == [(1, 101)]


def test_metric_names_are_replaced_once():
    got = semantic.resolve_metrics(["A", "b"], {"m": ['SUM("a" * "B")'], "n": ['SUM("zz")', 'SUM("b")']})
    assert got == {"m": 'SUM("A" * "b")', "n": 'SUM("b")'}


def test_number_suffixes_are_not_numbers(spark):
    from plumbline.operators import clean

    rows = spark.createDataFrame([("12d",), ("12",), ("1e3",), ("3f",)], "x string")
    assert [r[0] for r in rows.select(clean.parsed_number("x", "plain")).collect()] == [None, 12.0, 1000.0, None]


def test_join_check_of_text_against_numbers(spark):
    from plumbline.operators import joins

    left = spark.createDataFrame([("1",), ("x",)], "k string")
    right = spark.createDataFrame([(1,), (2,)], "k bigint")
    pairs = joins.key_overlap(left, right, "k", "k")
    assert pairs.where("lk is not null and rk is not null").count() == 1


def test_doubled_quotes_stay_in_one_cell(spark, tmp_path):
    from plumbline.sources import delimited

    (tmp_path / "t.csv").write_text('a,b,c\n1,"say ""hi"", ok",z\n')
    row = delimited.read_text_table(spark, str(tmp_path / "t.csv")).first()
    assert tuple(row) == ("1", 'say "hi", ok', "z")


def test_only_undeclared_amounts_are_searched_for_mixed_currencies(spark):
    rows = [("a note of $5", "$5", "$7"), ("and €7 in prose", "€6", "€8")]
    df = spark.createDataFrame(rows, "note string, price string, paid string")
    found = lambda **k: sorted(r["column"] for r in quality.quality_issues(df, **k).where("severity = 'error'").collect())
    assert found() == ["paid", "price"]
    declared = [("note", "other", None), ("price", "measure", None), ("paid", "measure", "$")]
    known = spark.createDataFrame(declared, "column string, role string, currency_symbol string")
    assert found(dictionary=known) == ["price"]


def test_anomaly_and_split_evidence_is_complete(spark):
    days = [(dt.date(2024, 1, d), "s", 10.0, 1.0) for d in range(1, 31)] + [(dt.date(2024, 2, 1), "s", 900.0, 1.0)]
    df = spark.createDataFrame(days, "day date, seg string, revenue double, units double")
    january, february = TimeWindow("2024-01-01", "2024-01-31"), TimeWindow("2024-02-01", "2024-02-29")
    specs = [
        AnalysisSpec("none", "anomaly_detection", "revenue", "day", january),
        AnalysisSpec("one", "anomaly_detection", "revenue", "day"),
        AnalysisSpec("split", "volume_price_decomp", "revenue", "day", february, january),
    ]
    rows = evidence.run_specs(df, specs, spread=True).collect()
    got = {(r["spec_id"], r["item"], r["field"]): (r["value"], r["rows_used"]) for r in rows}
    assert got["none", None, "anomaly_count"] == (0.0, 30) and got["none", None, "mean"] == (10.0, 30)
    assert got["one", None, "anomaly_count"] == (1.0, 31) and got["one", "2024-02-01", "value"] == (900.0, 1)
    assert got["split", None, "total_delta"] == (600.0, 31)
