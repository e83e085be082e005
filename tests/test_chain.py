"""Evidence that can be run again, request tables, versions, and the faults that were found in single operators."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import analysis, chain, clean, dictionary, evidence, joins, profile, requests, sufficiency
from plumbline.plans.selection import cumulative_counts
from plumbline.plans.spec import AnalysisSpec, TimeWindow
from plumbline.sources import versions


def sales(spark):
    rows = [(f"2024-0{1 + i % 3}-{1 + i % 27:02d}", ["n", "s", None][i % 3], ["a", "b"][i % 2], float(i), i % 5 or None) for i in range(60)]
    return spark.createDataFrame(rows, "day string, region string, kind string, unit_price double, price int").withColumn("day", F.to_date("day"))


JAN, FEB, MAR = (TimeWindow(f"2024-0{m}-01", f"2024-0{m}-29") for m in (1, 2, 3))
METRICS = {"average": 'SUM("unit_price") / NULLIF(COUNT(*), 0)', "rows": "COUNT(*)"}
SPECS = [
    AnalysisSpec("a", "compare_periods", "unit_price", "day", FEB, JAN),
    AnalysisSpec("b", "contribution", "unit_price", "day", MAR, JAN, ("region", "kind"), {"kind": ["a", "b"]}),
    AnalysisSpec("c", "generic", "rows", None, filters={"kind": "a"}),
    AnalysisSpec("d", "contribution", "average", "day", MAR, FEB, ("region", "kind")),
    AnalysisSpec("e", "anomaly_detection", "unit_price", "day"),
    AnalysisSpec("f", "generic", "average", "day", JAN),
    AnalysisSpec("g", "compare_periods", "average", "day", FEB, JAN, ("region", "kind")),
    AnalysisSpec("again", "generic", "average", "day", JAN),
    AnalysisSpec("h", "generic", "unit_price", "day", TimeWindow("2030-01-01", "2030-01-02")),
]


def test_request_table_equals_single_runs(spark):
    df = sales(spark)
    got = {}
    for r in requests.run_requests(df, SPECS, METRICS).collect():
        got[r["spec_id"], r["dimension"], r["item"], r["field"]] = (r["value"], r["rows_used"])
    want = {}
    for s in SPECS:
        if s.spec_id == "again":
            continue
        for d in s.dimensions if s.analysis_type == "contribution" else (None,):
            one = AnalysisSpec(s.spec_id, s.analysis_type, s.metric, s.date_col, s.current, s.baseline, (d,) if d else s.dimensions, s.filters)
            for r in evidence.run_specs(df, [one], METRICS, spread=True).collect():
                want[s.spec_id, d, r["item"], r["field"]] = (r["value"], r["rows_used"])
    assert got.keys() == want.keys()
    for key, (value, rows) in want.items():
        assert got[key][1] == rows, key
        assert (value is None and got[key][0] is None) or math.isclose(got[key][0], value, rel_tol=1e-12), key


def test_scans_do_not_grow_with_the_requests(spark, tmp_path):
    sales(spark).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    specs = [AnalysisSpec(str(i), "compare_periods", "unit_price", "day", TimeWindow("2024-01-01", f"2024-01-{i:02d}"), JAN) for i in range(1, 29)]
    plans = [requests.run_requests(df, some)._jdf.queryExecution().optimizedPlan().toString() for some in (specs[:1], specs)]
    assert plans[0].count("Relation [") == plans[1].count("Relation [")


def test_chain_proves_what_it_stored(spark):
    df = sales(spark)
    outputs = chain.outputs_of(df, SPECS, METRICS)
    table = chain.request_table(df, SPECS, METRICS, "sales", "v3")
    records = chain.evidence_records(table, outputs, chain.coverage(df, SPECS, METRICS))
    assert records.count() == len(SPECS) - 1
    fresh = chain.run_again(df, records, METRICS)
    proven = {r["evidence_id"]: r for r in chain.proofs(outputs, fresh).collect()}
    assert all(r["proven"] and not r["mismatched"] for r in proven.values())
    off = outputs.withColumn("value", F.when(F.col("spec_id") == "c", F.col("value") + 1).otherwise(F.col("value")))
    assert [r["mismatched"] for r in chain.proofs(off, fresh).where("NOT proven").collect()] == [1]
    findings = chain.findings_of(records)
    assert findings.count() == len(SPECS) - 2
    claims = {r["spec_id"]: r["claim"] for r in findings.join(records.select("evidence_id", "spec_id"), "evidence_id").collect()}
    assert claims["c"] == "rows is 30.00." and claims["e"].endswith("anomalies detected in unit_price.")
    one = findings.join(records.where("spec_id = 'c'").select("evidence_id"), "evidence_id").first()["finding_id"]
    assert {r["kind"] for r in chain.rows_behind(df, findings, records, one, ["day", "unit_price"]).collect()} == {"a"}
    assert chain.rows_behind(df, findings, records, "none", ["day"]).count() == 0
    record = records.where("spec_id = 'b'").first()
    assert record["filters"] == '{"kind": ["a", "b"]}' and record["engine_version"] == "1.0"
    assert record["query"].startswith('SELECT "region", "kind", SUM("unit_price") AS value FROM sales WHERE "kind" IN')
    assert evidence.request_of(record["request"], "b") == SPECS[1].__class__(**{**SPECS[1].__dict__, "filters": {"kind": ["a", "b"]}})


def test_used_columns_are_those_of_the_expression(spark):
    df = sales(spark)
    assert chain.used_columns(df, "average", METRICS) == ["unit_price"]
    issues = spark.createDataFrame([("price", "error")], "column string, severity string")
    outputs = chain.outputs_of(df, SPECS[:1], METRICS)
    records = chain.evidence_records(
        chain.request_table(df, SPECS[:1], METRICS, "sales", "v3"), outputs, chain.coverage(df, SPECS[:1], METRICS)
    )
    checked = chain.validated(chain.findings_of(records), records, outputs, issues).first()
    assert checked["evidence_status"] == "supported"
    literal = chain.validated(chain.findings_of(records), records.drop("columns"), outputs, issues).first()
    assert literal["evidence_status"] == "insufficient_evidence"


def test_text_values_and_missing_ones_are_compared(spark):
    schema = "k int, value string"
    stored = spark.createDataFrame([(1, "north"), (2, "10.0"), (3, None), (4, "x"), (5, "1")], schema)
    fresh = spark.createDataFrame([(1, "north"), (2, "10.005"), (3, None), (4, "y"), (6, "1")], schema)
    got = {r["k"]: r["matched"] for r in evidence.recompute(stored, fresh, ["k"]).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}


def test_changed_rows_of_versions(spark):
    schema = "a int, b string, v double"
    old = [(i, f"k{i % 7}", float(i)) for i in range(300)] + [(1, "twice", 1.0), (1, "twice", 2.0), (None, None, 1.0)]
    new = [r for r in old if r[0] != 17]
    new = [(r[0], r[1], -1.0) if r[0] == 40 else r for r in new]
    new += [(1, "twice", 2.0), (900, "new", 0.0)]
    dfs = [spark.createDataFrame(rows, schema).repartition(n) for rows, n in ((old, 3), (new, 5))]
    got = versions.changed_rows(*dfs, ["a", "b"], fan_out=4, levels=3).collect()
    assert sorted(map(tuple, got)) == [
        (1, "twice", "changed", 2, 3), (17, "k3", "removed", 1, 0), (40, "k5", "changed", 1, 1), (900, "new", "added", 0, 1),
    ]
    assert versions.changed_rows(dfs[0], dfs[0].repartition(2), ["a", "b"]).count() == 0
    assert versions.changed_rows(dfs[0], dfs[0].limit(0), ["a", "b"]).where("change <> 'removed'").count() == 0


def test_nested_columns_are_counted(spark):
    rows = [([1, 2], (1, "x"), {"k": 1}, 0.0), ([1, 2], (1, "x"), {"k": 1}, -0.0), ([2], None, {"k": 2}, None), (None, (2, None), None, float("nan"))]
    df = spark.createDataFrame(rows, "l array<int>, s struct<a: int, b: string>, m map<string, int>, d double")
    want = {"l": (4, 1, 2), "s": (4, 1, 2), "m": (4, 1, 2), "d": (4, 1, 2)}
    for exact in (True, False):
        got = profile.column_profile(df, exact).collect()
        assert {r["column"]: (r["total_rows"], r["missing_count"], r["unique_count"]) for r in got} == want
    assert {r["column"]: r["role"] for r in dictionary.propose_dictionary(df).collect()} == {"l": "other", "s": "other", "m": "other", "d": "measure"}
    assert [r["unique_count"] for r in profile.column_profile(df.limit(0)).collect()] == [0] * 4


def test_samples_take_one_scan(spark):
    rows = [(i % 9, f"t{i % 4}" if i % 3 else None, float("nan") if i % 2 else float(-i)) for i in range(100)]
    df = spark.createDataFrame(rows, "a int, b string, c double").repartition(7)
    got = {}
    for r in profile.sample_values(df, ["a", "b", "c"], 3).collect():
        got.setdefault(r["column"], []).append(r["value"])
    assert got == {"a": ["0", "1", "2"], "b": ["t0", "t1", "t2"], "c": ["-98.0", "-96.0", "-94.0"]}
    assert profile.sample_values(df.limit(0), ["a"]).count() == 0
    assert profile.table_sample(df, 10).exceptAll(df).count() == 0 and profile.table_sample(df, 10).count() == 10


@pytest.mark.parametrize(
    "texts, date_format, ambiguous",
    [
        (["13/02/2024", "25/12/2023", "28/01/2024"], "d/M/yyyy", False),
        (["02/13/2024", "1/2/2024", None], "M/d/yyyy", True),
        (["13.02.2024", "1.2.2024"], "d.M.yyyy", False),
        (["20240213", "20231231"], "yyyyMMdd", False),
        (["12345678", "99999999"], None, False),
        (["2024-02-13T10:00:00Z", "2024-02-13T10:00:00.5+01:00"], "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S][XXX]", False),
    ],
)
def test_date_orders_are_inferred(spark, texts, date_format, ambiguous):
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    got = clean.date_formats(df).first()
    assert (got["date_format"], got["ambiguous"]) == (date_format, ambiguous)
    if date_format:
        assert df.where(clean.parsed_date("d", date_format).isNull() & F.col("d").isNotNull()).count() == 0


def test_unsafe_joins_say_why(spark):
    left = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 30.0)], "k int, v double")
    right = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    got = joins.join_safety(left, right, "k", "k", ["v"]).first()
    assert not got["safe"] and got["invariant_failures"] == "SUM(v) changed by 50.0% after join"


def test_requests_share_one_dictionary(spark):
    df = sales(spark)
    needs = {"x": sufficiency.Requirements(("measure",), ("price",)), "y": sufficiency.Requirements(("identifier",), min_rows=100)}
    checks = sufficiency.request_checks(df, dictionary.propose_dictionary(df), needs)
    got = {r["request"]: r["verdict"] for r in sufficiency.sufficiency(checks, ["request"]).collect()}
    assert got == {"x": "sufficient", "y": "insufficient"}


def test_insight_levels_open_the_top_segments(spark):
    df = sales(spark)
    got = analysis.insight_levels(df, "unit_price", "day", MAR, JAN, ["region", "kind"], top=2, depth=3).collect()
    assert {r["depth"] for r in got} == {1, 2}
    whole = df.where("day <= '2024-01-29' AND region IS NULL").agg(F.sum("unit_price")).first()[0] or 0.0
    assert all(r["delta"] == r["current"] - r["baseline"] for r in got)
    assert [r["baseline"] for r in got if r["depth"] == 1 and r["dimension"] == "region" and r["segment"] is None] in ([whole], [])


def test_ranks_take_as_many_buckets_as_rows_need(spark, monkeypatch):
    from plumbline.plans import selection

    monkeypatch.setattr(selection, "BUCKETS", 2)
    monkeypatch.setattr(selection, "BUCKET_ROWS", 10)
    df = spark.range(500).select((F.col("id") % 3).alias("f"), (F.col("id") * 7 % 250).alias("v"))
    got = cumulative_counts(df, ["f"], "v")
    want = {}
    for f in range(3):
        values = sorted(i * 7 % 250 for i in range(500) if i % 3 == f)
        for v in set(values):
            want[f, v] = (sum(x < v for x in values), sum(x <= v for x in values), len(values))
    assert {(r["f"], r["v"]): (r["rows_before"], r["rows_through"], r["family_rows"]) for r in got.collect()} == want
