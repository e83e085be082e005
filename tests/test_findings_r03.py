"""What the findings of round 3 brought to light."""

import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.functions import text as texts
from plumbline.operators import clean, profile, quality
from plumbline.operators.analysis import change_pct
from plumbline.plans import selection
from plumbline.sources import ingest, records


def test_mentions_are_never_gathered_in_one_place(spark):
    asked = [(1, "Ask ANNA and anna, not Bo"), (2, "İ bob"), (3, None), (4, ""), (5, "an"), (5, "banana anna")]
    known = [("Anna", 1), ("ANNA", 2), ("bo", 3), ("an", 4), ("", 5), (None, 6), ("not bo", 7), ("a", 8), ("zzz", 9)]
    questions = spark.createDataFrame(asked, "id long, q string")
    names = spark.createDataFrame(known, "name string, n int")
    want = sorted((i, n) for i, q in asked for name, n in known if q and name and name.lower() in q.lower())
    for heads in (20_000, 1):
        found = texts.mentions(questions, names, "id", "q", "name", heads)
        assert sorted((r["id"], r["n"]) for r in found.collect()) == want
    # Spark must not choose to send the parts of all questions, whose number it cannot estimate, to the driver.
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [__name" in plan
    assert texts.mentions(questions, names.limit(0), "id", "q", "name").count() == 0


def test_claims_round_half_up_where_the_quotient_lost_its_last_bit(spark):
    rows = spark.createDataFrame([(1393.0, 2000.0), (1707.0, 2000.0), (2247.0, 2000.0), (2000.0, 2000.0)], "c double, b double")
    claim = texts.claim_for_change(F.lit("units"), F.col("c"), F.col("b"), change_pct(F.col("c"), F.col("b")), F.lit("1997"), F.lit("1996"))
    shown = [r[0].split("%")[0].split()[-1] for r in rows.select(claim).collect()]
    assert shown == ["30.4", "14.7", "12.4", "0.0"]


def test_duplicates_are_counted_by_value_and_the_log_only_when_asked_for(spark):
    nan = float("nan")
    rows = [(1, "a", 0.0), (1, "a", -0.0), (None, "a", 1.0), (1, None, 1.0), (1, None, 1.0), (2, "a", nan), (2, "a", nan), (3, "a", None)]
    df = spark.createDataFrame(rows, "k int, s string, x double")
    assert profile.duplicate_count(df) == df.count() - df.distinct().count() == 3
    assert profile.duplicate_count(df.limit(0)) == 0
    jobs = spark.sparkContext.statusTracker()
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    spark.sparkContext.setJobGroup("cleaning", "")
    cleaned = clean.clean(texts)
    before = len(jobs.getJobIdsForGroup("cleaning"))
    log = {r["step_type"]: r["rows_affected"] for r in cleaned.log.collect()}
    assert log["duplicate_rows_detected"] == 2 and len(jobs.getJobIdsForGroup("cleaning")) > before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_quality_computes_a_column_once_for_all_comparisons_and_shuffles_no_rows(spark, monkeypatch):
    plans, frame = [], type(spark.range(1))
    first = frame.first
    monkeypatch.setattr(frame, "first", lambda self: (plans.append(self._jdf.queryExecution().optimizedPlan().toString()), first(self))[1])
    x = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 2 == 0, F.col("id") * 3.5).otherwise(-F.col("id").cast("double"))
    df = spark.range(5000).select("id", x.alias("x"), F.col("id").cast("decimal(12,2)").alias("d"), F.col("id").cast("float").alias("f"))
    want = df.selectExpr(*[f"percentile({c}, {p})" for c in ("id", "x", "d", "f") for p in (0.25, 0.75)]).first()
    monkeypatch.setattr(selection, "SMALL_BRACKET", 100)
    found = selection.exact_quantiles(df, [(f"{c}{p}", c, p) for c in ("id", "x", "d", "f") for p in (0.25, 0.75)])
    assert list(found.values()) == [float(v) for v in want]
    assert "kll_sketch" in plans[1] and plans[1].count("percentile_approx") == 1
    # What is ordered in the end is picked above the projections: the expression of x is there once.
    picked = [p for p in plans if "part#" in p and "% 7" in p]
    assert picked and all(p.count("% 7") == 1 for p in picked)
    copies = df.unionByName(df.where("id % 5 = 0"))
    for hashes in (100_000, 1):
        monkeypatch.setattr(profile, "SHARED_HASHES", hashes)
        plans.clear()
        issue = quality.duplicate_issues(copies).first()
        assert (issue["affected_rows"], issue["description"]) == (1000, "1000 duplicate rows detected.")
        assert "Aggregate [__hash" in plans[0]
    assert quality.duplicate_issues(df).count() == 0 and quality.duplicate_issues(df.limit(0)).count() == 0


def test_ingest_takes_log_and_dictionary_from_the_version_only_when_asked_for(spark, tmp_path, monkeypatch):
    files = tmp_path / "files"
    files.mkdir()
    (files / "a.csv").write_text("id,day,note\n" + "".join(f'{i % 90},2024-01-{i % 28 + 1:02d},"x ""{i % 2}""\n\ny"\n' for i in [*range(150)] * 2))
    asked = []
    propose, count = ingest.dictionary.propose_dictionary, clean.duplicate_count
    monkeypatch.setattr(ingest.dictionary, "propose_dictionary", lambda df: asked.append("dictionary") or propose(df))
    monkeypatch.setattr(clean, "duplicate_count", lambda df: asked.append(df.inputFiles()) or count(df))
    done = ingest.ingest(spark, str(files), str(tmp_path / "store"), "notes", "v1")
    assert not asked
    log = {r["step_type"]: r["rows_affected"] for r in done.log.collect()}
    assert log["date_parsed"] == 300 and log["duplicate_rows_detected"] == 150 == 300 - done.table.distinct().count()
    assert len(asked) == 1 and all("version_id=v1" in f for f in asked[0])
    assert {r["column"]: r["role"] for r in done.dictionary.collect()}["day"] == "date" and asked[1:] == ["dictionary"]


def test_lines_become_records_in_batches_of_any_size():
    """Bytes that are no UTF-8 pass; a record may span batches and splits."""
    texts = [b'1,"a', b"", b'b"', b"2,\xe9", b'3,"c', b'd"', b'4,"e', b'f', b'g"', b"5", b'6,"h', b"i"]
    splits = [0] * 5 + [1] * 3 + [2] * 4
    opens = {0: False, 1: True, 2: True}
    types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
    names = ["file", "split", "at", "opens", "line"]
    want = {
        True: [(0, 0, "whole", b'1,"a\n\nb"'), (0, 3, "whole", b"2,\xe9"), (2, 9, "whole", b"5")],
        False: [(0, 4, "start", b'3,"c'), (1, 5, "end", b'd"'), (1, 6, "start", b'4,"e\nf'), (2, 8, "end", b'g"'), (2, 10, "start", b'6,"h\ni')],
    }
    for size in (1, 2, 5, 12):
        batches = []
        for i in range(0, len(texts), size):
            part = range(i, min(i + size, len(texts)))
            line = pa.array([texts[k] for k in part], pa.binary()).cast(pa.string(), safe=False)
            rest = [["f"] * len(part), [splits[k] for k in part], list(part), [opens[splits[k]] for k in part]]
            batches.append(pa.RecordBatch.from_arrays([*[pa.array(v, t) for v, t in zip(rest, types)], line], names=names))
        for whole in (True, False):
            got = []
            for b in records._pieced(whole)(iter(batches)):
                columns = [b.column(i).to_pylist() for i in (1, 2, 3)] + [b.column(4).cast(pa.binary()).to_pylist()]
                got += zip(*columns)
            assert got == want[whole]
