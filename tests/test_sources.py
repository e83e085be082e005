"""Delimited files of several dialects, versions and user functions."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import userfn
from plumbline.plans.storage import shared_folder, work_path
from plumbline.sources import delimited, tables
from plumbline.workload import QUERIES

FOLDER = "/root/testdata/sf0.001"


def write(folder, name, data):
    path = folder / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_delimiters(spark, tmp_path):
    files = {"a.txt": "x,y;z\n1,2\n", "b.txt": "x;y\n1;2,5\n;;\n", "c.txt": "x|y\n", "d.txt": "x\ty\tz,w\n", "e.txt": "plain\n",
             "f.txt": "a;b\n" * 5 + "1,2,3,4,5\n" * 50}
    for name, data in files.items():
        write(tmp_path, name, data)
    got = {r["file"][-5:]: r["delimiter"] for r in delimited.sniff_delimiters(delimited.file_lines(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": ",", "b.txt": ";", "c.txt": "|", "d.txt": "\t", "e.txt": ",", "f.txt": ";"}


def test_encodings(spark, tmp_path):
    write(tmp_path, "a.txt", "élan\n")
    write(tmp_path, "b.txt", "ok\nélan\n".encode("latin-1"))
    write(tmp_path, "c.txt", b"\xef\xbb\xbfx\n")
    got = {r["file"][-5:]: r["encoding"] for r in delimited.sniff_encodings(delimited.file_lines(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": "UTF-8", "b.txt": "ISO-8859-1", "c.txt": "UTF-8"}


def test_header_row_and_merged_names(spark, tmp_path):
    write(tmp_path, "a.txt", "Report 2024;;;\n;;;\nRegion;;Sales;Cost\nx;1;2;3\n")
    write(tmp_path, "b.txt", "k;v\n1;2\n")
    lines = delimited.file_lines(spark, str(tmp_path))
    rows = delimited.header_rows(lines, ";")
    assert {r["file"][-5:]: r["header_row"] for r in rows.collect()} == {"a.txt": 2, "b.txt": 0}
    names = delimited.filled_headers(rows, ";").orderBy("file", "position").collect()
    assert [r["name"] for r in names] == ["Region", "Region_2", "Sales", "Cost", "k", "v"]


def test_header_row_of_a_file_in_many_splits(spark, tmp_path):
    write(tmp_path, "a.txt", "t;;\n" * 3000 + "a;b;c\n" + "1;2;3\n" * 3000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = delimited.file_lines(spark, str(tmp_path))
        assert lines.select("split").distinct().count() > 5
        rows = delimited.header_rows(lines, ";")
        assert [(r["header_row"], r["lines"]) for r in rows.collect()] == [(3000, 6001)]
        assert [r["line"] for r in rows.collect()] == ["a;b;c"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_blank_cells_are_empty_strings(spark, tmp_path):
    path = write(tmp_path, "a.csv", "a,b\n1,\n,x\n")
    got = delimited.read_text_table(spark, path)
    assert got.dtypes == [("a", "string"), ("b", "string")]
    assert [tuple(r) for r in got.collect()] == [("1", ""), ("", "x")]


def test_rows_only_queries(spark):
    for r in QUERIES["s2_delimiter_sniff"](spark, FOLDER).collect():
        assert r["delimiter"] == {"comma": ",", "semicolon": ";", "bar": "|", "tab": "\t"}[r["dialect"]]
    for r in QUERIES["s3_encoding_sniff"](spark, FOLDER).collect():
        assert r["written"] == r["encoding"]
    assert all(r["header_row"] == 2 for r in QUERIES["s4_header_row"](spark, FOLDER).collect())
    names = {(r["position"], r["name"]) for r in QUERIES["s5_header_fill"](spark, FOLDER).collect()}
    assert names == {(0, "Customer"), (1, "Customer_2"), (2, "Place"), (3, "Place_2"), (4, "Balance")}


def test_fingerprint(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, t string")
    same = tables.fingerprint(df.repartition(3)).first()
    assert tables.fingerprint(df).first() == same
    assert tables.fingerprint(df.distinct()).first() != same
    assert tables.fingerprint(df.fillna("")).first() != same


def test_versions(spark, tmp_path):
    rows = [tables.write_version(spark.range(n), str(tmp_path), "d", f"v{n}", n, "x.csv") for n in (1, 2)]
    latest = tables.latest_versions(rows[0].unionByName(rows[1]), "dataset_id", ["version_number"]).first()
    assert (latest["version_id"], latest["row_count"], latest["versions"]) == ("v2", 2, 2)
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_version(spark.range(1), str(tmp_path), "d", "v1", 1, "x.csv")


def test_grouped_function_folds_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(userfn, "MERGE_ROWS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), "id")

        def partial(batch: pd.DataFrame) -> pd.DataFrame:
            return batch.groupby("k")["id"].agg(n="count", s="sum").reset_index()

        def merge(rows: pd.DataFrame) -> pd.DataFrame:
            return rows.groupby("k")[["n", "s"]].sum().reset_index()

        got = {r["k"]: (r["n"], r["s"]) for r in userfn.grouped_function(df, ["k"], partial, merge, "k long, n long, s long").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {r["k"]: (r["n"], r["s"]) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s")).collect()}
    assert got == want and len(want) == 1001


def test_shared_folder_is_read_from_the_session(spark):
    class Session:
        """A session whose settings are the given ones."""

        def __init__(self, master, **settings):
            self.conf, self.sparkContext = self, self
            self.master, self.applicationId, self.settings = master, "app-1", settings

        def get(self, key, default):
            return self.settings.get(key.replace(".", "_"), default)

    assert work_path(Session("yarn", spark_checkpoint_dir="s3://x/"), "t") == "s3://x/app-1/t"
    with pytest.raises(RuntimeError):
        shared_folder(Session("yarn"))
    assert shared_folder(Session("local[2]")) == shared_folder(Session("local[2]"))
    assert work_path(spark, "t").endswith(f"{spark.sparkContext.applicationId}/t")
