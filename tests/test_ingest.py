"""Ingest of mixed delimited files, also where splits cut quoted cells."""

import csv
import hashlib
import io
import os
import pickle
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from plumbline.sources import heads, ingest
from plumbline.sources.delimited import file_lines
from plumbline.sources.records import records, split_facts


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def write(folder, name, rows, delimiter=",", titles=(), encoding="utf-8"):
    text = io.StringIO()
    csv.writer(text, delimiter=delimiter, lineterminator="\n").writerows([*titles, *rows])
    (folder / name).write_bytes(text.getvalue().encode(encoding))


def test_records_across_splits(small_splits, tmp_path):
    rng = random.Random(1)
    expected = []
    for i in range(3):
        rows = [[f"{i}-{n}", rng.choice(["plain", 'a "quoted" word', "two\nlines", "l" * 90 + "\n" + "m" * 150 + "\n\nn", ""])] for n in range(200)]
        write(tmp_path, f"f{i}.csv", rows)
        expected += rows
    lines = file_lines(small_splits, str(tmp_path))
    facts = split_facts(lines)
    assert facts.count() > 30 and facts.where("opens").count() > 5
    got = [next(csv.reader(io.StringIO(r["record"]))) for r in records(lines, facts.persist()).select("record").collect()]
    assert sorted(got) == sorted(expected)


def test_folder_of_mixed_files(small_splits, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    rows = [[str(i), f"{i % 12 + 1:02d}/{i % 28 + 1:02d}/2024", ["note", "two\nlines; and, more", 'say "x"'][i % 3]] for i in range(1, 41)]
    head = ["id", "day", "note"]
    write(files, "a.csv", [head, *rows])
    write(files, "b.csv", [head, *rows], ";", titles=[["Sales report"], []])
    write(files, "c.csv", [["day", "id", "café"], *[[r[1], r[0], "é"] for r in rows]], "|", encoding="latin-1")
    write(files, "d.csv", [head, *rows], "\t", encoding="utf-8-sig")
    write(files, "e.csv", [head, *rows], ",", encoding="utf-16")
    (files / "empty.csv").write_bytes(b"")
    texts, dialects = ingest.read_mixed(small_splits, str(files))
    found = {r["file"].rsplit("/", 1)[1]: r for r in dialects}
    assert [found[f]["delimiter"] for f in ("a.csv", "b.csv", "c.csv", "d.csv")] == [",", ";", "|", "\t"]
    assert found["b.csv"]["titles"] == 2 and found["c.csv"]["encoding"] == "ISO-8859-1"
    got = texts.select("id", "day", "note").collect()
    assert len(got) == 200
    whole = sorted((*r,) for r in got if r["note"] is not None)
    assert whole == sorted(tuple(r) for r in rows * 4)
    assert {r["café"] for r in texts.select("café").where("`café` IS NOT NULL").collect()} == {"é"}

    done = ingest.ingest(small_splits, str(files), str(tmp_path / "store"), "sales", "v1")
    assert dict(done.table.dtypes)["day"] == "timestamp_ntz" and dict(done.table.dtypes)["id"] == "double"
    manifest = done.manifest.first()
    assert manifest["row_count"] == 200 and manifest["file_size_bytes"] == sum(f.stat().st_size for f in files.iterdir())
    log = [(r["step"], r["step_type"]) for r in done.log.orderBy("step").collect()]
    assert [n for n, _ in log] == list(range(1, len(log) + 1))
    assert {"encoding_detected", "delimiter_detected", "header_row_detected", "date_parsed", "numeric_parsed"} <= {k for _, k in log}
    assert {r["column"]: r["role"] for r in done.dictionary.collect()}["day"] == "date"


def test_heads_and_hashes_read_by_offset(spark, tmp_path):
    (tmp_path / "big.bin").write_bytes(b"x" * 300_000 + b"tail")
    (tmp_path / "small one.bin").write_bytes(b"abc")
    got = {r["file"].rsplit("/", 1)[1]: r for r in heads.file_heads(spark, str(tmp_path), 1000).collect()}
    assert {k: (r["length"], len(r["head"])) for k, r in got.items()} == {"big.bin": (300_004, 1000), "small%20one.bin": (3, 3)}
    plan = heads.file_heads(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    whole = {r["length"]: r for r in heads.raw_hashes(spark, str(tmp_path)).collect()}
    assert whole[3]["content_hash"] == hashlib.sha256(b"abc").hexdigest()
    data = (tmp_path / "big.bin").read_bytes()
    assert whole[300_004]["content_hash"] == hashlib.sha256(data).hexdigest()
    blocks = heads.raw_hashes(spark, str(tmp_path), block=100_000).where("length > 3").first()
    parts = b"".join(hashlib.sha256(data[a : a + 100_000]).digest() for a in range(0, 300_004, 100_000))
    assert (blocks["blocks"], blocks["content_hash"]) == (4, hashlib.sha256(parts).hexdigest())


def test_functions_sent_to_tasks_do_not_need_the_library(spark, tmp_path, monkeypatch):
    from pyspark import cloudpickle

    from plumbline.operators import profile

    (tmp_path / "a.csv").write_text("a,b\n1,\"x\ny\"\n")
    sent, apply = [], type(spark.range(1)).mapInArrow

    def recorded(df, func, *args, **kwargs):
        sent.append(cloudpickle.dumps(func))
        return apply(df, func, *args, **kwargs)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", recorded)
    assert ingest.read_mixed(spark, str(tmp_path))[0].count() == 1
    heads.raw_hashes(spark, str(tmp_path)).count()
    profile.sample_values(spark.range(3), ["id"]).count()
    assert len(sent) >= 5
    (tmp_path / "sent").write_bytes(pickle.dumps(sent))
    load = "import pickle, sys; [pickle.loads(s) for s in pickle.load(open(sys.argv[1], 'rb'))]; print('plumbline' in sys.modules)"
    alone = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", load, str(tmp_path / "sent")], cwd=tmp_path, env=alone, capture_output=True, text=True)
    assert done.stdout.strip() == "False", done.stderr
