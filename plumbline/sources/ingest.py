"""S1-S8 and C1-C8 in one step: a folder of delimited files of any dialect to a registered version of a table.

Every file says its own encoding, delimiter, title lines and header in its first bytes; files alike in these are
parsed together, and their tables are put together by column name. Nothing but one row per file comes to the
driver, as much as Spark's own file listing.
"""

from __future__ import annotations

import codecs
import csv
import io
from collections import defaultdict
from dataclasses import dataclass
from functools import cached_property
from typing import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import fixed_values as fixed
from plumbline.operators import clean as cleaning, dictionary
from plumbline.operators.profile import union_all
from plumbline.plans.storage import work_path
from plumbline.sources import heads
from plumbline.sources.delimited import BYTE_ORDER_MARKS, file_lines, read_text_table
from plumbline.sources.records import records, split_facts
from plumbline.sources.tables import write_version

DIALECT = "file string, path string, length long, encoding string, marked boolean, delimiter string, titles int, skipped int, names array<string>"


@dataclass
class Ingested:
    """A stored version; its log and dictionary are computed from it when they are first asked for."""

    table: DataFrame
    manifest: DataFrame
    files: DataFrame
    make_log: Callable[[], DataFrame]

    @cached_property
    def log(self) -> DataFrame:
        return self.make_log()

    @cached_property
    def dictionary(self) -> DataFrame:
        return dictionary.propose_dictionary(self.table)


def dialect_reader():
    """A function from the first bytes of a file, and whether these are all, to ``(encoding, marked, delimiter, titles,
    skipped, names)``; ``titles`` are the records above the header, ``skipped`` the lines up to and including it.

    It is made of local values only, so that it travels to tasks without the library.
    """
    marks = {bytes.fromhex(prefix): name for prefix, name in BYTE_ORDER_MARKS.items()}
    delimiters, sniffed, least = list(fixed.DELIMITERS), fixed.SNIFF_LINES, fixed.HEADER_MIN_FILLED

    def dialect(head: bytes, complete: bool):
        mark = next((name for prefix, name in marks.items() if head.startswith(prefix)), None)
        encoding = mark or "UTF-8"
        if not mark:
            try:
                codecs.getincrementaldecoder("utf-8")().decode(head, final=complete)
            except UnicodeDecodeError:
                encoding = "ISO-8859-1"
        text = head.decode(encoding, errors="replace").lstrip("\ufeff")
        counts = {d: sum(line.count(d) for line in text.splitlines()[:sniffed]) for d in delimiters}
        delimiter = max(counts, key=counts.get)
        reader, rows, ends = csv.reader(io.StringIO(text), delimiter=delimiter), [], []
        for row in reader:
            rows.append(row)
            ends.append(reader.line_num)
        if not complete and len(rows) > 1:
            rows.pop()
        width = max(map(len, rows), default=0)
        filled = [sum(c.strip() != "" for c in row) for row in rows]
        titles = next((i for i, n in enumerate(filled) if n > width * least), 0)
        names: list[str] = []
        for cell in rows[titles] if rows else []:
            names.append(cell.strip() or (names[-1] if names else ""))
        nth: dict[str, int] = defaultdict(int)
        for i, name in enumerate(names):
            nth[name] += 1
            names[i] = f"{name}_{nth[name]}" if nth[name] > 1 else name
        return encoding, mark is not None, delimiter, titles, ends[titles] if rows else 0, names

    return dialect


def file_dialects(spark: SparkSession, path: str | Sequence[str], head_bytes: int = heads.HEAD_BYTES) -> DataFrame:
    """One row per file: encoding by its mark (else UTF-8 if they are valid), delimiter, title records, lines up to the header
    and column names, from its first bytes alone."""

    dialect, fields = dialect_reader(), [f.split()[0] for f in DIALECT.split(", ")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()))
        for batch in batches:
            found = [dialect(h, n <= len(h)) for n, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            columns = zip(*found) if found else [[]] * len(types)
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], names=fields)

    return heads.file_heads(spark, path, head_bytes).mapInArrow(judge, DIALECT)


def _parsed(record: DataFrame, delimiter: str, names: Sequence[str]) -> DataFrame:
    """Rows of ``record`` as one text column per name; ``valid`` says whether they are UTF-8."""
    text = F.when(F.col("valid"), F.col("record")).otherwise(F.decode(F.col("record").cast("binary"), "ISO-8859-1"))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {"sep": delimiter, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "mode": "PERMISSIVE"}
    cells = record.where(F.trim("record") != "").select(F.from_csv(text, schema, options).alias("r"))
    return cells.select(*[F.coalesce(F.col(f"r.c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)])


def _lines_of(spark: SparkSession, files: list[str], skipped: int, number: int) -> tuple[DataFrame, set]:
    """Records below the header of files that are alike, with ``valid``; also the files that are not UTF-8."""
    lines = file_lines(spark, files)
    folder = work_path(spark, f"ingest-splits-{number}")
    split_facts(lines).write.mode("overwrite").parquet(folder)
    facts = spark.read.parquet(folder)
    per_file = facts.groupBy("file").agg(F.min("valid").alias("valid"), F.min(F.when(F.col("split") == 0, F.col("first_at"))).alias("start"))
    known = F.broadcast(per_file)
    below = lines.join(known.select("file", "start"), "file").where((F.col("split") > 0) | (F.col("at") - F.col("start") >= skipped))
    found = records(below.select("file", "split", "at", "line"), facts).join(known.select("file", "valid"), "file")
    return found, {r["file"] for r in per_file.where("NOT valid").collect()}


def read_mixed(spark: SparkSession, path: str | Sequence[str], head_bytes: int = heads.HEAD_BYTES) -> tuple[DataFrame, list[dict]]:
    """All files as one table of texts, and the dialects of the files.

    Quoted cells may hold line breaks anywhere, also where Spark splits a file. Blank cells are empty strings,
    columns that a file lacks are NULL; cells beyond a file's header are left out. A file that is not valid UTF-8
    anywhere is ISO-8859-1. UTF-16 files, whose line ends are not single bytes, are read by one task each.
    """
    dialects = [r.asDict() for r in sorted(file_dialects(spark, path, head_bytes).collect())]
    groups: dict[tuple, list[dict]] = defaultdict(list)
    for r in dialects:
        if r["names"]:
            groups[r["encoding"], r["delimiter"], r["skipped"], tuple(r["names"])].append(r)
    parts = []
    for number, ((encoding, delimiter, skipped, names), files) in enumerate(sorted(groups.items())):
        paths = [r["path"] for r in files]
        if encoding.startswith("UTF-16"):
            wide = read_text_table(spark, paths, delimiter, encoding, multi_line=True)
            parts.append(wide.toDF(*names[: len(wide.columns)]))
            continue
        found, wrong = _lines_of(spark, paths, skipped, number)
        parts.append(_parsed(found, delimiter, names))
        for r in files:
            r["encoding"] = "ISO-8859-1" if r["file"] in wrong else r["encoding"]
    if not parts:
        raise ValueError(f"no file with a header line under {path}")
    return union_all(parts), dialects


def ingest(
    spark: SparkSession,
    path: str | Sequence[str],
    root: str,
    dataset_id: str,
    version_id: str,
    version_number: int = 1,
    remove_totals: bool = True,
) -> Ingested:
    """Files to a cleaned table, written as a version under ``root``, with its manifest row (which has the hash of
    the files' bytes), the log of all steps, and the proposed dictionary."""
    texts, dialects = read_mixed(spark, path)
    raw = work_path(spark, f"ingest-raw-{dataset_id}-{version_id}")
    texts.write.mode("overwrite").parquet(raw)
    cleaned = cleaning.clean(spark.read.parquet(raw), remove_totals)
    hashes = heads.raw_hashes(spark, [r["path"] for r in dialects])
    names = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("file", "content_hash"))), lambda r: r["content_hash"]))
    content = hashes.agg(
        F.sum("length").alias("file_size_bytes"),
        F.when(F.count(F.lit(1)) == 1, F.min("content_hash")).otherwise(F.sha2(names, 256)).alias("content_hash"),
    ).first()
    source = ", ".join(sorted(r["file"].rsplit("/", 1)[1] for r in dialects))
    manifest = write_version(cleaned.table, root, dataset_id, version_id, version_number, source).withColumns(
        {"content_hash": F.lit(content["content_hash"]), "file_size_bytes": F.lit(content["file_size_bytes"]).cast("long")}
    )
    stored = spark.read.parquet(f"{root}/dataset_id={dataset_id}/version_id={version_id}")

    def log() -> DataFrame:
        steps = read_steps(dialects)
        first = spark.createDataFrame([(i + 1, *s) for i, s in enumerate(steps)], cleaning.LOG_SCHEMA)
        # Counted in the stored version, whose texts need not be parsed again.
        return first.union(cleaned.make_log(stored).withColumn("step", F.col("step") + len(steps)))

    return Ingested(stored, manifest, spark.createDataFrame(dialects, DIALECT), log)


def read_steps(dialects: Sequence[dict]) -> list[tuple]:
    """What reading found, each finding once with the number of files when there are several."""

    def counted(key: str) -> list[tuple]:
        seen: dict = defaultdict(int)
        for r in dialects:
            seen[r[key]] += 1
        return sorted(seen.items())

    def among(text: str, files: int) -> str:
        return text if files == len(dialects) else f"{text} in {files} of {len(dialects)} files"

    steps = [("encoding_detected", among(fixed.ENCODING_STEP.format(e), n), 0, False) for e, n in counted("encoding")]
    steps += [("delimiter_detected", among(fixed.DELIMITER_STEP.format(repr(d)), n), 0, False) for d, n in counted("delimiter")]
    for titles, files in counted("titles"):
        if titles:
            steps.append(("header_row_detected", among(fixed.HEADER_STEP.format(titles), files), titles * files, False))
    return steps
