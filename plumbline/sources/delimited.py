"""Delimited text of unknown dialect.

Files are read as lines, so a file of any size is split over tasks. Questions about the head of a
file (delimiter, header row) are answered from its first lines, which are found by split offset
and position within the split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from plumbline import fixed_values as fixed

# Byte order marks and the encodings they announce.
BYTE_ORDER_MARKS = {"EFBBBF": "UTF-8", "FFFE": "UTF-16LE", "FEFF": "UTF-16BE"}


def read_text_table(
    spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8", multi_line: bool = False
) -> DataFrame:
    """Every column a string, blanks kept as empty strings; a quote in a cell is doubled.

    ``multi_line`` lets quoted cells hold line breaks. A file is then read by one task, so it is off
    unless asked for.
    """
    reader = spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding)
    raw = reader.option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(path)
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns])


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, split, at, line)``: lines with the offset of their split and their order in it."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
    )


def head_lines(lines: DataFrame, count: int = fixed.SNIFF_LINES) -> DataFrame:
    """The first lines of every file, numbered from 1; tasks keep that many before the shuffle."""
    order = W.partitionBy("file").orderBy("split", "at")
    return lines.withColumn("line_no", F.row_number().over(order)).where(F.col("line_no") <= count)


def sniff_delimiters(lines: DataFrame) -> DataFrame:
    """Per file the most frequent of ``, ; | tab`` in its first five lines."""
    found = head_lines(lines).groupBy("file").agg(
        *[
            F.sum(F.length("line") - F.length(F.replace(F.col("line"), F.lit(d), F.lit("")))).alias(f"d{i}")
            for i, d in enumerate(fixed.DELIMITERS)
        ]
    )
    most = F.greatest(*[F.col(f"d{i}") for i in range(len(fixed.DELIMITERS))])
    chosen = F.coalesce(*[F.when(F.col(f"d{i}") == most, F.lit(d)) for i, d in enumerate(fixed.DELIMITERS)])
    return found.select("file", chosen.alias("delimiter"), most.cast("long").alias("hits"))


def sniff_encodings(lines: DataFrame) -> DataFrame:
    """S3: per file the encoding its byte order mark names, else UTF-8 if every line is valid."""
    raw = F.hex(F.substring(F.col("line").cast("binary"), 1, 3))
    mark = F.lit(None).cast("string")
    for prefix, name in BYTE_ORDER_MARKS.items():
        mark = F.when(raw.startswith(prefix), F.lit(name)).otherwise(mark)
    first = F.min_by(mark, F.struct("split", "at"))
    valid = F.min(F.is_valid_utf8(F.col("line")))
    return lines.groupBy("file").agg(first.alias("mark"), valid.alias("valid"), F.count(F.lit(1)).alias("lines")).select(
        "file",
        F.coalesce("mark", F.when(F.col("valid"), "UTF-8").otherwise("ISO-8859-1")).alias("encoding"),
        "lines",
    )


def cells(line: Column, delimiter: str) -> Column:
    return F.split(line, f"[{delimiter}]" if delimiter != "\t" else "\t", -1)


def header_rows(lines: DataFrame, delimiter: str) -> DataFrame:
    """Per file the number of lines above the first one that fills over half of the columns,
    and that line.

    The width of a file is that of its widest line. Lines fold to one row per file, split and
    number of filled cells, so nothing but those few counts and lines is brought together.
    """
    parts = cells(F.col("line"), delimiter)
    filled = F.size(F.filter(parts, lambda c: F.trim(c) != ""))
    folded = (
        lines.withColumns({"width": F.size(parts), "filled": filled})
        .groupBy("file", "split", "filled")
        .agg(
            F.min(F.struct("at", "line")).alias("first"),
            F.max("width").alias("width"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    of_file = W.partitionBy("file")
    widths = folded.withColumn("width", F.max("width").over(of_file))
    splits = widths.groupBy("file", "split", "width").agg(
        F.sum("n").alias("n"),
        F.min("first").alias("first"),
        F.min(F.when(F.col("filled") > F.col("width") * fixed.HEADER_MIN_FILLED, F.col("first"))).alias("header"),
    )
    above = F.sum("n").over(of_file.orderBy("split")) - F.col("n")
    place = above + F.col("header.at") - F.col("first.at")
    numbered = splits.withColumn("place", place).groupBy("file").agg(
        F.min(F.when(F.col("place").isNotNull(), F.struct("place", "header.line"))).alias("header"),
        F.min_by("first.line", "split").alias("first_line"),
        F.max("width").cast("long").alias("columns"),
        F.sum("n").alias("lines"),
    )
    return numbered.select(
        "file",
        F.coalesce("header.place", F.lit(0)).alias("header_row"),
        F.coalesce("header.line", "first_line").alias("line"),
        "columns",
        "lines",
    )


def filled_headers(headers: DataFrame, delimiter: str) -> DataFrame:
    """The column names of each header line; a blank takes the name before it.

    Repeated names get a number (``name_2``), because a table needs distinct ones.
    """
    cell = headers.select("file", F.posexplode(cells(F.col("line"), delimiter)).alias("position", "name"))
    trimmed = F.trim(F.col("name"))
    order = W.partitionBy("file").orderBy("position")
    filled = F.last(F.when(trimmed != "", trimmed), ignorenulls=True).over(order)
    named = cell.withColumn("name", F.coalesce(filled, F.lit("")))
    nth = F.row_number().over(W.partitionBy("file", "name").orderBy("position"))
    return named.withColumn("nth", nth).select(
        "file",
        "position",
        F.when(F.col("nth") > 1, F.concat_ws("_", "name", "nth")).otherwise(F.col("name")).alias("name"),
    )
