"""Records of delimited text whose quoted cells may hold line breaks, without making a file one task.

A line break is inside a cell if an odd number of quotes comes before it in the file. One pass counts quotes
per split; a running sum over the few rows of a file's splits tells which splits begin inside a cell. A second
pass then puts lines together split by split, each task knowing how its split begins. A record that crosses
splits comes out in pieces, at most two per split, which are joined by their order.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

OPEN_SPLITS = 200_000
SCHEMA = "file string, split long, at long, piece string, record string"


def quotes_odd(line: Column) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2


def split_facts(lines: DataFrame) -> DataFrame:
    """Per file and split: its first line, number of lines, quotes modulo 2, and whether it is valid UTF-8;
    ``opens``: it begins inside a quoted cell."""
    facts = lines.groupBy("file", "split").agg(
        F.min("at").alias("first_at"),
        F.count(F.lit(1)).alias("lines"),
        F.sum(quotes_odd(F.col("line"))).alias("odd"),
        F.min(F.is_valid_utf8("line")).alias("valid"),
    )
    before = F.sum("odd").over(W.partitionBy("file").orderBy("split")) - F.col("odd")
    return facts.withColumn("opens", before % 2 == 1)


def records(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """``file, split, at, record`` from ``file_lines`` and their stored ``split_facts``.

    Line breaks inside a cell become ``\\n``. A quote that never closes makes the rest of its file one record.
    """
    if not facts.where("odd > 0").take(1):
        return lines.select("file", "split", "at", F.col("line").alias("record"))
    opens = facts.where("opens").select("file", "split", F.lit(True).alias("opens"))
    if opens.limit(OPEN_SPLITS + 1).count() <= OPEN_SPLITS:
        marked = lines.join(F.broadcast(opens), ["file", "split"], "left")
    else:
        marked = lines.join(opens, ["file", "split"], "left").repartition("file", "split")
    marked = marked.select("file", "split", "at", F.coalesce("opens", F.lit(False)).alias("opens"), "line")
    # A split is read by one task, so its lines have numbers in a row: in their order no split is mixed with another.
    marked = marked.sortWithinPartitions("at")
    whole = marked.mapInArrow(_pieced(True), SCHEMA).select("file", "split", "at", "record")
    # Only a split that begins or ends inside a cell has pieces.
    cut = facts.where("opens OR (odd + int(opens)) % 2 = 1").select("file", "split")
    if not cut.take(1):
        return whole
    some = marked.join(F.broadcast(cut) if cut.limit(OPEN_SPLITS + 1).count() <= OPEN_SPLITS else cut, ["file", "split"], "left_semi")
    pieces = some.repartition("file", "split").sortWithinPartitions("at").mapInArrow(_pieced(False), SCHEMA)
    number = F.sum(F.when(F.col("piece") == "start", 1).otherwise(0)).over(W.partitionBy("file").orderBy("split", "at"))
    ordered = F.sort_array(F.collect_list(F.struct("split", "at", "record")))
    joined = pieces.withColumn("n", number).groupBy("file", "n").agg(ordered.alias("parts"))
    stitched = joined.select(
        "file",
        F.col("parts")[0]["split"].alias("split"),
        F.col("parts")[0]["at"].alias("at"),
        F.concat_ws("\n", F.transform("parts", lambda p: p["record"])).alias("record"),
    )
    return whole.unionByName(stitched)


def _pieced(whole: bool):
    """Lines of splits, in order, to whole records, or to the pieces of those that cross splits.

    Lines are counted and joined by Arrow as bytes, a batch at a time; Python sees splits, not lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, first, inside, began = None, [], 0, False, False
        names = [f.split()[0] for f in SCHEMA.split(", ")]

        def joined(ends, lines) -> pa.Array:
            return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), lines), "\n")

        def put(piece: str, ats, texts) -> Iterator[pa.RecordBatch]:
            if (piece == "whole") == whole and len(texts):
                same = [pa.repeat(pa.scalar(v, t), len(texts)) for v, t in ((now[0], pa.string()), (now[1], pa.int64()), (piece, pa.string()))]
                yield pa.RecordBatch.from_arrays([same[0], same[1], pa.array(ats, pa.int64()), same[2], texts], names=names)

        def rest() -> Iterator[pa.RecordBatch]:
            if held:
                lines = pa.concat_arrays(held)
                yield from put("inside" if began else "start", [first], joined([len(lines)], lines))
                held.clear()

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            file, split, line = batch.column(0), batch.column(1).to_numpy(), batch.column(4)
            at, odd = batch.column(2).to_numpy(), pc.count_substring(line, '"').to_numpy() % 2
            other = pc.not_equal(file.slice(1), file.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(other.astype(bool) | (split[1:] != split[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, n]):
                if now != (file[a].as_py(), split[a]):
                    yield from rest()
                    inside = began = batch.column(3)[a].as_py()
                    now = (file[a].as_py(), split[a])
                lines = line.slice(a, b - a)
                after = (np.cumsum(odd[a:b]) + inside) % 2 == 1
                ends, inside = np.flatnonzero(~after) + 1, bool(after[-1])
                if not held:
                    first = at[a]
                if not len(ends):
                    held.append(lines)
                    continue
                if held or began:
                    # The record at hand ends here.
                    head = pa.concat_arrays([*held, lines.slice(0, ends[0])])
                    yield from put("end" if began else "whole", [first], joined([len(head)], head))
                    lines, a, ends, began = lines.slice(ends[0]), a + ends[0], ends[1:] - ends[0], False
                    held.clear()
                done = ends[-1] if len(ends) else 0
                if done:
                    yield from put("whole", at[a + np.array([0, *ends[:-1]])], joined(ends, lines.slice(0, done)))
                if done < len(lines):
                    held.append(lines.slice(done))
                    first = at[a + done]
        yield from rest()

    return run
