"""Beginnings and blocks of files, read by offset instead of reading the files.

The list of files comes from Spark's own listing, which reads no content when only paths and lengths are
asked for. Tasks then open each file and read the bytes they need.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

HEAD_BYTES = 1 << 16
BLOCK_BYTES = 64 << 20
CHUNK_BYTES = 1 << 20


def file_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file`` (its URI), ``path`` and ``length`` of every file under ``path``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("_metadata.file_path").alias("file"), "path", "length")


def file_heads(spark: SparkSession, path: str | list[str], size: int = HEAD_BYTES) -> DataFrame:
    """``file``, ``path``, ``length``, ``head``: the first ``size`` bytes of every file, and no others."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for file in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(file)
                with system.open_input_file(place) as stream:
                    heads.append(stream.read(size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary())], names=["file", "path", "length", "head"])

    return file_list(spark, path).mapInArrow(read, "file string, path string, length long, head binary")


def raw_hashes(spark: SparkSession, path: str | list[str], block: int = BLOCK_BYTES) -> DataFrame:
    """``file``, ``length``, ``blocks`` and the SHA-256 of the file's bytes as ``content_hash``.

    Blocks are hashed by many tasks; a file of several blocks has the hash of its blocks' hashes, in order.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for file, length, number in zip(*(c.to_pylist() for c in batch.columns)):
                system, place = fs.FileSystem.from_uri(file)
                sha, at, end = hashlib.sha256(), number * block, min(length, (number + 1) * block)
                with system.open_input_file(place) as stream:
                    stream.seek(at)
                    while at < end:
                        part = stream.read(min(CHUNK_BYTES, end - at))
                        if not part:
                            break
                        sha.update(part)
                        at += len(part)
                found.append(sha.digest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.binary())], names=["file", "length", "block", "digest"]
            )

    last = F.greatest(F.ceil(F.col("length") / block) - 1, F.lit(0)).cast("long")
    blocks = file_list(spark, path).select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    # The blocks of a large file are read by different tasks.
    dealt = blocks.repartition("file", "block").mapInArrow(digest, "file string, length long, block long, digest binary")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("block", "digest"))), lambda b: F.hex(b["digest"]))
    per_file = dealt.groupBy("file", "length").agg(F.count(F.lit(1)).alias("blocks"), ordered.alias("hashes"))
    whole = F.sha2(F.unhex(F.concat_ws("", "hashes")), 256)
    one = F.lower(F.get("hashes", F.lit(0)))
    return per_file.select("file", "length", "blocks", F.when(F.col("blocks") == 1, one).otherwise(whole).alias("content_hash"))
