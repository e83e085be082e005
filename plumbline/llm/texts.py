"""What the operators share: columns computed from texts in Arrow batches, stored steps, checked broadcasts."""

from __future__ import annotations

import uuid
from typing import Any, Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.plans.storage import work_path

#: Rows of a table that may be sent to every task. Its rows are a few numbers each.
BROADCAST_ROWS = 200_000


def with_columns(
    df: DataFrame,
    column: str | Sequence[str],
    make: Callable[[], Callable],
    fields: Sequence[tuple[str, str]],
    raw: bool = False,
) -> DataFrame:
    """``df`` with ``fields`` (name, type) computed from ``column``, one Arrow batch at a time.

    ``make()`` runs once per task and returns a function from a list of values per column (with ``raw``, from
    Arrow arrays) to a list of one sequence per field. Batches are bounded in rows and bytes by the session.
    Columns of ``df`` that carry a name of ``fields`` are replaced.
    """
    names, given = [n for n, _ in fields], [column] if isinstance(column, str) else list(column)
    kept = df.select([F.col(f"`{c}`") for c in df.columns if c not in names])
    places = [kept.columns.index(c) for c in given]
    added = [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields]
    schema = T.StructType(kept.schema.fields + added)
    types = list(to_arrow_schema(T.StructType(added)).types)
    all_names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            found = compute(*[batch.column(p) if raw else batch.column(p).to_pylist() for p in places])
            arrays = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(found, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=all_names)

    return kept.mapInArrow(run, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read again: lineage ends here."""
    path = work_path(df.sparkSession, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for file in table.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, marked for broadcast if it has at most ``limit`` rows.

    A larger one stays as it is: the join then shuffles both sides and adaptive execution splits
    the partitions of hot keys.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def literal_rows(rows: Sequence[Any]) -> str:
    """Rows of numbers and texts as SQL VALUES."""
    return ", ".join("(" + ", ".join("'" + v + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
