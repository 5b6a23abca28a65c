"""Helpers shared by the training-data operators: the shared folder, stored tables, global row numbers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local master without one gets its own, a cluster an error."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="lintlake-shared-")
        context.setCheckpointDir(named)
        named = context.getCheckpointDir()
    return named


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table that is read several times, or whose row order was sampled, to the shared folder and read it back.

    Everything upstream runs once and the rows survive a lost executor. The folder goes with the checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, label: str, *order: str | Column) -> DataFrame:
    """Rows cut into contiguous ranges of the given order; ``part`` numbers the ranges. Stored, as ranges come from a sample."""
    return stored(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), label)


def offsets(parts: DataFrame, keys: list[str], totals: list[str]) -> DataFrame:
    """From one row per (keys, part): what the parts before this one hold. The input has one row per range, so it is small."""
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*keys, "part", *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(f"{t}_before") for t in totals])


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def sliced_by_bytes(batches: Iterator[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller batches whose values in a column take about ``size`` bytes; a longer value is a batch of its own."""
    for batch in batches:
        start, values = 0, batch.column(column)
        while start < batch.num_rows:
            rows = batch.num_rows - start
            while rows > 1 and values.slice(start, rows).nbytes > size:
                rows = (rows + 1) // 2
            yield batch.slice(start, rows)
            start += rows


def text_bytes(column: Column | str = "text") -> Column:
    """UTF-8 bytes of a text; null is the empty text."""
    return F.encode(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")), "UTF-8")
