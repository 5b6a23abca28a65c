"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are range partitioned by id. Each range contributes one total; the totals before a range plus the running sum
inside it give every row's place in the whole byte line, and the line is cut at equal targets. No task holds more
than a range, and the only unpartitioned step sees one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import offsets, ranged, text_bytes

ROW_OVERHEAD = 16


def byte_shards(
    docs: DataFrame, shards: int = 40, id_column: str = "doc_id", size: Column | None = None, carry: Sequence[str] = (),
) -> DataFrame:
    """Returns id, size, text_crc32, shard, slot and the ``carry`` columns, one row per input row.

    A row belongs to the shard that the middle of its bytes falls in, so a shard misses its target by less than one
    row at either end. ``slot`` numbers a shard's rows from 0 in id order. Null ids come first; equal ids are ordered
    by size and checksum, and rows that agree in these as well are interchangeable. A null text has no bytes. A row
    larger than a shard's target may leave a neighbour empty. An empty table gives no rows.
    """
    body = text_bytes()
    rows = docs.select(
        F.col(id_column).alias("_id"),
        (F.length(body).cast("long") + ROW_OVERHEAD if size is None else size.cast("long")).alias("_size"),
        F.crc32(body).alias("_crc"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    rows = ranged(rows, "shard-rows", "_id", "_size", "_crc")
    totals = rows.groupBy("part").agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    inside = Window.partitionBy("part").orderBy("_id", "_size", "_crc").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.select("*", F.coalesce(F.sum("_size").over(inside), F.lit(0)).alias("_run"), F.count(F.lit(1)).over(inside).alias("_nth"))
        .join(F.broadcast(offsets(totals, [], ["bytes", "rows"])), "part")  # one row per range
        .crossJoin(F.broadcast(totals.agg(F.sum("bytes").alias("_total"))))  # one row
        .withColumn("shard", F.expr(
            f"cast(least((2 * (bytes_before + _run) + _size) * {int(shards)} div greatest(2 * _total, 1), {int(shards) - 1}) as int)"))
        .withColumn("_row", F.col("rows_before") + F.col("_nth")))
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("_id").alias(id_column), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard",
        (F.col("_row") - F.col("_first")).alias("slot"), *[F.col(f"_c_{c}").alias(c) for c in carry])


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Write whole rows as one folder per shard. Rows travel once; writers stay on their contiguous range.

    Nulls, ties and repeated rows fall as in ``byte_shards``. Columns named as its results are kept as ``<name>_of_row``. An
    empty table gives a folder without shards.
    """
    carry = [c for c in docs.columns if c != "doc_id"]
    clash = {c: f"{c}_of_row" for c in carry if c in ("size", "text_crc32", "shard", "slot", "part")}
    docs = docs.withColumnsRenamed(clash)
    byte_shards(docs, shards, carry=[clash.get(c, c) for c in carry]).write.partitionBy("shard").parquet(path)
