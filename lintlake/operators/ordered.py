"""Running totals and previous values within a key, without one task per key.

A window over a key sorts all of the key's rows in one task. Here rows are range
partitioned by key and order, so a key with very many rows is cut into ranges;
each range is handled on its own and then adjusted by what the ranges before it
hold, which is one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.operators.joins import join_lookup
from lintlake.session import settle


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Rows with the number of the range they fall in; settled, as ranges come from a sample. Spark chooses how many by default."""
    return settle(df.repartitionByRange(*([ranges] if ranges else []), *keys, *order).withColumn("_part", F.spark_partition_id()))


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, Column]
) -> DataFrame:
    """Adds, per name, the sum of a column over a key's rows up to and including this one.

    ``order`` must name columns that tell all rows of a key apart.
    """
    keys, order = list(keys), list(order)
    rows = ranged(df.select("*", *[c.cast("long").alias(f"_v_{n}") for n, c in totals.items()]), keys, order)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    offsets = sums.select(*keys, "_part", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in totals])
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select("*", *[F.sum(f"_v_{n}").over(within).alias(f"_w_{n}") for n in totals])
    joined = join_lookup(local, offsets, [*keys, "_part"], order, "inner")
    return joined.select(*df.columns, *[(F.col(f"_w_{n}") + F.col(f"_o_{n}")).alias(n) for n in totals])


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    """Adds the column's value on the key's previous row; null on the first."""
    keys, order = list(keys), list(order)
    rows = ranged(df, keys, order)
    last = rows.groupBy(*keys, "_part").agg(F.max_by(column, F.struct(*order)).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_part")
    carried = last.select(*keys, "_part", F.lag("_last").over(before).alias("_carried"))
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    local = rows.select("*", F.lag(column).over(within).alias("_lag"), F.row_number().over(within).alias("_rank"))
    joined = join_lookup(local, carried, [*keys, "_part"], order, "inner")
    return joined.select(*df.columns, F.when(F.col("_rank") == 1, F.col("_carried")).otherwise(F.col("_lag")).alias(name))
