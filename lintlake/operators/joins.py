"""Join helpers that keep a hot key from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def join_lookup(
    facts: DataFrame, lookup: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join a large table with a lookup that has one row per key.

    The rows of one key are spread over ``salts`` tasks by a hash of the
    ``spread`` columns, and the lookup is repeated once per salt, so a key that
    holds a third of all facts does not decide the run time. No hint is given:
    Spark broadcasts the lookup when its measured size is under the session's
    limit, and shuffles both sides otherwise. The salts are a table that is
    cross joined, because its estimate counts the copies; that of an explode
    does not, and a lookup in compressed files would be sent to the driver.
    """
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    numbers = lookup.sparkSession.range(0, salts, 1, 1).select(F.col("id").cast("int").alias("_salt"))
    repeated = lookup.crossJoin(F.broadcast(numbers))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
