"""Per-repository limits on the number of files and bytes of a scan.

The first mode keeps at most the count limit of rows per repository. The second cuts all rows into ranges of path order and
walks single files only in ranges where a limit is met, so a repository of any size is spread over tasks.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.operators.joins import join_lookup
from lintlake.operators.ordered import ranged, running_totals
from lintlake.session import settle

# Service and workstation limits.
SERVICE_LIMITS = {"max_files": 200, "max_bytes": 4 * 1024 * 1024, "max_file_bytes": 160 * 1024}
LOCAL_LIMITS = {"max_files": 400, "max_bytes": 8 * 1024 * 1024, "max_file_bytes": 200 * 1024}


def running_bytes(files: DataFrame) -> DataFrame:
    """(repo_id, path, size, position, running_bytes) of each file in path order."""
    return running_totals(
        files.select("repo_id", "path", "size"), ["repo_id"], ["path"],
        {"position": F.lit(1), "running_bytes": F.col("size")},
    )


def file_budget_stop(files: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """First ``max_files`` files by path, cut before the first that overflows the bytes."""
    order = Window.partitionBy("repo_id").orderBy("path")
    first = files.withColumn("position", F.row_number().over(order)).where(F.col("position") <= max_files)
    running = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return first.withColumn("running_bytes", running).where(F.col("running_bytes") <= max_bytes)


def _walk_ranges(rows: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """Files kept of rows that carry the ``files`` and ``bytes`` taken before their range; one range a repository."""

    def walk(batches):
        repo, count, total = None, 0, 0
        for batch in batches:
            keep = []
            columns = (batch[c].tolist() for c in ("repo_id", "size", "files", "bytes"))
            for here, size, before, used in zip(*columns):
                if here != repo:
                    repo, count, total = here, before, used
                taken = count < max_files and total + size <= max_bytes
                if taken:
                    count, total = count + 1, total + size
                keep.append(taken)
            yield batch.loc[pd.Series(keep, index=batch.index, dtype=bool), ["repo_id", "path", "size"]]

    return (
        rows.repartition("repo_id").sortWithinPartitions("repo_id", "path", "size")
        .mapInPandas(walk, "repo_id string, path string, size long")
    )


def file_budget_skip(files: DataFrame, max_files: int, max_bytes: int, ranges: int | None = None) -> DataFrame:
    """Walk files in path order, passing over any that would overflow the bytes.

    Returns (repo_id, path, size) of the files kept. Files without a repository or size are left out; equal paths go by size.

    Leading ranges that fit whole are taken by prefix sums over one row per range. The first that does not is walked file
    by file in one task and leaves fewer bytes; files larger than these are out, and the ranges after it go on in the same way until
    nothing is open. A range is walked once at most; limits that are small against a range need one or two turns.
    """
    possible = files.select("repo_id", "path", F.col("size").cast("long").alias("size"))
    possible = possible.where(F.col("repo_id").isNotNull() & (F.col("size") <= max_bytes))
    rows = ranged(possible, ["repo_id", "path", "size"], [], ranges)
    state = None
    kept = []
    while True:
        if state is None:
            rest = rows.withColumns({"files": F.lit(0).cast("long"), "bytes": F.lit(0).cast("long")})
        else:
            rest = join_lookup(rows, state, ["repo_id"], ["path", "size"], "inner").where(
                (F.col("_part") > F.col("_done")) & (F.col("size") + F.col("bytes") <= max_bytes) & (F.col("files") < max_files))
        sums = rest.groupBy("repo_id", "_part").agg(
            F.first("files").alias("files"), F.first("bytes").alias("bytes"), F.count("*").alias("_n"), F.sum("size").alias("_b"))
        earlier = Window.partitionBy("repo_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        before = {"files": F.col("files") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)),
                  "bytes": F.col("bytes") + F.coalesce(F.sum("_b").over(earlier), F.lit(0))}
        open_files, open_bytes = F.col("files") <= max_files, F.col("bytes") <= max_bytes
        whole = (F.col("files") + F.col("_n") <= max_files) & (F.col("bytes") + F.col("_b") <= max_bytes)
        marks = settle(sums.withColumns(before).where(open_files & open_bytes).select(
            "repo_id", "_part", "files", "bytes", whole.alias("_whole")))
        open_rows = join_lookup(rest.drop("files", "bytes", "_done"), marks, ["repo_id", "_part"], ["path", "size"], "inner")
        kept.append(open_rows.where("_whole").select("repo_id", "path", "size"))
        met = marks.where("not _whole")
        if met.isEmpty():
            return reduce(DataFrame.unionByName, kept)
        walked = settle(_walk_ranges(open_rows.where("not _whole").select("repo_id", "path", "size", "files", "bytes"), max_files, max_bytes))
        kept.append(walked)
        taken = walked.groupBy("repo_id").agg(F.count("*").alias("_n"), F.sum("size").alias("_b"))
        state = settle(met.join(taken, "repo_id", "left").select(
            "repo_id", F.col("_part").alias("_done"), (F.col("files") + F.coalesce("_n", F.lit(0))).alias("files"),
            (F.col("bytes") + F.coalesce("_b", F.lit(0))).alias("bytes")))


def budget_report(candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """Per repository: files and bytes kept, candidates, and whether any were cut."""
    all_files = candidates.groupBy("repo_id").agg(F.count("*").alias("total_candidate_files"))
    used = kept.groupBy("repo_id").agg(F.count("*").alias("files_scanned"), F.sum("size").alias("bytes_scanned"))
    joined = all_files.join(used, "repo_id", "left")
    files = F.coalesce("files_scanned", F.lit(0))
    return joined.select(
        "repo_id", files.alias("files_scanned"), F.coalesce("bytes_scanned", F.lit(0)).alias("bytes_scanned"),
        "total_candidate_files", (F.col("total_candidate_files") > files).alias("truncated"),
    )
