"""Structured Streaming: rate windows, cache lookups, scan on arrival, push events."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lintlake.operators.joins import join_lookup
from lintlake.operators.rules import RULEBOOK, Rule
from lintlake.operators.scan import scan_files, unique_findings
from lintlake.schemas import FILES, PUSH_EVENTS
from lintlake.session import remove_folder, settled_under
from lintlake.streaming.anchored import anchored_windows, with_verdict


def rate_windows_stream(
    events: DataFrame, key: str, limit: int, width_seconds: int, ts: str = "ts", order: str = "event_id",
    watermark: str = "10 minutes",
) -> DataFrame:
    """Anchored rate windows over a stream, one state row per live key.

    State is the open window's reset time and count; it expires when the
    watermark passes the reset. Events later than the watermark are dropped by
    Spark and show up in the query's progress metrics. Equal to ``rate_windows``
    when batches arrive in time order.
    """
    kind = events.schema[key].dataType.simpleString()
    order_kind = events.schema[order].dataType.simpleString()
    width = pd.Timedelta(seconds=width_seconds)

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # Spark hands over a key's rows of the micro-batch unordered; the trigger bounds them.
        rows = pd.concat(list(batches)).sort_values(["_ts", "_order"])
        reset_us, count = state.get if state.exists else (-1, 0)
        reset = pd.Timestamp(reset_us, unit="us") if reset_us >= 0 else None
        out = []
        for moment, tie in zip(rows["_ts"], rows["_order"]):
            if reset is None or moment >= reset:
                reset, count = moment + width, 0
            count += 1
            out.append((keys[0], tie, moment, count, count <= limit, max(0, limit - count), reset))
        state.update((int(reset.value // 1000), count))
        state.setTimeoutTimestamp(max(int(reset.value // 1_000_000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "event", "ts", "hit", "ok", "remaining", "reset_at"])

    stamped = events.select(
        F.col(key).alias("_key"), F.col(ts).cast("timestamp").alias("_ts"), F.col(order).alias("_order")
    ).withWatermark("_ts", watermark)
    return stamped.groupBy("_key").applyInPandasWithState(
        run,
        f"key {kind}, event {order_kind}, ts timestamp, hit long, ok boolean, remaining long, reset_at timestamp",
        "reset_us long, count long", "append", GroupStateTimeout.EventTimeTimeout,
    )


def ttl_cache_stream(
    lookups: DataFrame, key: str, ttl_seconds: int, ts: str = "ts", order: str = "event_id", watermark: str = "10 minutes"
) -> DataFrame:
    """Cache lookups over a stream: the first of a window stores, the others hit."""
    windows = rate_windows_stream(lookups, key, 1, ttl_seconds, ts, order, watermark)
    return windows.select("key", "event", "ts", (F.col("hit") > 1).alias("cache_hit"), F.col("reset_at").alias("expires_at"))


def write_rate_windows(
    events: DataFrame, key: str, limit: int, width_seconds: int, target: str, checkpoint: str, ts: str = "ts",
    order: str = "event_id", delay_seconds: int = 600, trigger: dict | None = None,
):
    """Anchored rate windows of a stream, equal to ``rate_windows`` whatever order the events arrive in; returns the started query.

    An event is decided once the clock, the latest time seen, is more than ``delay_seconds`` past it; until then it waits. So all
    events before the decided time are known when a window is opened. Decided events go to ``target/windows`` with the columns
    that ``rate_windows`` adds. Events older than the decided time of the batches before theirs, and events without a key or a
    time, go to ``target/late`` with ``late_reason`` (late, incomplete): every event is in exactly one of the two, or waits.

    Each micro-batch runs the parallel form over its due events, so a key that has nearly all of them is spread over tasks. What
    goes on to the next batch is waiting events and one row per key whose window is still open; neither grows with history. Every
    batch overwrites its own folders, so one that is run again leaves the same rows. Of older state only the last batch's is kept.
    """
    columns, kind, time_kind = events.columns, events.schema[key].dataType, events.schema[ts].dataType
    row_schema = StructType([*events.schema.fields, StructField("late_reason", StringType())])
    open_schema = StructType([StructField(key, kind), StructField("_opened", time_kind), StructField("_hits", LongType())])
    moment = F.unix_micros(F.col(ts).cast("timestamp"))
    ends = F.unix_micros(F.col("_opened").cast("timestamp")) + F.lit(width_seconds * 1_000_000)

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def place(table: str, number: int = batch_id) -> str:
            return f"{target}/{table}/batch_id={number}"

        def kept(table: str, schema, number: int = batch_id) -> DataFrame:
            return spark.read.schema(schema).parquet(place(table, number))

        clock = kept("state/clock", "clock long", batch_id - 1).first()["clock"] if batch_id else None
        decided = F.lit(None if clock is None else clock - delay_seconds * 1_000_000).cast("long")
        reason = F.when(F.col(key).isNull() | F.col(ts).isNull(), "incomplete").when(moment < decided, "late")
        rows = batch.select(*columns, reason.cast("string").alias("late_reason"))
        opened = spark.createDataFrame([], open_schema)
        if batch_id:
            waiting = kept("state/rows", row_schema, batch_id - 1).where(F.col("late_reason").isNull() & (moment >= decided))
            opened = kept("state/open", open_schema, batch_id - 1)
            rows = rows.unionByName(waiting)
        rows.write.mode("overwrite").parquet(place("state/rows"))
        rows = kept("state/rows", row_schema)
        rows.where("late_reason IS NOT NULL").write.mode("overwrite").parquet(place("late"))
        on_time = rows.where("late_reason IS NULL").drop("late_reason")
        latest = on_time.agg(F.max(moment).alias("latest")).first()["latest"]
        clock = max((c for c in (clock, latest) if c is not None), default=None)
        until = F.lit(None if clock is None else clock - delay_seconds * 1_000_000).cast("long")
        with settled_under(spark, place("state/work")):
            # An open window comes back as one event at its start, which is first among the key's events.
            seeds = opened.select(key, F.col("_opened").alias(ts), F.lit(True).alias("_seed"))
            due = on_time.where(moment < until).withColumn("_seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True)
            counted = anchored_windows(due, key, ts, order, width_seconds).where("NOT _seed").drop("_seed")
            joined = join_lookup(counted, opened, [key], [order, ts])
            carried = F.when(F.col("window_start") == F.col("_opened"), F.col("_hits") - 1).otherwise(0)
            hit = F.col("hit") + carried
            judged = joined.select(*columns, "window_start", hit.alias("hit"))
            judged = with_verdict(judged, F.lit(limit), width_seconds)
            judged.write.mode("overwrite").parquet(place("windows"))
        known = kept("windows", judged.schema).select(key, F.col("window_start").alias("_opened"), F.col("hit").alias("_hits"))
        last = known.unionByName(opened).groupBy(key).agg(F.max(F.struct("_opened", "_hits")).alias("_last"))
        last.select(key, "_last.*").where(ends > until).write.mode("overwrite").parquet(place("state/open"))
        spark.createDataFrame([(clock,)], "clock long").write.mode("overwrite").parquet(place("state/clock"))
        for table in ("rows", "open", "clock"):
            remove_folder(spark, place(f"state/{table}", batch_id - 2))

    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(decide)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_file_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Arriving file rows, with the commit they belong to and ``arrived_at``, the time their input file was written."""
    schema = FILES.add("sha", "string") if "sha" not in FILES.fieldNames() else FILES
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return rows.select("*", F.col("_metadata.file_modification_time").alias("arrived_at"))


BETWEEN = "\u0001"  # between a repository and a commit


def scan_stream(
    files: DataFrame, target: str, checkpoint: str, rulebook: Sequence[Rule] = RULEBOOK, trigger: dict | None = None,
    remember: str | None = None,
):
    """Scan arriving files and append findings; returns the started query.

    Findings carry the commit. A (repo_id, sha, path) seen before, nulls being
    equal, is not scanned again, so the files of a commit may arrive over many
    batches. What was seen is keyed state of the stream: a batch costs what it
    brings, not what came before. ``remember`` ("30 days") drops keys when
    ``arrived_at`` has moved on by that much, which bounds the state; without it
    they are kept for good. Each micro-batch overwrites its own partition, so a
    replayed batch leaves the same rows.
    """
    place = ["repo_id", "sha", "path"]
    fresh = files.dropDuplicates(place) if remember is None else files.withWatermark(
        "arrived_at", remember).dropDuplicatesWithinWatermark(place)

    def scan_batch(batch: DataFrame, batch_id: int) -> None:
        # A commit is scanned as a repository of its own; ids don't depend on the name.
        commit = F.concat_ws(BETWEEN, "repo_id", F.coalesce("sha", F.lit("")))
        with settled_under(batch.sparkSession, f"{target}/work/batch_id={batch_id}"):
            found = unique_findings(scan_files(batch.select(commit.alias("repo_id"), "path", "content"), rulebook))
            named = found.withColumn("sha", F.substring_index("repo_id", BETWEEN, -1)).withColumn(
                "repo_id", F.substring_index("repo_id", BETWEEN, 1))
            named.write.mode("overwrite").parquet(f"{target}/findings/batch_id={batch_id}")

    writer = fresh.writeStream.option("checkpointLocation", checkpoint).foreachBatch(scan_batch)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


# The webhook actions that start a scan.
PULL_REQUEST_ACTIONS = ("opened", "synchronize", "reopened")


def push_events(raw: DataFrame) -> DataFrame:
    """(event, full_name, installation_id, ref, status) of webhook rows, batch or stream.

    Pings and installation changes are dropped; ``status`` says why a row does
    not lead to a scan, or is null.
    """
    event, action = F.col("event"), F.col("action")
    ref = F.when(event == "pull_request", F.col("pull_request.head.ref")).otherwise(
        F.regexp_replace("ref", r"^refs/heads/", "")
    )
    status = (
        F.when(~event.isin("push", "pull_request"), "ignored_event")
        .when(F.col("repository.full_name").isNull() | F.col("installation.id").isNull(), "missing_repo_or_installation")
        .when((event == "pull_request") & ~F.coalesce(action.isin(*PULL_REQUEST_ACTIONS), F.lit(False)), "ignored_action")
    )
    return raw.where(
        ~F.coalesce(event.isin("ping", "installation", "installation_repositories"), F.lit(False))
    ).select("event", F.col("repository.full_name").alias("full_name"), F.col("installation.id").alias("installation_id"),
             ref.alias("ref"), status.alias("status"))


def read_push_events(spark: SparkSession, path: str) -> DataFrame:
    return push_events(spark.readStream.schema(PUSH_EVENTS).json(path))


def events_to_repos(events: DataFrame, repositories: DataFrame) -> DataFrame:
    """Attach the registered workspace of each event's repository, or ``not_registered``.

    A repository registered twice counts once: its earliest registration.
    """
    first = repositories.groupBy("full_name").agg(
        F.min_by("org_id", F.struct("created_at", "id")).alias("org_id")
    )
    joined = join_lookup(events, first, ["full_name"], ["event", "ref", "installation_id"])
    # An unregistered repository is answered before the action is looked at.
    before = F.col("status").isin("ignored_event", "missing_repo_or_installation")
    status = F.when(before, F.col("status")).when(F.col("org_id").isNull(), "not_registered").otherwise(F.col("status"))
    return joined.withColumn("status", status)


def findings_per_window(findings: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, severity, n) of a stream of findings (id, ts, severity), each id counted once.

    Event-time windows in append mode: a window is written once, when the watermark, ``late`` behind the latest event seen, has
    passed its end. Repeated ids within that delay are dropped; state for ids and windows older than it is removed.
    """
    seen = findings.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
    return seen.groupBy(F.window("ts", width), "severity").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), "severity", "n")


def write_findings_per_window(findings: DataFrame, target: str, checkpoint: str, width: str = "1 day", late: str = "1 hour", trigger: dict | None = None):
    """Appends closed windows to a Parquet folder, each exactly once; returns the started query."""
    counts = findings_per_window(findings, width, late)
    writer = counts.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
