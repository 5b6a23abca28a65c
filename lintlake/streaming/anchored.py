"""Windows anchored at a key's first hit, in parallel even within one key.

A window opens at the first event at or after the previous window's end and
lasts a fixed width. That chain is sequential per key, so it is computed on
chunks as a parallel prefix:

1. events are counted per (key, instant), and the instants are cut into ranges of
   equal rows, in the order of key and time; what a key has in a range is a chunk;
2. each (key, chunk) is summarised as a step function: for every moment the open
   window may end, which window is open when the chunk ends;
3. the few summary rows of a key are folded in order, giving each chunk the
   window it starts in;
4. every chunk assigns its instants to windows.

A task holds the distinct instants of one range, whatever the key and however
dense its events are. A range's border cuts one key at most, so all chunks beyond
the first of their key together are fewer than the ranges: that is what is folded.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.operators.ordered import ranged

NEVER = np.iinfo(np.int64).min


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(key, chunk, other columns as arrays) of each (key, chunk) run, across Arrow batches."""
    held: list[tuple] = []

    def merged():
        arrays = [h[2] for h in held]
        return held[0][0], held[0][1], [np.concatenate(a) for a in zip(*arrays)] if len(held) > 1 else arrays[0]

    for batch in batches:
        keys, chunks = batch["_key"].to_numpy(), batch["_chunk"].to_numpy()
        rest = [batch[c].to_numpy() for c in batch.columns if c not in ("_key", "_chunk")]
        changes = np.flatnonzero((keys[1:] != keys[:-1]) | (chunks[1:] != chunks[:-1])) + 1
        bounds = [0, *changes.tolist(), len(keys)] if len(keys) else []
        for start, stop in zip(bounds, bounds[1:]):
            part = keys[start], chunks[start], [a[start:stop] for a in rest]
            if held and held[0][:2] != part[:2]:
                yield merged()
                held = []
            held.append(part)
    if held:
        yield merged()


def _collected(rows: Iterator[tuple], names: list[str], size: int = 10_000) -> Iterator[pd.DataFrame]:
    """Group (n, scalar or array per column) pieces into frames of a useful size."""
    pieces, held = [], 0

    def frame():
        columns = zip(*[values for _, values in pieces])
        lengths = [n for n, _ in pieces]
        return pd.DataFrame({
            name: np.concatenate([v if isinstance(v, np.ndarray) else np.repeat(np.asarray([v]), n)
                                  for n, v in zip(lengths, column)])
            for name, column in zip(names, columns)
        })

    for piece in rows:
        pieces.append(piece)
        held += piece[0]
        if held >= size:
            yield frame()
            pieces, held = [], 0
    if pieces:
        yield frame()


def _last_windows(ts: np.ndarray, last_entry: int, width: int) -> np.ndarray:
    """For each possible first window (by its index), the index the last window opens at."""
    if last_entry < 4:  # few chains: walk them one by one
        moments, out = ts.tolist(), []
        for entry in range(last_entry + 1):
            while (following := bisect_left(moments, moments[entry] + width)) < len(moments):
                entry = following
            out.append(entry)
        return np.array(out)
    # Follow all chains at once; chains that meet stay together.
    at = owner = np.arange(last_entry + 1)
    while True:
        following = np.searchsorted(ts, ts[at] + width)
        moved = np.where(following < len(ts), following, at)
        if np.array_equal(moved, at):
            return at[owner]
        at, back = np.unique(moved, return_inverse=True)
        owner = back[owner]


def _summaries(width: int):
    def rows(batches):
        for key, chunk, (ts, n) in _segments(batches):
            total, before = int(n.sum()), np.concatenate(([0], np.cumsum(n)))
            # A window that is open when the chunk begins opened before its first instant.
            last_entry = min(int(np.searchsorted(ts, ts[0] + width)), len(ts) - 1)
            final = _last_windows(ts, last_entry, width)
            ends = np.append(np.flatnonzero(np.diff(final)), last_entry)
            yield len(ends), (key, chunk, ts[ends], ts[final[ends]], total - before[final[ends]], total)

    return lambda batches: _collected(rows(batches), ["_key", "_chunk", "_upto", "_anchor", "_open", "_total"])


def _entries(width: int):
    """Fold the summaries of a key in chunk order; one row per chunk with its opening window."""
    def rows(batches):
        current, reset, hits = None, NEVER, 0
        for key, chunk, (upto, anchor, opened, total) in _segments(batches):
            if key != current:
                current, reset, hits = key, NEVER, 0
            yield 1, (key, chunk, NEVER, hits, reset)
            row = int(np.searchsorted(upto, reset))
            if row < len(upto):
                reset, hits = int(anchor[row]) + width, int(opened[row])
            else:
                hits += int(total[0])

    return lambda batches: _collected(rows(batches), ["_key", "_chunk", "_ts", "_n", "_reset"])


def _assign(width: int):
    def rows(batches):
        for key, _, (ts, n, resets) in _segments(batches):
            reset, hits = int(resets[0]), int(n[0])
            ts, n = ts[1:], n[1:]
            before = np.concatenate(([0], np.cumsum(n)))[:-1]
            start, offset = np.empty(len(ts), np.int64), np.empty(len(ts), np.int64)
            moments = ts.tolist()
            i = bisect_left(moments, reset)
            if i:  # instants still inside the window the chunk starts in
                start[:i], offset[:i] = reset - width, before[:i] + hits
            while i < len(ts):
                j = bisect_left(moments, moments[i] + width)
                start[i:j], offset[i:j] = ts[i], before[i:j] - before[i]
                i = j
            yield len(ts), (key, ts, start, offset)

    return lambda batches: _collected(rows(batches), ["_key", "_ts", "_start", "_before"])


def anchored_windows(
    events: DataFrame, key: str, ts: str, order: str, width_seconds: int, ranges: int | None = None
) -> DataFrame:
    """Events plus ``window_start`` and ``hit``, the event's 1-based number in its window.

    ``order`` breaks ties between events of one instant; ``ranges`` sets the number of ranges.
    """
    width = width_seconds * 1_000_000
    kind = events.schema[key].dataType.simpleString()
    stamped = events.withColumn("_key", F.col(key)).withColumn("_ts", F.unix_micros(F.col(ts).cast("timestamp")))
    counted = stamped.groupBy("_key", "_ts").agg(F.count("*").alias("_n"))
    cells = ranged(counted, ["_key"], ["_ts"], ranges).withColumnRenamed("_part", "_chunk").withColumn("_chunk", F.col("_chunk").cast("long"))
    by_chunk = ["_key", "_chunk"]
    summaries = (
        cells.select("_key", "_chunk", "_ts", "_n").repartition(*by_chunk).sortWithinPartitions(*by_chunk, "_ts")
        .mapInPandas(_summaries(width),
                     f"_key {kind}, _chunk long, _upto long, _anchor long, _open long, _total long")
    )
    entries = summaries.repartition("_key").sortWithinPartitions(*by_chunk, "_upto").mapInPandas(
        _entries(width), f"_key {kind}, _chunk long, _ts long, _n long, _reset long"
    )
    assigned = (
        cells.select("_key", "_chunk", "_ts", "_n", F.lit(0).cast("long").alias("_reset")).unionByName(entries)
        .repartition(*by_chunk).sortWithinPartitions(*by_chunk, "_ts")
        .mapInPandas(_assign(width), f"_key {kind}, _ts long, _start long, _before long")
    )
    instant = Window.partitionBy("_key", "_ts").orderBy(order)
    return (
        stamped.join(assigned, ["_key", "_ts"])
        .withColumn("hit", F.col("_before") + F.row_number().over(instant))
        .withColumn("window_start", F.timestamp_micros("_start").cast(events.schema[ts].dataType))
        .drop("_key", "_ts", "_start", "_before")
    )


def _plus(ts: Column, seconds: int) -> Column:
    return ts + F.make_dt_interval(secs=F.lit(seconds))


def rate_key(scope: str, identifier: Column) -> Column:
    return F.left(F.sha2(F.concat(F.lit(scope + ":"), identifier.cast("string")), 256), F.lit(40))


def client_address(forwarded: Column, remote: Column) -> Column:
    """First hop of a forwarded-for list, else the remote address."""
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.when(F.trim(F.coalesce(forwarded, F.lit(""))) != "", first).otherwise(F.coalesce(remote, F.lit("unknown")))


def retry_after(reset_at: Column, now: Column) -> Column:
    micros = F.unix_micros(reset_at.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))
    return F.greatest(F.lit(1).cast("long"), F.ceil(micros / 1_000_000))


def with_verdict(counted: DataFrame, limit: Column, width_seconds: int) -> DataFrame:
    """Adds ok, remaining and reset_at to events with ``hit`` and ``window_start``."""
    return (
        counted.withColumn("ok", F.col("hit") <= limit)
        .withColumn("remaining", F.greatest(F.lit(0).cast("long"), limit - F.col("hit")))
        .withColumn("reset_at", _plus(F.col("window_start"), width_seconds))
    )


def rate_windows(
    events: DataFrame, key: str, limit: int | Column, width_seconds: int, ts: str = "ts", order: str = "event_id"
) -> DataFrame:
    """Events plus window_start, hit, ok, remaining and reset_at."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return with_verdict(anchored_windows(events, key, ts, order, width_seconds), limit, width_seconds)


# Allowed scans per minute and hour.
SIGNED_IN_LIMITS = (12, 200)
ANONYMOUS_LIMITS = (3, 20)


def rate_two_tier(
    events: DataFrame, key: str, signed_in: Column, ts: str = "ts", order: str = "event_id",
    minute_seconds: int = 60, hour_seconds: int = 3600,
    signed_in_limits: tuple[int, int] = SIGNED_IN_LIMITS, anonymous_limits: tuple[int, int] = ANONYMOUS_LIMITS,
) -> DataFrame:
    """Minute limit, then hour limit over what the minute limit let through.

    Adds ``refused_by`` (minute, hour or null) and ``reset_at`` of the refusing
    tier, with ``retry_after`` seconds.
    """
    def limit(tier: int) -> Column:
        return F.when(signed_in, signed_in_limits[tier]).otherwise(anonymous_limits[tier])

    columns = events.columns
    minute = rate_windows(events, key, limit(0), minute_seconds, ts, order)
    passed = minute.where("ok").select(*columns)
    hour = rate_windows(passed, key, limit(1), hour_seconds, ts, order)
    refused = minute.where(~F.col("ok")).select(*columns, F.lit("minute").alias("refused_by"), "reset_at")
    rest = hour.select(*columns, F.when(~F.col("ok"), "hour").alias("refused_by"),
                       F.when(~F.col("ok"), F.col("reset_at")).alias("reset_at"))
    return refused.unionByName(rest).withColumn(
        "retry_after", F.when(F.col("refused_by").isNotNull(), retry_after(F.col("reset_at"), F.col(ts)))
    )


CACHE_SECONDS = 24 * 3600


def ttl_cache(
    lookups: DataFrame, key: str, ttl_seconds: int = CACHE_SECONDS, ts: str = "ts", order: str = "event_id"
) -> DataFrame:
    """Lookups plus ``cache_hit`` and ``expires_at``: a miss stores, later lookups hit until expiry."""
    return (
        anchored_windows(lookups, key, ts, order, ttl_seconds)
        .withColumn("cache_hit", F.col("hit") > 1)
        .withColumn("expires_at", _plus(F.col("window_start"), ttl_seconds))
        .drop("hit", "window_start")
    )
