"""The session each request was made in: an interval join as a sweep over time bins."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN_SECONDS = 86_400
HOT_ROWS = 500_000


def sessions_of_requests(
    requests: DataFrame, sessions: DataFrame, bin_seconds: int = BIN_SECONDS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(request_id, user_id, ts, session_id, org_id): each request with its user's session open at that instant.

    ``requests`` is (request_id, user_id, ts), ``sessions`` (id, user_id, org_id, created_at, expires_at). A session is open from
    its creation until just before its expiry; of several the one created last counts, of equal ones the greatest id. Requests
    outside any session, without user or without time keep null. Sessions without end, or that end before they begin, are never open.

    Time is cut into bins; a session stands in every bin it overlaps, within the span of the requests. Each user's bin is swept
    in time order with a heap of open sessions, so no pairs of requests and sessions are made. Requests of a bin with more than
    ``hot_rows`` of them are dealt over several tasks, each with the bin's sessions.
    """
    width = bin_seconds * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    asked = requests.select("request_id", "user_id", "ts", micros("ts").alias("at")).withColumn("bin", F.expr(f"at div {width} - IF(at % {width} < 0, 1, 0)"))
    span = asked.agg(F.min("bin").alias("low"), F.max("bin").alias("high"))
    hot = asked.where("user_id IS NOT NULL").groupBy("user_id", "bin").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select(
        "user_id", "bin", F.ceil(F.col("n") / hot_rows).cast("int").alias("shares"))
    asked = asked.join(hot, ["user_id", "bin"], "left").withColumn(
        "share", F.pmod(F.xxhash64("request_id", "at"), F.when(F.col("user_id").isNull() | F.col("at").isNull(), 64).otherwise(F.coalesce("shares", F.lit(1)))).cast("int")
    ).drop("shares")
    opened = sessions.select("user_id", F.col("id").alias("session_id"), "org_id", micros("created_at").alias("at"),
                             micros("expires_at").alias("until")).where("user_id IS NOT NULL AND at < until").crossJoin(F.broadcast(span))  # one row
    opened = opened.withColumn("first", F.greatest(F.expr(f"at div {width} - IF(at % {width} < 0, 1, 0)"), "low")).withColumn(
        "last", F.least(F.expr(f"(until - 1) div {width} - IF((until - 1) % {width} < 0, 1, 0)"), "high")).where("first <= last")
    opened = opened.withColumn("bin", F.explode(F.sequence("first", "last"))).join(hot, ["user_id", "bin"], "left").withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)))
    kinds = {c: df.schema[c].dataType.simpleString() for df, names in (
        (requests, ("request_id", "user_id", "ts")), (opened, ("session_id", "org_id"))) for c in names}
    both = opened.select("user_id", "bin", "share", "at", F.lit(0).alias("kind"), "until", "session_id", "org_id").unionByName(
        asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    # Sessions that begin at an instant come before its requests.
    swept = both.repartition("user_id", "bin", "share").sortWithinPartitions("user_id", "bin", "share", "at", "kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_sessions = None, []
        for batch in batches:
            user, bins, shares, at, kind, until, session, org = (batch.column(c).to_pylist() for c in (
                "user_id", "bin", "share", "at", "kind", "until", "session_id", "org_id"))
            rows, found = [], []
            for n in range(batch.num_rows):
                if (user[n], bins[n], shares[n]) != key:
                    key, open_sessions = (user[n], bins[n], shares[n]), []
                if not kind[n]:
                    heapq.heappush(open_sessions, _Open(at[n], session[n], until[n], org[n]))
                    continue
                while open_sessions and at[n] is not None and open_sessions[0].until <= at[n]:
                    heapq.heappop(open_sessions)  # time goes on: it never opens again
                best = open_sessions[0] if open_sessions and at[n] is not None and user[n] is not None else None
                rows.append(n)
                found.append((best.session, best.org) if best else (None, None))
            kept = batch.select(["request_id", "user_id", "ts"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, *[pa.array([f[n] for f in found], batch.schema.field(c).type) for n, c in enumerate(("session_id", "org_id"))]],
                names=["request_id", "user_id", "ts", "session_id", "org_id"])

    return swept.mapInArrow(sweep, ", ".join(f"{c} {kinds[c]}" for c in ("request_id", "user_id", "ts", "session_id", "org_id")))


class _Open:
    """An open session; the one created last is the least, of equal ones the greatest id."""

    __slots__ = ("created", "session", "until", "org")

    def __init__(self, created: int, session, until: int, org) -> None:
        self.created, self.session, self.until, self.org = created, session, until, org

    def __lt__(self, other: _Open) -> bool:
        return (self.created, self.session) > (other.created, other.session)
