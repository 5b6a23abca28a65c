"""Session lookup, rollups from sketches and counts per window, against brute force."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lintlake.operators.rollups import daily_totals, findings_rollup
from lintlake.operators.sessions import sessions_of_requests
from lintlake.streaming.streams import write_findings_per_window

START = dt.datetime(2024, 1, 1)


def at(hours):
    return None if hours is None else START + dt.timedelta(hours=hours)


def brute(requests, sessions):
    out = []
    for rid, user, when in requests:
        fits = [(c, i, o) for i, u, o, c, e in sessions if None not in (user, when, c, e) and u == user and c <= when < e]
        out.append((rid, user, *(max(fits)[1:] if fits else (None, None))))
    return Counter(out)


def found(spark, requests, sessions, **options):
    asked = spark.createDataFrame([(*r, "x") for r in requests], "request_id long, user_id long, ts timestamp, at string").repartition(3)
    opened = spark.createDataFrame([(*s, 1) for s in sessions], "id long, user_id long, org_id string, created_at timestamp, expires_at timestamp, bin int")
    return Counter((r.request_id, r.user_id, r.session_id, r.org_id) for r in sessions_of_requests(asked, opened, **options).collect())


@pytest.mark.parametrize("options", [{}, {"hot_rows": 20}, {"bin_seconds": 3600, "hot_rows": 5}])
def test_sessions_equal_all_pairs(spark, options):
    rng = random.Random(3)
    requests = [(n, 1 if n % 3 else rng.randint(2, 9), at(rng.uniform(-60, 300))) for n in range(600)]
    sessions = [(n, 1 if n % 3 else rng.randint(2, 9), f"o{n % 4}", at(s := rng.uniform(-100, 300)), at(s + rng.choice([0.01, 1, 30, 200]))) for n in range(200)]
    assert found(spark, requests, sessions, **options) == brute(requests, sessions)


def test_odd_sessions_and_requests(spark):
    requests = [(1, 1, at(0)), (1, 1, at(0)), (2, 1, at(5)), (3, None, at(1)), (4, 1, None), (None, 1, at(1)), (5, 9, at(1)), (6, 1, at(-30))]
    sessions = [(10, 1, "a", at(0), at(5)), (11, 1, None, at(0), at(5)), (11, 1, "b", at(2), at(2)), (12, None, "c", at(0), at(9)), (13, 1, "d", at(1), None),
                (14, 1, "e", at(7), at(6)), (15, 1, "f", at(-10_000), at(10_000_000))]
    assert found(spark, requests, sessions) == brute(requests, sessions)
    assert found(spark, requests, []) == brute(requests, []) and found(spark, [], sessions) == Counter()


def test_sessions_are_joined_without_pairs(spark):
    asked = spark.createDataFrame([], "request_id long, user_id long, ts timestamp")
    opened = spark.createDataFrame([], "id long, user_id long, org_id string, created_at timestamp, expires_at timestamp")
    plan = sessions_of_requests(asked, opened)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") <= 1  # the one row of the requests' span


def test_totals_from_sketches(spark):
    rows = [(n % 3, f"r{n % 2}", None if n % 50 == 0 else f"rule{n % 5}", "high" if n % 4 else "low", f"file{n * 7919 % 9000}") for n in range(30_000)]
    findings = spark.createDataFrame(rows, "day int, repo_id string, rule string, severity string, file string").repartition(4)
    totals = daily_totals(findings).cache()
    sets = [("repo_id",), ("day", "rule"), ("severity", "day"), ()]
    for r in findings_rollup(totals, sets).collect():
        names = [n for n in r.grouping.split(",") if n]
        mine = [x for x in rows if all(x[("day", "repo_id", "rule", "severity").index(n)] == r[n] for n in names)]
        exact = len({x[4] for x in mine})
        assert r.n == len(mine) and abs(r.distinct_files - exact) <= 4 * 0.0065 * exact + 1
    # Days added later change nothing in what is stored.
    more = daily_totals(findings.where("day = 0").withColumn("day", F.lit(9)))
    both = {r.grouping: r for r in findings_rollup(totals.unionByName(more), [()]).collect()}
    alone = {r.grouping: r for r in findings_rollup(totals, [()]).collect()}
    assert both[""].n > alone[""].n and both[""].distinct_files == alone[""].distinct_files
    empty = findings_rollup(totals.limit(0), [(), ("rule",)]).collect()
    assert [(r.grouping, r.n, r.distinct_files) for r in empty] == [("", 0, 0)]


def test_distinct_counts_are_exact(spark):
    findings = spark.range(40_000).selectExpr(
        "id % 3 AS day", "'r' AS repo_id", "concat('rule', id % 5) AS rule", "'high' AS severity", "concat('file', id % 9000) AS file")
    totals = daily_totals(findings.unionByName(findings.limit(1).withColumn("file", F.lit(None).cast("string"))))
    counts = {(r.rule, r.day): (r.n, r.distinct_files) for r in findings_rollup(totals, [("rule",), ("day",), ()]).collect()}
    by_rule = {(f"rule{n}", None): (8000 + (n == 0), 1800) for n in range(5)}
    by_day = {(None, n): (sum(1 for i in range(n, 40_000, 3)) + (n == 0), 3000) for n in range(3)}
    assert counts == by_rule | by_day | {(None, None): (40_001, 9000)}


def test_windows_are_counted_once(spark, tmp_path):
    schema = "id long, ts timestamp, severity string"
    batches = [[(1, at(1), "high"), (2, at(2), "low"), (1, at(1), "high")], [(3, at(20), "high"), (2, at(2), "low"), (4, None, "low")],
               [(5, at(26), "low"), (6, at(49), "high")], [(7, at(3), "high")]]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for n, batch in enumerate(batches):  # the last batch comes after its window has closed
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        write_findings_per_window(source, out, checkpoint, late="30 hours").awaitTermination()
    spark.createDataFrame([(8, at(500), "low")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    write_findings_per_window(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), out, checkpoint, late="30 hours").awaitTermination()
    rows = Counter({(r.window_start, r.severity): r.n for r in spark.read.parquet(out).collect()})
    assert rows == Counter({(at(0), "high"): 2, (at(0), "low"): 1, (at(24), "low"): 1, (at(48), "high"): 1})
