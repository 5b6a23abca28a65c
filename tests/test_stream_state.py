"""Streams that carry state from batch to batch, and writes that may be repeated."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from lintlake.session import settle, settled_under
from lintlake.sources import sinks
from lintlake.streaming import streams

START = dt.datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp, event_id long"


def walk(rows, width, limit):
    """(hit, ok, reset) of each event, one after the other."""
    opened, out = {}, {}
    for key, ts, event in sorted(rows, key=lambda r: (r[1], r[2])):
        start, hit = opened.get(key, (None, 0))
        if start is None or ts >= start + dt.timedelta(seconds=width):
            start, hit = ts, 0
        opened[key] = (start, hit + 1)
        out[event] = (hit + 1, hit + 1 <= limit, start + dt.timedelta(seconds=width))
    return out


def arrive(spark, path, batches):
    for rows in batches:  # one file each, in this order
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, limit=3, width=60, delay=100):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.write_rate_windows(source, "key", limit, width, str(tmp_path / "out"), str(tmp_path / "cp"), delay_seconds=delay).awaitTermination(600)
    decided = spark.read.parquet(str(tmp_path / "out" / "windows")).collect()
    late = spark.read.parquet(str(tmp_path / "out" / "late")).collect()
    return {r["event_id"]: (r["hit"], r["ok"], r["reset_at"]) for r in decided}, {r["event_id"]: r["late_reason"] for r in late}


@pytest.mark.parametrize("seed, width", [(1, 60), (2, 500)])
def test_windows_of_a_disordered_stream_equal_a_walk(spark, tmp_path, seed, width):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b"]), START + dt.timedelta(seconds=rng.randint(0, 900)), i) for i in range(300)]
    rows.sort(key=lambda r: r[1] + dt.timedelta(seconds=rng.randint(0, 99)))
    arrive(spark, str(tmp_path / "in"), [rows[n:n + 100] for n in range(0, 300, 100)])
    decided, late = run(spark, tmp_path, width=width)
    until = max(r[1] for r in rows) - dt.timedelta(seconds=100)
    assert decided == {e: v for e, v in walk(rows, width, 3).items() if next(r for r in rows if r[2] == e)[1] < until}
    assert late == {}


def test_late_and_incomplete_events_are_kept_apart(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    arrive(spark, str(tmp_path / "in"), [
        [("k", at(0), 1), ("k", at(30), 2), ("k", at(200), 3), (None, at(5), 4), ("k", None, 5)],
        [("k", at(99), 6), ("k", at(100), 7)],  # all before 100 is decided
        [("k", at(1000), 8)],
    ])
    decided, late = run(spark, tmp_path)
    assert late == {4: "incomplete", 5: "incomplete", 6: "late"}
    assert decided == walk([("k", at(s), e) for s, e in ((0, 1), (30, 2), (100, 7), (200, 3))], 60, 3)


def test_a_window_goes_on_in_later_batches_and_restarts(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [("k", at(s), s) for s in (0, 10, 20, 30, 40, 70, 80, 90, 125, 126, 500)]
    for n, part in enumerate((rows[:3], rows[3:6], rows[6:9], rows[9:])):  # a run of its own for each
        arrive(spark, str(tmp_path / "in"), [part])
        decided, late = run(spark, tmp_path, delay=0)
    assert decided == walk(rows[:-1], 60, 3) and late == {}
    state = tmp_path / "out" / "state"
    assert sorted(os.listdir(state / "open")) == ["batch_id=2", "batch_id=3"] and not any((state / "work").iterdir())


def test_streams_of_nothing(spark, tmp_path):
    arrive(spark, str(tmp_path / "in"), [[], [(None, None, 1)], [("k", START, 2)]])
    decided, late = run(spark, tmp_path)
    assert decided == {} and late == {1: "incomplete"}


def test_files_seen_before_are_not_scanned_again(spark, tmp_path):
    schema = "repo_id string, path string, content string, size long, sha string"
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    text = "requests.get(u, verify=False)\n"
    deliveries = [[("r", "a.py", text, 1, "s1"), ("r", "n.py", text, 1, None)], [("r", "a.py", text, 1, "s1"), ("r", "n.py", text, 1, None)],
                  [("r", "a.py", text, 1, "s2"), ("r", "b.py", text, 1, "s1")]]
    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        streams.scan_stream(streams.read_file_stream(spark, source), target, str(tmp_path / "cp"), remember="30 days").awaitTermination(300)
    found = spark.read.option("basePath", f"{target}/findings").parquet(f"{target}/findings").collect()
    # Batches without input, which move the watermark, are numbered too.
    assert sorted((r["sha"], r["file"]) for r in found) == [("", "n.py"), ("s1", "a.py"), ("s1", "b.py"), ("s2", "a.py")]


def test_a_batch_written_twice_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "lake")
    findings = spark.createDataFrame([("r", "x", "2024-01-01"), ("r", "y", "2024-01-02"), (None, "z", None)], "repo_id string, rule string, scan_date string")
    scans = findings.select("repo_id", "scan_date")
    for batch in ("b1", "b2", "b1", "b1"):
        sinks.write_findings(scans, findings, path, batch_id=batch)
    back = spark.read.parquet(f"{path}/findings")
    assert sorted((r["batch_id"], r["rule"]) for r in back.collect()) == [(b, r) for b in ("b1", "b2") for r in "xyz"]
    assert spark.read.parquet(f"{path}/scans").count() == 6
    sinks.write_findings(scans.limit(0), findings.limit(0), path, batch_id="b3")
    assert spark.read.parquet(f"{path}/findings").count() == 6
    audit, rows = str(tmp_path / "audit"), spark.sql("""SELECT 'o' org_id, 'u' user_id, 'scan.create' action, '{}' detail,
        explode(array(timestamp'2024-01-01 10:00:00', timestamp'2024-01-02 00:00:00', null)) created_at""")
    for batch in ("m", "n", "m"):
        sinks.audit_append(rows, audit, batch_id=batch)
    got = spark.read.parquet(audit).groupBy("created_on", "batch_id").count().collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == sorted((d, b, 1) for d in ("2024-01-01", "2024-01-02", "None") for b in "mn")


def test_work_tables_go_with_their_block(spark, tmp_path):
    folder = str(tmp_path / "work")
    with settled_under(spark, folder):
        assert settle(spark.range(3)).agg(F.sum("id")).first()[0] == 3 and os.listdir(folder)
    assert not os.path.exists(folder)
    with pytest.raises(ValueError), settled_under(spark, folder):
        settle(spark.range(1))
        raise ValueError
    assert not os.path.exists(folder)
    assert settle(spark.range(2)).count() == 2
