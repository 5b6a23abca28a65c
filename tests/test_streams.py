"""Windows over events, streaming jobs, sources and sinks."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from lintlake.operators import analytics
from lintlake.operators.scan import scan_files, unique_findings
from lintlake.plans.derived import arrivals
from lintlake.plans.finding_queries import report_totals, sarif_totals
from lintlake.sources import corpus, sinks
from lintlake.streaming import anchored, streams

START = dt.datetime(2024, 1, 1)


def brute(rows, width):
    state, out = {}, {}
    for key, ts, event in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in state or ts >= state[key][0] + dt.timedelta(seconds=width):
            state[key] = [ts, 0]
        state[key][1] += 1
        out[event] = tuple(state[key])
    return out


@pytest.mark.parametrize("seed, width, chunk", [(1, 60, 1), (2, 60, 3), (3, 7, 64), (4, 3600, 1)])
def test_anchored_windows_equal_a_walk(spark, seed, width, chunk):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b"]), START + dt.timedelta(seconds=rng.choice([rng.randint(0, 900), rng.randint(0, 9) * 60])), i)
            for i in range(600)]
    events = spark.createDataFrame(rows, "key string, ts timestamp, event_id long")
    got = anchored.anchored_windows(events, "key", "ts", "event_id", width, chunk).collect()
    assert {r["event_id"]: (r["window_start"], r["hit"]) for r in got} == brute(rows, width)


def test_window_reopens_exactly_at_reset(spark):
    rows = [("k", START + dt.timedelta(seconds=s), i) for i, s in enumerate([0, 59, 60, 119, 121])]
    events = spark.createDataFrame(rows, "key string, ts timestamp, event_id long")
    got = {r["event_id"]: (r["hit"], r["ok"], r["remaining"]) for r in anchored.rate_windows(events, "key", 1, 60).collect()}
    assert got == {0: (1, True, 0), 1: (2, False, 0), 2: (1, True, 0), 3: (2, False, 0), 4: (1, True, 0)}


def run_stream(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream_of_rate_windows_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted(((rng.choice("ab"), START + dt.timedelta(seconds=rng.randint(0, 600)), i) for i in range(200)), key=lambda r: (r[1], r[2]))
    schema = "key string, ts timestamp, event_id long"
    for n in range(4):
        spark.createDataFrame(rows[n * 50:(n + 1) * 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    batch = {r["event_id"]: (r["hit"], r["ok"], r["remaining"], r["reset_at"]) for r in anchored.rate_windows(events, "key", 3, 60).collect()}
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run_stream(streams.rate_windows_stream(source, "key", 3, 60), "limited")
    assert {r["event"]: (r["hit"], r["ok"], r["remaining"], r["reset_at"]) for r in out.collect()} == batch


def test_scan_stream_scans_each_commit_once(spark, tmp_path):
    schema = "repo_id string, path string, content string, size long, sha string"
    rows = [("r", "a.py", "requests.get(u, verify=False)\n", 10, "s1")]
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(2):  # the same commit arrives twice, then a new one
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        streams.scan_stream(streams.read_file_stream(spark, source), target, str(tmp_path / "cp")).awaitTermination(120)
    spark.createDataFrame([("r", "b.php", 'eval($_GET["c"]);', 10, "s2")], schema).coalesce(1).write.mode("append").parquet(source)
    streams.scan_stream(streams.read_file_stream(spark, source), target, str(tmp_path / "cp")).awaitTermination(120)
    found = spark.read.option("basePath", f"{target}/findings").parquet(f"{target}/findings")
    assert sorted((r["rule"], r["file"]) for r in found.collect()) == [("php.eval_user_input", "b.php"), ("py.tls_verify_disabled", "a.py")]


def test_scan_stream_keeps_all_files_of_a_commit(spark, tmp_path):
    schema = "repo_id string, path string, content string, size long, sha string"
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for sha in ("s1", "s2"):
        for n in range(3):
            spark.createDataFrame([("r", f"f{n}.py", "requests.get(u, verify=False)\n", 10, sha)], schema).coalesce(1).write.mode("append").parquet(source)
    streams.scan_stream(streams.read_file_stream(spark, source, 1), target, str(tmp_path / "cp")).awaitTermination(180)
    found = spark.read.option("basePath", f"{target}/findings").parquet(f"{target}/findings")
    assert sorted((r["sha"], r["file"]) for r in found.collect()) == [(s, f"f{n}.py") for s in ("s1", "s2") for n in range(3)]


def test_push_events_from_json(spark, tmp_path):
    repo, inst = {"full_name": "acme/a"}, {"id": 5}
    rows = [{"event": "ping"}, {"event": "push", "ref": "refs/heads/main", "repository": repo, "installation": inst},
            {"event": "pull_request", "action": "opened", "repository": repo, "installation": inst, "pull_request": {"head": {"ref": "fix"}}},
            {"event": "pull_request", "action": "closed", "repository": repo, "installation": inst, "pull_request": {"head": {"ref": "fix"}}},
            {"event": "issues", "repository": repo, "installation": inst}, {"event": "push", "ref": "refs/heads/main", "repository": repo},
            {"event": "push", "ref": "refs/heads/x", "repository": {"full_name": "acme/unknown"}, "installation": inst}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(r) for r in rows))
    out = run_stream(streams.read_push_events(spark, str(tmp_path / "in")), "pushes")
    repos = spark.createDataFrame([("1", "o", "acme/a", START)], "id string, org_id string, full_name string, created_at timestamp")
    joined = streams.events_to_repos(out, repos).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r["event"], r["full_name"], r["ref"], r["status"], r["org_id"]) for r in joined], key=key) == sorted([
        ("issues", "acme/a", None, "ignored_event", "o"), ("pull_request", "acme/a", "fix", None, "o"),
        ("pull_request", "acme/a", "fix", "ignored_action", "o"), ("push", "acme/a", "main", None, "o"),
        ("push", "acme/a", "main", "missing_repo_or_installation", "o"), ("push", "acme/unknown", "x", "not_registered", None)], key=key)


# -------------------------------------------------------------- sources, sinks
def test_corpus_files_from_a_tree(spark, tmp_path):
    def put(path, data):
        full = tmp_path / "tree" / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(data)

    put("one/src/a b+c.py", b"x = 1\n")
    put("one/package.json", b"{}")
    put("one/node_modules/p/i.js", b"no")
    put("one/image.png", b"no")
    put("one/nul.js", b"a\x00b")
    put("two/big.js", b"x" * (201 * 1024))
    put("two/ok.ts", "é\n".encode())
    rows = corpus.corpus_files(spark, str(tmp_path / "tree"), max_file_bytes=200 * 1024).collect()
    assert corpus.corpus_files(spark, str(tmp_path / "tree")).count() == len(rows) + 1
    assert sorted((r["repo_id"], r["path"], r["content"], r["size"]) for r in rows) == [
        ("one", "package.json", "{}", 2), ("one", "src/a b+c.py", "x = 1\n", 6), ("two", "ok.ts", "é\n", 3)]


@pytest.fixture(scope="module")
def findings(files_of):
    files = files_of([("a.py", "requests.get(u, verify=False)\nx = yaml.load(f)\n"), ("b.php", 'eval($_GET["c"]);')])
    return unique_findings(scan_files(files)).withColumn("suppressed", F.col("rule") == "py.yaml_unsafe_load").cache()


def test_sarif(spark, findings):
    scans = spark.createDataFrame([("r",), ("empty",)], "repo_id string")
    docs = {r["repo_id"]: json.loads(r["sarif"]) for r in sinks.sarif_documents(scans, findings).collect()}
    run = docs["r"]["runs"][0]
    assert docs["r"]["version"] == "2.1.0" and docs["empty"]["runs"][0]["results"] == []
    assert [(x["ruleId"], x["level"], x["locations"][0]["physicalLocation"]["region"]["startLine"]) for x in run["results"]] == [
        ("py.tls_verify_disabled", "error", 1), ("php.eval_user_input", "error", 1)]
    assert [x["id"] for x in run["tool"]["driver"]["rules"]] == ["php.eval_user_input", "py.tls_verify_disabled"]


def test_large_scans_go_to_several_whole_documents(spark, findings):
    headers = spark.createDataFrame([("r", 1)], "repo_id string, n int")
    rows = sinks.json_reports(headers, findings, rows_per_document=1).collect()
    ids = [f["id"] for r in rows for f in json.loads(r["json"])["findings"]]
    assert sorted(ids) == sorted(r["id"] for r in findings.collect())
    one = sinks.json_reports(headers, findings).collect()
    assert len(one) == 1 and len(json.loads(one[0]["json"])["findings"]) == 3


def test_totals_come_from_all_parts_of_a_document(spark, findings):
    whole = [r["id"] for r in findings.orderBy(*analytics.SCAN_ORDER).collect()]
    headers = spark.createDataFrame([("r", 1)], "repo_id string, n int")
    for size in (1, 2, 10_000):
        assert [tuple(r) for r in report_totals(sinks.json_reports(headers, findings, rows_per_document=size)).collect()] == [("r", 3, 1, ",".join(whole))]
        documents = sinks.sarif_documents(spark.createDataFrame([("r",), ("empty",)], "repo_id string"), findings, rows_per_document=size)
        assert sorted(tuple(r) for r in sarif_totals(documents).collect()) == [("empty", 0, 0, ""), ("r", 2, 2, "py.tls_verify_disabled")]


def test_lake_table_round_trip(spark, findings, tmp_path):
    scans = spark.createDataFrame([("r", "2024-01-01", 90)], "repo_id string, scan_date string, score int")
    dated = findings.withColumn("scan_date", F.lit("2024-01-01"))
    sinks.write_findings(scans, dated, str(tmp_path / "lake"))
    back = spark.read.parquet(str(tmp_path / "lake" / "findings"))
    assert back.where("scan_date = '2024-01-01'").count() == 3
    assert analytics.severity_counts(back).first()["critical"] == 1
    sinks.audit_append(spark.sql("select 'o' org_id, 'u' user_id, 'scan.create' action, '{}' detail, current_timestamp() created_at"), str(tmp_path / "audit"))
    sinks.audit_append(spark.sql("select 'o' org_id, 'u' user_id, 'scan.delete' action, '{}' detail, current_timestamp() created_at"), str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_one_key_is_cut_into_ranges_of_rows(spark, ranges):
    """A key with nearly all events, dense in places, over any number of ranges; several keys inside one range."""
    rng = random.Random(ranges)
    moments = [rng.choice([rng.randint(0, 300), rng.randint(0, 100_000)]) for _ in range(1500)]
    rows = [(n, "hot" if n % 10 else f"k{n % 70}", moments[n]) for n in range(1500)]
    events = spark.createDataFrame(rows, "event_id long, key string, at long").select("event_id", "key", F.timestamp_seconds("at").alias("ts"))
    want = {}
    for key in {r[1] for r in rows}:
        start = hit = None
        for at, n in sorted((r[2], r[0]) for r in rows if r[1] == key):
            start, hit = (start, hit + 1) if start is not None and at < start + 60 else (at, 1)
            want[n] = (start, hit)
    got = anchored.anchored_windows(events, "key", "ts", "event_id", 60, ranges).select("event_id", F.unix_seconds("window_start").alias("s"), "hit").collect()
    assert {r.event_id: (r.s, r.hit) for r in got} == want


def test_an_arrival_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(0, 6000, 1, 6).withColumn("x", F.col("id") % 10)
    seen = []
    for n, _ in enumerate(arrivals(rows, F.col("id") % 3, 3, str(tmp_path))):
        came = spark.read.parquet(str(tmp_path / "in"))
        seen.append((came.count(), came.where(f"id % 3 > {n}").count(), len(list((tmp_path / "in").glob("*.parquet"))) > n + 1))
    assert seen == [(2000, 0, True), (4000, 0, True), (6000, 0, True)] and came.columns == ["id", "x"]
