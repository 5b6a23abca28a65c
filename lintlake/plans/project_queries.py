"""Registered queries: dependencies, migrations, workspaces, histories, windows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.versions import clean_version, vuln_severity
from lintlake.operators import analytics as an
from lintlake.operators import dependencies as dp
from lintlake.operators import migrations as mg
from lintlake.operators import tenancy as tn
from lintlake.operators.reachability import label_propagation
from lintlake.operators.sessions import sessions_of_requests
from lintlake.plans import checks as ck
from lintlake.plans.derived import arrivals, fill, table
from lintlake.plans.registry import register
from lintlake.session import ensure_checkpoint_dir, settle
from lintlake.sources import sinks
from lintlake.streaming import anchored as aw
from lintlake.streaming import streams

# ---------------------------------------------------------------- dependencies
MANIFESTS = [
    ("requirements.txt", "# pinned\nreq-{n}==1.{m}.0  # note\nflask>=2.0\nReq_{m} == {n}.1\n"),
    ("web/package.json", '{"name":"x","dependencies":{"left-{n}":"^1.{m}.0","git-dep":"github:a/b"},"devDependencies":{"dev-{m}":" ~2.{n}.1 <3"}}'),
    ("package-lock.json", '{"packages":{"":{"version":"1.0.0"},"node_modules/a{n}":{"version":"1.{m}.0"},"node_modules/a{n}/node_modules/b{m}":{"version":"2.0.{n}"}}}'),
    ("old/package-lock.json", '{"dependencies":{"left-{n}":{"version":"1.{m}.0"}}}'),
    ("Gemfile.lock", "GEM\n  remote: https://rubygems.org/\n  specs:\n    rails (7.{m}.0)\n      dep (>= 1)\n    RedCloth (4.{n}.1)\n\nPLATFORMS\n  ruby\n\nDEPENDENCIES\n    notgem (1.0)\n"),
    ("go.mod", "module x\n\nrequire (\n\tgithub.com/a/p{n} v1.{m}.0\n\tgithub.com/b/q v0.{n}.0 // indirect\n)\n\nrequire github.com/z/z v9.9.9\n"),
    ("package.json", '{"dependencies": {'),
]
# The entries each manifest must yield: (manifest, ecosystem, name, version) in SQL.
ENTRIES = [
    (0, "PyPI", "'req-' || n", "'1.' || m || '.0'"), (0, "PyPI", "'Req_' || m", "n || '.1'"),
    (1, "npm", "'left-' || n", "'1.' || m || '.0'"), (1, "npm", "'dev-' || m", "'2.' || n || '.1'"),
    (2, "npm", "'a' || n", "'1.' || m || '.0'"), (2, "npm", "'b' || m", "'2.0.' || n"),
    (3, "npm", "'left-' || n", "'1.' || m || '.0'"),
    (4, "RubyGems", "'rails'", "'7.' || m || '.0'"), (4, "RubyGems", "'RedCloth'", "'4.' || n || '.1'"),
    (5, "Go", "'github.com/a/p' || n", "'1.' || m || '.0'"), (5, "Go", "'github.com/b/q'", "'0.' || n || '.0'"),
]


def derived_manifests(spark, sf_dir) -> DataFrame:
    """Three manifests of every customer's repository, in rotation."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))).alias("step"))
    names = {"n": F.col("c_nationkey").cast("string"), "m": (F.col("c_custkey") % 10).cast("string")}
    picked = F.element_at(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("text")) for p, t in MANIFESTS]),
                          ((F.col("c_custkey") + F.col("step")) % len(MANIFESTS) + 1).cast("int"))
    return customers.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("repo_id"), picked["path"].alias("path"),
        fill(picked["text"], names).alias("content"))


def entries_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT repo_id, '{MANIFESTS[k][0]}' AS path, {i} AS pos, '{eco}' AS ecosystem, {name} AS name, {version} AS version FROM base WHERE k = {k}"
        for i, (k, eco, name, version) in enumerate(ENTRIES))
    return (f"WITH base AS (SELECT 'c' || c_custkey AS repo_id, (c_custkey + step) % {len(MANIFESTS)} AS k, CAST(c_nationkey AS VARCHAR) AS n, "
            f"CAST(c_custkey % 10 AS VARCHAR) AS m FROM customer, (VALUES (0), (1), (3)) s(step)), entries AS ({parts})")


@register("dependency_inventory", entries_sql() + " SELECT repo_id, path, ecosystem, name, version FROM entries")
def dependency_inventory(spark, sf_dir):
    return dp.dependency_inventory(derived_manifests(spark, sf_dir)).select("repo_id", "path", "ecosystem", "name", "version")


FIRST_PATH = " SELECT repo_id, min(path) AS path, ecosystem, name, version FROM entries GROUP BY repo_id, ecosystem, name, version"


@register("distinct_dependencies", entries_sql() + FIRST_PATH)
def distinct_dependencies(spark, sf_dir):
    return dp.distinct_dependencies(dp.dependency_inventory(derived_manifests(spark, sf_dir))).select(
        "repo_id", "path", "ecosystem", "name", "version")


NOW = "2024-01-05 00:00:00"


def derived_advisories(spark, sf_dir) -> DataFrame:
    """Cached advisories of the left-* packages: four each."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 10).alias("m")).distinct()
    label = F.concat(F.col("n").cast("string"), F.lit("-"), F.col("m").cast("string"))

    def vuln(i, summary, severity, db, refs, ranges):
        return F.struct(F.concat(F.lit(f"V{i}-"), label).alias("id"), summary.alias("summary"),
                        severity.cast("array<struct<type:string,score:string>>").alias("severity"),
                        db.cast("array<string>").alias("db_severity"), refs.cast("array<string>").alias("references"), F.lit(ranges).alias("has_ranges"))

    score = F.concat(F.col("m").cast("string"), F.lit(".5"))
    vulns = F.array(
        vuln(1, F.concat(F.lit("Issue in left-"), F.col("n").cast("string")), F.array(F.struct(F.lit("CVSS_V3").alias("type"), score.alias("score"))),
             F.array(), F.array(F.concat(F.lit("https://advice.example/"), label)), True),
        vuln(2, F.lit(""), F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.lit("CVSS:3.1/AV:N/AC:L").alias("score"))), F.array(F.lit("HIGH")), F.array(), False),
        vuln(3, F.lit("Plain"), F.array(), F.array(), F.array(), False),
        vuln(4, F.lit("Beyond the services limit"), F.array(), F.array(), F.array(), False))
    return keys.select(
        F.lit("npm").alias("ecosystem"), F.concat(F.lit("left-"), F.col("n").cast("string")).alias("package_name"),
        F.concat(F.lit("1."), F.col("m").cast("string"), F.lit(".0")).alias("version"), vulns.alias("vulns"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("m").cast("int"))).alias("expires_at"))


SCORE_BAND = "CASE WHEN CAST(m AS INTEGER) + 0.5 >= 9 THEN 'critical' WHEN CAST(m AS INTEGER) + 0.5 >= 7 THEN 'high' WHEN CAST(m AS INTEGER) + 0.5 >= 4 THEN 'medium' ELSE 'low' END"


@register("dependency_advisories", f"""{entries_sql()}, firsts AS ({FIRST_PATH}),
    live AS (SELECT f.*, substr(name, 6) AS n, split_part(version, '.', 2) AS m FROM firsts f WHERE name LIKE 'left-%'
      AND TIMESTAMP '2024-01-01' + to_days(CAST(split_part(version, '.', 2) AS INTEGER)) > TIMESTAMP '{NOW}')
    SELECT repo_id, path AS file, 'deps.cve.V' || i || '-' || n || '-' || m AS rule,
      CASE i WHEN 1 THEN {SCORE_BAND} WHEN 2 THEN 'high' ELSE 'medium' END AS severity,
      name || '@' || version || ': ' || CASE i WHEN 1 THEN 'Issue in left-' || n WHEN 2 THEN 'V2-' || n || '-' || m WHEN 3 THEN 'Plain' ELSE 'Beyond the services limit' END AS title,
      name || '@' || version || ' (npm) — V' || i || '-' || n || '-' || m AS evidence,
      CASE i WHEN 1 THEN 'https://advice.example/' || n || '-' || m ELSE 'https://osv.dev/V' || i || '-' || n || '-' || m END AS refs,
      CASE i WHEN 1 THEN 'Upgrade ' || name || ' past the affected range. See https://advice.example/' || n || '-' || m || '.'
        ELSE 'Review and upgrade ' || name || ' to a non-affected version.' END AS fix,
      CAST(least(99, 94 + CASE CASE i WHEN 1 THEN {SCORE_BAND} WHEN 2 THEN 'high' ELSE 'medium' END WHEN 'critical' THEN 6 WHEN 'high' THEN 3 ELSE 0 END) AS INTEGER) AS confidence_score
    FROM live, (VALUES (1), (2), (3), (4)) v(i)""")
def dependency_advisories(spark, sf_dir):
    inventory = dp.dependency_inventory(derived_manifests(spark, sf_dir))
    found = dp.dependency_advisories(inventory, derived_advisories(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return found.select("repo_id", "file", "rule", "severity", "title", "evidence", F.array_join("references", ",").alias("refs"), "fix", "confidence_score")


RAW_VERSION = "CASE p_partkey % 6 WHEN 0 THEN '^' WHEN 1 THEN '~' WHEN 2 THEN ' >= ' WHEN 3 THEN '<=' WHEN 4 THEN '*' ELSE '' END"
RAW_TAIL = "CASE p_partkey % 4 WHEN 0 THEN ' <3' WHEN 1 THEN '-rc.1 || 2' ELSE '' END"
RAW_FULL = f"CASE WHEN p_partkey % 12 = 4 THEN '*' ELSE concat({RAW_VERSION}, CAST(p_size AS {{t}}), '.', CAST(p_partkey % 10 AS {{t}}), {RAW_TAIL}) END"


@register("clean_version", f"SELECT p_partkey, nullif(split_part(ltrim(raw, '^~>=<* '), ' ', 1), '') AS version FROM (SELECT p_partkey, {RAW_FULL.format(t='VARCHAR')} AS raw FROM part)")
def clean_versions(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.expr(RAW_FULL.format(t="STRING")).alias("raw"))
    return parts.select("p_partkey", clean_version(F.col("raw")).alias("version"))


@register("vuln_severity", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_size / 5.0 >= 9 THEN 'critical' WHEN p_size / 5.0 >= 7 THEN 'high'
    WHEN p_size / 5.0 >= 4 THEN 'medium' ELSE 'low' END WHEN p_partkey % 4 = 1 THEN lower(p_type) WHEN p_partkey % 4 = 2 THEN lower(p_type) ELSE 'medium' END AS severity FROM part""")
def vuln_severities(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 4
    score = F.when(kind == 0, (F.col("p_size") / 5).cast("string")).otherwise("CVSS:3.1/AV:N/AC:L")
    severity = F.when(kind != 2, F.array(F.struct(F.when(kind == 3, "CVSS_V2").otherwise("CVSS_V3").alias("type"), score.alias("score"))))
    labels = F.when(kind.isin(0, 1, 2), F.array("p_type"))
    return parts.select("p_partkey", vuln_severity(severity, labels).alias("severity"))


# ------------------------------------------------------------------ migrations
# Statement texts by doc_id % 8, as (text, kind); {t} is a table shared by eight documents.
STATEMENTS = [
    "create table t{t} (id int);", "ALTER TABLE ONLY public.\"T{t}\" ENABLE ROW LEVEL SECURITY;",
    "create policy \"open {id}\" on t{t} for insert to anon with check (true);",
    "create policy p{id} on public.t{t} for update to authenticated using (owner = 'a;b') with check (x(1) > 0);",
    "create policy \"read {id}\" on t{t} for select using ( (true) );",
    "create or replace view v{id} as select 1;",
    "create function f{id}() returns void language sql security definer as $x$ select 1; select 2; $x$;",
    "create table private.x{id} (id int); create policy q{id} on t{t} as restrictive for delete using (false);",
]


def derived_migrations(spark, sf_dir) -> DataFrame:
    """One migration per document: its whole text as a comment, then a statement."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    group = F.floor(F.col("doc_id") / 8).cast("long")
    names = {"t": group.cast("string"), "id": F.col("doc_id").cast("string")}
    text = F.element_at(F.array(*[F.lit(s) for s in STATEMENTS]), (F.pmod("doc_id", F.lit(8)) + 1).cast("int"))
    # Tables of every third group never meet their enabling statement.
    text = F.when((F.pmod("doc_id", F.lit(8)) == 1) & (F.pmod(group, F.lit(3)) == 0), F.lit("select 1;")).otherwise(text)
    return documents.select(
        "doc_id", F.lit("mono").alias("repo_id"),
        F.concat(F.lit("supabase/migrations/"), F.col("doc_id").cast("string"), F.lit(".sql")).alias("path"),
        F.concat(F.lit("/* "), F.replace("text", F.lit("*/"), F.lit("* /")), F.lit(" */\n"), fill(text, names)).alias("content"))


LINE = "CAST(2 + length(text) - length(replace(text, chr(10), '')) AS INTEGER)"
MIG = f"(SELECT doc_id, doc_id % 8 AS k, CAST(floor(doc_id / 8) AS BIGINT) AS t, 'supabase/migrations/' || doc_id || '.sql' AS path, {LINE} AS line FROM documents)"


@register("sql_statements", f"""SELECT path, line, CAST(seq AS INTEGER) AS seq, kind FROM (
    SELECT path, line, 0 AS seq, CASE WHEN k IN (0, 7) THEN 'table' WHEN k = 1 AND t % 3 = 0 THEN 'other' WHEN k = 1 THEN 'enable' WHEN k IN (2, 3, 4) THEN 'policy'
      WHEN k = 5 THEN 'view' ELSE 'function' END AS kind FROM {MIG} UNION ALL SELECT path, line, 1, 'policy' FROM {MIG} WHERE k = 7)""")
def sql_statements(spark, sf_dir):
    statements = settle(mg.sql_statements(derived_migrations(spark, sf_dir)))
    kinds = mg.classify_statement(statements).select("path", "seq", "kind")
    return statements.join(kinds, ["path", "seq"], "left").select("path", "line", "seq", F.coalesce("kind", F.lit("other")).alias("kind"))


@register("classify_statement", f"""SELECT path, CASE WHEN k = 7 THEN 'private' ELSE 'public' END AS schema_name,
    CASE WHEN k = 7 THEN 'x' || doc_id WHEN k = 5 THEN 'v' || doc_id WHEN k = 6 THEN 'f' || doc_id ELSE 't' || t END AS object_name
    FROM {MIG} WHERE NOT (k = 1 AND t % 3 = 0) UNION ALL SELECT path, 'public', 't' || t FROM {MIG} WHERE k = 7""")
def classify_statement(spark, sf_dir):
    statements = mg.sql_statements(derived_migrations(spark, sf_dir))
    return mg.classify_statement(statements).select("path", "schema_name", "object_name")


@register("parse_policy", f"""SELECT path, CASE k WHEN 2 THEN 'open ' || doc_id WHEN 3 THEN 'p' || doc_id WHEN 4 THEN 'read ' || doc_id ELSE 'q' || doc_id END AS policy_name,
    CASE k WHEN 2 THEN 'insert' WHEN 3 THEN 'update' WHEN 4 THEN 'select' ELSE 'delete' END AS command,
    CASE k WHEN 2 THEN 'anon' WHEN 3 THEN 'authenticated' ELSE 'public' END AS roles, k = 7 AS restrictive,
    k IN (2, 4) AS always_true, false AS user_scoped FROM {MIG} WHERE k IN (2, 3, 4, 7)""")
def parse_policy(spark, sf_dir):
    statements = mg.classify_statement(mg.sql_statements(derived_migrations(spark, sf_dir))).where("kind = 'policy'")
    return mg.parse_policy(statements).select(
        "path", "policy_name", "command", F.array_join("roles", ",").alias("roles"), "restrictive", "always_true", "user_scoped")


UNSAFE = f"SELECT path, line, 'supabase.rls_not_enabled' AS rule, 'critical' AS severity FROM {MIG} WHERE k = 0 AND t % 3 = 0"


@register("lint_migrations", f"""{UNSAFE} UNION ALL SELECT path, line, CASE k WHEN 2 THEN 'supabase.rls_policy_write_true' WHEN 3 THEN 'supabase.rls_policy_not_user_scoped'
    WHEN 4 THEN 'supabase.rls_policy_public_read' WHEN 5 THEN 'supabase.view_bypasses_rls' ELSE 'supabase.security_definer_search_path' END,
    CASE k WHEN 2 THEN 'critical' WHEN 3 THEN 'high' WHEN 4 THEN 'medium' WHEN 5 THEN 'high' ELSE 'medium' END FROM {MIG} WHERE k BETWEEN 2 AND 6
    UNION ALL SELECT m.path, m.line, 'supabase.rls_not_enabled', 'critical' FROM {MIG} m WHERE k = 0 AND t % 3 <> 0
      AND NOT EXISTS (SELECT 1 FROM {MIG} e WHERE e.k = 1 AND e.t = m.t)""")
def lint_migrations(spark, sf_dir):
    return mg.lint_migrations(derived_migrations(spark, sf_dir)).select(F.col("file").alias("path"), "line", "rule", "severity")


@register("rls_not_enabled", f"""SELECT 't' || t AS object_name, path, line FROM {MIG} m WHERE k = 0 AND (t % 3 = 0
    OR NOT EXISTS (SELECT 1 FROM {MIG} e WHERE e.k = 1 AND e.t = m.t))""")
def rls_not_enabled(spark, sf_dir):
    statements = mg.classify_statement(mg.sql_statements(derived_migrations(spark, sf_dir)))
    return mg.rls_not_enabled(statements).select("object_name", "path", "line")


# Every customer is a repository; some hold migrations, some only a package file.
@register("project_flags", """SELECT 'c' || c_custkey AS repo_id, c_custkey % 4 IN (0, 2) AS flagged FROM customer""")
def project_flags(spark, sf_dir):
    key = F.col("c_custkey")
    files = table(spark, sf_dir, "customer").select(key, F.explode(F.array(
        F.struct(F.when(key % 4 == 0, "apps/supabase/1.sql").when(key % 4 == 3, "src/a.js").otherwise("db/1.sql").alias("path"), F.lit("select 1").alias("content")),
        F.struct(F.lit("web/package.json").alias("path"),
                 F.when(key % 4 >= 2, '{"dependencies":{"@supabase/supabase-js":"2.0.0"}}').otherwise("{}").alias("content")))).alias("f"))
    return mg.project_flags(files.select(F.concat(F.lit("c"), key.cast("string")).alias("repo_id"), "f.*"))


# ------------------------------------------------------- scan histories (orders)
SEVERITY = "CASE l_linenumber % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END"


def derived_scans(spark, sf_dir) -> DataFrame:
    """Orders as scans: the customer is the target, their nation the workspace."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").alias("scan_id"), F.col("c_nationkey").alias("org_id"), F.col("o_custkey").cast("string").alias("target"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))


def derived_scan_findings(spark, sf_dir) -> DataFrame:
    """Line items as findings of those scans."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("scan_id"), F.expr(SEVERITY).alias("severity"), (F.col("l_returnflag") == "R").alias("suppressed"))


SCANS_SQL = """scans AS (SELECT o_orderkey AS scan_id, c_nationkey AS org_id, CAST(o_custkey AS VARCHAR) AS target, o_orderstatus AS status,
    o_orderdate AS created_at FROM orders JOIN customer ON o_custkey = c_custkey)"""
SCAN_FINDINGS_SQL = f"found AS (SELECT l_orderkey AS scan_id, {SEVERITY} AS severity, l_returnflag = 'R' AS suppressed FROM lineitem)"
SCORED_SQL = f"""scored AS (SELECT s.*, {ck.score_sql('p.penalty')} AS score FROM scans s LEFT JOIN (
    SELECT scan_id, sum({ck.WEIGHT}) AS penalty FROM found WHERE NOT suppressed GROUP BY scan_id) p USING (scan_id))"""
WITH_SCANS = f"WITH {SCANS_SQL}, {SCAN_FINDINGS_SQL}, {SCORED_SQL}"


def scored_scans(spark, sf_dir) -> DataFrame:
    scans = derived_scans(spark, sf_dir)
    return scans.join(an.scan_score(scans, derived_scan_findings(spark, sf_dir), ["scan_id"]), "scan_id")


@register("scan_scores", f"{WITH_SCANS} SELECT scan_id, score FROM scored")
def scan_scores(spark, sf_dir):
    return scored_scans(spark, sf_dir).select("scan_id", "score")


@register("scan_history", f"""{WITH_SCANS} SELECT s.scan_id, s.target, CAST(count(f.severity) AS BIGINT) AS findings_total,
    CAST(count(*) FILTER (WHERE f.severity = 'critical') AS BIGINT) AS critical_total, CAST(count(*) FILTER (WHERE f.suppressed) AS BIGINT) AS suppressed_total,
    CAST(count(*) FILTER (WHERE NOT f.suppressed) AS BIGINT) AS findings_active,
    CAST(count(*) FILTER (WHERE f.severity = 'critical' AND NOT f.suppressed) AS BIGINT) AS critical_active
    FROM (SELECT * FROM scored WHERE org_id = 7 ORDER BY created_at DESC, scan_id DESC LIMIT 50) s LEFT JOIN found f USING (scan_id) GROUP BY s.scan_id, s.target""")
def scan_history(spark, sf_dir):
    return an.scan_history(scored_scans(spark, sf_dir), derived_scan_findings(spark, sf_dir), 7, limit=an.HISTORY_ROWS).select(
        "scan_id", "target", "findings_total", "critical_total", "suppressed_total", "findings_active", "critical_active")


@register("latest_scan_per_target", f"{WITH_SCANS} SELECT org_id, target, arg_max(scan_id, (created_at, scan_id)) AS scan_id FROM scored GROUP BY org_id, target")
def latest_scan_per_target(spark, sf_dir):
    return an.latest_scan_per_target(derived_scans(spark, sf_dir)).select("org_id", "target", "scan_id")


@register("score_trend", f"""{WITH_SCANS} SELECT scan_id, score, lag(score) OVER w AS previous_score, score - lag(score) OVER w AS score_delta
    FROM scored WINDOW w AS (PARTITION BY org_id, target ORDER BY created_at, scan_id)""")
def score_trend(spark, sf_dir):
    return an.score_trend(scored_scans(spark, sf_dir)).select("scan_id", "score", "previous_score", "score_delta")


@register("tenant_scope", f"WITH {SCANS_SQL} SELECT scan_id, target FROM scans WHERE org_id = 3")
def tenant_scope(spark, sf_dir):
    return tn.tenant_scope(derived_scans(spark, sf_dir), 3).select("scan_id", "target")


@register("find_many", f"WITH {SCANS_SQL} SELECT scan_id, org_id, target FROM scans WHERE status = 'F' ORDER BY created_at DESC, scan_id LIMIT 120")
def find_many(spark, sf_dir):
    return an.find_many(derived_scans(spark, sf_dir), {"status": "F"}, limit=120, tiebreak=["scan_id"]).select("scan_id", "org_id", "target")


@register("merge_results", f"""{WITH_SCANS}, results AS (SELECT org_id, target, min(scan_id) AS position, count(*) AS files, sum(CAST(scan_id AS BIGINT)) AS bytes FROM scans GROUP BY org_id, target),
    paired AS (SELECT CAST(position AS BIGINT) // 2 AS group_id, * FROM results)
    SELECT p.group_id, string_agg(p.target, ' + ' ORDER BY p.position, p.target) AS target, CAST(sum(files) AS BIGINT) AS files_scanned, CAST(sum(bytes) AS BIGINT) AS bytes_scanned,
      CAST(coalesce(any_value(c.active), 0) AS BIGINT) AS active_findings, CAST(coalesce(any_value(c.gone), 0) AS BIGINT) AS suppressed_findings, {ck.score_sql('any_value(c.penalty)')} AS score
    FROM paired p LEFT JOIN (SELECT group_id, count(*) FILTER (WHERE NOT suppressed) AS active, count(*) FILTER (WHERE suppressed) AS gone,
      sum({ck.WEIGHT}) FILTER (WHERE NOT suppressed) AS penalty FROM found JOIN scans USING (scan_id) JOIN paired USING (org_id, target) GROUP BY group_id) c ON c.group_id = p.group_id
    GROUP BY p.group_id""")
def merge_results(spark, sf_dir):
    scans = derived_scans(spark, sf_dir)
    results = scans.groupBy("org_id", "target").agg(
        F.min("scan_id").alias("position"), F.count("*").alias("files_scanned"), F.sum("scan_id").alias("bytes_scanned"))
    results = results.withColumn("group_id", F.floor(F.col("position") / 2))
    findings = derived_scan_findings(spark, sf_dir).join(scans, "scan_id").join(results.select("org_id", "target", "group_id"), ["org_id", "target"])
    return an.merge_results(results, findings)


# ----------------------------------------------------- workspaces (customers)
MEMBERS_SQL = """members AS (SELECT c_custkey AS user_id, c_nationkey AS org_id, lower(c_mktsegment) AS role FROM customer
    UNION ALL SELECT c_custkey, (c_nationkey + 7) % 25, 'guest' FROM customer WHERE c_acctbal < 1000)"""


def derived_workspaces(spark, sf_dir) -> dict[str, DataFrame]:
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    users = customers.select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("@example.com")).alias("email"), F.col("c_name").alias("name"), "c_acctbal")
    members = customers.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("org_id"), F.lower("c_mktsegment").alias("role")).unionByName(
        customers.where("c_acctbal < 1000").select(F.col("c_custkey").alias("user_id"), ((F.col("c_nationkey") + 7) % 25).alias("org_id"), F.lit("guest").alias("role")))
    orgs = nations.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
                          F.when(F.col("n_regionkey") % 2 == 0, "free").otherwise("team").alias("plan"))
    return {"users": users, "memberships": members, "orgs": orgs, "scans": derived_scans(spark, sf_dir),
            "audit": table(spark, sf_dir, "events").select("event_id", "user_id")}


@register("user_org_summary", f"""WITH {MEMBERS_SQL} SELECT c_custkey AS id, c_name AS name, string_agg(org_id || ':' || n_name || ':' || CASE WHEN n_regionkey % 2 = 0 THEN 'free' ELSE 'team' END
    || ':' || role, ';' ORDER BY org_id, role) AS orgs FROM customer JOIN members ON user_id = c_custkey JOIN nation ON n_nationkey = org_id GROUP BY ALL""")
def user_org_summary(spark, sf_dir):
    w = derived_workspaces(spark, sf_dir)
    listed = F.transform("orgs", lambda o: F.concat_ws(":", o["id"].cast("string"), o["name"], o["plan"], o["role"]))
    return tn.user_org_summary(w["users"], w["memberships"], w["orgs"]).select("id", "name", F.array_join(listed, ";").alias("orgs"))


@register("erase_tenant", f"""WITH {MEMBERS_SQL}, {SCANS_SQL}, gone AS (SELECT c_custkey AS user_id FROM customer WHERE c_acctbal > 9990),
    gone_orgs AS (SELECT DISTINCT org_id FROM members WHERE user_id IN (SELECT user_id FROM gone))
    SELECT 'users' AS table_name, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM gone)
    UNION ALL SELECT 'memberships', count(*) FROM members WHERE org_id NOT IN (SELECT org_id FROM gone_orgs) AND user_id NOT IN (SELECT user_id FROM gone)
    UNION ALL SELECT 'orgs', count(*) FROM nation WHERE n_nationkey NOT IN (SELECT org_id FROM gone_orgs)
    UNION ALL SELECT 'scans', count(*) FROM scans WHERE org_id NOT IN (SELECT org_id FROM gone_orgs)
    UNION ALL SELECT 'audit', count(*) FROM events WHERE user_id NOT IN (SELECT user_id FROM gone)""")
def erase_tenant(spark, sf_dir):
    w = derived_workspaces(spark, sf_dir)
    kept = tn.erase_tenant(w, w["users"].where("c_acctbal > 9990").select(F.col("id").alias("user_id")))
    out = None
    for name, df in kept.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


# ----------------------------------------------------------- events over time
STAMP, STAMP_SQL = "yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"


def stamp(column: str) -> Column:
    return F.date_format(column, STAMP)


def chain_sql(rows: str, key: str, seconds: int, name: str = "chain") -> str:
    """Recursive CTEs that walk each key's events in order: columns k, ts, event_id, anchor, hit."""
    return f"""{name}_rows AS (SELECT *, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM {rows}),
    {name} AS (SELECT k, rn, ts, event_id, ts AS anchor, 1 AS hit FROM {name}_rows WHERE rn = 1
      UNION ALL SELECT r.k, r.rn, r.ts, r.event_id, CASE WHEN r.ts >= c.anchor + to_seconds({seconds}) THEN r.ts ELSE c.anchor END,
        CASE WHEN r.ts >= c.anchor + to_seconds({seconds}) THEN 1 ELSE c.hit + 1 END FROM {name} c JOIN {name}_rows r ON r.k = c.k AND r.rn = c.rn + 1)"""


DAY = 86400


@register("rate_windows", f"""WITH RECURSIVE {chain_sql('events', 'user_id', DAY)} SELECT event_id, CAST(hit AS BIGINT) AS hit, hit <= 3 AS ok,
    CAST(greatest(0, 3 - hit) AS BIGINT) AS remaining, strftime(anchor + to_seconds({DAY}), '{STAMP_SQL}') AS reset_at FROM chain""")
def rate_windows(spark, sf_dir):
    limited = aw.rate_windows(table(spark, sf_dir, "events"), "user_id", 3, DAY)
    return limited.select("event_id", "hit", "ok", "remaining", stamp("reset_at").alias("reset_at"))


# All events under one key: the hottest case there is.
@register("rate_windows_one_key", f"""WITH RECURSIVE {chain_sql('events', "'all'", 3600)} SELECT event_id, CAST(hit AS BIGINT) AS hit, strftime(anchor, '{STAMP_SQL}') AS window_start FROM chain""")
def rate_windows_one_key(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("everyone", F.lit("all"))
    return aw.rate_windows(events, "everyone", 3, 3600).select("event_id", "hit", stamp("window_start").alias("window_start"))


ARRIVALS = 4
LATE = "event_id % 97 = 0"  # these arrive after all others
DELAY = 6 * 3600


@register("rate_windows_stream", f"""WITH RECURSIVE clock AS (SELECT max(ts) FILTER (WHERE NOT {LATE}) - to_seconds({DELAY}) AS early, max(ts) - to_seconds({DELAY}) AS decided FROM events),
    timely AS (SELECT e.* FROM events e, clock WHERE (NOT {LATE} OR ts >= early) AND ts < decided),
    {chain_sql('timely', 'user_id', DAY)}
    SELECT event_id, CAST(hit AS BIGINT) AS hit, hit <= 3 AS ok, CAST(greatest(0, 3 - hit) AS BIGINT) AS remaining,
      strftime(anchor + to_seconds({DAY}), '{STAMP_SQL}') AS reset_at, NULL AS late_reason FROM chain
    UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, 'late' FROM events, clock WHERE {LATE} AND ts < early""")
def rate_windows_stream(spark, sf_dir):
    """Events arrive up to four hours out of order, and some after all others; every decided or late event of the stream."""
    events = table(spark, sf_dir, "events")
    arrival = F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("event_id") % 5 * 3600
    low, high = events.agg(F.min(arrival), F.max(arrival)).first()
    number = F.when(F.expr(LATE), ARRIVALS).otherwise(F.expr("0") if low is None or low == high else F.least(
        F.lit(ARRIVALS - 1), F.floor((arrival - low) * ARRIVALS / (high - low))))
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rates-{uuid.uuid4().hex}"
    for _ in arrivals(events, number, ARRIVALS + 1, place):
        source = spark.readStream.schema(events.schema).parquet(f"{place}/in")
        streams.write_rate_windows(source, "user_id", 3, DAY, f"{place}/out", f"{place}/checkpoint", delay_seconds=DELAY).awaitTermination()
    decided = spark.read.parquet(f"{place}/out/windows").select(
        "event_id", "hit", "ok", "remaining", stamp("reset_at").alias("reset_at"))
    late = spark.read.parquet(f"{place}/out/late").select("event_id", "late_reason")
    return decided.unionByName(late, allowMissingColumns=True)


TIER_KEY = "CASE WHEN event_type = 'signup' THEN 'ip:' || user_id ELSE 'org:' || (user_id % 20) END"
SHORT, LONG = 6 * 3600, 2 * DAY


@register("rate_two_tier", f"""WITH RECURSIVE {chain_sql('events', TIER_KEY, SHORT, 'burst')},
    passed AS (SELECT e.* FROM burst b JOIN events e USING (event_id) WHERE b.hit <= CASE WHEN e.event_type = 'signup' THEN 1 ELSE 2 END),
    {chain_sql('passed', TIER_KEY, LONG, 'budget')}
    SELECT e.event_id, CASE WHEN g.event_id IS NULL THEN 'minute' WHEN g.hit > CASE WHEN e.event_type = 'signup' THEN 2 ELSE 9 END THEN 'hour' END AS refused_by,
      CASE WHEN g.event_id IS NULL THEN CAST(greatest(1, ceil((epoch_us(b.anchor) + {SHORT}000000 - epoch_us(e.ts)) / 1000000.0)) AS BIGINT)
        WHEN g.hit > CASE WHEN e.event_type = 'signup' THEN 2 ELSE 9 END THEN CAST(greatest(1, ceil((epoch_us(g.anchor) + {LONG}000000 - epoch_us(e.ts)) / 1000000.0)) AS BIGINT) END AS retry_after
    FROM events e JOIN burst b USING (event_id) LEFT JOIN budget g USING (event_id)""")
def rate_two_tier(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    signed_in = F.col("event_type") != "signup"
    key = F.when(signed_in, F.concat(F.lit("org:"), (F.col("user_id") % 20).cast("string"))).otherwise(
        F.concat(F.lit("ip:"), F.col("user_id").cast("string")))
    limited = aw.rate_two_tier(events.withColumn("bucket", key), "bucket", signed_in, minute_seconds=SHORT, hour_seconds=LONG,
                               signed_in_limits=(2, 9), anonymous_limits=(1, 2))
    return limited.select("event_id", "refused_by", "retry_after")


@register("rate_key", "SELECT event_id, substr(sha256('scans.org.minute:' || user_id), 1, 40) AS rate_key, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || user_id "
          "WHEN event_id % 3 = 1 THEN '192.168.1.' || user_id ELSE 'unknown' END AS address FROM events")
def rate_keys(spark, sf_dir):
    events, user = table(spark, sf_dir, "events"), F.col("user_id").cast("string")
    forwarded = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), user, F.lit(", 172.16.0.1")))
    remote = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("192.168.1."), user))
    return events.select("event_id", aw.rate_key("scans.org.minute", user).alias("rate_key"), aw.client_address(forwarded, remote).alias("address"))


@register("ttl_cache", f"""WITH RECURSIVE {chain_sql('events', "user_id || event_type", DAY)} SELECT event_id, hit > 1 AS cache_hit,
    strftime(anchor + to_seconds({DAY}), '{STAMP_SQL}') AS expires_at FROM chain""")
def ttl_cache(spark, sf_dir):
    lookups = table(spark, sf_dir, "events").withColumn("package", F.concat(F.col("user_id").cast("string"), F.col("event_type")))
    return aw.ttl_cache(lookups, "package").select("event_id", "cache_hit", stamp("expires_at").alias("expires_at"))


PURGE_NOW = "2024-01-20 00:00:00"


@register("retention_purge", f"""SELECT table_name, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS deleted, CAST(count(*) FILTER (WHERE NOT gone) AS BIGINT) AS kept FROM (
    SELECT 'audit' AS table_name, ts < TIMESTAMP '{PURGE_NOW}' - to_days(10) AS gone FROM events
    UNION ALL SELECT 'sessions', ts + to_days(14) < TIMESTAMP '{PURGE_NOW}' - to_days(1) FROM events WHERE event_type = 'signup'
    UNION ALL SELECT 'rate_limits', ts < TIMESTAMP '{PURGE_NOW}' - to_hours(1) FROM events WHERE event_type = 'click'
    UNION ALL SELECT 'osv_cache', ts + to_days(1) < TIMESTAMP '{PURGE_NOW}' FROM events WHERE event_type = 'view') GROUP BY table_name""")
def retention_purge(spark, sf_dir):
    _, counts = tn.retention_purge(derived_expiring(spark, sf_dir), PURGE_NOW, audit_days=10)
    return counts


def derived_expiring(spark, sf_dir) -> dict[str, DataFrame]:
    events = table(spark, sf_dir, "events")
    return {
        "audit": events.select("event_id", F.col("ts").alias("created_at")),
        "sessions": events.where("event_type = 'signup'").select("event_id", "user_id", F.expr("ts + INTERVAL 14 DAYS").alias("expires_at")),
        "rate_limits": events.where("event_type = 'click'").select("event_id", F.col("ts").alias("reset_at")),
        "osv_cache": events.where("event_type = 'view'").select("event_id", F.expr("ts + INTERVAL 1 DAY").alias("expires_at")),
    }


@register("valid_sessions", "SELECT event_id, user_id FROM events WHERE event_type = 'signup' AND ts + to_days(14) > TIMESTAMP '2024-01-25'")
def valid_sessions(spark, sf_dir):
    return tn.valid_sessions(derived_expiring(spark, sf_dir)["sessions"], F.lit("2024-01-25").cast("timestamp_ntz")).select("event_id", "user_id")


@register("sessions_of_requests", """SELECT r.event_id AS request_id, r.user_id, max_by(s.event_id, (s.ts, s.event_id)) AS session_id,
      max_by(s.org_id, (s.ts, s.event_id)) AS org_id
    FROM events r LEFT JOIN (SELECT event_id, user_id, ts, user_id % 5 AS org_id, ts + to_hours(CAST(1 + event_id % 400 AS INTEGER)) AS until
                             FROM events WHERE event_type IN ('signup', 'view')) s
      ON s.user_id = r.user_id AND s.ts <= r.ts AND r.ts < s.until
    GROUP BY r.event_id, r.user_id""")
def sessions_of_requests_query(spark, sf_dir):
    """Every event is a request; sign-ups and views open a session that lasts from one hour to over two weeks."""
    events = table(spark, sf_dir, "events")
    opened = events.where("event_type IN ('signup', 'view')").select(
        F.col("event_id").alias("id"), "user_id", F.expr("user_id % 5").alias("org_id"), F.col("ts").alias("created_at"),
        F.expr("ts + make_interval(0, 0, 0, 0, 1 + CAST(event_id % 400 AS INT))").alias("expires_at"))
    requests = events.select(F.col("event_id").alias("request_id"), "user_id", "ts")
    return sessions_of_requests(requests, opened).select("request_id", "user_id", "session_id", "org_id")


@register("audit_append", f"""SELECT 'o' || (user_id % 20) AS org_id, CAST(user_id AS VARCHAR) AS user_id, event_type AS action, CAST(event_id AS VARCHAR) AS detail,
    strftime(ts, '{STAMP_SQL}') AS created_at, strftime(ts, '%Y-%m-%d') AS created_on FROM events""")
def audit_append_query(spark, sf_dir):
    """Events as audit rows in three batches, of which one is delivered again after the others."""
    rows = table(spark, sf_dir, "events").select(
        F.expr("'o' || (user_id % 20)").alias("org_id"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("action"),
        F.col("event_id").cast("string").alias("detail"), F.col("ts").alias("created_at"), (F.col("event_id") % 3).alias("batch"))
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/audit-{uuid.uuid4().hex}"
    for batch in (0, 1, 2, 1):
        sinks.audit_append(rows.where(F.col("batch") == batch), place, batch_id=f"b{batch}")
    return spark.read.parquet(place).select("org_id", "user_id", "action", "detail", stamp("created_at").alias("created_at"),
                                            F.date_format("created_on", "yyyy-MM-dd").alias("created_on"))


@register("findings_per_window", f"""SELECT strftime(date_trunc('day', ts), '{STAMP_SQL}') AS window_start, event_type AS severity, count(*) AS n FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""")
def findings_per_window_query(spark, sf_dir):
    """Events arrive as findings, day by day, some of them twice; the windows that closed are the batch counts."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("severity"))
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/windows-{uuid.uuid4().hex}"
    twice = events.unionByName(events.where("id % 5 = 0"))
    # One file per range of days, so that they arrive in the order of time.
    twice.repartitionByRange(4, "ts").write.parquet(f"{place}/in")
    source = spark.readStream.schema(twice.schema).parquet(f"{place}/in")
    streams.write_findings_per_window(source, f"{place}/out", f"{place}/checkpoint").awaitTermination()
    counts = spark.read.schema("window_start timestamp, severity string, n long").parquet(f"{place}/out")
    return counts.select(stamp("window_start").alias("window_start"), "severity", "n")


@register("last_used", f"SELECT user_id, strftime(max(ts), '{STAMP_SQL}') AS last_used_at FROM events GROUP BY user_id")
def last_used(spark, sf_dir):
    return an.last_used(table(spark, sf_dir, "events"), "user_id").select("user_id", stamp("last_used_at").alias("last_used_at"))


def derived_push_events(spark, sf_dir) -> DataFrame:
    """Events as webhook rows; the repository is the user's, some are not registered."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    event = F.when(F.col("event_type").isin("view", "click"), "push").when(F.col("event_type") == "signup", "ping").when(
        F.col("event_type") == "error", "issues").otherwise("pull_request")
    action = F.when(F.col("event_id") % 2 == 0, "opened").otherwise("closed")
    return e.select(
        "event_id", event.alias("event"), action.alias("action"), F.concat(F.lit("refs/heads/b"), user).alias("ref"),
        F.struct(F.concat(F.lit("acme/r"), user).alias("full_name")).alias("repository"),
        F.struct(F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("id")).alias("installation"),
        F.struct(F.struct(F.concat(F.lit("pr"), user).alias("ref")).alias("head")).alias("pull_request"))


EVENT_SQL = "CASE WHEN event_type IN ('view', 'click') THEN 'push' WHEN event_type = 'signup' THEN 'ping' WHEN event_type = 'error' THEN 'issues' ELSE 'pull_request' END"


@register("push_events", f"""SELECT full_name, ref, event, CASE WHEN event = 'issues' THEN 'ignored_event' WHEN user_id % 7 = 0 THEN 'missing_repo_or_installation'
    WHEN event = 'pull_request' AND event_id % 2 = 1 THEN 'ignored_action' END AS status, count(*) AS n FROM (SELECT *, 'acme/r' || user_id AS full_name, {EVENT_SQL} AS event,
      CASE WHEN {EVENT_SQL} = 'pull_request' THEN 'pr' ELSE 'b' END || user_id AS ref FROM events) WHERE event <> 'ping' GROUP BY ALL""")
def push_events(spark, sf_dir):
    return streams.push_events(derived_push_events(spark, sf_dir)).groupBy("full_name", "ref", "event", "status").agg(F.count("*").alias("n"))


@register("events_to_repos", f"""SELECT full_name, event, CASE WHEN org_id IS NULL AND status IS DISTINCT FROM 'ignored_event' AND status IS DISTINCT FROM 'missing_repo_or_installation'
      THEN 'not_registered' ELSE status END AS status, org_id, count(*) AS n FROM (SELECT 'acme/r' || user_id AS full_name, {EVENT_SQL} AS event,
      CASE WHEN {EVENT_SQL} = 'issues' THEN 'ignored_event' WHEN user_id % 7 = 0 THEN 'missing_repo_or_installation'
        WHEN {EVENT_SQL} = 'pull_request' AND event_id % 2 = 1 THEN 'ignored_action' END AS status, c_nationkey AS org_id FROM events LEFT JOIN customer ON c_custkey = user_id AND c_acctbal > 2000)
    WHERE event <> 'ping' GROUP BY ALL""")
def events_to_repos(spark, sf_dir):
    repositories = table(spark, sf_dir, "customer").where("c_acctbal > 2000").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("org_id"),
        F.concat(F.lit("acme/r"), F.col("c_custkey").cast("string")).alias("full_name"), F.lit("2024-01-01").alias("created_at"))
    later = repositories.withColumn("org_id", F.col("org_id") + 100).withColumn("created_at", F.lit("2024-02-01"))
    events = streams.push_events(derived_push_events(spark, sf_dir))
    return streams.events_to_repos(events, repositories.unionByName(later)).groupBy("full_name", "event", "status", "org_id").agg(F.count("*").alias("n"))


# Parts of one order are linked in line order, inside one return flag.
EDGES_SQL = """edges AS (SELECT DISTINCT scope, src, dst FROM (SELECT l_returnflag || l_linestatus AS scope, l_partkey AS src,
    lead(l_partkey) OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL),
    nodes AS (SELECT DISTINCT l_returnflag || l_linestatus AS scope, l_partkey AS node, p_size FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@register("label_propagation", f"""WITH RECURSIVE {EDGES_SQL}, walk(scope, node, depth) USING KEY (scope, node) AS (
      SELECT scope, node, 0 FROM nodes WHERE p_size = 1
      UNION SELECT w.scope, e.dst, min(w.depth) + 1 FROM walk w JOIN edges e ON e.scope = w.scope AND e.src = w.node
        LEFT JOIN recurring.walk r ON r.scope = w.scope AND r.node = e.dst WHERE r.node IS NULL GROUP BY w.scope, e.dst)
    SELECT scope, node, 'taint.sql_injection' AS rule, depth FROM walk JOIN nodes USING (scope, node) WHERE p_size >= 40""")
def label_propagation_query(spark, sf_dir):
    scope = F.concat("l_returnflag", "l_linestatus").alias("scope")
    items = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey", "l_returnflag", "l_linestatus").orderBy("l_linenumber", "l_partkey")
    edges = items.select(scope, F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).where("dst is not null")
    nodes = items.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        scope, F.col("l_partkey").alias("node"), "p_size").distinct()
    sinks = nodes.where("p_size >= 40").select("scope", "node", F.lit("taint.sql_injection").alias("rule"))
    return label_propagation(edges, nodes.where("p_size = 1"), sinks)
