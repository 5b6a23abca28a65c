"""Registered queries: suppression, scoring, reports and diffs over findings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lintlake.functions import prompts
from lintlake.functions.findings import severity_rank
from lintlake.functions.text import split_lines
from lintlake.operators import analytics as an
from lintlake.operators import rollups, scan, suppress
from lintlake.plans import checks as ck
from lintlake.plans import derived as dv
from lintlake.plans.registry import register
from lintlake.operators.rules import RULEBOOK
from lintlake.plans.scan_queries import core_findings, core_sql, shown
from lintlake.plans.scans import scan_repositories
from lintlake.session import ensure_checkpoint_dir, settle
from lintlake.sources import sinks
from lintlake.streaming import streams


def project_rules(spark, sf_dir):
    return suppress.ignore_rules(suppress.ignore_files(dv.derived_project(spark, sf_dir)))


@register("ignore_rules", dv.IGNORE_RULES_SQL.replace("replace(v.pattern", "v.finding_id AS f, replace(v.pattern").replace(
    "v.finding_id AS f, ", "").replace("AS pattern, v.finding_id", "AS regex, v.finding_id"))
def ignore_rules(spark, sf_dir):
    rules = project_rules(spark, sf_dir)
    # The check writes an end anchor as $; both see one-line paths only.
    return rules.select("repo_id", "line", "kind", "rule", F.replace("regex", F.lit(r"\z"), F.lit("$")).alias("regex"), "finding_id")


@register("drop_ignored_files", f"""WITH files AS ({dv.PROJECT_FILES_SQL}), rules AS ({dv.IGNORE_RULES_SQL})
    SELECT repo_id, path, size FROM files f WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.repo_id = f.repo_id
      AND r.kind = 'path' AND regexp_matches(f.path, r.pattern))""")
def drop_ignored_files(spark, sf_dir):
    files = dv.derived_project(spark, sf_dir)
    return suppress.drop_ignored_files(files, project_rules(spark, sf_dir)).select("repo_id", "path", "size")


# One ignored finding per repository beside the ignore file: its smallest id.
RULE_CTES = f""", rules_text AS ({dv.IGNORE_RULES_SQL}),
    ignore_all AS (SELECT repo_id, kind, rule, pattern, finding_id FROM rules_text
      UNION ALL SELECT repo_id, 'finding', NULL, NULL, min(id) FROM findings GROUP BY repo_id)"""
IGNORED = """EXISTS (SELECT 1 FROM ignore_all i WHERE i.repo_id = f.repo_id AND ((i.kind = 'finding' AND i.finding_id = f.id)
      OR (i.kind = 'rule' AND (i.rule = f.rule OR i.rule = '*') AND regexp_matches(f.file, i.pattern))))"""


def with_finding_rules(rules, findings):
    lowest = findings.groupBy("repo_id").agg(F.min("id").alias("finding_id")).withColumn("kind", F.lit("finding"))
    return rules.select("repo_id", "kind", "rule", "regex", "finding_id").unionByName(lowest, allowMissingColumns=True)


@register("match_ignore_rules", core_sql(f"SELECT repo_id, id, rule, file, {IGNORED} AS ignored_by_file FROM findings f", RULE_CTES))
def match_ignore_rules(spark, sf_dir):
    findings = settle(core_findings(spark, sf_dir))
    rules = with_finding_rules(project_rules(spark, sf_dir), findings)
    return suppress.match_ignore_rules(findings, rules).select("repo_id", "id", "rule", "file", "ignored_by_file")


MATCHED = """, owned AS (SELECT f.*, r.org_id, r.target FROM findings f JOIN repositories r USING (repo_id)),
    matched AS (SELECT o.repo_id, o.id, s.reason, row_number() OVER (PARTITION BY o.repo_id, o.id ORDER BY s.created_at DESC, s.sid DESC) AS rn
      FROM owned o JOIN suppressions s ON s.org_id = o.org_id AND s.finding_id = o.id AND (s.target IN ('*', '') OR s.target = o.target)),
    first_match AS (SELECT repo_id, id, reason FROM matched WHERE rn = 1)"""


def owned(findings, spark, sf_dir):
    return findings.join(dv.derived_repositories(spark, sf_dir), "repo_id")


@register("match_org_suppressions", core_sql(
    "SELECT o.repo_id, o.id, m.id IS NOT NULL AS ignored_by_org, m.reason AS org_reason FROM owned o "
    "LEFT JOIN first_match m ON m.repo_id = o.repo_id AND m.id = o.id", dv.SUPPRESSION_CTES + MATCHED))
def match_org_suppressions(spark, sf_dir):
    findings = settle(core_findings(spark, sf_dir))
    rules = dv.derived_suppressions(findings)
    return suppress.match_org_suppressions(owned(findings, spark, sf_dir), rules).select(
        "repo_id", "id", "ignored_by_org", "org_reason")


@register("newest_suppressions", core_sql(
    "SELECT org_id, sid AS id, finding_id FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY created_at DESC, sid DESC) "
    "AS rn FROM suppressions) WHERE rn <= 20", dv.SUPPRESSION_CTES))
def newest_suppressions(spark, sf_dir):
    rules = dv.derived_suppressions(core_findings(spark, sf_dir))
    return suppress.newest_suppressions(rules, 20).select("org_id", "id", "finding_id")


FINAL = f""", final AS (SELECT o.*, (m.id IS NOT NULL OR ({IGNORED.replace('f.', 'o.')})) AS hidden, m.reason AS org_reason
      FROM owned o LEFT JOIN first_match m ON m.repo_id = o.repo_id AND m.id = o.id)"""
SUPPRESSED_CTES = dv.SUPPRESSION_CTES + MATCHED + RULE_CTES + FINAL


def suppressed_findings(spark, sf_dir):
    findings = settle(core_findings(spark, sf_dir))
    rules = with_finding_rules(settle(project_rules(spark, sf_dir)), findings)
    return suppress.apply_suppressions(
        owned(findings, spark, sf_dir), rules, dv.derived_suppressions(findings))


@register("apply_suppressions", core_sql(
    "SELECT repo_id, id, hidden AS suppressed, CASE WHEN hidden THEN coalesce(nullif(org_reason, ''), 'matched ignore file') END "
    "AS suppression_reason FROM final", SUPPRESSED_CTES))
def apply_suppressions(spark, sf_dir):
    return suppressed_findings(spark, sf_dir).select("repo_id", "id", "suppressed", "suppression_reason")


@register("scan_repositories", f"""WITH kept_rules AS ({dv.IGNORE_RULES_SQL}), kept AS (SELECT repo_id, path, content, size FROM
      ({dv.PROJECT_FILES_SQL}) f WHERE NOT EXISTS (SELECT 1 FROM kept_rules r WHERE r.repo_id = f.repo_id AND r.kind = 'path'
        AND regexp_matches(f.path, r.pattern))), {ck.scan_ctes(RULEBOOK, "SELECT * FROM kept")}{dv.SUPPRESSION_CTES}{MATCHED},
    ignore_all AS (SELECT repo_id, kind, rule, pattern, finding_id FROM kept_rules){FINAL}
    SELECT k.repo_id, CAST(k.files_scanned AS BIGINT) AS files_scanned, CAST(k.bytes_scanned AS BIGINT) AS bytes_scanned,
      CAST(coalesce(active, 0) AS BIGINT) AS active_findings, CAST(coalesce(gone, 0) AS BIGINT) AS suppressed_findings,
      CAST((SELECT count(*) FROM kept_rules r WHERE r.repo_id = k.repo_id) AS BIGINT) AS ignore_rules_applied,
      false AS truncated,
      {ck.score_sql('penalty')} AS score
    FROM (SELECT repo_id, count(*) AS files_scanned, sum(size) AS bytes_scanned FROM kept GROUP BY repo_id) k
    LEFT JOIN (SELECT repo_id, count(*) FILTER (WHERE NOT hidden) AS active, count(*) FILTER (WHERE hidden) AS gone,
      sum({ck.WEIGHT}) FILTER (WHERE NOT hidden) AS penalty FROM final GROUP BY repo_id) s USING (repo_id)""")
def whole_scan(spark, sf_dir):
    """The whole scan of every file: ignore files, rules, dedup, suppression, summary."""
    files = dv.derived_project(spark, sf_dir)
    code = settle(scan.unique_findings(scan.scan_files(
        suppress.drop_ignored_files(files, project_rules(spark, sf_dir)), RULEBOOK)))
    _, summary = scan_repositories(
        files, dv.derived_repositories(spark, sf_dir), dv.derived_suppressions(code), rulebook=RULEBOOK, lint=False)
    return summary


ACTIVE_SCORES = f"""SELECT d.repo_id, {ck.score_sql('penalty')} AS score FROM (SELECT DISTINCT source AS repo_id FROM documents) d
    LEFT JOIN (SELECT repo_id, sum({ck.WEIGHT}) AS penalty FROM final WHERE NOT hidden GROUP BY repo_id) USING (repo_id)"""


@register("scan_score", core_sql(ACTIVE_SCORES, SUPPRESSED_CTES))
def scan_score(spark, sf_dir):
    return an.scan_score(dv.derived_repositories(spark, sf_dir), suppressed_findings(spark, sf_dir))


@register("file_score", core_sql(f"""SELECT repo_id, path AS file, {ck.score_sql('penalty')} AS score FROM files
    LEFT JOIN (SELECT repo_id, file AS path, sum({ck.WEIGHT}) AS penalty FROM findings GROUP BY ALL) USING (repo_id, path)"""))
def file_score(spark, sf_dir):
    files = dv.derived_files(spark, sf_dir).select("repo_id", F.col("path").alias("file"))
    return an.scan_score(files, core_findings(spark, sf_dir), ["repo_id", "file"])


@register("severity_counts", core_sql("SELECT repo_id, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE severity = '{s}') AS BIGINT) AS {s}" for s in ("critical", "high", "medium", "low"))
    + " FROM final WHERE NOT hidden GROUP BY repo_id", SUPPRESSED_CTES))
def severity_counts(spark, sf_dir):
    return an.severity_counts(suppressed_findings(spark, sf_dir))


@register("scan_summary", core_sql(f"""SELECT f.repo_id, f.files_scanned, f.bytes_scanned, false AS truncated,
    CAST(coalesce(s.active, 0) AS BIGINT) AS active_findings, CAST(coalesce(s.gone, 0) AS BIGINT) AS suppressed_findings,
    CAST(coalesce(r.n, 0) AS BIGINT) AS ignore_rules_applied, {ck.score_sql('s.penalty')} AS score
    FROM (SELECT repo_id, count(*) AS files_scanned, CAST(sum(size) AS BIGINT) AS bytes_scanned FROM files GROUP BY repo_id) f
    LEFT JOIN (SELECT repo_id, count(*) AS n FROM rules_text GROUP BY repo_id) r USING (repo_id)
    LEFT JOIN (SELECT repo_id, count(*) FILTER (WHERE NOT hidden) AS active, count(*) FILTER (WHERE hidden) AS gone,
      sum({ck.WEIGHT}) FILTER (WHERE NOT hidden) AS penalty FROM final GROUP BY repo_id) s USING (repo_id)""", SUPPRESSED_CTES))
def scan_summary(spark, sf_dir):
    return an.scan_summary(dv.derived_files(spark, sf_dir), suppressed_findings(spark, sf_dir), project_rules(spark, sf_dir))


@register("rule_catalogue", core_sql("""SELECT repo_id, rule, regexp_replace(rule, '\\W+', '_', 'g') AS name, title, fix, category,
    confidence_score || '%' AS confidence, rule_type, nullif(split_part(refs, ', ', 1), '') AS help_uri
    FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, rule ORDER BY file, ord, line, id) AS rn FROM final WHERE NOT hidden)
    WHERE rn = 1""", SUPPRESSED_CTES))
def rule_catalogue(spark, sf_dir):
    return an.rule_catalogue(suppressed_findings(spark, sf_dir))


@register("fail_gate", core_sql(f"""SELECT d.repo_id, coalesce(bool_or({ck.RANK} >= 4), false) AS failed
    FROM (SELECT DISTINCT source AS repo_id FROM documents) d LEFT JOIN (SELECT * FROM final WHERE NOT hidden) USING (repo_id)
    GROUP BY d.repo_id""", SUPPRESSED_CTES))
def fail_gate(spark, sf_dir):
    return an.fail_gate(dv.derived_repositories(spark, sf_dir), suppressed_findings(spark, sf_dir), "critical")


@register("severity_filter", core_sql(f"SELECT repo_id, id, severity FROM findings WHERE {ck.RANK} >= 3"))
def severity_filter(spark, sf_dir):
    return an.severity_filter(core_findings(spark, sf_dir), "high").select("repo_id", "id", "severity")


@register("severity_rank", core_sql(f"SELECT repo_id, id, {ck.RANK} AS rank, {ck.WEIGHT} AS weight FROM findings"))
def severity_rank_query(spark, sf_dir):
    from lintlake.functions.findings import severity_weight

    return core_findings(spark, sf_dir).select(
        "repo_id", "id", severity_rank(F.col("severity")).alias("rank"), severity_weight(F.col("severity")).alias("weight"))


@register("confidence_filter", core_sql("SELECT repo_id, id, confidence_score FROM findings WHERE confidence_score >= 80"))
def confidence_filter(spark, sf_dir):
    return an.confidence_filter(core_findings(spark, sf_dir), 80).select("repo_id", "id", "confidence_score")


@register("confidence_report", core_sql("SELECT repo_id, count(*) FILTER (WHERE confidence_score >= 80) AS shown, "
                                        "count(*) FILTER (WHERE confidence_score < 80) AS hidden FROM findings GROUP BY repo_id"))
def confidence_report(spark, sf_dir):
    return an.confidence_report(core_findings(spark, sf_dir), 80)


@register("search_findings", core_sql("SELECT repo_id, id, title FROM findings WHERE severity = 'critical' AND "
                                      "contains(lower(title || ' ' || category || ' ' || evidence || ' ' || fix), 'injection')"))
def search_findings(spark, sf_dir):
    return an.search_findings(core_findings(spark, sf_dir), " Injection ", "critical").select("repo_id", "id", "title")


@register("top_findings", core_sql("SELECT repo_id, id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id "
                                   "ORDER BY file, ord, line, id) AS INTEGER) AS rank FROM final WHERE NOT hidden) WHERE rank <= 10", SUPPRESSED_CTES))
def top_findings(spark, sf_dir):
    return an.top_findings(suppressed_findings(spark, sf_dir), 10).select("repo_id", "id", "rank")


@register("severity_sort", core_sql(f"SELECT repo_id, id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id "
                                    f"ORDER BY {ck.RANK} DESC, file, ord, line, id) AS INTEGER) AS rank FROM findings)"))
def severity_sort(spark, sf_dir):
    return an.severity_places(core_findings(spark, sf_dir)).select("repo_id", "id", F.col("place").cast("int").alias("rank"))


@register("group_by_severity", core_sql(f"""SELECT repo_id, id, severity, CAST(count(*) OVER (PARTITION BY repo_id, severity) AS BIGINT)
    AS group_size, 5 - {ck.RANK} AS group_rank FROM final WHERE NOT hidden AND {ck.RANK} >= 2""", SUPPRESSED_CTES))
def group_by_severity(spark, sf_dir):
    return an.group_by_severity(settle(suppressed_findings(spark, sf_dir)), "medium").select(
        "repo_id", "id", "severity", "group_size", "group_rank")


DESCRIBED = ("'[' || severity || '] ' || file || ':' || line || ': ' || title || ' (' || rule || ')' || chr(10) || "
             "{pad} || 'Evidence: ' || evidence || chr(10) || {pad} || 'Fix: ' || fix")


@register("describe", core_sql(f"SELECT repo_id, id, file || ':' || line AS location, {DESCRIBED.replace('{pad}', ck.q(''))} AS description FROM findings"))
def describe(spark, sf_dir):
    return core_findings(spark, sf_dir).select(
        "repo_id", "id", prompts.location(F.col("file"), F.col("line")).alias("location"), prompts.describe().alias("description"))


@register("fix_prompt", core_sql(
    f"SELECT repo_id, id, {ck.q(prompts.TOOL + prompts.PROMPT_HEAD)} || chr(10) || chr(10) || {DESCRIBED.replace('{pad}', ck.q(''))} || chr(10) || "
    f"chr(10) || {ck.q(prompts.PROMPT_TAIL)} AS fix_prompt FROM findings"))
def fix_prompt(spark, sf_dir):
    return prompts.with_fix_prompts(core_findings(spark, sf_dir)).select("repo_id", "id", "fix_prompt")


NUMBERED = f"""SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {ck.RANK} DESC, file, ord, line, id) AS number FROM final WHERE NOT hidden"""


@register("number_items", core_sql(f"SELECT repo_id, id, CAST(number AS BIGINT) AS number FROM ({NUMBERED})", SUPPRESSED_CTES))
def number_items(spark, sf_dir):
    return prompts.number_items(settle(suppressed_findings(spark, sf_dir))).select("repo_id", "id", "number")


PROMPT_ITEMS = 15


@register("combined_fix_prompt", core_sql(f"""SELECT repo_id, CAST((number - 1) // {PROMPT_ITEMS} AS BIGINT) AS part,
    '{prompts.TOOL} found ' || max(n) || ' weakness' || CASE WHEN max(n) = 1 THEN '' ELSE 'es' END ||
    '; the worst come first. Work through the list from the top.' || chr(10) || {ck.q(prompts.COMBINED_RULES)} || chr(10) || chr(10) ||
    string_agg(number || '. ' || {DESCRIBED.replace('{pad}', ck.q('   '))}, chr(10) || chr(10) ORDER BY number) || chr(10) || chr(10) ||
    {ck.q(prompts.COMBINED_TAIL)} AS prompt
    FROM (SELECT *, count(*) OVER (PARTITION BY repo_id) AS n FROM ({NUMBERED})) GROUP BY ALL""", SUPPRESSED_CTES))
def combined_fix_prompt(spark, sf_dir):
    return prompts.combined_fix_prompt(settle(suppressed_findings(spark, sf_dir)), items_per_prompt=PROMPT_ITEMS)


TEMPLATES = ", ".join(f"({ck.q(r)}, {ck.q(s)}, {ck.q(b)})" for r, (s, b) in prompts.REMEDIATIONS.items())


@register("remediation_lookup", core_sql(f"""SELECT f.repo_id, f.id, coalesce(t.summary, 'Manual fix required') AS patch_summary,
    coalesce(t.body, '// {prompts.TOOL} does not have an automated patch for ' || f.rule || ' yet.' || chr(10) || '// Apply: ' || f.fix) AS patch_body
    FROM findings f LEFT JOIN (VALUES {TEMPLATES}) t(rule, summary, body) ON f.rule = t.rule"""))
def remediation_lookup(spark, sf_dir):
    return prompts.remediation_lookup(core_findings(spark, sf_dir)).select("repo_id", "id", "patch_summary", "patch_body")


@register("sarif_results", core_sql("""SELECT repo_id, id, rule AS rule_id, CASE WHEN severity IN ('critical', 'high') THEN 'error'
    WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, title || ' — ' || fix AS message, file AS uri, line AS start_line
    FROM final WHERE NOT hidden""", SUPPRESSED_CTES))
def sarif_results(spark, sf_dir):
    rows = sinks.sarif_results(suppressed_findings(spark, sf_dir))
    place = F.col("result.locations")[0]["physicalLocation"]
    return rows.select("repo_id", "id", F.col("result.ruleId").alias("rule_id"), F.col("result.level").alias("level"),
                       F.col("result.message.text").alias("message"), place["artifactLocation"]["uri"].alias("uri"),
                       place["region"]["startLine"].alias("start_line"))


def sarif_totals(documents):
    """One row per scan from all parts of its document; each part carries the whole rule list."""
    parsed = F.from_json("sarif", "runs array<struct<results:array<struct<ruleId:string>>,"
                                  "tool:struct<driver:struct<rules:array<struct<id:string>>>>>>")
    run = parsed["runs"][0]
    parts = documents.select(
        "repo_id", "part", F.size(run["results"]).cast("long").alias("n"), F.size(run["tool"]["driver"]["rules"]).cast("long").alias("rules"),
        F.coalesce(F.try_element_at(run["results"], F.lit(1))["ruleId"], F.lit("")).alias("first"))
    return parts.groupBy("repo_id").agg(
        F.sum("n").alias("n_results"), F.max("rules").alias("n_rules"), F.min_by("first", "part").alias("first_rule"))


@register("sarif_documents", core_sql("""SELECT d.repo_id, coalesce(n, 0) AS n_results, coalesce(rules, 0) AS n_rules,
    coalesce(first_rule, '') AS first_rule FROM (SELECT DISTINCT source AS repo_id FROM documents) d LEFT JOIN (
      SELECT repo_id, count(*) AS n, count(DISTINCT rule) AS rules, arg_min(rule, (file, ord, line, id)) AS first_rule
      FROM final WHERE NOT hidden GROUP BY repo_id) USING (repo_id)""", SUPPRESSED_CTES))
def sarif_documents(spark, sf_dir):
    documents = sinks.sarif_documents(dv.derived_repositories(spark, sf_dir), settle(suppressed_findings(spark, sf_dir)))
    return sarif_totals(documents)


def report_totals(reports):
    """One row per scan from all parts of its report, ids in scan order."""
    listed = F.from_json("json", "findings array<struct<id:string,suppressed:boolean>>")["findings"]
    parts = reports.select(
        "repo_id", "part", F.size(listed).cast("long").alias("n"), F.size(F.filter(listed, lambda f: f["suppressed"])).cast("long").alias("hidden"),
        F.array_join(F.transform(listed, lambda f: f["id"]), ",").alias("ids"))
    # The ids of a scan are one value of the result.
    in_order = F.array_sort(F.collect_list(F.struct("part", "ids")))
    return parts.groupBy("repo_id").agg(
        F.sum("n").alias("n_findings"), F.sum("hidden").alias("n_suppressed"),
        F.array_join(F.transform(in_order, lambda p: p["ids"]), ",").alias("ids"))


@register("json_reports", core_sql("""SELECT repo_id, CAST(count(*) AS BIGINT) AS n_findings, CAST(count(*) FILTER (WHERE hidden) AS BIGINT) AS n_suppressed,
    string_agg(id, ',' ORDER BY file, ord, line, id) AS ids FROM final GROUP BY repo_id""", SUPPRESSED_CTES))
def json_reports(spark, sf_dir):
    findings = settle(suppressed_findings(spark, sf_dir))
    headers = findings.groupBy("repo_id").agg(F.count("*").alias("n"))
    reports = sinks.json_reports(headers, findings)
    return report_totals(reports)


def versions(spark, sf_dir):
    def at(version):
        return settle(scan.unique_findings(scan.scan_files(dv.derived_files(spark, sf_dir, version), RULEBOOK)))

    return at(1), at(0)


def two_versions(select: str) -> str:
    def named(version: int) -> str:
        return (f"(WITH {ck.scan_ctes(RULEBOOK, dv.derived_files_sql(version))} SELECT repo_id, id, rule, severity FROM findings)")

    return f"WITH now_f AS {named(1)}, before_f AS {named(0)} {select}"


@register("scan_diff", two_versions("""SELECT repo_id, id, rule, 'added' AS change FROM now_f WHERE (repo_id, id) NOT IN (SELECT (repo_id, id) FROM before_f)
    UNION ALL SELECT repo_id, id, rule, 'removed' FROM before_f WHERE (repo_id, id) NOT IN (SELECT (repo_id, id) FROM now_f)
    UNION ALL SELECT repo_id, id, rule, 'persisted' FROM now_f WHERE (repo_id, id) IN (SELECT (repo_id, id) FROM before_f)"""))
def scan_diff(spark, sf_dir):
    now, before = versions(spark, sf_dir)
    return an.scan_diff(now, before).select("repo_id", "id", "rule", "change")


@register("scan_diff_summary", two_versions(f"""SELECT repo_id, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed,
    CAST(sum(persisted) AS BIGINT) AS persisted, {ck.score_sql('sum(w_now)')} - {ck.score_sql('sum(w_before)')} AS score_delta FROM (
      SELECT repo_id, CASE WHEN b.id IS NULL THEN 1 ELSE 0 END AS added, 0 AS removed, CASE WHEN b.id IS NULL THEN 0 ELSE 1 END AS persisted,
        {ck.WEIGHT.replace('severity', 'n.severity')} AS w_now, 0 AS w_before FROM now_f n LEFT JOIN (SELECT repo_id, id FROM before_f) b USING (repo_id, id)
      UNION ALL SELECT repo_id, 0, CASE WHEN n.id IS NULL THEN 1 ELSE 0 END, 0, 0, {ck.WEIGHT.replace('severity', 'b.severity')}
        FROM before_f b LEFT JOIN (SELECT repo_id, id FROM now_f) n USING (repo_id, id)) GROUP BY repo_id""").replace("b.id IS NULL", "b.id IS NULL"))
def scan_diff_summary(spark, sf_dir):
    now, before = versions(spark, sf_dir)
    return an.scan_diff_summary(now, before)


@register("intersect_ids", two_versions("SELECT repo_id, id FROM now_f INTERSECT SELECT repo_id, id FROM before_f"))
def intersect_ids(spark, sf_dir):
    now, before = versions(spark, sf_dir)
    return now.select("repo_id", "id").intersect(before.select("repo_id", "id"))


@register("except_ids", two_versions("SELECT repo_id, id FROM now_f EXCEPT SELECT repo_id, id FROM before_f"))
def except_ids(spark, sf_dir):
    now, before = versions(spark, sf_dir)
    return now.select("repo_id", "id").exceptAll(before.select("repo_id", "id"))


@register("restrict_to_paths", core_sql("SELECT repo_id, id, file FROM findings WHERE file IN (SELECT f.path FROM files f JOIN documents d "
                                        "USING (doc_id) WHERE d.lang = 'en')"))
def restrict_to_paths(spark, sf_dir):
    files = dv.derived_files(spark, sf_dir)
    english = dv.table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    changed = files.join(english, "doc_id", "left_semi").select("repo_id", "path")
    return an.restrict_to_paths(core_findings(spark, sf_dir), changed).select("repo_id", "id", "file")


# Labels say which documents are expected to hold a critical finding.
@register("detection_quality", core_sql("""SELECT count(*) FILTER (WHERE f.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS matched,
    count(*) FILTER (WHERE f.doc_id IS NULL) AS missed, count(*) FILTER (WHERE l.doc_id IS NULL) AS unexpected,
    round(count(*) FILTER (WHERE f.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) / count(l.doc_id), 6) AS recall,
    round(count(*) FILTER (WHERE f.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) / count(f.doc_id), 6) AS precision
    FROM (SELECT DISTINCT doc_id FROM findings x JOIN files y ON x.file = y.path WHERE severity = 'critical') f
    FULL JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0 OR toxic = 1) l ON f.doc_id = l.doc_id"""))
def detection_quality(spark, sf_dir):
    files = dv.derived_files(spark, sf_dir).select("doc_id", "repo_id", F.col("path").alias("file"))
    actual = core_findings(spark, sf_dir).where("severity = 'critical'").join(files, ["repo_id", "file"]).select("doc_id")
    expected = dv.table(spark, sf_dir, "labels").where("quality = 0 OR toxic = 1").select("doc_id")
    return an.detection_quality(actual, expected, ["doc_id"])


@register("expected_in_range", core_sql("""SELECT repo_id, file, line FROM (SELECT l.doc_id, f.repo_id, f.path AS file, l.quality * 40 + l.doc_id % 7 AS line,
    len(string_split(f.content, chr(10))) AS n FROM labels l JOIN files f USING (doc_id)) WHERE line < 1 OR line > n"""))
def expected_in_range(spark, sf_dir):
    files = dv.derived_files(spark, sf_dir)
    labels = dv.table(spark, sf_dir, "labels")
    expected = labels.join(files.select("doc_id", "repo_id", F.col("path").alias("file")), "doc_id").select(
        "repo_id", "file", (F.col("quality") * 40 + F.col("doc_id") % 7).alias("line"))
    return an.expected_in_range(expected, files).select("repo_id", "file", "line")


@register("scan_stream", ck.scan_sql(RULEBOOK))
def scan_stream(spark, sf_dir):
    """The corpus arriving as commits whose files are spread over many micro-batches."""
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    files = dv.derived_files(spark, sf_dir).withColumn("sha", F.concat(F.lit("c"), F.pmod("doc_id", F.lit(3)).cast("string")))
    for _ in dv.arrivals(files.drop("doc_id"), F.pmod(F.xxhash64("path"), F.lit(4)), 4, place):
        streams.scan_stream(streams.read_file_stream(spark, f"{place}/in"), f"{place}/out", f"{place}/checkpoint").awaitTermination()
    found = spark.read.option("basePath", f"{place}/out/findings").parquet(f"{place}/out/findings")
    return shown(found)


@register("write_findings", core_sql("SELECT repo_id, id, rule, severity, file, CAST(line AS INTEGER) AS line, evidence FROM findings"))
def write_findings(spark, sf_dir):
    """Findings after a round trip through the lake table, in two batches of which the first is delivered twice."""
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lake/{uuid.uuid4().hex}"
    day, second = F.lit("2024-01-01").alias("scan_date"), F.pmod(F.xxhash64("repo_id"), F.lit(2)) == 1
    findings = settle(core_findings(spark, sf_dir).select("*", day))
    scans = dv.derived_repositories(spark, sf_dir).select("repo_id", day)
    for batch in ("first", "second", "first"):
        part = second if batch == "second" else ~second
        sinks.write_findings(scans.where(part), findings.where(part), place, batch_id=batch)
    return spark.read.parquet(f"{place}/findings").select("repo_id", "id", "rule", "severity", "file", "line", "evidence")


ROLLUP_SETS = [("day", "repo_id", "rule", "severity"), ("repo_id", "severity"), ("rule",), ("day",), ()]
_SETS = ", ".join("(" + ", ".join(names) + ")" for names in ROLLUP_SETS)
_NAMES = " ".join(f"WHEN {sum(1 << (3 - i) for i, d in enumerate(rollups.DIMENSIONS) if d not in names)} THEN '{','.join(names)}'" for names in ROLLUP_SETS)


@register("findings_rollup", core_sql(f"""SELECT CASE GROUPING(day, repo_id, rule, severity) {_NAMES} END AS grouping, day, repo_id, rule, severity,
      count(*) AS n, count(DISTINCT file) AS distinct_files
    FROM (SELECT *, line % 7 AS day FROM findings) GROUP BY GROUPING SETS ({_SETS})"""))
def findings_rollup(spark, sf_dir):
    """All totals come from the stored daily ones; the day stands for that of a scan."""
    findings = core_findings(spark, sf_dir).withColumn("day", F.col("line") % 7)
    return rollups.findings_rollup(settle(rollups.daily_totals(findings)), ROLLUP_SETS)
