"""Registered queries: sources, scalar steps and rule scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions import findings as fnd
from lintlake.functions import text as txt
from lintlake.functions.masking import mask_secrets, redact_corpus
from lintlake.operators import budget, scan
from lintlake.operators.rules import RULEBOOK, rules_for
from lintlake.plans import checks as ck
from lintlake.plans.derived import derived_files, derived_files_sql, table
from lintlake.plans.registry import register
from lintlake.plans.scans import union_findings
from lintlake.sources import corpus

JS_RULES = [r for r in RULEBOOK if r.languages == ("javascript",)]
FAMILIES = {
    "scan_secrets": [r for r in rules_for("secrets.") if not r.languages and r.rule != "secrets.env_public_secret"],
    "scan_env_files": rules_for("secrets.env_public_secret"),
    "scan_python": rules_for("py."),
    "scan_ruby": rules_for("rb."),
    "scan_go": rules_for("go."),
    "scan_php": rules_for("php."),
    "scan_sql": rules_for("db."),
    "scan_js_lines": [r for r in JS_RULES if r.scope == "line"],
    "scan_js_spans": [r for r in JS_RULES if r.scope in ("span", "call")],
    "scan_js_files": [r for r in JS_RULES if r.scope == "file"],
}
SHOWN = ("repo_id", "id", "rule", "severity", "title", "category", "file", "line", "evidence", "fix", "refs",
         "confidence_score", "confidence_source", "rule_type")


def core_findings(spark, sf_dir) -> DataFrame:
    return scan.unique_findings(scan.scan_files(derived_files(spark, sf_dir), RULEBOOK))


def core_sql(select: str, more: str = "") -> str:
    return f"WITH RECURSIVE {ck.scan_ctes(RULEBOOK)}{more} {select}"


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("refs", F.array_join("references", ", ")).select(*SHOWN)


def _family(rules):
    return lambda spark, sf_dir: shown(scan.unique_findings(scan.scan_files(derived_files(spark, sf_dir), rules)))


for _name, _rules in FAMILIES.items():
    register(_name, ck.scan_sql(_rules))(_family(_rules))

register("scan_all_rules", ck.scan_sql(RULEBOOK))(_family(RULEBOOK))


@register("build_finding", core_sql("SELECT repo_id, id, rule, file, line, evidence, confidence_score || '%' AS confidence, "
                                    "confidence_source, rule_type, suppressed FROM findings"))
def build_finding(spark, sf_dir):
    return core_findings(spark, sf_dir).select(
        "repo_id", "id", "rule", "file", "line", "evidence", "confidence", "confidence_source", "rule_type", "suppressed")


@register("rules_enrich", f"WITH {ck.scan_ctes(RULEBOOK)} SELECT repo_id, rule, severity, title, category, file, line, "
                          "count(*) AS n FROM raw_findings GROUP BY ALL")
def rules_enrich(spark, sf_dir):
    hits = scan.scan_hits(derived_files(spark, sf_dir), RULEBOOK)
    return scan.rules_enrich(hits, RULEBOOK).groupBy(
        "repo_id", "rule", "severity", "title", "category", "file", "line").agg(F.count("*").alias("n"))


# Two overlapping rule sets over the same files, so that union leaves duplicates for dedup.
TWICE = ", ".join(sorted({ck.q(r.rule) for r in [*FAMILIES["scan_secrets"], *FAMILIES["scan_env_files"]]}))


@register("union_findings", f"WITH {ck.scan_ctes(RULEBOOK)} SELECT repo_id, id, rule, n * CASE WHEN rule IN ({TWICE}) "
                            "THEN 2 ELSE 1 END AS n FROM (SELECT repo_id, id, rule, count(*) AS n FROM raw_findings GROUP BY ALL)")
def union_of_findings(spark, sf_dir):
    files = derived_files(spark, sf_dir)
    both = union_findings(scan.scan_files(files, RULEBOOK), scan.scan_files(files, FAMILIES["scan_secrets"]),
                          scan.scan_files(files, FAMILIES["scan_env_files"]))
    return both.groupBy("repo_id", "id", "rule").agg(F.count("*").alias("n"))


@register("unique_findings", f"WITH {ck.scan_ctes(RULEBOOK)} SELECT repo_id, id, rule, file, line FROM findings")
def unique_of_findings(spark, sf_dir):
    files = derived_files(spark, sf_dir)
    both = union_findings(scan.scan_files(files, RULEBOOK), scan.scan_files(files, FAMILIES["scan_secrets"]))
    return scan.unique_findings(both).select("repo_id", "id", "rule", "file", "line")


@register("files_from_documents", "SELECT source AS repo_id, source || '/' || doc_id || '.txt' AS path, "
                                  "md5(text) AS digest, CAST(strlen(text) AS BIGINT) AS size FROM documents")
def files_from_documents(spark, sf_dir):
    files = corpus.files_from_documents(table(spark, sf_dir, "documents"))
    return files.select("repo_id", "path", F.md5(F.col("content").cast("binary")).alias("digest"), "size")


@register("candidate_files", f"""SELECT repo_id, path, size FROM ({derived_files_sql()})
    WHERE size <= 163840 AND regexp_matches(path, {ck.rx(corpus.SERVICE_TEXT)})
      AND NOT regexp_matches(path, {ck.rx(corpus.SERVICE_SKIPPED)}) AND NOT contains(content, chr(0))""")
def candidate_files(spark, sf_dir):
    return corpus.candidate_files(derived_files(spark, sf_dir)).select("repo_id", "path", "size")


@register("detect_language", f"SELECT path, {ck.language_sql()} AS language FROM ({derived_files_sql()})")
def detect_language(spark, sf_dir):
    return derived_files(spark, sf_dir).select("path", txt.detect_language(F.col("path")).alias("language"))


LINES = f"WITH {ck.scan_ctes(RULEBOOK[:1])}"


@register("explode_lines", f"{LINES} SELECT repo_id, path, CAST(line AS INTEGER) AS line, text FROM lines")
def explode_lines(spark, sf_dir):
    return txt.explode_lines(derived_files(spark, sf_dir)).select("repo_id", "path", "line", "text")


@register("strip_comments", f"{LINES} SELECT path, CAST(line AS INTEGER) AS line, code FROM lines WHERE code <> text")
def strip_comments(spark, sf_dir):
    lines = txt.explode_lines(derived_files(spark, sf_dir))
    code = txt.strip_comments(txt.detect_language(F.col("path")), F.col("text"))
    return lines.select("path", "line", "text", code.alias("code")).where("code <> text").select("path", "line", "code")


@register("is_comment_line", f"{LINES} SELECT path, CAST(line AS INTEGER) AS line, text FROM lines WHERE "
                             f"regexp_matches(text, {ck.q(txt.COMMENT_LINE_PATTERNS['generic'])})")
def is_comment_line(spark, sf_dir):
    lines = txt.explode_lines(derived_files(spark, sf_dir)).select("path", "line", "text")
    return lines.where(txt.is_comment_line(F.col("text")))


@register("mask_secrets", f"{LINES} SELECT * FROM (SELECT path, CAST(line AS INTEGER) AS line, {ck.mask_sql('text')} AS masked, "
                          "text FROM lines) WHERE masked <> text")
def masked_lines(spark, sf_dir):
    lines = txt.explode_lines(derived_files(spark, sf_dir)).select("path", "line", "text")
    masked = lines.select("path", "line", "text", mask_secrets(F.col("text")).alias("masked"))
    return masked.where(F.col("masked") != F.col("text"))


@register("redact_corpus", f"SELECT doc_id, md5({ck.mask_sql('content')}) AS digest FROM ({derived_files_sql()})")
def redacted(spark, sf_dir):
    files = redact_corpus(derived_files(spark, sf_dir).select("doc_id", "content"), "content")
    return files.select("doc_id", F.md5(F.col("content").cast("binary")).alias("digest"))


GRID_TYPE = ("CASE l_linenumber % 7 WHEN 0 THEN 'literal_credential' WHEN 1 THEN 'ast_match' WHEN 2 THEN 'semantic_match' "
             "WHEN 3 THEN 'regex_match' WHEN 4 THEN 'dependency_cve' WHEN 5 THEN 'inference' ELSE 'other' END")


@register("calibrate_confidence", f"""SELECT l_orderkey, l_linenumber, rule_type,
    {ck.confidence_sql('rule_type', 'signal')} AS score, {ck.source_sql('rule_type')} AS source
    FROM (SELECT l_orderkey, l_linenumber, {GRID_TYPE} AS rule_type, CAST(l_quantity AS INTEGER) - 25 AS signal FROM lineitem)""")
def calibrate_confidence(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.expr(GRID_TYPE).alias("rule_type"),
        (F.col("l_quantity").cast("int") - 25).alias("signal"))
    return rows.select(
        "l_orderkey", "l_linenumber", "rule_type",
        fnd.confidence_score(F.col("rule_type"), F.col("signal")).alias("score"),
        fnd.confidence_source(F.col("rule_type")).alias("source"))


@register("fingerprint", "SELECT doc_id, substr(sha256('rule.' || lang || '|' || source || '|' || CASE WHEN doc_id % 3 = 0 THEN 0 "
                         "ELSE doc_id % 50 END || '|' || text), 1, 16) AS id FROM documents")
def fingerprint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    line = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 50)
    return docs.select("doc_id", fnd.fingerprint(
        F.concat(F.lit("rule."), F.col("lang")), F.col("source"), line, F.col("text")).alias("id"))


@register("env_key_value", f"""{LINES} SELECT path, CAST(line AS INTEGER) AS line,
    regexp_extract(text, {ck.rx(scan.RULEBOOK[-1].pattern)}, 1) AS env_key, regexp_extract(text, {ck.rx(scan.RULEBOOK[-1].pattern)}, 2) AS env_value
    FROM lines WHERE regexp_matches(path, {ck.rx(scan.RULEBOOK[-1].path_pattern)}) AND regexp_matches(text, {ck.rx(scan.RULEBOOK[-1].pattern)})""")
def env_key_value(spark, sf_dir):
    rule = RULEBOOK[-1]
    files = derived_files(spark, sf_dir).where(F.col("path").rlike(rule.path_pattern))
    lines = txt.explode_lines(files).where(F.col("text").rlike(rule.pattern))
    return lines.select("path", "line", F.regexp_extract("text", rule.pattern, 1).alias("env_key"),
                        F.regexp_extract("text", rule.pattern, 2).alias("env_value"))


REPO_URLS = ["https://github.com/acme{k}/app", "https://github.com/acme/app-{k}.git", "http://github.com/acme/{k}",
             "HTTPS://GitHub.com/Team{k}/Repo.GIT/tree/main?x=1", "https://example.com/{k}/b", "https://github.com/acme{k}"]


@register("parse_repo_url", f"""SELECT c_custkey, CASE WHEN ok THEN regexp_extract(url, {ck.rx(corpus.REPO_URL)}, 1) END AS owner,
    CASE WHEN ok THEN regexp_replace(regexp_extract(url, {ck.rx(corpus.REPO_URL)}, 2), '(?i)\\.git$', '') END AS repo,
    CASE WHEN NOT ok THEN 'invalid_repo_url' END AS error
    FROM (SELECT c_custkey, url, regexp_matches(url, {ck.rx(corpus.REPO_URL)}) AS ok FROM (SELECT c_custkey,
      CASE c_custkey % 6 {' '.join(f"WHEN {i} THEN replace({ck.q(u)}, '{{k}}', CAST(c_custkey AS VARCHAR))" for i, u in enumerate(REPO_URLS))} END
      AS url FROM customer))""")
def parse_repo_url(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    url = F.replace(F.element_at(F.array(*[F.lit(u) for u in REPO_URLS]), (F.col("c_custkey") % 6 + 1).cast("int")),
                    F.lit("{k}"), F.col("c_custkey").cast("string"))
    return corpus.parse_repo_url(customers.select("c_custkey", url.alias("repo_url"))).select(
        "c_custkey", "owner", "repo", "error")


MAX_FILES, MAX_BYTES = 20, 40_000


@register("running_bytes", f"""SELECT repo_id, path, CAST(row_number() OVER w AS BIGINT) AS position,
    CAST(sum(size) OVER w AS BIGINT) AS running_bytes FROM ({derived_files_sql()})
    WINDOW w AS (PARTITION BY repo_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_bytes(spark, sf_dir):
    return budget.running_bytes(derived_files(spark, sf_dir)).select("repo_id", "path", "position", "running_bytes")


STOP = f"""SELECT repo_id, path, size FROM (SELECT *, row_number() OVER w AS rn, sum(size) OVER w AS total
    FROM ({derived_files_sql()}) WINDOW w AS (PARTITION BY repo_id ORDER BY path ROWS UNBOUNDED PRECEDING))
    WHERE rn <= {MAX_FILES} AND total <= {MAX_BYTES}"""


@register("file_budget_stop", STOP)
def file_budget_stop(spark, sf_dir):
    return budget.file_budget_stop(derived_files(spark, sf_dir), MAX_FILES, MAX_BYTES).select("repo_id", "path", "size")


@register("file_budget_skip", f"""WITH RECURSIVE ordered AS (SELECT repo_id, path, size, row_number() OVER (
      PARTITION BY repo_id ORDER BY path) AS rn FROM ({derived_files_sql()})),
    walk AS (SELECT repo_id, path, size, rn, size <= {MAX_BYTES} AS taken, CASE WHEN size <= {MAX_BYTES} THEN size ELSE 0 END AS total,
        CASE WHEN size <= {MAX_BYTES} THEN 1 ELSE 0 END AS n FROM ordered WHERE rn = 1
      UNION ALL
      SELECT o.repo_id, o.path, o.size, o.rn, ok, w.total + CASE WHEN ok THEN o.size ELSE 0 END, w.n + CASE WHEN ok THEN 1 ELSE 0 END
      FROM (SELECT o.*, w.total AS before, w.n AS taken_n, (w.n < {MAX_FILES} AND w.total + o.size <= {MAX_BYTES}) AS ok
            FROM walk w JOIN ordered o ON o.repo_id = w.repo_id AND o.rn = w.rn + 1) o
      JOIN walk w ON o.repo_id = w.repo_id AND o.rn = w.rn + 1)
    SELECT repo_id, path, size FROM walk WHERE taken""")
def file_budget_skip(spark, sf_dir):
    return budget.file_budget_skip(derived_files(spark, sf_dir), MAX_FILES, MAX_BYTES)


@register("budget_report", f"""SELECT a.repo_id, CAST(count(k.path) AS BIGINT) AS files_scanned,
    CAST(coalesce(sum(k.size), 0) AS BIGINT) AS bytes_scanned, CAST(count(*) AS BIGINT) AS total_candidate_files,
    count(*) > count(k.path) AS truncated
    FROM ({derived_files_sql()}) a LEFT JOIN ({STOP}) k ON a.repo_id = k.repo_id AND a.path = k.path GROUP BY a.repo_id""")
def budget_report(spark, sf_dir):
    files = derived_files(spark, sf_dir)
    return budget.budget_report(files, budget.file_budget_stop(files, MAX_FILES, MAX_BYTES))
