"""SQL texts of the checks: rule scans written for a second engine.

The patterns are the rulebook's own data in RE2 spelling; the way they are
applied (unnested lines, cut pieces, running line counts) is not the library's.
"""

from __future__ import annotations

import re

from lintlake.functions import masking, text
from lintlake.functions.findings import RULE_CONFIDENCE
from lintlake.operators.rules import Rule
from lintlake.operators.rules import rulebook as rb
from lintlake.plans.derived import EXPECTED_CALLS, derived_files_sql

NOT_IN_NAME = r"(?<![\w.])"
START, END, SPLIT = "chr(57344)", "chr(57345)", "chr(57346)"


def re2(pattern: str) -> str:
    """RE2 spelling of a Java pattern: no look-around."""
    return pattern.replace(r"(?<!\w)", r"\b").replace(r"(?!\w)", r"\b").replace("(?<![A-Za-z0-9_])", "")


def q(value: str) -> str:
    """SQL string literal."""
    return " || chr(10) || ".join("'" + piece.replace("'", "''") + "'" for piece in value.split("\n"))


def rx(pattern: str) -> str:
    return q(re2(pattern)).replace(" || chr(10) || ", "\\n") if "\n" in pattern else q(re2(pattern))


def language_sql(path: str = "path") -> str:
    cases = " ".join(f"WHEN regexp_matches({path}, {q('(?i)' + p)}) THEN '{n}'" for n, p in text.LANGUAGE_EXTENSIONS)
    return f"CASE {cases} ELSE 'unknown' END"


def trim_sql(expr: str) -> str:
    return f"trim({expr}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def mask_sql(expr: str) -> str:
    masks = [(p, r) for p, r, _ in masking.SECRET_MASKS + masking.EXTRA_MASKS]
    masks.append((masking.KEYWORD_MASK_QUOTED, "$1[redacted]"))
    out = expr
    for pattern, replacement in masks:
        out = f"regexp_replace({out}, {rx(pattern)}, {q(replacement.replace('$1', chr(92) + '1'))}, 'g')"
    return out


def confidence_sql(rule_type: str, signal: str) -> str:
    base = " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in RULE_CONFIDENCE.items())
    return (f"CAST(greatest(40, least(99, CASE {rule_type} {base} ELSE 70 END "
            f"+ least(8, greatest(-10, {signal})))) AS INTEGER)")


def source_sql(rule_type: str) -> str:
    return f"CASE {rule_type} " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in RULE_CONFIDENCE.items()) + " ELSE 'regex heuristic' END"


# What the file rules ask of (content, path).
FILE_CONDITIONS = {
    "auth.unprotected_route": lambda: (
        f"(regexp_matches(path, {rx(rb.API_DIR_PATH)}) OR regexp_matches(path, {rx(rb.HANDLER_NAME_PATH)})) "
        f"AND NOT regexp_matches(path, {rx(rb.PRIVATE_SEGMENT_PATH)}) AND NOT regexp_matches(path, '(?i)webhook') "
        f"AND NOT regexp_matches(path, {rx(rb.NEXT_ROUTE_PATH)}) AND regexp_matches(content, {rx(rb.HANDLER_CODE)}) "
        f"AND NOT regexp_matches(content, {rx(rb.GUARD_WORDS)}) AND NOT regexp_matches(content, {rx(rb.GUARD_CALLS)})"),
    "webhooks.unverified_signature": lambda: (
        f"lower(path) LIKE '%webhook%' AND NOT contains(lower(content), 'clerk') "
        f"AND regexp_matches(content, {rx(rb.WEBHOOK_PARSES)}) AND NOT regexp_matches(content, {rx(rb.WEBHOOK_VERIFIES)})"),
    "clerk.webhook_unverified": lambda: (
        f"lower(path) LIKE '%webhook%' AND contains(lower(content), 'clerk') "
        f"AND NOT regexp_matches(content, {rx(rb.CLERK_VERIFIES)})"),
    "secrets.client_bundle_exposure": lambda: f"regexp_matches(content, {rx(rb.PUBLIC_SECRET_NAME)})",
    "supabase.service_role_client_side": lambda: (
        f"contains(content, 'SUPABASE_SERVICE_ROLE_KEY') AND regexp_matches(content, {rx(rb.USE_CLIENT)})"),
    "supabase.service_role_in_client_bundle": lambda: f"regexp_matches(content, {rx(rb.USE_CLIENT)})",
    "nextjs.route_handler_no_auth": lambda: (
        f"regexp_matches(path, {rx(rb.NEXT_ROUTE_PATH)}) AND lower(path) NOT LIKE '%webhook%' "
        f"AND NOT regexp_matches(content, {rx(rb.AUTH_NEARBY)})"),
    "py.unprotected_route": lambda: (
        f"(regexp_matches(content, {rx(rb.PY_ROUTE)}) OR regexp_matches(content, {rx(rb.PY_VIEW)}) "
        f"OR regexp_matches(path, {rx(rb.PY_VIEW_PATH)})) AND NOT regexp_matches(content, {rx(rb.PY_GUARD)})"),
    "rb.unprotected_controller": lambda: (
        f"regexp_matches(content, {rx(rb.RB_CONTROLLER)}) AND NOT regexp_matches(content, {rx(rb.RB_GUARD)}) "
        f"AND regexp_matches(content, {rx(rb.RB_WRITE)})"),
    "go.unprotected_route": lambda: f"NOT regexp_matches(content, {rx(rb.GO_GUARD)})",
}


def _fill_sql(template: str, expr: str, pattern: str) -> str:
    parts = [p for p in re.split(r"(\$\d)", template) if p]
    return " || ".join(
        f"regexp_extract({expr}, {rx(pattern)}, {p[1]})" if re.fullmatch(r"\$\d", p) else q(p) for p in parts)


def _line_sql(i: int, rule: Rule) -> str:
    expr = "text" if rule.raw or rule.languages in (("javascript",), ("sql",)) else "code"
    where = [f"regexp_matches({expr}, {rx(rule.pattern)})"]
    where += [f"regexp_matches({expr}, {rx(p)})" for p in rule.also]
    if rule.languages:
        where.append(f"lang IN ({', '.join(q(n) for n in rule.languages)})")
    if rule.unless:
        where.append(f"NOT contains({expr}, {q(rule.unless)})")
    if rule.unless_pattern:
        where.append(f"NOT regexp_matches({expr}, {rx(rule.unless_pattern.removeprefix(NOT_IN_NAME))})")
    if rule.path_pattern:
        where.append(f"regexp_matches(path, {rx(rule.path_pattern)})")
    if rule.file_when:
        where.append("(" + FILE_CONDITIONS[rule.rule]() + ")")
    if not rule.languages:
        where.append(f"NOT regexp_matches(text, {q(text.COMMENT_LINE_PATTERNS['generic'])})")
    elif rule.languages[0] in ("javascript", "sql"):
        where.append(f"NOT regexp_matches(text, {q(text.COMMENT_LINE_PATTERNS[rule.languages[0]])})")
    shown = _fill_sql(rule.shown, expr, rule.pattern) if rule.shown else trim_sql(expr)
    subject = _fill_sql(rule.subject, expr, rule.pattern) if rule.subject else "CAST(NULL AS VARCHAR)"
    return (f"SELECT {i} AS ord, repo_id, path, line, path || ':' || line || ' ' || {shown} AS evidence, "
            f"{subject} AS subject FROM lines WHERE {' AND '.join(where)}")


def _file_sql(i: int, rule: Rule) -> str:
    return (f"SELECT {i} AS ord, repo_id, path, 1 AS line, path || ' ' || {q(rule.shown)} AS evidence, CAST(NULL AS VARCHAR) AS subject "
            f"FROM files WHERE lang = '{rule.languages[0]}' AND {FILE_CONDITIONS[rule.rule]()}")


def _span_sql(i: int, rule: Rule) -> str:
    body = rule.pattern[len(NOT_IN_NAME):]
    pattern = r"(^|[^\w.])(" + body + ")"

    def template(value: str | None) -> str:
        return q(re.sub(r"\$(\d)", lambda m: "\\" + str(int(m.group(1)) + 2), value or ""))

    marked = (f"regexp_replace(content, {rx(pattern)}, '\\1' || {START} || {template(rule.subject)} || {SPLIT} || "
              f"{template(rule.shown)} || {END} || '\\2', 'g')")
    extra = f" AND {FILE_CONDITIONS[rule.rule]()}" if rule.file_when else ""
    comment = text.COMMENT_LINE_PATTERNS["javascript"]
    return f"""SELECT {i} AS ord, repo_id, path, line,
        path || ':' || line || ' ' || string_split(marker, {SPLIT})[2] AS evidence, string_split(marker, {SPLIT})[1] AS subject
      FROM (SELECT repo_id, path, content, pos, string_split(piece, {END})[1] AS marker,
              CAST(1 + sum(length(piece) - length(replace(piece, chr(10), ''))) OVER (
                PARTITION BY repo_id, path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER) AS line
            FROM (SELECT repo_id, path, content, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos
                  FROM (SELECT *, string_split({marked}, {START}) AS pieces FROM files WHERE lang = 'javascript'{extra})))
      WHERE pos > 1 AND NOT regexp_matches(string_split(content, chr(10))[line], {q(comment)})"""


def _call_sql(i: int, rule: Rule) -> str:
    """The rows that the planted calls must give."""
    rows = [(text, shown) for name, text, shown in EXPECTED_CALLS if name == rule.rule]
    if rule.rule == "nextjs.cookies_missing_options":  # two rules: of cookies itself, and of a member of that name
        rows = [r for r in rows if r[1].startswith("cookies.") == rule.shown.startswith("cookies.")]
    values = ", ".join(f"({q(text)}, {q(shown)}, {q(shown.split('(')[0])})" for text, shown in rows)
    return f"""SELECT {i} AS ord, repo_id, path, line,
        path || ':' || line || ' ' || replace(shown, '{{text}}', regexp_extract(text, '"([^"]*)"', 1)) AS evidence, subject
      FROM lines JOIN (VALUES {values}) AS expected(line_like, shown, subject) ON text LIKE line_like WHERE lang = 'javascript'"""


def scan_ctes(rules: list[Rule], files_sql: str | None = None) -> str:
    """CTEs files, lines, rules, hits and findings of a rule scan."""
    parts = []
    for i, rule in enumerate(rules):
        parts.append({"line": _line_sql, "span": _span_sql, "file": _file_sql, "call": _call_sql}[rule.scope](i, rule))
    values = ", ".join(
        f"({i}, {q(r.rule)}, {q(r.severity)}, {q(r.title)}, {q(r.category)}, {q(r.fix)}, {q(', '.join(r.references))}, "
        f"{q(r.rule_type)}, {r.signal})" for i, r in enumerate(rules))
    code = "CASE lang " + " ".join(
        f"WHEN '{n}' THEN regexp_replace(text, {q(p)}, {q(chr(92) + '1') if n == 'python' else q('')})"
        for n, p in text.COMMENT_PATTERNS.items()) + " ELSE text END"
    return f"""files AS (SELECT *, {language_sql()} AS lang FROM ({files_sql or derived_files_sql()})),
    split AS (SELECT *, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS all_lines FROM files),
    numbered AS (SELECT repo_id, path, lang, content, unnest(all_lines) AS text,
                        generate_subscripts(all_lines, 1) AS line FROM split),
    lines AS (SELECT *, {code} AS code FROM numbered),
    rules(ord, rule, severity, title, category, fix, refs, rule_type, signal) AS (VALUES {values}),
    hits AS ({' UNION ALL '.join(parts)}),
    masked AS (SELECT h.ord, h.repo_id, h.path AS file, CAST(h.line AS INTEGER) AS line, h.subject,
                      {mask_sql('h.evidence')} AS evidence FROM hits h),
    raw_findings AS (SELECT m.repo_id, m.file, m.line, m.evidence, m.ord, r.rule, r.severity,
        replace(r.title, '%s', coalesce(m.subject, '')) AS title, r.category, r.fix, r.refs, r.rule_type,
        {confidence_sql('r.rule_type', 'r.signal')} AS confidence_score,
        {source_sql('r.rule_type')} AS confidence_source,
        substr(sha256(r.rule || '|' || m.file || '|' || m.line || '|' || m.evidence), 1, 16) AS id,
        false AS suppressed
      FROM masked m JOIN rules r USING (ord)),
    findings AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
        PARTITION BY repo_id, id ORDER BY file, ord, line, title, severity) AS rn FROM raw_findings) WHERE rn = 1)"""


def scan_sql(rules: list[Rule], files_sql: str | None = None) -> str:
    return f"""WITH {scan_ctes(rules, files_sql)}
    SELECT repo_id, id, rule, severity, title, category, file, line, evidence, fix, refs, confidence_score,
           confidence_source, rule_type FROM findings"""


WEIGHT = "CASE severity WHEN 'critical' THEN 18 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 0 END"
RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END"


def score_sql(penalty: str) -> str:
    return f"CAST(greatest(0, least(100, 100 - coalesce({penalty}, 0))) AS INTEGER)"
