"""Rule scans: one pass over a file table, one finding row per match.

The plan has no shuffle. Plain substring tests decide per line whether a regex
runs: only lines holding a rule's literal stay, and meet that rule's regex. File-wide and multi-line (span) matches and
calls are computed beside the lines and join the stream on the file's first
line, so the corpus is read once whatever the number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions.findings import assemble_findings
from lintlake.functions.sqltext import all_of, any_of, contains_any, literal, matches
from lintlake.functions.text import (
    BLANKS,
    COMMENT_LINE_PATTERNS,
    detect_language,
    split_lines,
    strip_comments,
)
from lintlake.operators.calls import call_hits
from lintlake.operators.rules import RULEBOOK, Rule

MARK_START, MARK_END, MARK_SPLIT = "\ue000", "\ue001", "\ue002"  # private-use characters
MARKED = f"{MARK_START}([^{MARK_END}]*){MARK_END}"
HIT = "array<struct<ord:int,line:int,shown:string,subject:string>>"
NO_HIT = f"CAST(NULL AS {HIT})"
Numbered = list[tuple[int, Rule]]


def _has_needle(rule: Rule, text: str) -> str:
    if not rule.needles:
        return "true"
    return contains_any(f"lower({text})" if rule.fold_case else text, rule.needles)


def _hit(ord_: int, line: str, shown: str, subject: str | None = None) -> str:
    return (f"named_struct('ord', {ord_}, 'line', CAST({line} AS INT), 'shown', {shown}, "
            f"'subject', {subject or 'CAST(NULL AS STRING)'})")


def _fill(template: str, text: str, pattern: str) -> str:
    """A template such as ``$1=<value>`` with the groups of the first match."""
    parts = [p for p in re.split(r"(\$\d)", template) if p]
    return "concat(" + ", ".join(
        f"regexp_extract({text}, {literal(pattern)}, {p[1]})" if re.fullmatch(r"\$\d", p) else literal(p) for p in parts
    ) + ")"


def _java_template(template: str | None) -> str:
    return re.sub(r"\$(?!\d)", r"\\$", template or "")


def _compact(items: Sequence[str]) -> str:
    return f"CAST(array_compact(array({', '.join(items)})) AS {HIT})"


def _line_hits(rules: Numbered, own_text: str) -> str:
    items = []
    for ord_, rule in rules:
        text = "text" if rule.raw else own_text
        tests = [matches("path", rule.path_pattern)] if rule.path_pattern else []
        tests += [_has_needle(rule, text), matches(text, rule.pattern), *[matches(text, p) for p in rule.also]]
        if rule.unless:
            tests.append(f"NOT contains({text}, {literal(rule.unless)})")
        if rule.unless_pattern:
            tests.append(f"NOT {matches(text, rule.unless_pattern)}")
        if rule.file_when:
            tests.append(f"flag_{ord_}")
        shown = _fill(rule.shown, text, rule.pattern) if rule.shown else f"btrim({text}, {literal(BLANKS)})"
        subject = _fill(rule.subject, text, rule.pattern) if rule.subject else None
        items.append(f"CASE WHEN {all_of(tests)} THEN {_hit(ord_, 'pos + 1', shown, subject)} END")
    return _compact(items)


def _span_hits(ord_: int, rule: Rule) -> str:
    """Hits of a pattern that may run over several lines.

    A marker holding the match's groups is inserted before each match; after
    splitting, the lines that carry a marker are the lines matches start on.
    """
    marker = MARK_START + _java_template(rule.subject) + MARK_SPLIT + _java_template(rule.shown) + MARK_END
    clean = f"translate(content, {literal(MARK_START + MARK_END + MARK_SPLIT)}, '   ')"
    marked = f"regexp_replace({clean}, {literal(rule.pattern)}, {literal(marker + '$0')})"
    numbered = f"transform(split({marked}, '\\n', -1), (x, i) -> named_struct('line', i + 1, 'text', x))"
    comment = COMMENT_LINE_PATTERNS["javascript" if rule.languages[:1] == ("javascript",) else "generic"]
    found = (f"filter({numbered}, s -> contains(s.text, {literal(MARK_START)}) AND NOT "
             f"{matches(f'regexp_replace(s.text, {literal(MARKED)}, {literal(str())})', comment)})")
    groups = f"split(m, {literal(MARK_SPLIT)})"
    hits = (f"flatten(transform({found}, s -> transform(regexp_extract_all(s.text, {literal(MARKED)}, 1), "
            f"m -> {_hit(ord_, 's.line', groups + '[1]', groups + '[0]')})))")
    tests = [_has_needle(rule, "content"), *([f"flag_{ord_}"] if rule.file_when else []), matches("content", rule.pattern)]
    return f"CASE WHEN {all_of(tests)} THEN CAST({hits} AS {HIT}) END"


def _by_language(languages: Sequence[str], value: Callable[[str], str | None], other: str) -> str:
    cases = [f"WHEN {literal(n)} THEN {v}" for n in languages if (v := value(n)) is not None]
    return f"CASE language {' '.join(cases)} ELSE {other} END" if cases else other


def scan_hits(files: DataFrame, rulebook: Sequence[Rule] = RULEBOOK) -> DataFrame:
    """(repo_id, path, ord, line, shown, subject) for every match of every rule."""
    numbered = list(enumerate(rulebook))
    languages = list(dict.fromkeys(name for _, r in numbered for name in r.languages))
    line_rules: Numbered = [(i, r) for i, r in numbered if r.scope == "line"]
    shared = [(i, r) for i, r in line_rules if not r.languages]
    flagged = [(i, r) for i, r in numbered if r.file_when]
    flags = [f"flag_{i}" for i, r in flagged if r.scope == "line"]

    def own(name: str, scope: str) -> Numbered:
        return [(i, r) for i, r in numbered if r.scope == scope and name in r.languages]

    def line_gate(rules: Numbered) -> str | None:
        tests = [all_of([*([matches("path", r.path_pattern)] if r.path_pattern else []), _has_needle(r, "text")]) for _, r in rules]
        return any_of(tests) if tests else None

    def flag(rule: Rule) -> str:
        of_language = f"language IN ({', '.join(literal(n) for n in rule.languages)})" if rule.languages else "true"
        return all_of([of_language, _has_needle(rule, "content"), rule.file_when])

    def whole_file(name: str) -> str | None:
        items = [f"CASE WHEN flag_{i} THEN CAST(array({_hit(i, '1', literal(r.shown))}) AS {HIT}) END"
                 for i, r in own(name, "file")]
        items += [_span_hits(i, r) for i, r in own(name, "span")]
        items += ["call_hits"] if own(name, "call") else []
        return f"flatten(array_compact(array({', '.join(items)})))" if items else None

    def own_lines(name: str) -> str | None:
        rules = own(name, "line")
        if not rules:
            return None
        gate = any_of([_has_needle(r, "text") for _, r in rules])
        comment = COMMENT_LINE_PATTERNS.get(name)
        if comment:
            gate = f"({gate}) AND NOT {matches('text', comment)}"
        return f"CASE WHEN {gate} THEN {_line_hits(rules, 'text' if comment else 'code')} END"

    # Every array is computed in a projection of its own before it is exploded: an
    # expression inside a generator is interpreted, and a sibling of one would be
    # evaluated again for each line it yields.
    staged = files.select(
        "repo_id", "path", F.coalesce("content", F.lit("")).alias("content"), detect_language(F.col("path")).alias("language")
    ).selectExpr(
        "*", *[f"{flag(r)} AS flag_{i}" for i, r in flagged]
    )
    calls = [(i, r) for i, r in numbered if r.scope == "call"]
    if calls:
        # Only texts that hold the name of such a call go to the workers' Python.
        allowed = [F.expr(all_of([_by_language(r.languages, lambda _: "true", "false"), _has_needle(r, "content"),
                                  *([f"flag_{i}"] if r.file_when else [])])) for i, r in calls]
        asked = F.when(F.array_contains(F.array(*allowed), True), F.col("content"))
        staged = staged.withColumn("call_hits", call_hits(calls, asked, allowed))
    staged = staged.selectExpr(
        "repo_id", "path", "language", "content", *flags,
        f"{_by_language(languages, whole_file, NO_HIT)} AS file_hits",
    ).select("repo_id", "path", "language", *flags, "file_hits", (
        split_lines(F.col("content")) if line_rules else F.array(F.lit(""))).alias("lines"))
    # The literals are looked for once, line by line: a line without any goes before an array is built for it. The first line also
    # carries the file's hits.
    reported = any_of(["pos = 0 AND file_hits IS NOT NULL", _by_language(languages, lambda n: line_gate(own(n, "line")), "false"),
                       line_gate(shared) or "false"])
    lines = staged.select(
        "repo_id", "path", "language", *flags, "file_hits", F.posexplode_outer("lines").alias("pos", "text")
    ).where(reported).withColumn("code", strip_comments(F.col("language"), F.col("text")))
    everywhere = NO_HIT
    if shared:
        gate = any_of([_has_needle(r, "text") for _, r in shared])
        comment = matches("text", COMMENT_LINE_PATTERNS["generic"])
        everywhere = f"CASE WHEN ({gate}) AND NOT {comment} THEN {_line_hits(shared, 'text')} END"
    hits = (f"flatten(array_compact(array({_by_language(languages, own_lines, NO_HIT)}, {everywhere}, "
            f"CASE WHEN pos = 0 THEN file_hits END)))")
    # The outer form: for the inner one the optimizer adds a size(hits) > 0 filter
    # below the explode, which would evaluate every regex twice.
    exploded = lines.selectExpr("repo_id", "path", f"{hits} AS hits").select(
        "repo_id", "path", F.explode_outer("hits").alias("hit")
    )
    return exploded.where(F.col("hit").isNotNull()).select("repo_id", "path", "hit.*")


def rule_table(spark, rulebook: Sequence[Rule] = RULEBOOK) -> DataFrame:
    """The rulebook as an inline table; its size is the number of rules, never the data."""
    rows = ", ".join(
        f"({i}, {', '.join(literal(v) for v in (r.rule, r.severity, r.title, r.category, r.fix, r.rule_type, r.scope))}, "
        f"CAST(array({', '.join(literal(u) for u in r.references)}) AS array<string>), {r.signal})"
        for i, r in enumerate(rulebook))
    return spark.sql(
        f"SELECT * FROM VALUES {rows} AS rules(ord, rule, severity, title, category, fix, rule_type, scope, references, signal)")


def rules_enrich(hits: DataFrame, rulebook: Sequence[Rule] = RULEBOOK) -> DataFrame:
    """Join rule metadata to hits; the rule side is broadcast, it holds one row per rule."""
    table = rule_table(hits.sparkSession, rulebook)
    joined = hits.join(F.broadcast(table), "ord")
    evidence = F.when(
        F.col("scope") == "file", F.concat_ws(" ", "path", "shown")
    ).otherwise(F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(" "), F.col("shown")))
    title = F.when(F.col("title").contains("%s"), F.replace(F.col("title"), F.lit("%s"), F.col("subject"))).otherwise(
        F.col("title")
    )
    return joined.select(
        "repo_id", "rule", "severity", title.alias("title"), "category", F.col("path").alias("file"), "line",
        evidence.alias("evidence"), "fix", "references", "rule_type", "signal", "ord",
    )


def scan_files(files: DataFrame, rulebook: Sequence[Rule] = RULEBOOK, strict_compat: bool = False) -> DataFrame:
    """All findings of a rulebook over a file table, before deduplication."""
    return assemble_findings(rules_enrich(scan_hits(files, rulebook), rulebook), strict_compat)


def unique_findings(findings: DataFrame, keys: Sequence[str] = ("repo_id", "id")) -> DataFrame:
    """First row per key in scan order.

    ``row_number() = 1`` is cut per input partition before the exchange, so a
    finding repeated across a third of the rows leaves one row per partition.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy("file", "ord", "line", "title", "severity")
    return findings.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
