"""The finding row: confidence, fingerprint, assembly, severity scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.masking import mask_secrets

# Fixed values.
SEVERITIES = ("critical", "high", "medium", "low")
SEVERITY_WEIGHTS = {"critical": 18, "high": 10, "medium": 5, "low": 2}
SEVERITY_RANKS = {"critical": 4, "high": 3, "medium": 2, "low": 1}
RULE_CONFIDENCE = {
    "literal_credential": (96, "literal pattern"),
    "ast_match": (88, "AST analysis"),
    "semantic_match": (82, "semantic heuristic"),
    "regex_match": (70, "regex heuristic"),
    "dependency_cve": (94, "OSV advisory"),
    "inference": (60, "inferred from context"),
}
DEFAULT_RULE_TYPE = "regex_match"

FINDING_COLUMNS = [
    "repo_id", "id", "rule", "severity", "title", "category", "file", "line", "evidence", "fix",
    "references", "confidence", "confidence_score", "confidence_source", "rule_type", "suppressed", "ord",
]


def _lookup(col: Column, table: dict, default) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    return out.otherwise(F.lit(default))


def severity_weight(severity: Column) -> Column:
    return _lookup(severity, SEVERITY_WEIGHTS, 0)


def severity_rank(severity: Column) -> Column:
    return _lookup(severity, SEVERITY_RANKS, None)


def severity_at_least(severity: Column, threshold: str) -> Column:
    return F.coalesce(severity_rank(severity) >= SEVERITY_RANKS[threshold], F.lit(False))


def confidence_score(rule_type: Column, signal: Column, adjustment: Column | None = None) -> Column:
    base = _lookup(rule_type, {k: v[0] for k, v in RULE_CONFIDENCE.items()}, RULE_CONFIDENCE[DEFAULT_RULE_TYPE][0])
    bounded = F.least(F.lit(8), F.greatest(F.lit(-10), F.coalesce(signal, F.lit(0))))
    total = base + bounded + (F.lit(0) if adjustment is None else adjustment)
    return F.greatest(F.lit(40), F.least(F.lit(99), F.round(total))).cast("int")


def confidence_source(rule_type: Column) -> Column:
    return _lookup(rule_type, {k: v[1] for k, v in RULE_CONFIDENCE.items()}, RULE_CONFIDENCE[DEFAULT_RULE_TYPE][1])


def fingerprint(rule: Column, file: Column, line: Column, evidence: Column) -> Column:
    return F.left(
        F.sha2(F.concat_ws("|", rule, F.coalesce(file, F.lit("null")),
                           F.coalesce(line, F.lit(0)).cast("string"), evidence), 256),
        F.lit(16),
    )


def assemble_findings(hits: DataFrame, strict_compat: bool = False) -> DataFrame:
    """Turn raw hits into finding rows.

    ``hits`` carries repo_id, rule, severity, title, category, file, line,
    evidence (unmasked), fix, references, rule_type, signal and ord.
    """
    score = confidence_score(F.col("rule_type"), F.col("signal"))
    scored = hits.select(
        "*", mask_secrets(F.col("evidence"), strict_compat).alias("_masked"), score.alias("confidence_score"),
        confidence_source(F.col("rule_type")).alias("confidence_source"),
    )
    return scored.selectExpr(
        "repo_id",
        "left(sha2(concat_ws('|', rule, coalesce(file, 'null'), CAST(coalesce(line, 0) AS STRING), _masked), 256), 16) AS id",
        "rule", "severity", "title", "category", "file", "CAST(line AS INT) AS line", "_masked AS evidence", "fix",
        "references", "concat(CAST(confidence_score AS STRING), '%') AS confidence", "confidence_score",
        "confidence_source", "rule_type", "false AS suppressed", "CAST(ord AS INT) AS ord",
    )
