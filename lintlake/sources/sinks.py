"""Where findings go: a partitioned lake table, JSON reports, SARIF documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.prompts import TOOL
from lintlake.operators.analytics import SCAN_ORDER, rule_catalogue
from lintlake.operators.ordered import running_totals

SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
REPORT_COLUMNS = (
    "id", "rule", "severity", "title", "category", "file", "line", "evidence", "fix", "references", "confidence",
    "confidence_score", "confidence_source", "rule_type", "suppressed",
)


def _write_batch(rows: DataFrame, path: str, day: str, batch_id: str, order: Sequence[str] = ()) -> None:
    """Rows below path/<day>/batch_id; a batch written again takes the place of its earlier rows.

    Spark stages the files and moves them when the job commits; only the folders of this batch are replaced.
    A batch that is run again must hold the days it held before: days that it has no more are kept.
    """
    rows.withColumn("batch_id", F.lit(batch_id)).sortWithinPartitions(day, *order).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(day, "batch_id").parquet(path)


def write_findings(
    scans: DataFrame, findings: DataFrame, path: str, mode: str = "append", batch_id: str | None = None
) -> None:
    """Header rows and finding rows as two tables, partitioned by day.

    Rows of one day are sorted by repository inside each file, so readers prune
    by day and skip row groups by repository. With a ``batch_id`` the write is
    idempotent: the same batch twice leaves one copy, whatever else was written
    between. Without one, ``mode`` decides. Keep to one way per table.
    """
    if batch_id is not None:
        # Headers last: a scan that has one has all its findings.
        _write_batch(findings, f"{path}/findings", "scan_date", batch_id, ("repo_id", "rule"))
        _write_batch(scans, f"{path}/scans", "scan_date", batch_id)
        return
    scans.write.mode(mode).partitionBy("scan_date").parquet(f"{path}/scans")
    findings.sortWithinPartitions("scan_date", "repo_id", "rule").write.mode(mode).partitionBy("scan_date").parquet(
        f"{path}/findings"
    )


def audit_append(rows: DataFrame, path: str, batch_id: str | None = None) -> None:
    """Append (org_id, user_id, action, detail, created_at) rows.

    With a ``batch_id`` they go below their day (``created_on``, null for rows
    without a time), and the same batch twice leaves one copy.
    """
    rows = rows.select("org_id", "user_id", "action", "detail", "created_at")
    if batch_id is None:
        rows.write.mode("append").parquet(path)
    else:
        _write_batch(rows.withColumn("created_on", F.to_date("created_at")), path, "created_on", batch_id, ("org_id", "created_at"))


def severity_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def _in_order(value: Column) -> Column:
    """Rows of one document in scan order; ``_part`` keeps a document's size bounded."""
    return F.transform(
        F.array_sort(F.collect_list(F.struct(*SCAN_ORDER, value.alias("value")))), lambda s: s["value"]
    )


def _with_parts(findings: DataFrame, keys: Sequence[str], rows_per_document: int) -> DataFrame:
    """Adds ``_part``: documents of ``rows_per_document`` rows each, in scan order from one to the next."""
    numbered = running_totals(findings, keys, SCAN_ORDER, {"_number": F.lit(1)})
    return numbered.withColumn("_part", F.floor((F.col("_number") - 1) / rows_per_document).cast("int")).drop("_number")


def json_reports(
    headers: DataFrame, findings: DataFrame, keys: Sequence[str] = ("repo_id",), rows_per_document: int = 10_000
) -> DataFrame:
    """(keys, part, json): header fields and the findings array of each scan.

    A scan with more findings than one document takes is written as several
    documents with the same header; together they hold every finding.
    """
    keys = list(keys)
    columns = [c for c in (*REPORT_COLUMNS, "suppression_reason", "fix_prompt") if c in findings.columns]
    listed = _with_parts(findings, keys, rows_per_document).groupBy(*keys, "_part").agg(
        _in_order(F.struct(*columns)).alias("findings"))
    joined = headers.join(listed, keys, "left")
    empty = F.array().cast(listed.schema["findings"].dataType)
    return joined.select(
        *keys, F.coalesce("_part", F.lit(0)).alias("part"),
        F.to_json(F.struct(*headers.columns, F.coalesce("findings", empty).alias("findings"))).alias("json"),
    )


def write_json_report(headers: DataFrame, findings: DataFrame, path: str, keys: Sequence[str] = ("repo_id",)) -> None:
    json_reports(headers, findings, keys).select("json").write.mode("overwrite").text(path)


def sarif_results(findings: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """One row per active finding as a SARIF result."""
    region = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine")))
    place = F.struct(F.struct(
        F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")
    ).alias("physicalLocation"))
    prompt = (
        F.when(F.col("fix_prompt").isNotNull(), F.struct(F.col("fix_prompt").alias("fixPrompt")))
        if "fix_prompt" in findings.columns else F.lit(None).cast("struct<fixPrompt:string>")
    )
    result = F.struct(
        F.col("rule").alias("ruleId"), severity_level(F.col("severity")).alias("level"),
        F.struct(F.concat_ws(" — ", "title", "fix").alias("text")).alias("message"),
        prompt.alias("properties"),
        F.filter(F.array(F.when(F.col("file").isNotNull(), place)), lambda p: p.isNotNull()).alias("locations"),
    )
    return findings.where(~F.col("suppressed")).select(*keys, *[c for c in SCAN_ORDER], result.alias("result"))


def sarif_documents(
    scans: DataFrame, findings: DataFrame, keys: Sequence[str] = ("repo_id",), tool: str = TOOL, version: str = "0.1.0",
    rows_per_document: int = 10_000,
) -> DataFrame:
    """(keys, part, sarif): SARIF 2.1.0 documents; suppressed findings are left out.

    Every document of a scan carries the scan's whole rule list; results beyond
    ``rows_per_document`` go to further documents.
    """
    keys = list(keys)
    results = _with_parts(sarif_results(findings, keys), keys, rows_per_document).groupBy(*keys, "_part").agg(
        _in_order(F.col("result")).alias("results"))
    entry = F.struct(
        F.col("rule").alias("id"), F.col("name"), F.struct(F.col("title").alias("text")).alias("shortDescription"),
        F.struct(F.col("fix").alias("text")).alias("fullDescription"), F.col("help_uri").alias("helpUri"),
        F.struct("category", "confidence", "rule_type").alias("properties"),
    )
    # One entry per rule, so the rulebook and the advisories bound this list.
    rules = rule_catalogue(findings, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("rules"))
    joined = scans.select(*keys).distinct().join(results, keys, "left").join(rules, keys, "left")
    run = F.struct(
        F.struct(F.struct(
            F.lit(tool).alias("name"), F.lit(version).alias("version"),
            F.coalesce("rules", F.array().cast(rules.schema["rules"].dataType)).alias("rules"),
        ).alias("driver")).alias("tool"),
        F.coalesce("results", F.array().cast(results.schema["results"].dataType)).alias("results"),
    )
    document = F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return joined.select(*keys, F.coalesce("_part", F.lit(0)).alias("part"), F.to_json(document).alias("sarif"))


def write_sarif(scans: DataFrame, findings: DataFrame, path: str, keys: Sequence[str] = ("repo_id",)) -> None:
    sarif_documents(scans, findings, keys).select("sarif").write.mode("overwrite").text(path)
