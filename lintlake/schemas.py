"""Explicit schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("size", T.LongType()),
])

FINDINGS = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("fix", T.StringType()),
    T.StructField("references", T.ArrayType(T.StringType())),
    T.StructField("confidence", T.StringType()),
    T.StructField("confidence_score", T.IntegerType()),
    T.StructField("confidence_source", T.StringType()),
    T.StructField("rule_type", T.StringType()),
    T.StructField("suppressed", T.BooleanType()),
    T.StructField("ord", T.IntegerType()),
])

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

ASSETS = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("body", T.StringType()),
])

VULN = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("severity", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("score", T.StringType()),
    ]))),
    T.StructField("db_severity", T.ArrayType(T.StringType())),
    T.StructField("references", T.ArrayType(T.StringType())),
    T.StructField("has_ranges", T.BooleanType()),
])

ADVISORIES = T.StructType([
    T.StructField("ecosystem", T.StringType()),
    T.StructField("package_name", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("vulns", T.ArrayType(VULN)),
    T.StructField("expires_at", T.TimestampType()),
])

SUPPRESSIONS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("org_id", T.StringType()),
    T.StructField("finding_id", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("created_by", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

REPOSITORIES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("org_id", T.StringType()),
    T.StructField("full_name", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

PUSH_EVENTS = T.StructType([
    T.StructField("event", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("ref", T.StringType()),
    T.StructField("repository", T.StructType([T.StructField("full_name", T.StringType())])),
    T.StructField("installation", T.StructType([T.StructField("id", T.LongType())])),
    T.StructField("pull_request", T.StructType([
        T.StructField("head", T.StructType([T.StructField("ref", T.StringType())])),
    ])),
])
