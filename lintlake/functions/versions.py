"""Versions and advisory severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_version(version: Column) -> Column:
    """Range operators and anything after the first blank removed; null if nothing is left."""
    cut = F.regexp_replace(F.regexp_replace(version, r"^[\^~>=<\s*]+", ""), r"\s[\s\S]*\z", "")
    return F.nullif(cut, F.lit(""))


def vuln_severity(severity: Column, db_severity: Column) -> Column:
    """Severity of an advisory from its first numeric CVSS v3 score, else its own label."""
    scores = F.transform(
        F.filter(F.coalesce(severity, F.array()), lambda s: (s["type"] == "CVSS_V3") & (s["score"] != "")),
        lambda s: F.regexp_extract(F.regexp_replace(s["score"], r".*/", ""), r"^\s*([+-]?\d+(?:\.\d*)?)", 1)
        .try_cast("double"),
    )
    first = F.try_element_at(F.array_compact(scores), F.lit(1))
    label = F.lower(F.try_element_at(db_severity, F.lit(1)))
    return (
        F.when(first >= 9, "critical").when(first >= 7, "high").when(first >= 4, "medium")
        .when(first.isNotNull(), "low").otherwise(F.coalesce(label, F.lit("medium")))
    )
