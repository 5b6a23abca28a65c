"""Workspace scoping, sessions, retention and erasure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUDIT_RETENTION_DAYS = 90
SESSION_DAYS = 14

# Rows each table loses, as SQL over its columns and a fixed now.
RETENTION = {
    "audit": "created_at < {now} - INTERVAL {audit_days} DAYS",
    "sessions": "expires_at < {now} - INTERVAL 1 DAY",
    "rate_limits": "reset_at < {now} - INTERVAL 1 HOUR",
    "osv_cache": "expires_at < {now}",
}
# Our option, off by default: scans have no retention window of their own.
SCAN_RETENTION = {"scans": "created_at < {now} - INTERVAL {scan_days} DAYS"}
ORG_TABLES = ("scans", "api_keys", "repositories", "suppressions", "memberships", "sessions")
USER_TABLES = ("sessions", "memberships", "api_keys", "audit")


def tenant_scope(df: DataFrame, org_id) -> DataFrame:
    """Rows of one workspace. Tables partitioned by org_id read only its folders."""
    return df.where(F.col("org_id") == org_id)


def user_org_summary(users: DataFrame, memberships: DataFrame, orgs: DataFrame) -> DataFrame:
    """(id, email, name, orgs): each user with the workspaces they belong to."""
    named = memberships.join(
        orgs.select(F.col("id").alias("org_id"), F.col("name").alias("org_name"), "plan"), "org_id"
    ).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("org_id").alias("id"), F.col("org_name").alias("name"), "plan", "role"))).alias("orgs"))
    joined = users.join(named.withColumnRenamed("user_id", "id"), "id", "left")
    empty = F.array().cast(named.schema["orgs"].dataType)
    return joined.select("id", "email", "name", F.coalesce("orgs", empty).alias("orgs"))


def valid_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") > now)


def expired(table: str, now: str, audit_days: int = AUDIT_RETENTION_DAYS, scan_days: int | None = None) -> Column:
    """Predicate of the rows ``retention_purge`` removes; ``now`` is a SQL timestamp."""
    rules = RETENTION if scan_days is None else {**RETENTION, **SCAN_RETENTION}
    text = rules[table].format(now=f"TIMESTAMP '{now}'", audit_days=audit_days, scan_days=scan_days)
    return F.coalesce(F.expr(text), F.lit(False))


def retention_purge(
    tables: dict[str, DataFrame], now: str, audit_days: int = AUDIT_RETENTION_DAYS, scan_days: int | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(rows to keep per table, one row of deleted counts per table)."""
    kept, counts = {}, None
    for name, df in tables.items():
        gone = expired(name, now, audit_days, scan_days)
        kept[name] = df.where(~gone)
        row = df.agg(F.count_if(gone).alias("deleted"), F.count("*").alias("total")).select(
            F.lit(name).alias("table_name"), "deleted", (F.col("total") - F.col("deleted")).alias("kept")
        )
        counts = row if counts is None else counts.unionByName(row)
    return kept, counts


def erase_tenant(tables: dict[str, DataFrame], user_ids: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of closed accounts and of the workspaces those belong to.

    ``user_ids`` has one column, user_id. Write the results to a new path.
    """
    users = user_ids.select("user_id").distinct()
    orgs = tables["memberships"].join(users, "user_id", "left_semi").select("org_id").distinct()
    out = dict(tables)
    for name in ORG_TABLES:
        if name in out:
            out[name] = out[name].join(orgs, "org_id", "left_anti")
    if "orgs" in out:
        out["orgs"] = out["orgs"].join(orgs.withColumnRenamed("org_id", "id"), "id", "left_anti")
    for name in USER_TABLES:
        if name in out:
            out[name] = out[name].join(users, "user_id", "left_anti")
    if "users" in out:
        out["users"] = out["users"].join(users.withColumnRenamed("user_id", "id"), "id", "left_anti")
    return out
