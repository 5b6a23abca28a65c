"""Whole scans, composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.findings import assemble_findings
from lintlake.operators.analytics import scan_summary
from lintlake.operators.dependencies import PARSERS, base_name, dependency_advisories, dependency_inventory
from lintlake.operators.joins import join_lookup
from lintlake.operators.migrations import lint_migrations
from lintlake.operators.rules import RULEBOOK, Rule
from lintlake.operators.scan import rules_enrich, scan_hits, unique_findings
from lintlake.operators.suppress import (
    IGNORE_FILE,
    apply_suppressions,
    drop_ignored_files,
    ignore_files,
    ignore_rules,
)
from lintlake.session import settle


def project_files(files: DataFrame) -> DataFrame:
    """Files with a meaning beyond their own text: migrations, manifests, ignore files."""
    name = base_name(F.col("path"))
    return files.where(name.isin(*PARSERS, IGNORE_FILE) | name.endswith(".sql"))


def union_findings(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scan_repositories(
    files: DataFrame,
    repositories: DataFrame,
    suppressions: DataFrame,
    advisories: DataFrame | None = None,
    now: Column | None = None,
    rulebook: Sequence[Rule] = RULEBOOK,
    lint: bool = True,
    candidates: DataFrame | None = None,
    suppression_limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(findings, summary) of every repository in a file table.

    ``repositories`` is (repo_id, org_id, target), ``candidates`` the (repo_id, path) rows that ``files`` was chosen from;
    where files were left out by a budget the summary says truncated. Code findings are
    deduplicated, dependency findings are appended after, then both meet the
    ignore file and the workspace suppressions. The result is checkpointed: it is
    small next to the corpus, and callers read it more than once.

    Text is read twice and never shuffled: once by the rule scan, once to pick
    the migrations, manifests and ignore files, which are settled. Files that an
    ignore file drops are taken out of the hits and of the (repo_id, path, size)
    rows, so their rows leave the scan without their text meeting a join.
    """
    special = settle(project_files(files.select("repo_id", "path", "content")))
    rules = settle(ignore_rules(ignore_files(special)))
    kept = drop_ignored_files(special, rules)
    code = assemble_findings(rules_enrich(drop_ignored_files(scan_hits(files, rulebook), rules), rulebook))
    if lint:
        code = union_findings(code, lint_migrations(kept))
    findings = unique_findings(code)
    if advisories is not None:
        found = dependency_advisories(dependency_inventory(kept), advisories, F.current_timestamp() if now is None else now)
        findings = union_findings(findings, found)
    owned = join_lookup(findings, repositories.select("repo_id", "org_id", "target"), ["repo_id"], ["id"])
    final = settle(apply_suppressions(owned, rules, suppressions, limit=suppression_limit))
    sizes = files.select("repo_id", "path", "size")
    return final, scan_summary(drop_ignored_files(sizes, rules), final, rules, candidates, sizes)
