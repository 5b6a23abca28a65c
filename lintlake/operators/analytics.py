"""Scores, counts, rankings, diffs and histories over findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.findings import SEVERITIES, severity_at_least, severity_rank, severity_weight
from lintlake.operators.joins import join_lookup
from lintlake.operators.ordered import previous_value, running_totals

SCAN_ORDER = ("file", "ord", "line", "id")


def _active() -> Column:
    return ~F.coalesce(F.col("suppressed"), F.lit(False))


def _score(penalty: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - F.coalesce(penalty, F.lit(0)))).cast("int")


def scan_score(scans: DataFrame, findings: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """0..100 per scan; a scan without findings scores 100."""
    penalty = findings.where(_active()).groupBy(*keys).agg(F.sum(severity_weight(F.col("severity"))).alias("penalty"))
    return scans.select(*keys).distinct().join(penalty, list(keys), "left").select(
        *keys, _score(F.col("penalty")).alias("score")
    )


def severity_counts(findings: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Active findings per severity, zero-filled, one column per severity."""
    return findings.where(_active()).groupBy(*keys).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    )


def scan_summary(
    files: DataFrame, findings: DataFrame, rules: DataFrame | None = None, candidates: DataFrame | None = None,
    loaded: DataFrame | None = None,
) -> DataFrame:
    """One header row per repository.

    ``files`` are those scanned, ``loaded`` those read before ignore files took some away (default: ``files``), and
    ``candidates`` those that could have been read. A scan is truncated if a limit kept it from reading all candidates.
    """
    scanned = files.groupBy("repo_id").agg(
        F.count("*").alias("files_scanned"), F.sum("size").alias("bytes_scanned")
    )
    counted = findings.groupBy("repo_id").agg(
        F.count_if(_active()).alias("active_findings"),
        F.count_if(~_active()).alias("suppressed_findings"),
        F.sum(F.when(_active(), severity_weight(F.col("severity")))).alias("penalty"),
    )
    out = scanned.join(counted, "repo_id", "left")
    zero = F.lit(0).cast("long")
    if rules is not None:
        applied = rules.groupBy("repo_id").agg(F.count("*").alias("ignore_rules_applied"))
        out = out.join(applied, "repo_id", "left")
    else:
        out = out.withColumn("ignore_rules_applied", zero)
    if candidates is not None:
        total = candidates.groupBy("repo_id").agg(F.count("*").alias("total_candidate_files"))
        out = out.join(total, "repo_id", "left")
    else:
        out = out.withColumn("total_candidate_files", F.lit(None).cast("long"))
    if loaded is not None:
        out = out.join(loaded.groupBy("repo_id").agg(F.count("*").alias("files_loaded")), "repo_id", "left")
    else:
        out = out.withColumn("files_loaded", F.col("files_scanned"))
    return out.select(
        "repo_id", "files_scanned", "bytes_scanned",
        F.coalesce("active_findings", zero).alias("active_findings"),
        F.coalesce("suppressed_findings", zero).alias("suppressed_findings"),
        F.coalesce("ignore_rules_applied", zero).alias("ignore_rules_applied"),
        F.coalesce(F.col("total_candidate_files") > F.col("files_loaded"), F.lit(False)).alias("truncated"),
        _score(F.col("penalty")).alias("score"),
    )


HISTORY_ROWS = 50  # fixed value: rows on a history page of the hosted service


def scan_history(
    scans: DataFrame, findings: DataFrame, org_id, target: str | None = None, limit: int | None = None
) -> DataFrame:
    """Newest scans of one workspace with their finding counts; all of them without a limit.

    ``*_total`` counts include suppressed findings, ``*_active`` do not.
    """
    wanted = scans.where(F.col("org_id") == org_id)
    if target is not None:
        wanted = wanted.where(F.col("target") == target)
    newest = wanted.orderBy(F.col("created_at").desc(), F.col("scan_id").desc())
    if limit is not None:
        newest = newest.limit(limit)
    counted = findings.join(newest.select("scan_id"), "scan_id", "left_semi").groupBy("scan_id").agg(
        F.count("*").alias("findings_total"),
        F.count_if(F.col("severity") == "critical").alias("critical_total"),
        F.count_if(~_active()).alias("suppressed_total"),
        F.count_if(_active()).alias("findings_active"),
        F.count_if(_active() & (F.col("severity") == "critical")).alias("critical_active"),
    )
    zero = F.lit(0).cast("long")
    return newest.join(counted, "scan_id", "left").select(
        *newest.columns,
        *[F.coalesce(c, zero).alias(c) for c in
          ("findings_total", "critical_total", "suppressed_total", "findings_active", "critical_active")],
    ).orderBy(F.col("created_at").desc(), F.col("scan_id").desc())


def merge_results(results: DataFrame, findings: DataFrame, group: str = "group_id") -> DataFrame:
    """Several results of one group as one: targets joined, sums, score recomputed.

    ``results`` carries group, position, target, files_scanned, bytes_scanned;
    ``findings`` carries the group.
    """
    merged = results.groupBy(group).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "target"))), lambda s: s["target"]), " + "
        ).alias("target"),
        F.sum("files_scanned").alias("files_scanned"),
        F.sum("bytes_scanned").alias("bytes_scanned"),
    )
    counted = findings.groupBy(group).agg(
        F.count_if(_active()).alias("active_findings"),
        F.count_if(~_active()).alias("suppressed_findings"),
        F.sum(F.when(_active(), severity_weight(F.col("severity")))).alias("penalty"),
    )
    zero = F.lit(0).cast("long")
    return merged.join(counted, group, "left").select(
        group, "target", "files_scanned", "bytes_scanned",
        F.coalesce("active_findings", zero).alias("active_findings"),
        F.coalesce("suppressed_findings", zero).alias("suppressed_findings"),
        _score(F.col("penalty")).alias("score"),
    )


def rule_catalogue(findings: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Per scan and rule the first active finding's text: the rule list of a report."""
    first = F.min_by(
        F.struct("title", "fix", "category", "confidence", "rule_type",
                 F.try_element_at("references", F.lit(1)).alias("help_uri")),
        F.struct(*SCAN_ORDER),
    )
    return findings.where(_active()).groupBy(*keys, "rule").agg(first.alias("first")).select(
        *keys, "rule", F.regexp_replace("rule", r"\W+", "_").alias("name"), "first.*"
    )


def fail_gate(scans: DataFrame, findings: DataFrame, threshold: str, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Whether any active finding of a scan reaches the threshold; ``none`` never fails."""
    ids = scans.select(*keys).distinct()
    if threshold == "none":
        return ids.withColumn("failed", F.lit(False))
    failing = findings.where(_active() & severity_at_least(F.col("severity"), threshold)).groupBy(*keys).agg(
        F.lit(True).alias("failed")
    )
    return ids.join(failing, list(keys), "left").select(*keys, F.coalesce("failed", F.lit(False)).alias("failed"))


def severity_filter(findings: DataFrame, threshold: str) -> DataFrame:
    return findings.where(severity_at_least(F.col("severity"), threshold))


def confidence_filter(findings: DataFrame, threshold: int) -> DataFrame:
    return findings.where(F.col("confidence_score") >= threshold)


def confidence_report(findings: DataFrame, threshold: int, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """How many findings a confidence threshold shows and hides."""
    return findings.groupBy(*keys).agg(
        F.count_if(F.col("confidence_score") >= threshold).alias("shown"),
        F.count_if(F.col("confidence_score") < threshold).alias("hidden"),
    )


def search_findings(findings: DataFrame, query: str = "", severity: str = "all") -> DataFrame:
    """Case-insensitive substring over title, category, evidence and fix."""
    haystack = F.lower(F.concat_ws(" ", "title", "category", "evidence", "fix"))
    found = findings.where(haystack.contains(query.strip().lower()))
    return found if severity == "all" else found.where(F.col("severity") == severity)


def top_findings(
    findings: DataFrame, n: int, keys: Sequence[str] = ("repo_id",), by_severity: bool = False
) -> DataFrame:
    """First ``n`` active findings per scan, in scan order or most severe first."""
    order = [severity_rank(F.col("severity")).desc()] if by_severity else []
    window = Window.partitionBy(*keys).orderBy(*order, *SCAN_ORDER)
    return findings.where(_active()).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def severity_sort(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")).desc(), *SCAN_ORDER)


def severity_places(findings: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Every finding with its place in its scan, most severe first and then in scan order; a hot scan is cut into ranges."""
    ranked = findings.withColumn("_order", -severity_rank(F.col("severity")))
    return running_totals(ranked, keys, ["_order", *SCAN_ORDER], {"place": F.lit(1)}).drop("_order")


def group_by_severity(findings: DataFrame, threshold: str = "low", keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Visible findings with their severity group's rank and size, for a grouped listing.

    Rows stay rows: sizes come from a partial aggregate joined back, so a large
    group is never held in one place.
    """
    visible = severity_filter(findings.where(_active()), threshold)
    sizes = visible.groupBy(*keys, "severity").agg(F.count("*").alias("group_size"))
    return join_lookup(visible, sizes, [*keys, "severity"], ["id", "file", "line"], "inner").withColumn(
        "group_rank", F.lit(5) - severity_rank(F.col("severity"))
    )


def find_many(
    df: DataFrame, filters: dict, order_by: str = "created_at", direction: str = "desc", limit: int | None = None,
    tiebreak: Sequence[str] = ("id",),
) -> DataFrame:
    """Equality filters, one sort column, the first ``limit`` rows or all."""
    out = df
    for column, value in filters.items():
        out = out.where(F.col(column).isin(*value) if isinstance(value, (list, tuple)) else F.col(column) == value)
    order = F.col(order_by).asc() if direction == "asc" else F.col(order_by).desc()
    ordered = out.orderBy(order, *tiebreak)
    return ordered if limit is None else ordered.limit(limit)


def latest_scan_per_target(scans: DataFrame) -> DataFrame:
    window = Window.partitionBy("org_id", "target").orderBy(F.col("created_at").desc(), F.col("scan_id").desc())
    return scans.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def score_trend(scans: DataFrame) -> DataFrame:
    """Each scan's score beside the previous scan of the same target."""
    paired = previous_value(scans, ["org_id", "target"], ["created_at", "scan_id"], "score", "previous_score")
    return paired.withColumn("score_delta", F.col("score") - F.col("previous_score"))


def scan_diff(current: DataFrame, previous: DataFrame, keys: Sequence[str] = ("repo_id", "id")) -> DataFrame:
    """Findings added, removed or persisted between two scans, with ``change``.

    Suppressed rows take part; payloads come from the scan that holds the row.
    Both sides are read more than once: pass stored or settled findings.
    """
    keys = list(keys)
    side = lambda df, n: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(n))
    both = side(current, "_now").join(side(previous, "_before"), keys, "full")
    change = F.when(F.col("_before").isNull(), "added").when(F.col("_now").isNull(), "removed").otherwise("persisted")
    row = F.coalesce("_now", "_before")
    return both.select(*keys, row.alias("_row"), change.alias("change")).select(
        *[F.col(c) if c in keys else F.col(f"_row.`{c}`") for c in current.columns], "change")


def scan_diff_summary(
    current: DataFrame, previous: DataFrame, keys: Sequence[str] = ("repo_id", "id"), by: str = "repo_id"
) -> DataFrame:
    """Counts per change and the score delta, in one shuffle instead of three joins."""
    keys = list(keys)
    penalty = F.when(_active(), severity_weight(F.col("severity"))).otherwise(0)

    def side(df: DataFrame, name: str) -> DataFrame:
        mine, other = ("now", "before") if name == "now" else ("before", "now")
        return df.select(*keys, F.lit(1).alias(f"n_{mine}"), F.lit(0).alias(f"n_{other}"),
                         penalty.alias(f"w_{mine}"), F.lit(0).alias(f"w_{other}"))

    per_id = side(current, "now").unionByName(side(previous, "before")).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n_now", "n_before", "w_now", "w_before")]
    )
    return per_id.groupBy(by).agg(
        F.sum(F.when(F.col("n_before") == 0, F.col("n_now")).otherwise(0)).alias("added"),
        F.sum(F.when(F.col("n_now") == 0, F.col("n_before")).otherwise(0)).alias("removed"),
        F.sum(F.when(F.col("n_before") > 0, F.col("n_now")).otherwise(0)).alias("persisted"),
        (_score(F.sum("w_now")) - _score(F.sum("w_before"))).alias("score_delta"),
    )


def restrict_to_paths(findings: DataFrame, paths: DataFrame) -> DataFrame:
    """Keep findings of the given (repo_id, path) rows only."""
    return findings.join(paths.select("repo_id", F.col("path").alias("file")), ["repo_id", "file"], "left_semi")


def detection_quality(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matched, missed and unexpected keys, with recall and precision."""
    keys = list(keys)
    a = actual.select(*keys).distinct().withColumn("found", F.lit(1))
    e = expected.select(*keys).distinct().withColumn("wanted", F.lit(1))
    both = a.join(e, keys, "full")
    matched = F.count_if(F.col("found").isNotNull() & F.col("wanted").isNotNull())
    return both.agg(
        matched.alias("matched"),
        F.count_if(F.col("found").isNull()).alias("missed"),
        F.count_if(F.col("wanted").isNull()).alias("unexpected"),
        F.round(F.try_divide(matched, F.count("wanted")), 6).alias("recall"),
        F.round(F.try_divide(matched, F.count("found")), 6).alias("precision"),
    )


def expected_in_range(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Expected findings whose line does not exist in their file."""
    from lintlake.functions.text import split_lines

    sizes = files.select("repo_id", F.col("path").alias("file"), F.size(split_lines(F.col("content"))).alias("n_lines"))
    joined = expected.join(sizes, ["repo_id", "file"], "left")
    return joined.where(F.col("n_lines").isNull() | (F.col("line") < 1) | (F.col("line") > F.col("n_lines")))


def last_used(uses: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    return uses.groupBy(key).agg(F.max(ts).alias("last_used_at"))
