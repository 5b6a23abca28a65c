"""Dependency inventory from manifests, and its join with cached advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.findings import assemble_findings
from lintlake.functions.text import split_lines, trimmed
from lintlake.functions.versions import clean_version, vuln_severity
from lintlake.operators.joins import join_lookup

# Manifest names per ecosystem.
ECOSYSTEMS = {
    "npm": ("package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml"),
    "PyPI": ("requirements.txt", "pipfile.lock", "poetry.lock"),
    "RubyGems": ("gemfile", "gemfile.lock"),
    "Go": ("go.mod", "go.sum"),
    "Packagist": ("composer.lock", "composer.json"),
    "Maven": ("pom.xml",),
}
NPM_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
# Limits of the hosted service, for callers that want its exact output.
SERVICE_LIMITS = {"per_manifest": 100, "per_package": 3, "links": 3, "summary_chars": 160}
LOCK_MAP = "map<string,struct<version:string>>"
ENTRIES = "array<struct<pos:long,name:string,version:string>>"


def base_name(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1))


def detect_ecosystem(path: Column) -> Column:
    name, out = base_name(path), None
    for ecosystem, names in ECOSYSTEMS.items():
        test = name.isin(*names)
        out = F.when(test, ecosystem) if out is None else out.when(test, ecosystem)
    return out


def _of_lines(lines: Column, pattern: str, offset: Column | None = None, trim_comment: bool = False) -> Column:
    """Entries of the lines that match; the first group of ``pattern`` is never empty in a match."""
    start = F.lit(0).cast("long") if offset is None else offset

    def entry(text: Column, at: Column) -> Column:
        value = trimmed(F.substring_index(text, "#", 1)) if trim_comment else text
        return F.struct((start + at + 1).alias("pos"), F.regexp_extract(value, pattern, 1).alias("name"),
                        F.regexp_extract(value, pattern, 2).alias("version"))

    return F.filter(F.transform(lines, entry), lambda e: e["name"] != "")


def _package_json(content: Column) -> Column:
    sections = [
        F.coalesce(
            F.map_entries(F.from_json(F.get_json_object(content, f"$.{s}"), "map<string,string>")),
            F.array().cast("array<struct<key:string,value:string>>"))
        for s in NPM_SECTIONS
    ]
    entries = F.transform(F.concat(*sections), lambda e, at: F.struct(
        at.cast("long").alias("pos"), e["key"].alias("name"), clean_version(e["value"]).alias("version")))
    return F.filter(entries, lambda e: e["version"].rlike(r"^\d"))


def _package_lock(content: Column) -> Column:
    packages = F.get_json_object(content, "$.packages")
    nested = packages.isNotNull()
    flat = F.from_json(F.get_json_object(content, "$.dependencies"), LOCK_MAP)
    listed = F.when(nested, F.map_entries(F.from_json(packages, LOCK_MAP))).otherwise(F.map_entries(flat))
    # The package is the part after the last node_modules/ of a nested path.
    last = r"(?s)^(?:.*/)?node_modules/(.+)\z"
    entries = F.transform(listed, lambda e, at: F.struct(
        at.cast("long").alias("pos"),
        F.when(nested, F.regexp_extract(e["key"], last, 1)).otherwise(e["key"]).alias("name"),
        e["value"]["version"].alias("version")))
    return F.filter(entries, lambda e: (e["name"] != "") & (e["version"] != ""))


def _requirements(content: Column) -> Column:
    return _of_lines(split_lines(content), r"^([A-Za-z0-9_.\-]+)\s*==\s*([A-Za-z0-9_.\-+]+)", trim_comment=True)


def _gemfile_lock(content: Column) -> Column:
    """Gems of the GEM sections: a section starts at an unindented capital.

    The text is cut into sections by one split; a gem whose own name starts with
    a capital is indented and so does not end its section.
    """
    sections = F.split(F.concat(F.lit("\n"), content), r"\n(?=[A-Z])", -1)
    pattern = r"^\s{4}([A-Za-z0-9_.\-]+)\s*\(([0-9][^)]*)\)"
    return F.flatten(F.transform(sections, lambda text, at: F.when(
        text.startswith("GEM"), _of_lines(split_lines(text), pattern, at.cast("long") * F.lit(1 << 32))
    ).otherwise(F.array().cast(ENTRIES))))


def _go_mod(content: Column) -> Column:
    block = r"require\s*\(([^)]*)\)"
    body = F.when(content.rlike(block), F.regexp_extract(content, block, 1)).otherwise(content)
    return _of_lines(split_lines(body), r"^\s*([A-Za-z0-9._/-]+)\s+v([0-9]\S*)")


PARSERS = {
    "package.json": _package_json,
    "package-lock.json": _package_lock,
    "requirements.txt": _requirements,
    "gemfile.lock": _gemfile_lock,
    "go.mod": _go_mod,
}


def dependency_inventory(files: DataFrame) -> DataFrame:
    """(repo_id, path, pos, ecosystem, name, version) of every manifest entry.

    One pass: the name of a file chooses its parser. Files without content have no entries.
    """
    name, entries = base_name(F.col("path")), F.lit(None).cast(ENTRIES)
    for manifest, parse in PARSERS.items():
        entries = F.when(name == manifest, parse(F.col("content"))).otherwise(entries)
    listed = files.where(name.isin(*PARSERS)).select("repo_id", "path", entries.alias("entries"))
    return listed.select("repo_id", "path", F.explode_outer("entries").alias("e")).where("e is not null").select(
        "repo_id", "path", "e.pos", detect_ecosystem(F.col("path")).alias("ecosystem"), "e.name", "e.version")


def distinct_dependencies(dependencies: DataFrame, per_manifest: int | None = None) -> DataFrame:
    """The first manifest per package of a repository; with ``per_manifest`` only a manifest's first entries count."""
    first = dependencies
    if per_manifest is not None:
        in_file = Window.partitionBy("repo_id", "path").orderBy("pos", "name", "version")
        first = dependencies.withColumn("_rank", F.row_number().over(in_file)).where(F.col("_rank") <= per_manifest)
    return first.groupBy("repo_id", "ecosystem", "name", "version").agg(F.min(F.struct("path", "pos")).alias("_first")).select(
        "repo_id", "_first.path", "_first.pos", "ecosystem", "name", "version")


def dependency_advisories(
    dependencies: DataFrame, advisories: DataFrame, now: Column, per_manifest: int | None = None,
    per_package: int | None = None, links: int | None = None, summary_chars: int | None = None,
) -> DataFrame:
    """Findings for dependencies with unexpired advisories, one per advisory.

    The four limits are off unless given; ``**SERVICE_LIMITS`` gives the hosted service's.

    ``advisories`` holds one row per (ecosystem, package_name, version), so the
    join cannot multiply rows; a package used everywhere is spread by salt.
    """
    live = advisories.where(F.col("expires_at") > now).select(
        "ecosystem", F.col("package_name").alias("name"), "version", (F.slice("vulns", 1, per_package) if per_package is not None else F.col("vulns")).alias("vulns")
    )
    joined = join_lookup(
        distinct_dependencies(dependencies, per_manifest), live, ["ecosystem", "name", "version"], ["repo_id", "path"], "inner"
    )
    rows = joined.select("repo_id", "path", "ecosystem", "name", "version", F.posexplode("vulns").alias("rank", "vuln"))
    vuln = F.col("vuln")
    label = F.concat_ws("@", "name", "version")
    severity = vuln_severity(vuln["severity"], vuln["db_severity"])
    given = F.coalesce(vuln["references"], F.array().cast("array<string>"))
    shown = F.filter(F.slice(given, 1, links) if links is not None else given, lambda u: u != "")
    told = F.coalesce(F.nullif(vuln["summary"], F.lit("")), F.nullif(F.coalesce(vuln["id"], F.lit("")), F.lit("")), F.lit("Vulnerable dependency"))
    vid = F.coalesce(vuln["id"], F.lit(""))
    hits = rows.select(
        "repo_id",
        F.concat(F.lit("deps.cve."), F.coalesce(F.nullif(vid, F.lit("")), F.lit("unknown"))).alias("rule"),
        severity.alias("severity"),
        F.concat(label, F.lit(": "), F.left(told, F.lit(summary_chars)) if summary_chars is not None else told).alias("title"),
        F.lit("Supply Chain").alias("category"), F.col("path").alias("file"), F.lit(None).cast("int").alias("line"),
        F.concat(label, F.lit(" ("), F.col("ecosystem"), F.lit(") — "),
                 F.coalesce(F.nullif(vid, F.lit("")), F.lit("advisory"))).alias("evidence"),
        F.when(F.coalesce(vuln["has_ranges"], F.lit(False)),
               F.concat(F.lit("Upgrade "), F.col("name"), F.lit(" past the affected range. See "),
                        F.coalesce(F.try_element_at(shown, F.lit(1)), F.lit("OSV.dev")), F.lit(".")))
        .otherwise(F.concat(F.lit("Review and upgrade "), F.col("name"), F.lit(" to a non-affected version."))).alias("fix"),
        F.when(F.size(shown) > 0, shown).otherwise(F.array(F.concat(F.lit("https://osv.dev/"), vid))).alias("references"),
        F.lit("dependency_cve").alias("rule_type"),
        F.when(severity == "critical", 6).when(severity == "high", 3).otherwise(0).alias("signal"),
        # After every code rule in scan order.
        (F.lit(1000) + F.col("rank")).alias("ord"),
    )
    return assemble_findings(hits)
