"""File tables: from a directory tree, or from any (id, text) table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators.suppress import IGNORE_FILE

# What a scan reads and what it passes over.
SERVICE_TEXT = (
    r"(?i)\.(js|jsx|ts|tsx|mjs|cjs|py|rb|php|go|java|cs|rs|sql|prisma|json|env|yml|yaml|toml|html|vue|svelte|"
    r"gemfile|gemfile\.lock|lock|mod|sum)$"
)
LOCAL_TEXT = (
    r"(?i)\.(js|jsx|ts|tsx|mjs|cjs|py|rb|php|go|java|cs|rs|sql|prisma|json|env|yml|yaml|toml|html|vue|svelte)$"
)
ALWAYS_INCLUDED = (
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "requirements.txt", "Pipfile.lock",
    "poetry.lock", "Gemfile", "Gemfile.lock", "go.mod", "go.sum", "composer.lock", IGNORE_FILE,
)
SERVICE_SKIPPED = r"(^|/)(node_modules|dist|build|coverage|\.next|\.git|vendor|target|__pycache__)(/|$)"
LOCAL_SKIPPED = (
    r"(^|/)(node_modules|dist|build|coverage|\.next|\.git|\.turbo|\.vercel|vendor|target|__pycache__|\.cache)(/|$)"
)
REPO_URL = r"(?i)^https://github\.com/([^/\s]+)/([^/\s#?]+)(?:[/?#].*)?$"


def should_include(path: Column, profile: str = "service") -> Column:
    """Service: exact names win over skipped folders. Local: skipped folders win."""
    named = F.substring_index(path, "/", -1).isin(*ALWAYS_INCLUDED)
    if profile == "service":
        return named | (~path.rlike(SERVICE_SKIPPED) & path.rlike(SERVICE_TEXT))
    return ~path.rlike(LOCAL_SKIPPED) & (named | path.rlike(LOCAL_TEXT))


def corpus_files(spark: SparkSession, root: str, profile: str = "local", repo_depth: int = 1,
                 max_file_bytes: int | None = None) -> DataFrame:
    """Files below ``root`` as (repo_id, path, content, size).

    The first ``repo_depth`` folders below the root name the repository; with 0
    the whole tree is one. ``max_file_bytes`` (``SERVICE_LIMITS`` and ``LOCAL_LIMITS``
    name the usual ones) is pushed into the file source, so larger files are never
    read. Files holding a NUL are dropped.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if max_file_bytes is not None:
        raw = raw.where(F.col("length") <= max_file_bytes)
    base = root.rstrip("/").split("://", 1)[-1].lstrip("/")
    full = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), r"^[a-z0-9]+:/+", "")
    relative = F.substr(full, F.lit(len(base) + 2))
    if repo_depth:
        repo = F.substring_index(relative, "/", repo_depth)
        inner = F.substr(relative, F.length(repo) + 2)
    else:
        repo, inner = F.lit(base.rsplit("/", 1)[-1]), relative
    named = raw.select(repo.alias("repo_id"), inner.alias("path"), F.col("content").alias("bytes"), "length")
    kept = named.where(should_include(F.col("path"), profile))
    return kept.select(
        "repo_id", "path", F.decode("bytes", "UTF-8").alias("content"), F.col("length").alias("size")
    ).where(~F.col("content").contains("\x00"))


def files_from_documents(
    documents: DataFrame, repo: str = "source", doc_id: str = "doc_id", text: str = "text", extension: str = ".txt"
) -> DataFrame:
    """Any (id, text) table as files."""
    return documents.select(
        F.col(repo).alias("repo_id"),
        F.concat(F.col(repo), F.lit("/"), F.col(doc_id).cast("string"), F.lit(extension)).alias("path"),
        F.col(text).alias("content"), F.octet_length(text).cast("long").alias("size"),
    )


def candidate_files(files: DataFrame, profile: str = "service", max_file_bytes: int | None = None) -> DataFrame:
    """Files of an existing table that a scan would consider."""
    kept = files.where(should_include(F.col("path"), profile) & ~F.col("content").contains("\x00"))
    return kept if max_file_bytes is None else kept.where(F.col("size") <= max_file_bytes)


def parse_repo_url(df: DataFrame, column: str = "repo_url") -> DataFrame:
    """Adds owner, repo and error (``invalid_repo_url``) of a repository url."""
    url = F.coalesce(F.col(column), F.lit(""))
    valid = url.rlike(REPO_URL)
    return df.withColumn("owner", F.when(valid, F.regexp_extract(url, REPO_URL, 1))).withColumn(
        "repo", F.when(valid, F.regexp_replace(F.regexp_extract(url, REPO_URL, 2), r"(?i)\.git$", ""))
    ).withColumn("error", F.when(~valid, F.lit("invalid_repo_url")))
