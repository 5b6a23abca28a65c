"""Column steps over paths and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extension patterns per language, in match order.
LANGUAGE_EXTENSIONS = [
    ("javascript", r"\.(js|jsx|ts|tsx|mjs|cjs|vue|svelte)$"),
    ("python", r"\.py$"),
    ("ruby", r"\.rb$"),
    ("go", r"\.go$"),
    ("php", r"\.(php|phtml)$"),
    ("sql", r"\.sql$"),
]

# What a comment looks like per language.
COMMENT_PATTERNS = {
    "python": r"(^|\s)#.*$",
    "ruby": r"#.*$",
    "go": r"//.*$",
    "php": r"//.*$|#.*$",
}
COMMENT_LINE_PATTERNS = {
    "generic": r"^\s*(//|#|--|\*)",
    "javascript": r"^\s*(//|\*|#)",
    "sql": r"^\s*--",
}

BLANKS = " \t\n\x0b\f\r"


def trimmed(col: Column) -> Column:
    """Trim every ASCII blank, not only spaces."""
    return F.btrim(col, F.lit(BLANKS))


def detect_language(path: Column) -> Column:
    out = None
    for language, pattern in LANGUAGE_EXTENSIONS:
        test = path.rlike("(?i)" + pattern)
        out = F.when(test, language) if out is None else out.when(test, language)
    return out.otherwise("unknown")


def split_lines(content: Column) -> Column:
    """Lines of a text, broken at ``\\r?\\n``, trailing empty lines kept.

    A one-character separator takes the JVM's fast split path; the carriage
    returns are dropped first, and only where there are any.
    """
    unix = F.when(content.contains("\r"), F.replace(content, F.lit("\r\n"), F.lit("\n"))).otherwise(content)
    return F.split(unix, "\n", -1)


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line, 1-based, trailing empty lines kept."""
    keep = [c for c in files.columns if c != "content"]
    return files.select(
        *keep, F.posexplode(split_lines(F.col("content"))).alias("pos", "text")
    ).select(*keep, (F.col("pos") + 1).alias("line"), "text")


def strip_comments(language: Column, text: Column) -> Column:
    """Cut the comment of languages that have line comments; others pass through."""
    return (
        F.when((language == "python") & text.contains("#"),
               F.regexp_replace(text, COMMENT_PATTERNS["python"], "$1"))
        .when((language == "ruby") & text.contains("#"),
              F.regexp_replace(text, COMMENT_PATTERNS["ruby"], ""))
        .when((language == "go") & text.contains("//"),
              F.regexp_replace(text, COMMENT_PATTERNS["go"], ""))
        .when((language == "php") & (text.contains("//") | text.contains("#")),
              F.regexp_replace(text, COMMENT_PATTERNS["php"], ""))
        .otherwise(text)
    )


def is_comment_line(text: Column, dialect: str = "generic") -> Column:
    return text.rlike(COMMENT_LINE_PATTERNS[dialect])
