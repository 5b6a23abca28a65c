"""Secret masking of evidence and of whole text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVIDENCE_CHARS = 280  # fixed value: where ``strict_compat`` cuts evidence
KEYWORDS = ("secret", "token", "private_key", "api_key", "password")

# The eight masks in order, as (pattern, replacement, literals one
# of which any match contains). The literals let most rows skip the regex.
# The last pattern carries a look-behind so that one long run of word characters
# is tried once, not once per character; it matches the same spans.
SECRET_MASKS = [
    (r"(sk-proj-)[A-Za-z0-9_-]{12,}", "$1[redacted]", ("sk-proj-",)),
    (r"(sk_(?:live|test)_)[A-Za-z0-9]{12,}", "$1[redacted]", ("sk_live_", "sk_test_")),
    (r"(ghp_|github_pat_)[A-Za-z0-9_]{12,}", "$1[redacted]", ("ghp_", "github_pat_")),
    (r"(AKIA)[A-Z0-9]{12,}", "$1[redacted]", ("AKIA",)),
    (r"(xox[abprs]-)[A-Za-z0-9-]{12,}", "$1[redacted]", ("xox",)),
    (r"(rk_(live|test)_)[A-Za-z0-9_]{12,}", "$1[redacted]", ("rk_live_", "rk_test_")),
    (r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,})", "[redacted-jwt]", ("eyJ",)),
]
KEYWORD_MASK = (
    r"(?i)((?<![A-Za-z0-9_])[A-Za-z0-9_]*(?:SECRET|TOKEN|PRIVATE_KEY|API_KEY|PASSWORD)"
    r"[A-Za-z0-9_]*\s*[:=]\s*)[^\s\"'`]+"
)
# Deliberate extensions: a quoted value is masked too, and so is every detected
# key kind (see README, "Differences").
KEYWORD_MASK_QUOTED = KEYWORD_MASK.replace(r"[:=]\s*)", r"[:=]\s*[\"'`]?)")
EXTRA_MASKS = [
    (r"(SG\.)[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", "$1[redacted]", ("SG.",)),
    (r"(AC)[a-f0-9]{32}", "$1[redacted]", ("AC",)),
    (r"(re_)[A-Za-z0-9_]{16,}", "$1[redacted]", ("re_",)),
]


def _any_contains(col: Column, needles) -> Column:
    test = col.contains(needles[0])
    for needle in needles[1:]:
        test = test | col.contains(needle)
    return test


def redact(col: Column, strict_compat: bool = False) -> Column:
    """Replace every secret in the whole text, in mask order."""
    out = col
    for pattern, replacement, _ in SECRET_MASKS + ([] if strict_compat else EXTRA_MASKS):
        out = F.regexp_replace(out, pattern, replacement)
    return F.regexp_replace(out, KEYWORD_MASK if strict_compat else KEYWORD_MASK_QUOTED, "$1[redacted]")


def may_hold_secret(col: Column, strict_compat: bool = False) -> Column:
    """Cheap substring test that is true for every text a mask would change."""
    test = _any_contains(F.lower(col), KEYWORDS)
    for _, _, needles in SECRET_MASKS + ([] if strict_compat else EXTRA_MASKS):
        test = test | _any_contains(col, needles)
    return test


def redact_corpus(df: DataFrame, column: str, strict_compat: bool = False) -> DataFrame:
    """Mask one text column of any table; texts without a trigger skip the regexes."""
    text = F.col(column)
    masked = F.when(may_hold_secret(text, strict_compat), redact(text, strict_compat)).otherwise(text)
    return df.withColumn(column, masked)


def mask_secrets(col: Column, strict_compat: bool = False) -> Column:
    """Masked evidence, whole; with ``strict_compat`` only its first characters."""
    masked = redact(col, strict_compat)
    return F.substring(masked, 1, EVIDENCE_CHARS) if strict_compat else masked
