"""URL steps of the site scan, and token claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def url_origin(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def _fold_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of a rooted path."""
    segments = F.split(F.substr(path, F.lit(2)), "/", -1)
    folded = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segments, -1)
    closed = F.when(last.isin(".", "..") & (F.size(folded) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(folded, "/"), closed)


def resolve_url(base: Column, ref: Column) -> Column:
    """Absolute form of a reference found on a page; null when it has none."""
    origin = url_origin(base)
    folder = F.regexp_replace(url_path(base), r"[^/]*$", "")
    tail = F.regexp_extract(ref, r"^[^?#]*([\s\S]*)$", 1)
    body = F.regexp_extract(ref, r"^([^?#]*)", 1)

    def rooted(path: Column) -> Column:
        simple = F.when(path.rlike(r"/\.\.?(/|$)"), _fold_dots(path)).otherwise(path)
        return F.concat(origin, simple, tail)

    absolute_path = url_path(ref)
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"), F.concat(url_origin(ref), absolute_path, tail_of(ref)))
        .when(ref.rlike(ABSOLUTE), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), ref))
        .when(ref.startswith("/"), rooted(body))
        .when(ref.startswith("?") | ref.startswith("#") | (ref == ""), F.concat(origin, url_path(base), tail))
        .otherwise(rooted(F.concat(folder, body)))
    )


def tail_of(url: Column) -> Column:
    """Query and fragment of a URL."""
    return F.regexp_extract(url, r"^[^?#]*([\s\S]*)$", 1)


def decode_jwt_claims(token: Column) -> Column:
    """role and ref of a token's payload; null fields when it is malformed."""
    payload = F.translate(F.split_part(token, F.lit("."), F.lit(2)), "-_", "+/")
    missing = F.pmod(F.lit(4) - F.pmod(F.length(payload), F.lit(4)), F.lit(4))
    padded = F.concat(payload, F.repeat(F.lit("="), missing))
    text = F.try_to_binary(padded, F.lit("base64"))
    return F.from_json(F.decode(text, "UTF-8"), "role string, ref string")
