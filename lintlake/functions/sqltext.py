"""Spark SQL text from Python values.

A rule pack has thousands of expression nodes. Built one by one from Python they
take seconds; as one text they are parsed by the session in a moment.
"""

from __future__ import annotations

from collections.abc import Iterable

ESCAPES = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\t": "\\t", "$": "\\u0024"}


def literal(value: str) -> str:
    """A string literal; ``$`` is escaped because ``${name}`` would be substituted."""
    return "'" + "".join(ESCAPES.get(c, c) for c in value) + "'"


def contains_any(text: str, needles: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {literal(n)})" for n in needles) + ")"


def matches(text: str, pattern: str) -> str:
    return f"{text} RLIKE {literal(pattern)}"


def all_of(tests: Iterable[str]) -> str:
    return " AND ".join(f"({t})" for t in tests) or "true"


def any_of(tests: Iterable[str]) -> str:
    return " OR ".join(f"({t})" for t in tests) or "false"
