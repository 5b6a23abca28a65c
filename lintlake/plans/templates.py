"""Small text templates as SQL text, for the SQL checks.

``{name}`` stands for a named value; everything else is literal. The registered
queries derive their inputs from the given tables with the same templates.
"""

from __future__ import annotations

import re


def _parts(template: str) -> list[str]:
    return [p for p in re.split(r"(\{\w+\})", template) if p]


def sql_text(value: str) -> str:
    """A SQL string literal; line breaks as chr(10)."""
    pieces = ["'" + piece.replace("'", "''") + "'" for piece in value.split("\n")]
    return " || chr(10) || ".join(pieces)


def render_sql(template: str, names: dict[str, str]) -> str:
    return "(" + " || ".join(
        names[p[1:-1]] if re.fullmatch(r"\{\w+\}", p) and p[1:-1] in names else sql_text(p) for p in _parts(template)
    ) + ")"


def pick_sql(selector: str, templates: list[str], names: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {i} THEN {render_sql(t, names)}" for i, t in enumerate(templates))
    return f"CASE {selector} {cases} END"
