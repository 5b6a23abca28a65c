"""The rule record. Users add rules by appending ``Rule`` objects to a rulebook."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CallTest:
    """What a call rule asks of the arguments of a call.

    argument
        Which one, from 0; None for any of them.
    keys
        If given, the argument has to be an object, and the test is for a property with one of these names.
    mode
        ``literal``: a string or a template without code, whose whole text matches ``pattern``; ``name``: a name or a chain of
        names that does; ``code``: the pattern occurs in it outside texts and comments; ``any``: it is there.
    missing
        Report calls where nothing passes, instead of those where something does.
    """

    argument: int | None = None
    keys: tuple[str, ...] = ()
    mode: str = "any"
    pattern: str | None = None
    missing: bool = False


@dataclass(frozen=True)
class Rule:
    """One pattern rule.

    scope
        ``line``: ``pattern`` is tested on each line (after comment stripping for
        languages that have it, on the raw line for ``raw=True``).
        ``span``: every match of ``pattern`` in the whole text is a hit on the
        line it starts on; ``shown`` and ``subject`` may use its groups.
        ``call``: calls of JavaScript whose callee (``a.b``, ``a().b``) matches ``pattern`` as a whole and whose arguments pass
        ``call``; both patterns are Python's. ``$1`` is the callee, ``$2`` the name or text that passed.
        ``file``: ``file_when`` decides, after the needles; the hit is on line 1.
    unless, unless_pattern
        A literal, a pattern: a line rule skips lines that hold it.
    needles
        Literals of which every match contains at least one. They are tested
        first as plain substrings, so most text never meets a regex. With
        ``fold_case`` they are lower case and tested on the lowered text.
    file_when
        Extra SQL condition over ``content`` and ``path``, evaluated once per file.
    """

    rule: str
    severity: str
    title: str
    category: str
    fix: str
    scope: str
    languages: tuple[str, ...] = ()
    pattern: str | None = None
    also: tuple[str, ...] = ()
    unless: str | None = None
    unless_pattern: str | None = None
    needles: tuple[str, ...] = ()
    fold_case: bool = False
    raw: bool = False
    path_pattern: str | None = None
    shown: str | None = None
    subject: str | None = None
    file_when: str | None = None
    call: CallTest | None = None
    references: tuple[str, ...] = field(default=())
    rule_type: str = "regex_match"
    signal: int = 0
