"""Calls in JavaScript sources: one pass over tokens, with an explicit stack.

Strings, template literals with code inside, comments, regular expressions and brackets are told apart, so a bracket in a string
closes nothing. A call's arguments and the properties of objects among them are summed up while the pass goes by, so nothing is
read twice and any depth, length or number of arguments takes time in proportion to the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake.operators.rules.rule import CallTest, Rule

TOKEN = re.compile(
    r"(?P<name>[A-Za-z_$][\w$]*(?:\s*\??\.[ \t]*[A-Za-z_$#][\w$]*)*)|(?P<number>[0-9][\w.]*)|(?P<quote>['\"])|(?P<tick>`)|(?P<line>//[^\n]*)"
    r"|(?P<block>/\*)|(?P<slash>/)|(?P<bracket>[(){}\[\]])|(?P<comma>,)|(?P<other>[^\s\w$'\"`/(){}\[\],]+|\S)", re.S)
STRING = {q: re.compile(rf"{q}[^{q}\\\n]*(?:\\[\s\S][^{q}\\\n]*)*{q}") for q in "'\""}
REGEX = re.compile(r"/(?![*/])[^/\\\[\n]*(?:(?:\\[^\n]|\[[^\]\\\n]*(?:\\[^\n][^\]\\\n]*)*\])[^/\\\[\n]*)*/[A-Za-z]*")
TEMPLATE = re.compile(r"`|\$\{|\\[\s\S]")
COMMENT_LINE = re.compile(r"\s*(//|\*|#)")
BLANK = re.compile(r"[^\n]")
#: Words after which a slash begins a regular expression.
BEFORE_REGEX = frozenset("return typeof case in of do else void delete throw new await yield instanceof".split())
CLOSES = {")": "(", "]": "[", "}": "{"}


class Value:
    """What is known of an argument or a property: its place, its one token if it has only one, its properties if it is an object."""

    __slots__ = ("start", "end", "tokens", "kind", "text", "object")

    def __init__(self, start: int) -> None:
        self.start = self.end = start
        self.tokens, self.kind, self.text, self.object = 0, "", "", None

    def literal(self) -> str | None:
        """The text of a string, or of a template without code."""
        return self.text[1:-1] if self.tokens == 1 and self.kind in ("string", "template") else None


class Frame:
    """An open bracket, with the callee before it, the finished values inside it and the one that goes on."""

    __slots__ = ("kind", "callee", "start", "line", "commented", "values", "value", "key", "properties")

    def __init__(self, kind: str, at: int, callee: str | None = None, start: int = 0) -> None:
        self.kind, self.callee, self.start = kind, callee, start
        self.line, self.commented = 0, False
        self.values: list[Value] = []
        self.value = Value(at)
        self.key: str | None = None
        self.properties: dict[str, Value] = {}

    def next_value(self, end: int, keys: frozenset[str]) -> None:
        """Ends the current value: an argument, or a property, of which only the named ones are kept."""
        value, self.value = self.value, Value(end + 1)
        value.end = end
        if self.kind == "{":
            key = self.key if self.key is not None else value.text if value.tokens == 1 and value.kind == "name" else None
            if key in keys:
                self.properties.setdefault(key, value)
            self.key = None
        elif self.callee is not None and (value.tokens or self.values):
            self.values.append(value)


def _keys_of(tests: Sequence[CallTest]) -> frozenset[str]:
    return frozenset(key for test in tests for key in test.keys)


def calls_of(source: str, wanted: re.Pattern, keys: frozenset[str] = frozenset()) -> tuple[list[Frame], str]:
    """The closed calls whose callee matches as a whole, by their start, and the source with comments and texts of strings blanked.

    ``a().b(`` has the callee ``a().b``; a chain goes on in the next line if that begins with the dot. Brackets that nothing closes, or that close nothing, are passed over.
    """
    found: list[Frame] = []
    stack = [Frame("", 0)]
    opened = {"(": 0, "[": 0, "{": 0, "${": 0}
    code: list[str] = []
    at, kept, line, line_start, counted, end = 0, 0, 1, 0, 0, len(source)
    before, before_text, before_at = "", "", 0  # kind, text and place of the token before
    chained = ""  # "a()." after a call's end and a dot
    open_comments = True
    barren = {"'": 0, '"': 0, "/": 0}  # up to where no text in such marks ends: a line's end, so that a search is not repeated
    templates: list[int] = []  # starts of the open template literals

    def line_end(start: int) -> int:
        stop = source.find("\n", start)
        return stop if stop >= 0 else end

    def blank(start: int, stop: int) -> None:
        nonlocal kept
        code.append(source[kept:start])
        code.append(BLANK.sub(" ", source[start:stop]))
        kept = stop

    def token(kind: str, text: str, start: int) -> None:
        nonlocal before, before_text, before_at
        value = stack[-1].value
        if not (kind == "other" and text == "!" and value.tokens):  # a mark of the type checker
            value.tokens += 1
            if value.tokens == 1:
                value.kind, value.text, value.start = kind, text, start
        before, before_text, before_at = kind, text, start

    def template(start: int) -> int:
        """Reads a template's text on from a place; returns where code goes on: inside ${ or after the end."""
        place = start
        while True:
            mark = TEMPLATE.search(source, place)
            if not mark:
                blank(start, end)
                return end
            place = mark.end()
            if mark[0] == "`":
                blank(start, mark.start())
                begin = templates.pop()
                whole = start == begin + 1
                token("template" if whole else "mixed", source[begin:place] if whole else "", begin)
                return place
            if mark[0] == "${":
                blank(start, mark.start())
                stack.append(Frame("${", place))
                opened["${"] += 1
                return place

    def close(kind: str, place: int) -> bool:
        """Closes the innermost bracket of a kind; brackets left open inside it go. False if none is open."""
        nonlocal before, before_text, before_at
        if not opened[kind]:
            return False
        while stack[-1].kind != kind:
            frame = stack.pop()
            opened[frame.kind] -= 1
            if frame.kind == "${":
                templates.pop()
        frame = stack.pop()
        opened[kind] -= 1
        # Brackets around a call, awaited or not, stand for the call.
        inner = before_text if kind == "(" and frame.callee is None and before == "close" and frame.value.tokens <= 3 else ""
        frame.next_value(place, keys)
        value = stack[-1].value
        if kind == "{" and value.tokens == 1 and value.kind == "{":
            value.object = frame.properties
        if frame.callee is not None and frame.line:
            found.append(frame)
        before, before_text, before_at = "close", frame.callee or inner, place
        return True

    while at < end:
        match = TOKEN.search(source, at)
        if not match:
            break
        kind, text, start = match.lastgroup, match[0], match.start()
        at = match.end()
        frame = stack[-1]
        if kind == "line":
            blank(start, at)
        elif kind == "block":
            stop = source.find("*/", at) if open_comments else -1
            if stop >= 0:
                at = stop + 2
                blank(start, at)
            else:
                open_comments = False
        elif kind == "slash":
            regex = None
            if start >= barren["/"] and (before in ("", "other", "comma", "open") or before == "name" and before_text in BEFORE_REGEX):
                regex = REGEX.match(source, start)
                if not regex:
                    barren["/"] = line_end(start)
            if regex:
                at = regex.end()
                blank(start + 1, at)
                token("regex", "", start)
            else:
                token("other", "/", start)
        elif kind == "tick":
            templates.append(start)
            at = template(at)
        elif kind == "quote":
            string = STRING[text].match(source, start) if start >= barren[text] else None
            if string:
                at = string.end()
                blank(start + 1, at - 1)
                token("string", string[0], start)
            else:
                if start >= barren[text]:
                    barren[text] = line_end(start)
                token("other", text, start)
        elif kind == "comma":
            frame.next_value(start, keys)
            before, before_text = "comma", ""
        elif kind == "bracket":
            if text in "([{":
                callee = None
                if text == "(" and before == "name" and before_text not in BEFORE_REGEX:
                    callee, begin = before_text, before_at
                token(text, "", start)
                child = Frame(text, at, callee, begin if callee else start)
                if callee and wanted.fullmatch(callee):
                    line += source.count("\n", counted, begin)
                    line_start = max(line_start, source.rfind("\n", counted, begin) + 1)
                    counted = max(counted, begin)
                    child.line, child.commented = line, bool(COMMENT_LINE.match(source, line_start, max(begin, line_start)))
                stack.append(child)
                opened[text] += 1
                before, before_text = "open", ""
            elif text == "}" and opened["${"] and not _inner(stack, "{"):
                close("${", start)
                at = template(at)
            else:
                close(CLOSES[text], start)
        elif kind == "name":
            name = "".join(text.split()).replace("?.", ".")
            if chained and "\n" not in source[dotted:start]:
                name, start = chained + name, chained_at
            defined = before == "name" and before_text == "function"
            token("name", "function " + name if defined else name, start)
        elif kind == "other" and frame.kind == "{" and text[0] == ":" and frame.key is None and frame.value.tokens == 1 and frame.value.kind in ("name", "string"):
            frame.key = frame.value.literal() if frame.value.kind == "string" else frame.value.text
            frame.value = Value(at)
            before, before_text = "other", ":"
        else:
            owner = f"{before_text}()." if before == "close" else f"{before_text}." if before == "name" else "()."
            token(kind, text, start)
            if kind == "other" and text[-1] == "." and text[-3:] != "...":  # a member of what stands before
                chained, chained_at, dotted = owner, start, at
                continue
        chained = ""
    code.append(source[kept:])
    found.sort(key=lambda f: f.start)
    return found, "".join(code)


def _inner(stack: list[Frame], kind: str) -> bool:
    """Whether a bracket of a kind is open inside the innermost template code."""
    for frame in reversed(stack):
        if frame.kind == "${":
            return False
        if frame.kind == kind:
            return True
    return False


class CallMatcher:
    """The call rules of a rulebook, ready to be applied to sources."""

    def __init__(self, rules: Sequence[tuple[int, Rule]]) -> None:
        self.rules = [(ord_, rule, re.compile(rule.pattern), re.compile(rule.call.pattern or "")) for ord_, rule in rules]
        self.wanted = re.compile("|".join(f"(?:{rule.pattern})" for _, rule in rules))
        self.keys = _keys_of([rule.call for _, rule in rules])

    def hits(self, source: str, allowed: Sequence[bool]) -> Iterator[tuple[int, int, str, str | None]]:
        """(ord, line, shown, subject) of every call that a rule, if allowed for the file, reports."""
        calls, code = calls_of(source, self.wanted, self.keys)
        places: dict[int, list[int]] = {}
        for call in calls:
            if call.commented:
                continue
            for (ord_, rule, callee, pattern), may in zip(self.rules, allowed, strict=True):
                groups = may and callee.fullmatch(call.callee)
                if not groups:
                    continue
                test = rule.call
                if test.mode == "code":
                    if ord_ not in places:
                        places[ord_] = [m.start() for m in pattern.finditer(code)]
                    value = self._code(test, call, places[ord_])
                else:
                    value = self._value(test, call, pattern)
                if (value is None) == test.missing:
                    texts = (call.callee, value or "")
                    yield ord_, call.line, _filled(rule.shown, texts), _filled(rule.subject, texts) if rule.subject else None

    @staticmethod
    def _code(test: CallTest, call: Frame, places: list[int]) -> str | None:
        for value in call.values if test.argument is None else call.values[test.argument:test.argument + 1]:
            at = bisect_left(places, value.start)
            if at < len(places) and places[at] < value.end:
                return ""
        return None

    @staticmethod
    def _value(test: CallTest, call: Frame, pattern: re.Pattern) -> str | None:
        for value in call.values if test.argument is None else call.values[test.argument:test.argument + 1]:
            for own in [value] if not test.keys else [v for k, v in (value.object or {}).items() if k in test.keys]:
                if test.mode == "any":
                    return ""
                text = own.literal() if test.mode == "literal" else own.text if own.tokens == 1 and own.kind == "name" else None
                if text is not None and pattern.fullmatch(text):
                    return text
        return None


def _filled(template: str, texts: tuple[str, str]) -> str:
    return re.sub(r"\$([12])", lambda m: texts[int(m[1]) - 1], template)


def call_hits(rules: Sequence[tuple[int, Rule]], content: Column, allowed: Sequence[Column]) -> Column:
    """array<struct<ord, line, shown, subject>> of the calls that rules report in a source; null contents have none.

    The column is computed in batches on the workers; ``allowed`` says per rule whether the file may be reported.
    """
    kind = pa.list_(pa.struct([("ord", pa.int32()), ("line", pa.int32()), ("shown", pa.string()), ("subject", pa.string())]))
    rules = list(rules)

    @F.arrow_udf("array<struct<ord:int,line:int,shown:string,subject:string>>")
    def found(contents: pa.Array, may: pa.Array) -> pa.Array:
        matcher, out = None, []
        for n in range(len(contents)):
            source = contents[n].as_py()
            if source is None:
                out.append([])
                continue
            matcher = matcher or CallMatcher(rules)
            out.append([dict(zip(("ord", "line", "shown", "subject"), hit, strict=True)) for hit in matcher.hits(source, may[n].as_py())])
        return pa.array(out, kind)

    return found(content, F.array(*[F.coalesce(a, F.lit(False)) for a in allowed]))
