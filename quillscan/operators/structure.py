"""Structure of a source file: an outline of its blocks, read once from the masked text.

Brackets are paired in one pass, lines of indentation and ``end`` words in another. A
definition is a span of the text, so its length, its branches and the methods of a class
are questions of containment, answered by bisection.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from functools import cached_property
from typing import NamedTuple

BODY_LINES = 50
BRANCHES = 25
DEPTH = 6
METHODS = 20

# What starts a function or class in brace languages, what branches, what isn't a method.
NAMED = r"\b(?:function|func|fn|fun)\s+\w+\s*\("
ARROW = r"\bconst\s+\w+\s*=\s*(?:async\s*)?\([^)]*\)\s*=>\s*\{"
MODIFIED = r"\b(?:public|private|protected|internal|static|virtual|override|final|abstract)\s+[\w<>\[\],\s]+\s+\w+\s*\([^)]*\)\s*(?:throws\s+[\w,\s]+)?\s*\{"
RETURNING = r"\b(?:void|int|bool|string|double|float|char|long|unsigned|size_t|auto)\s+\w+\s*\([^)]*\)\s*\{"
FUNCTION = re.compile(rf"{NAMED}|{ARROW}|{MODIFIED}")
FUNCTION_OR_CLASS = re.compile(rf"{NAMED}|{ARROW}|\bclass\s+\w+|{MODIFIED}|{RETURNING}")
DEFINED = {"python": re.compile(r"\bdef\s+\w+\s*\("), "ruby": re.compile(r"\bdef\s+[A-Za-z_]\w*")}
BRANCH = {"brace": re.compile(r"\b(?:if|for|while|switch|case|catch)\b|&&|\|\||\?"), "word": re.compile(r"\b(?:if|for|while|switch|case|catch|and|or|elif)\b|&&|\|\||\?")}
CLASS = re.compile(r"\b(?:class|struct|interface|trait|object)\s+([A-Za-z_]\w*)|type\s+([A-Za-z_]\w*)\s+struct\b")
RECEIVER = re.compile(r"\bfunc\s*\([^)]*?\b([A-Za-z_]\w*)(?:\[[^\]]*\])?\s*\)\s+\w+\s*\(")
AFTER_PARAMETERS = re.compile(r"\s*(?::[^={};]+|(?:throws|const|override|noexcept)\b[^={};]*)?\Z")
NAME = re.compile(r"([A-Za-z_]\w*)\s*\Z")
NOT_METHODS = frozenset("if for while switch catch function return constructor".split())
BRACKET = re.compile(r"[{}()]")
BOUNDARY = re.compile(r"[;{}]")
RUBY_WORD = re.compile(r"(?:^|;)[ \t]*(?:(?:private|public|protected|module_function|private_class_method)[ \t]+)?(?:[\w@.\[\]]+[ \t]*(?:\|\|)?=[ \t]*)?(if|unless|while|until|case|for|begin|def(?![ \t]+[\w.?!]+(?:\([^()\n]*\))?[ \t]+=[ \t])|class|module)\b|\b(do)\b|(?<![\w.:@])(end)\b(?![?!:])", re.M)
INDENTED = re.compile(r"^([ \t]*)(?=\S)", re.M)


class Span(NamedTuple):
    """A definition: where it starts, where its body opens and ends, and the lines of the body."""

    start: int
    opened: int
    end: int
    lines: int
    closed: bool


class Outline:
    """The blocks of a masked text of one language family: ``python``, ``ruby`` or ``brace``."""

    def __init__(self, code: str, family: str):
        self.code, self.family = code, family
        self.line_ends = [m.start() for m in re.finditer("\n", code)]
        self.total = len(self.line_ends) + (not code.endswith("\n"))

    def line(self, at: int) -> int:
        return bisect_left(self.line_ends, at)

    @cached_property
    def pairs(self) -> dict[int, int]:
        """Opening to closing brackets; what nothing closes is absent."""
        pairs, open_ = {}, {"{": [], "(": []}
        for m in BRACKET.finditer(self.code):
            c = m[0]
            if c in "{(":
                open_[c].append(m.start())
            elif open_["{" if c == "}" else "("]:
                pairs[open_["{" if c == "}" else "("].pop()] = m.start()
        return pairs

    @cached_property
    def braces(self) -> list[int]:
        return [m.start() for m in re.finditer(r"\{", self.code)]

    @cached_property
    def branches(self) -> list[int]:
        return [m.start() for m in BRANCH["brace" if self.family == "brace" else "word"].finditer(self.code)]

    @cached_property
    def words(self) -> dict[int, int]:
        """Ruby: the offset of each word that opens a block, with that of its ``end``."""
        closes, stack, loop = {}, [], -1
        for m in RUBY_WORD.finditer(self.code):
            at = m.start(m.lastindex)
            if m[3]:
                if stack:
                    closes[stack.pop()] = at
            elif m[2] and loop == self.line(at):  # the do of a loop opens no block of its own
                loop = -1
            else:
                stack.append(at)
                loop = self.line(at) if m[1] in ("while", "until", "for") else -1
        return closes

    @cached_property
    def margins(self) -> tuple[list[int], list[int]]:
        """Python: the lines that hold something and their indentation."""
        found = [(self.line(m.start()), len(m[1])) for m in INDENTED.finditer(self.code)]
        return [n for n, _ in found], [w for _, w in found]

    def body(self, start: int, after: int) -> Span | None:
        """The block that belongs to a definition at ``start`` whose head reaches to ``after`` or further."""
        if self.family == "brace":
            if self.code[after - 1] == "{":
                opened = after - 1
            else:
                if self.code[after - 1] == "(":
                    after = self.pairs.get(after - 1, after)
                k = bisect_left(self.braces, after)
                if k == len(self.braces):
                    return None
                opened = self.braces[k]
                if ";" in self.code[after:opened]:  # declared without a body
                    return None
            end = self.pairs.get(opened)
            last = self.line(end) if end is not None else self.total
            return Span(start, opened, len(self.code) if end is None else end, max(0, last - self.line(opened) - 1), end is not None)
        first = self.line(start)
        if self.family == "ruby":
            end = self.words.get(start)
            last = self.line(end) if end is not None else self.total
            return Span(start, start, len(self.code) if end is None else end, max(0, last - first - 1), end is not None)
        lines, widths = self.margins
        k = bisect_left(lines, first)
        base = widths[k] if k < len(lines) else 0
        k = next((j for j in range(k + 1, len(lines)) if widths[j] <= base), None)
        last = lines[k] if k is not None else self.total
        return Span(start, start, self.line_ends[last - 1] if 0 < last <= len(self.line_ends) else len(self.code), max(0, last - first - 1), True)

    def definitions(self, rx: re.Pattern) -> list[Span]:
        return [s for m in rx.finditer(self.code) if (s := self.body(m.start(), m.end()))]

    @cached_property
    def functions(self) -> list[Span]:
        return self.definitions(FUNCTION if self.family == "brace" else DEFINED[self.family])

    def long_function(self) -> tuple[int, int] | None:
        """(offset, lines) of the first definition with a long body."""
        spans = self.definitions(FUNCTION_OR_CLASS) if self.family == "brace" else self.functions
        return next(((s.start, s.lines) for s in spans if s.lines > BODY_LINES), None)

    def most_branches(self) -> tuple[int, int]:
        """(branches, offset) of the definition with most branches, the first of equals."""
        counts = [(bisect_left(self.branches, s.end) - bisect_left(self.branches, s.opened), -s.start) for s in self.functions if s.closed]
        most, start = max(counts, default=(0, 0))
        return most, -start

    def deepest(self, text: str) -> int:
        """Levels of braces, or of indentation in the text itself."""
        if self.family == "brace":
            depth = most = 0
            for m in BRACKET.finditer(self.code):
                depth = depth + 1 if m[0] == "{" else max(0, depth - 1) if m[0] == "}" else depth
                most = max(most, depth)
            return most
        widest = max((len(m[1]) for m in INDENTED.finditer(text)), default=0)
        return math.floor(widest / (4 if self.family == "python" else 2) + 0.5)

    @cached_property
    def methods(self) -> list[int]:
        """Where methods start: definitions, or blocks whose head ends with a name and its parameters."""
        if self.family != "brace":
            return [s.start for s in self.functions]
        opens = {v: k for k, v in self.pairs.items()}
        cuts = [m.start() for m in BOUNDARY.finditer(self.code)]
        out = []
        for k, at in enumerate(cuts):
            if self.code[at] == "{" and k:
                close = self.code.rfind(")", cuts[k - 1] + 1, at)
                opened = opens.get(close) if close >= 0 and AFTER_PARAMETERS.match(self.code[close + 1 : at]) else None
                if opened is not None and (m := NAME.search(self.code[max(0, opened - 120) : opened])) and m[1] not in NOT_METHODS:
                    out.append(at)
        return out

    @cached_property
    def received(self) -> dict[str, int]:
        """Go: methods by the type of their receiver."""
        counts: dict[str, int] = {}
        for m in RECEIVER.finditer(self.code):
            counts[m[1]] = counts.get(m[1], 0) + 1
        return counts

    def god_class(self) -> tuple[int, str, int] | None:
        """(offset, name, methods) of the first class with too many methods."""
        for m in CLASS.finditer(self.code):
            name = m[1] or m[2]
            if self.family == "ruby":
                start = next((at for at in (m.start(), m.start() - 1) if at in self.words), None)
                span = self.body(start, m.end()) if start is not None else None
            else:
                span = self.body(m.start(), m.end())
            n = bisect_right(self.methods, span.end) - bisect_right(self.methods, span.opened) if span else 0
            if (n := n + (self.received.get(name, 0) if m[2] else 0)) > METHODS:
                return m.start(), name, n
        return None
