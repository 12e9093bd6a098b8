"""Parsing-expression grammars and their packrat parser.

A grammar is a text of rules. It is compiled to closures over one text at a time with a
memo per rule and position, so a parse takes time in proportion to the text, and it
keeps the furthest position at which a token failed. Tokens are patterns; a grammar may
name a token for a run of plain statements, which is then taken in one match.

Notation: ``Rule <- e``; ``'text'`` a token, ``/pattern/`` a token by pattern, ``~/pattern/``
without space after it; ``e / e`` ordered choice, ``e*``, ``e+``, ``e?``, ``&e``, ``!e``. A token
takes the grammar's space after it. A rule in capitals is a token or stands for one.

A grammar may rewrite a text before it parses it (comments out, indents marked). What was
moved is kept, so that a failure is told in the original text.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Callable, Iterable
from functools import cached_property

import regex

LONG_PATTERN = 2000  # compiling a run of statements twice costs more than trying it where it can't start
LOOKBEHIND = regex.compile(r"\(\?<[=!](?:[^()\\\[]|\\.|\[(?:[^\]\\]|\\.)*\])*\)")
LEX = regex.compile(r"\s*(?:(?P<name>[A-Za-z]\w*)|'(?P<lit>(?:[^'\\]|\\.)+)'|(?P<bare>~?)/(?!\s)(?P<pat>(?:[^/\\]|\\.)+)/(?=[\s*+?)]|$)|(?P<op>[()*+?&!/]))")


def _read(text: str) -> tuple:
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = LEX.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"grammar: {text[at : at + 40]!r}")
        at = m.end()
        if m["name"]:
            tokens.append(("name", m["name"]))
        elif m["lit"]:
            tokens.append(("lit", regex.sub(r"\\(.)", r"\1", m["lit"])))
        elif m["pat"]:
            tokens.append(("bare" if m["bare"] else "pat", m["pat"].replace("\\/", "/")))
        else:
            tokens.append(("op", m["op"]))
    pos = 0

    def choice() -> tuple:
        nonlocal pos
        parts = [sequence()]
        while pos < len(tokens) and tokens[pos] == ("op", "/"):
            pos += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence() -> tuple:
        nonlocal pos
        parts = []
        while pos < len(tokens) and tokens[pos] not in (("op", "/"), ("op", ")")):
            parts.append(item())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def item() -> tuple:
        nonlocal pos
        t = tokens[pos]
        pos += 1
        if t in (("op", "&"), ("op", "!")):
            return (t[1], item())
        if t == ("op", "("):
            e = choice()
            pos += 1
        else:
            e = t
        while pos < len(tokens) and tokens[pos] in (("op", "*"), ("op", "+"), ("op", "?")):
            e = (tokens[pos][1], e)
            pos += 1
        return e

    return choice()


class Moved:
    """A rewritten text that knows where its characters come from."""

    def __init__(self, text: str):
        self.text, self.length = text, len(text)
        self.stages: list[tuple[list[int], list[int]]] = []

    def pieces(self, pieces: Iterable[tuple[str, int]]) -> Moved:
        """Replace the text by pieces, each with the offset in the text where it begins."""
        out, new, old = [], [0], [0]
        at, shift = 0, 0
        for piece, origin in pieces:
            if origin - at != shift:
                shift = origin - at
                new.append(at)
                old.append(origin)
            out.append(piece)
            at += len(piece)
        self.stages.append((new, old))
        self.text = "".join(out)
        return self

    def sub(self, rx: regex.Pattern, by: Callable[[regex.Match], str]) -> Moved:
        """Replace what matches; nothing is done if nothing does."""
        if not rx.search(self.text):
            return self

        def pieces() -> Iterable[tuple[str, int]]:
            at = 0
            for m in rx.finditer(self.text):
                if m.start() > at:
                    yield self.text[at : m.start()], at
                yield by(m), m.start()
                at = m.end()
            yield self.text[at:], at

        return self.pieces(pieces())

    def origin(self, at: int) -> int:
        """Where the character at an offset of the rewritten text stands in the original."""
        for new, old in reversed(self.stages):
            k = bisect_right(new, at) - 1
            at = old[k] + at - new[k] if k + 1 == len(new) else min(old[k] + at - new[k], max(old[k], old[k + 1] - 1))
        return max(0, min(at, self.length))


class Grammar:
    """``space`` follows a token; ``tight`` follows one after which a line may end a statement."""

    def __init__(self, rules: str, space: str, tight: str | None = None, ends: str = r"(?!)", prepare: Callable[[Moved], Moved] | None = None):
        self.space, self.tight, self.ends, self.prepare = space, tight or space, regex.compile(ends), prepare
        joined: list[str] = []
        for line in rules.strip().splitlines():
            if "<-" in line.split("'")[0].split("/")[0]:
                joined.append(line)
            elif line.strip():
                joined[-1] += " " + line.strip()
        pairs = [x.split("<-", 1) for x in joined]
        self.first = pairs[0][0].strip()
        self.rules = {n.strip(): _read(e) for n, e in pairs}

    def __getstate__(self) -> dict:
        # what is compiled belongs to one process
        return {k: v for k, v in self.__dict__.items() if k not in ("packrat", "starts", "slow")}

    def _pattern(self, e: tuple) -> str | None:
        """The pattern of a token, None for what isn't one."""
        kind, v = e
        if kind == "bare":
            return f"(?>{v})"
        if kind in ("lit", "pat"):
            body = (regex.escape(v) + (r"(?![\w$])" if v[-1].isalnum() else "")) if kind == "lit" else f"(?>{v})"
            after = self.tight if self.ends.fullmatch(v if kind == "lit" else "\0" + v) else self.space
            return f"{body}(?>{after})"
        if kind == "name" and v.isupper():
            return self._pattern(self.rules[v])
        return None

    @cached_property
    def starts(self) -> Callable[[tuple], frozenset[str] | None]:
        """The ASCII characters with which a match of an expression can start; None: any, or nothing."""
        known: dict[str, frozenset[str] | None] = {}
        open_: set[str] = set()

        def by_token(p: str) -> frozenset[str] | None:
            if len(p) > LONG_PATTERN:
                return None
            if p not in known:
                # what stands before a token is not known here
                rx = regex.compile(LOOKBEHIND.sub("", p), regex.S)
                known[p] = None if "(?<" in rx.pattern or (m := rx.match("")) is not None and not m.partial else frozenset(c for c in map(chr, range(128)) if rx.match(c, partial=True))
            return known[p]

        def first(e: tuple) -> frozenset[str] | None:
            if (p := self._pattern(e)) is not None:
                return by_token(p)
            kind, v = e
            if kind == "name":
                if v in open_:
                    return None
                if (key := f"\0{v}") not in known:
                    open_.add(v)
                    known[key] = first(self.rules[v])
                    open_.discard(v)
                return known[key]
            if kind == "seq":
                out: frozenset[str] = frozenset()
                for x in v:
                    if x[0] in "&!":
                        continue
                    f = first(x[1] if x[0] in "*?" else x)
                    if f is None:
                        return None
                    out |= f
                    if x[0] not in "*?":
                        return out
                return None
            if kind == "or":
                sets = [first(x) for x in v]
                return None if None in sets else frozenset().union(*sets)
            return first(v) if kind == "+" else None

        return first

    @cached_property
    def packrat(self) -> Callable[[str], tuple[bool, int]]:
        """text -> (accepted as a whole, furthest failure position)."""
        memo: dict[str, dict[int, int]] = {n: {} for n in self.rules}
        text, far, length = "", 0, 0
        compiled: dict[str, Callable[[int], int]] = {}

        def token(p: str) -> Callable[[int], int]:
            # the standard engine is the faster one where it knows the pattern
            try:
                match = re.compile(p, re.S).match
            except re.error:
                match = regex.compile(p, regex.S).match

            def run(at: int) -> int:
                nonlocal far
                m = match(text, at)
                if m:
                    return m.end()
                if at > far:
                    far = at
                return -1

            return run

        def build(e: tuple) -> Callable[[int], int]:
            if (p := self._pattern(e)) is not None:
                return token(p)
            kind, v = e
            if kind == "name":

                def call(at: int, name: str = v, seen: dict[int, int] = memo[v]) -> int:
                    got = seen.get(at)
                    if got is None:
                        got = seen[at] = compiled[name](at)
                    return got

                return call
            if kind in ("seq", "or"):
                parts = [build(x) for x in v]
                by_char = {chr(c): tuple(f for f, s in zip(parts, sets) if s is None or chr(c) in s) for c in range(128)} if kind == "or" and (sets := [self.starts(x) for x in v]) else {}
                every = tuple(parts)

                def in_order(at: int) -> int:
                    for f in parts:
                        at = f(at)
                        if at < 0:
                            return -1
                    return at

                def first_of(at: int) -> int:
                    nonlocal far
                    for f in by_char.get(text[at], every) if at < length else every:
                        to = f(at)
                        if to >= 0:
                            return to
                    if at > far:
                        far = at
                    return -1

                return in_order if kind == "seq" else first_of
            f, chars = build(v), self.starts(v)
            never = frozenset(map(chr, range(128))) - chars if chars is not None else frozenset()
            if kind in "*+":

                def many(at: int) -> int:
                    n = 0
                    while at < length and text[at] not in never and (to := f(at)) >= 0 and to > at:
                        at, n = to, n + 1
                    return at if n or kind == "*" else -1

                return many
            if kind == "?":
                return lambda at: at if at < length and text[at] in never else to if (to := f(at)) >= 0 else at
            if kind == "&":
                return lambda at: at if f(at) >= 0 else -1
            return lambda at: at if f(at) < 0 else -1

        for n, e in self.rules.items():
            if not n.isupper():
                compiled[n] = build(e)
        lead = token(f"(?>{self.space})")

        def parse(whole: str) -> tuple[bool, int]:
            nonlocal text, far, length
            text, far, length = whole, 0, len(whole)
            try:
                end = compiled[self.first](max(0, lead(0)))
            finally:
                for seen in memo.values():
                    seen.clear()
            ok = end == len(text)
            return ok, len(text) if ok else max(far, end)

        return parse

    @cached_property
    def slow(self) -> Grammar:
        """The same grammar without its runs in one match."""
        out = Grammar.__new__(Grammar)
        out.space, out.tight, out.ends, out.prepare, out.first = self.space, self.tight, self.ends, self.prepare, self.first
        out.rules = {n: ("bare", "(?!)") if n in ("FAST", "NUMBERS") else e for n, e in self.rules.items()}
        return out

    def check(self, text: str) -> tuple[bool, int]:
        """(accepted, furthest failure position in the text).

        Depth costs memory alone: the parser's calls live on the heap, and their number
        may grow with the text.
        """
        moved = self.prepare(Moved(text)) if self.prepare else Moved(text)
        before = sys.getrecursionlimit()
        try:
            sys.setrecursionlimit(max(before, 20_000))
            ok, far = self.packrat(moved.text)
        except RecursionError:
            sys.setrecursionlimit(max(before, 20_000 + 100 * len(moved.text)))
            ok, far = self.packrat(moved.text)
        finally:
            sys.setrecursionlimit(before)
        return ok, moved.origin(far)
