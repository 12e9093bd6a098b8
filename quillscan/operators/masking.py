"""Blanking comments, strings and pattern literals without moving a character."""

from __future__ import annotations

import re

_COMMENT = r"//[^\n]*+|/\*(?>[^*]++|\*(?!/))*+(?:\*/)?|(?:(?<=[\n ])|\A)#[^\n]*+"
_DOC = r"\"\"\"(?>[^\"]++|\"(?!\"\"))*+(?:\"\"\")?|'''(?>[^']++|'(?!''))*+(?:''')?"
_STRING = r"\"(?>[^\"\\]++|\\.)*+(?:\"|\\?\Z)|'(?>[^'\\]++|\\.)*+(?:'|\\?\Z)|`(?>[^`\\]++|\\.)*+(?:`|\\?\Z)"
_PATTERN = r"/(?>[^/\\\[]++|\\.|\[(?>[^\]\\]++|\\.)*+\]?)*+(?:/|\Z)"
_WITH = re.compile(rf"(?P<doc>{_DOC})|(?P<comment>{_COMMENT})|(?P<string>{_STRING})|(?P<pattern>{_PATTERN})", re.S)
_WITHOUT = re.compile(rf"(?P<doc>{_DOC})|(?P<comment>{_COMMENT})|(?P<string>{_STRING})", re.S)
_BLANK = re.compile(r"[^\n]")
_AFTER_WORD = re.compile(r"\b(?:return|typeof|case|instanceof|void|delete|yield|await|throw|in|of)\s*\Z", re.I)


def views(text: str, patterns: bool = True) -> tuple[str, str]:
    """``text`` with comments and doc strings blank, and the same with strings and pattern literals blank too.

    Line ends and the length stay. A ``/`` after a name, number or closing bracket
    divides, except after a keyword; without ``patterns`` it always does.
    """
    kept: list[str] = []
    code: list[str] = []
    at = 0
    rx = _WITH if patterns else _WITHOUT
    while m := rx.search(text, at):
        kind, start = m.lastgroup, m.start()
        if kind == "pattern":
            before = text[max(0, start - 40) : start].rstrip()
            if before and (before[-1].isalnum() or before[-1] in "_)]$") and not _AFTER_WORD.search(before):
                kept.append(text[at : start + 1])
                code.append(kept[-1])
                at = start + 1
                continue
        blank = _BLANK.sub(" ", m[0]) if "\n" in m[0] else " " * len(m[0])
        kept += (text[at:start], m[0] if kind == "string" else blank)
        code += (kept[-2], blank)
        at = m.end()
    kept.append(text[at:])
    code.append(text[at:])
    return "".join(kept), "".join(code)


def mask(text: str, strings: bool = True, patterns: bool = True) -> str:
    """One of the two views: with strings blank, or kept."""
    return views(text, patterns)[strings]
