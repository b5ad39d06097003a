"""Patterns of linear-time engines, rewritten for the JVM's regex dialect.

Group names go (Java allows no underscore in them), ``\\b`` becomes its ASCII meaning,
``.`` matches everything but a line feed, ``$`` matches only at the very end, and
case-insensitive patterns fold Unicode. Patterns that could backtrack without bound are
refused, so an imported rule can't stall an executor.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

ASCII_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_ATOM = r"(?:\\.|\[\^?\]?[^\]]*\]|[^\\()\[\]|*+?{}])"
_NESTED = re.compile(rf"\((?:\?(?::|P?<\w+>))?(?:[^()]*\|)?{_ATOM}(?:[+*]|\{{\d+,\}})(?:\|[^()]*)?\)(?:[+*]|\{{\d+,\}})")


@dataclass(frozen=True)
class Pattern:
    text: str
    groups: tuple[str, ...]  # name of each capturing group, '' if it has none

    def group(self, name: str) -> int:
        return self.groups.index(name) + 1


def nested_quantifier(pattern: str) -> bool:
    """Whether a group repeats an alternative that is one repeated atom, as ``(a+)+`` does."""
    return bool(_NESTED.search(pattern))


def to_java(pattern: str, ignore_case: bool = False) -> Pattern:
    out: list[str] = []
    names: list[str] = []
    i, in_class = 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\":
            out.append(ASCII_EDGE if two == r"\b" and not in_class else two)
            i += 2
            continue
        c = pattern[i]
        if in_class:
            out.append(r"\[" if c == "[" else c)
            in_class = c != "]"
        elif c == "[":
            in_class = True
            out.append(c)
            if pattern[i + 1 : i + 2] in ("]", "^"):
                out.append(pattern[i + 1])
                i += 1
        elif c == "(":
            m = re.match(r"\(\?P?<([A-Za-z]\w*)>", pattern[i:])
            if m:
                names.append(m[1])
                out.append("(")
                i += len(m[0])
                continue
            if two != "(?":
                names.append("")
            out.append(c)
        elif c == "$":
            out.append(r"\z")
        else:
            out.append(c)
        i += 1
    text = "".join(out)
    if text.startswith("(?i)"):
        ignore_case, text = True, text[4:]
    return Pattern(("(?diu)" if ignore_case else "(?d)") + text, tuple(names))
