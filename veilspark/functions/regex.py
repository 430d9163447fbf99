"""Regular expressions with Unicode classes, as Spark literals.

Rule packs are written in the dialect most people know (Unicode ``\\w \\d \\s``,
``$`` only before ``\\n``).  Java's defaults differ, so every pattern goes through
:func:`java_pattern` once, on the driver, and reaches Spark as a literal.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# U: Unicode classes and case folding, d: only \n ends a line.
UNICODE_FLAGS = "(?Ud)"

# Java leaves \x1c-\x1f out of \s; \w there holds marks and lacks No/Nl.
_CLASSES = {
    "s": r"\s\x1c-\x1f",
    "w": r"\p{L}\p{N}_",
}


@lru_cache(maxsize=None)
def java_body(pattern: str) -> str:
    """*pattern* with ``\\s`` and ``\\w`` spelled out, without flags."""
    out, i, in_class = [], 0, False
    ignores_case = pattern.startswith("(?i")
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt in _CLASSES:
                body = _CLASSES[nxt]
                out.append(body if in_class else f"[{body}]")
            elif nxt in "SW" and not in_class:
                out.append(f"[^{_CLASSES[nxt.lower()]}]")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and in_class:
            out.append("\\[")  # a bare [ inside a class would nest in Java
            i += 1
            continue
        if ch == "[":
            in_class = True
            out.append(ch)
            i += 1
            # ] right after the opening is a literal
            if i < len(pattern) and pattern[i] == "^":
                out.append("^")
                i += 1
            if i < len(pattern) and pattern[i] == "]":
                out.append("\\]")
                i += 1
            continue
        if in_class and ignores_case and pattern[i : i + 3] == "A-Z":
            # Java folds to lower case but would only look among capitals.
            out.append("A-Za-z")
            i += 3
            continue
        if ch == "&" and in_class and pattern[i : i + 2] == "&&":
            out.append("\\&\\&")  # && intersects classes in Java
            i += 2
            continue
        if ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def java_pattern(pattern: str) -> str:
    return UNICODE_FLAGS + java_body(pattern)


def found(subject: Column, pattern: str) -> Column:
    """True where *pattern* occurs anywhere in *subject*."""
    return subject.rlike(java_pattern(pattern))


def group_layout(pattern: str, group: int) -> tuple[str, str]:
    """Where capture *group* sits in a match, and the pattern that tells.

    Returns ``("whole"|"head"|"tail"|"middle", pattern)``.  For ``middle`` the
    returned pattern has the text before the group captured as group 1, so that
    the value's offset is the length of that capture and the value itself is
    ``group + 1``.  A group inside another group, or beside a top-level ``|``,
    has no such layout and raises ``ValueError``.
    """
    if group == 0:
        return "whole", pattern
    depth, seen, i, in_class = 0, 0, 0, False
    opened = closed = None
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            if not in_class and i + 1 < len(pattern) and pattern[i + 1].isdigit() and pattern[i + 1] != "0":
                raise ValueError("back-references are not supported beside a value group")
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
            if pattern[i + 1 : i + 2] == "^":
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                i += 1
        elif ch == "(":
            capturing = pattern[i + 1 : i + 2] != "?" or pattern[i + 1 : i + 4] == "?P<"
            if capturing:
                seen += 1
                if seen == group:
                    if depth:
                        raise ValueError("the value group must not sit inside another group")
                    opened = i
            if not _is_flag_group(pattern, i):
                depth += 1
        elif ch == ")" and not _closes_flag_group(pattern, i):
            depth -= 1
            if opened is not None and closed is None and depth == 0:
                closed = i
        elif ch == "|" and depth == 0:
            raise ValueError("a value group cannot sit beside a top-level alternative")
        i += 1
    if opened is None or closed is None:
        raise ValueError(f"the pattern has no group {group}")
    flags_end = 0
    if _is_flag_group(pattern, 0):
        flags_end = pattern.index(")") + 1
    before, after = pattern[flags_end:opened], pattern[closed + 1 :]
    if not after:
        return "tail", pattern
    if after[:1] in "?*{+":
        raise ValueError("the value group must not repeat")
    if not before or before == "^":
        return "head", pattern
    if before == r"\b":
        return "head", pattern
    return "middle", f"{pattern[:flags_end]}({before}){pattern[opened:]}"


def _is_flag_group(pattern: str, i: int) -> bool:
    if pattern[i : i + 2] != "(?":
        return False
    j = i + 2
    while j < len(pattern) and pattern[j].isalpha():
        j += 1
    return j > i + 2 and pattern[j : j + 1] == ")"


def _closes_flag_group(pattern: str, i: int) -> bool:
    start = pattern.rfind("(?", 0, i)
    return start >= 0 and _is_flag_group(pattern, start) and pattern.index(")", start) == i
