"""Name patterns: literal, wildcard, regular expression, any.

A pattern's syntax is told from its text: `/re/` or `!re!` (with a trailing i to ignore case) is a regular expression that may
match anywhere; text with `*`, `?` or `[` is a wildcard for the whole string; anything else is a literal. Literals and wildcards
ignore case unless asked otherwise; regular expressions respect it unless marked.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NamePattern:
    """A compiled pattern: kind is any, literal, wildcard or regex; text is what to compare with or a Java expression."""

    kind: str
    text: str
    ignore_case: bool = True


def glob_to_regex(glob: str) -> str:
    """A wildcard as an expression for the whole string."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = end
        else:
            out.append(re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", c))
        i += 1
    return "".join(out)


def compile_pattern(text: str | None, ignore_case: bool = True) -> NamePattern:
    """Tell the syntax and compile. None or empty text matches everything."""
    if text is None or not text.strip():
        return NamePattern("any", "")
    text = text.strip()
    m = re.fullmatch(r"([/!])(.*)\1(i?)", text, re.S)
    if m and len(text) > 2:
        re.compile(re.sub(r"\\p\{\w+\}", "x", m[2]))  # a bad expression fails here rather than in a task
        return NamePattern("regex", m[2], bool(m[3]))
    if re.search(r"[*?\[]", text):
        return NamePattern("wildcard", glob_to_regex(text), ignore_case)
    return NamePattern("literal", text, ignore_case)


def matches(value: Column, pattern: NamePattern | str | None, ignore_case: bool = True) -> Column:
    """A predicate; equality where the pattern is a literal, so that scans can be pruned."""
    p = pattern if isinstance(pattern, NamePattern) else compile_pattern(pattern, ignore_case)
    if p.kind == "any":
        return F.lit(True)
    if p.kind == "literal":
        return F.lower(value) == p.text.lower() if p.ignore_case else value == p.text
    if p.kind == "wildcard":
        return value.rlike(f"(?s{'i' if p.ignore_case else ''})^(?:{p.text})$")
    return value.rlike(f"(?i){p.text}" if p.ignore_case else p.text)
