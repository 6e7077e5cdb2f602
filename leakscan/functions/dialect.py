"""Patterns of other dialects rewritten for java.util.regex. Pure functions on the driver."""

from __future__ import annotations

import re

_WORD = "A-Za-z0-9_"
BOUNDARY = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
SPACE = r"\s\xA0  -     　﻿"


def ascii_words(pattern: str) -> str:
    r"""\b between ASCII word characters and others only, and \s over Unicode spaces."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\":
            out.append({r"\b": two if in_class else BOUNDARY, r"\s": SPACE if in_class else f"[{SPACE}]", r"\S": two if in_class else f"[^{SPACE}]"}.get(two, two))
            i += 2
            continue
        if two[0] == "[" and not in_class:
            in_class = True
        elif two[0] == "]":
            in_class = False
        out.append(two[0])
        i += 1
    return "".join(out)


def rule_regex(source: str) -> str:
    r"""A rule file's pattern: an inline (?i) anywhere makes the whole pattern case-blind, named groups lose their
    names, (?s:.) takes any character, \z is a plain z, $ is the true end and a brace that counts nothing is plain."""
    blind = "(?i)" in source or "(?i:" in source
    s = source.replace("(?i)", "").replace("(?-i)", "").replace("(?-i:", "(?:").replace("(?i:", "(?:")
    s = re.sub(r"\(\?P?<[A-Za-z_]\w*>", "(", s).replace("(?s:.)", r"[\s\S]")
    out, in_class, i = [], False, 0
    while i < len(s):
        c = s[i]
        if c == "\\":
            out.append("z" if s[i : i + 2] == r"\z" else s[i : i + 2])
            i += 2
            continue
        if in_class and c == "[":
            out.append(r"\[")  # a bracket inside a class is itself
        elif c == "[":
            in_class = True
            out.append(c)
            if s[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        elif c == "]" and in_class:
            in_class = False
            out.append(c)
        elif in_class and s[i : i + 2] == "&&":
            out.append(r"\&\&")
            i += 1
        elif c == "$" and not in_class:
            out.append(r"\z")
        elif c == "{" and not in_class and not re.match(r"\{\d+(,\d*)?\}", s[i:]):
            out.append(r"\{")
        else:
            out.append(c)
        i += 1
    return ("(?iu)" if blind else "") + ascii_words("".join(out))


def groups(source: str) -> int:
    """How many capturing groups the pattern has."""
    n, in_class, i = 0, False, 0
    while i < len(source):
        c = source[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        elif c == "(" and not in_class and not re.match(r"\(\?(?!P?<[A-Za-z_])", source[i:]):
            n += 1
        i += 1
    return n


def glob_regex(glob: str) -> str:
    """** is anything, * anything but a slash; unanchored, case-blind, and ? is left a quantifier."""
    s = re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", glob)
    return "(?i)" + s.replace("**", "\0").replace("*", "[^/]*").replace("\0", ".*")


def ignore_rule(line: str) -> dict | None:
    """One line of an ignore file: pattern, negated, dir_only; None for blanks and comments."""
    s = re.sub(r"\s+\Z", "", line)
    if not s or s.startswith("#"):
        return None
    negated = s.startswith("!")
    s = s[1:] if negated else s
    dir_only = s.endswith("/")
    s = s[:-1] if dir_only else s
    if not s:
        return None
    anchored, out, i = "/" in s, [], 0
    s = s.removeprefix("/")
    while i < len(s):
        step, text = 1, re.escape(s[i])
        if s.startswith("**/", i):
            step, text = 3, "(?:.*/)?"
        elif s.startswith("**", i):
            step, text = 2, ".*"
        elif s[i] == "*":
            text = "[^/]*"
        elif s[i] == "?":
            text = "[^/]"
        elif s[i] == "\\" and i + 1 < len(s):
            step, text = 2, re.escape(s[i + 1])
        out.append(text)
        i += step
    return {"pattern": ("^" if anchored else "^(?:.*/)?") + "".join(out) + r"\z", "negated": negated, "dir_only": dir_only}
