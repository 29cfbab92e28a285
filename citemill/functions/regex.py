"""Patterns written in the ECMAScript dialect, made ready for the JVM's engine."""

from __future__ import annotations

import re

#: White space of ECMAScript's \s, as the inside of a class.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_SPECIAL = set(".*+?^${}()|[]\\/-")


def quote(text: str) -> str:
    """A pattern for the text itself."""
    return "".join("\\" + c if c in _SPECIAL else c for c in text)


def tokens(pattern: str):
    """(text, inside a class) of each unit: an escape, or one character."""
    inside, i = False, 0
    while i < len(pattern):
        n = 2 if pattern[i] == "\\" and i + 1 < len(pattern) else 1
        unit = pattern[i : i + n]
        yield unit, inside
        if unit == "[" and not inside:
            inside = True
        elif unit == "]" and inside:
            inside = False
        i += n


def to_java(pattern: str, multiline: bool = False) -> str:
    """\\s with its ECMAScript meaning, \\v as the vertical tab, $ as the very end, "/" unescaped, [ in a class escaped."""
    out = []
    for unit, inside in tokens(pattern):
        if unit == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif unit == r"\S" and not inside:
            out.append(f"[^{SPACE}]")
        elif unit == r"\v":
            out.append(r"\x0B")
        elif unit == r"\/":
            out.append("/")
        elif unit == "$" and not inside and not multiline:
            out.append(r"\z")
        elif unit in "[&" and inside:
            out.append("\\" + unit)
        else:
            out.append(unit)
    return "".join(out)


def delimited(what: str) -> tuple[str, bool]:
    """(JVM pattern, all hits): ``/re/flags`` as given, any other text literally, with no regard to case, all hits."""
    m = re.fullmatch(r"/(.+)/([a-z]*)", what, re.S)
    if not m:
        return "(?iu)" + quote(what), True
    flags = ("iu" if "i" in m[2] else "") + ("m" if "m" in m[2] else "") + ("s" if "s" in m[2] else "")
    return (f"(?{flags})" if flags else "") + to_java(m[1], "m" in m[2]), "g" in m[2]


def non_capturing(pattern: str) -> str:
    """Plain groups made non-capturing; look-arounds, escapes and classes stay."""
    out, units = [], list(tokens(pattern))
    for i, (unit, inside) in enumerate(units):
        plain = unit == "(" and not inside and (i + 1 == len(units) or units[i + 1][0] != "?")
        out.append("(?:" if plain else unit)
    return "".join(out)


def group_count(pattern: str) -> int:
    """Capture groups of a pattern (named ones too)."""
    units, n = list(tokens(pattern)), 0
    for i, (unit, inside) in enumerate(units):
        if unit == "(" and not inside:
            rest = "".join(u for u, _ in units[i + 1 : i + 4])
            n += not rest.startswith("?") or (rest.startswith("?<") and rest[2:3] not in ("=", "!"))
    return n
