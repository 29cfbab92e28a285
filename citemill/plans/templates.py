"""Templates and conditions of views, parsed to a tree and built as Columns. Nothing is evaluated as code.

``{{ $1|year|pad:'0':4 }}`` is the first capture through two converters; ``$1`` outside braces is the capture itself. Arguments
are quoted texts, numbers, lists in brackets and captures (also in parentheses, with pipes of their own). Conditions combine
pipes and texts by ``==``, ``!=``, ``<``, ``>``, ``and``, ``or``, ``not`` (or ``&&``, ``||``, ``!``). ``::`` and ``$$`` stand for
a colon and a dollar sign. Raw code in ``[[ ]]`` is refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.converters import REGISTRY, text, truthy


class TemplateError(ValueError):
    pass


_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>-?\d+)|(?P<cap>\$\d+)|(?P<var>\$[A-Za-z][\w-]*)|(?P<op>\|\||&&|==|!=|<=|>=|[|:()\[\],<>!])|(?P<name>[A-Za-z_]\w*))""")


@dataclass
class Scope:
    """What a template may refer to: captures, and attributes that earlier views rendered."""

    groups: Column
    attributes: Column | None = None

    def capture(self, n: int) -> Column:
        return text(F.get(self.groups, F.lit(n)))

    def variable(self, name: str) -> Column:
        return text(F.try_element_at(self.attributes, F.lit(name))) if self.attributes is not None else F.lit("")


class Parser:
    def __init__(self, source: str, scope: Scope) -> None:
        self.scope, self.units, at = scope, [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m or m.end() == at:
                raise TemplateError(f"can't read {source[at:at + 20]!r}")
            self.units.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.units[self.at][1] if self.at < len(self.units) else ""

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted and self.units[self.at][0] in ("op", "name"):
            self.at += 1
            return True
        return False

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected before {self.peek()!r}")

    def whole(self, rule):
        out = rule()
        if self.at != len(self.units):
            raise TemplateError(f"can't read from {self.peek()!r} on")
        return out

    # condition: any of alls; all: tests; test: pipe, compared with another or alone
    def condition(self) -> Column:
        out = self.all_of()
        while self.take("||", "or"):
            out = out | self.all_of()
        return out

    def all_of(self) -> Column:
        out = self.test()
        while self.take("&&", "and"):
            out = out & self.test()
        return out

    def test(self) -> Column:
        if self.take("!", "not"):
            return ~self.test()
        if self.peek() == "(" :
            self.need("(")
            out = self.condition()
            self.need(")")
            return out
        left = self.pipe()
        for op, build in (("==", lambda a, b: text(a) == text(b)), ("!=", lambda a, b: text(a) != text(b)), ("<=", lambda a, b: text(a).try_cast("double") <= text(b).try_cast("double")), (">=", lambda a, b: text(a).try_cast("double") >= text(b).try_cast("double")), ("<", lambda a, b: text(a).try_cast("double") < text(b).try_cast("double")), (">", lambda a, b: text(a).try_cast("double") > text(b).try_cast("double"))):
            if self.take(op):
                return F.coalesce(build(left, self.pipe()), F.lit(False))
        return truthy(left)

    def pipe(self):
        out = self.value()
        while self.take("|"):
            kind, name = self.units[self.at] if self.at < len(self.units) else ("", "")
            if kind != "name" or name not in REGISTRY:
                raise TemplateError(f"no converter {name!r}")
            self.at += 1
            args = []
            while self.take(":"):
                args.append(self.value())
            out = REGISTRY[name](out, *args)
        return out if isinstance(out, Column) else F.lit(out)

    def value(self):
        if self.at >= len(self.units):
            raise TemplateError("a value is missing")
        kind, unit = self.units[self.at]
        self.at += 1
        if kind == "str":
            return re.sub(r"\\(['\"])", r"\1", unit[1:-1])
        if kind == "num":
            return int(unit)
        if kind == "cap":
            return self.scope.capture(int(unit[1:]))
        if kind == "var":
            return self.scope.variable(unit[1:])
        if unit == "(":
            out = self.pipe()
            self.need(")")
            return out
        if unit == "[":
            out = []
            while not self.take("]"):
                out.append(self.value())
                self.take(",")
            return out
        raise TemplateError(f"a value expected, not {unit!r}")


_PART = re.compile(r"\{\{(.*?)\}\}|\$\$|::|\$(\d+)", re.S)


def template(source: str, scope: Scope) -> Column:
    """A text Column."""
    if "[[" in source and "]]" in source:
        raise TemplateError("raw code in a template")
    parts, at = [], 0
    for m in _PART.finditer(source):
        if m.start() > at:
            parts.append(F.lit(source[at : m.start()]))
        if m[1] is not None:
            p = Parser(m[1], scope)
            parts.append(text(p.whole(p.pipe)))
        elif m[2]:
            parts.append(scope.capture(int(m[2])))
        else:
            parts.append(F.lit({"$$": "$", "::": ":"}[m[0]]))
        at = m.end()
    if at < len(source) or not parts:
        parts.append(F.lit(source[at:]))
    return F.concat(*parts)


def condition(source: str, scope: Scope) -> Column:
    """A boolean Column; an empty condition holds."""
    if not source.strip():
        return F.lit(True)
    p = Parser(source, scope)
    return p.whole(p.condition)
