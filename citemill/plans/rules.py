"""Rules: their model, XML and JSON forms, and their compilation to patterns.

A rule has a pattern with capture groups; named patterns are macros of others: ``{{ name }}`` puts the pattern in,
``{{?: name }}`` without its groups, ``{{?= name }}`` and ``{{?! name }}`` as a look-ahead. A name is looked up for the language
first, then for the group of English, German and French, then plainly.
"""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path
from xml.etree import ElementTree

from ..functions.regex import group_count, non_capturing, to_java
from ..options import ALL, Options

log = logging.getLogger(__name__)

#: Letters that may not touch a match.
LETTERS = r"\p{L}"
BEFORE = rf"(?<![{LETTERS}0-9/])"
AFTER = rf"(?![{LETTERS}0-9/])"
HYBRID = ("EN", "DE", "FR")
MACRO_DEPTH = 30
_MACRO = re.compile(r"\{\{(\?[:=!])?\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}")


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class View:
    """A rendering of a match for a target."""

    target: str
    template: str
    condition: str = ""
    label: str = ""
    group_target: str = ""
    base_target: str = ""
    environments: tuple[str, ...] = (ALL,)
    order: int | None = None
    common: bool = False
    is_default: bool = False
    ld_condition: str = ""


@dataclass(frozen=True)
class Footnote:
    template: str
    type: str = ""


@dataclass(frozen=True)
class Rule:
    type: str = ""
    name: str = ""
    pattern: str = ""
    label: str = ""
    base_type: str = ""
    order: int | None = None
    languages: tuple[str, ...] = ()
    item_pattern: str = ""
    guard_pattern: str = ""
    skip_pattern: str = ""
    strict_pattern: str = ""
    trim_pattern: str = ""
    forced: bool = False
    converter: bool = False
    common: str = ""  # the type of a rule whose views are added
    ld_types: tuple[str, ...] = ()
    list_prefix: tuple[int, ...] = ()
    list_shared: tuple[int, ...] = ()
    list_identifiers: tuple[int, ...] = ()
    list_core: tuple[int, ...] = ()
    list_vars: tuple[int, ...] = ()
    list_skip: tuple[int, ...] = ()
    views: tuple[View, ...] = ()
    footnotes: tuple[Footnote, ...] = ()


# ---- compilation


def normalised(pattern: str) -> str:
    """Without comments (from # to the end of a line) and runs of white space."""
    return re.sub(r"\s{2,}", "", re.sub(r"(?<!\\)#[^\n]*(?:\n|$)", " ", pattern)).strip("\n")


@dataclass
class Macros:
    """Named patterns, and their expansion."""

    patterns: dict[str, str]
    language: str = "EN"
    done: dict[str, str] = field(default_factory=dict)

    def find(self, name: str) -> str:
        """The name under which a macro is stored for the language."""
        tries = [f"{name}_{self.language}", *([f"{name}_ENDEFR"] if self.language in HYBRID else []), name]
        for t in tries:
            if t in self.patterns:
                return t
        raise RuleError(f"unknown pattern {name}")

    def expand(self, pattern: str, stack: tuple[str, ...] = ()) -> str:
        if len(stack) > MACRO_DEPTH:
            raise RuleError("patterns are nested too deep: " + " > ".join(stack))

        def put(m: re.Match) -> str:
            kind, name = m[1], m[2]
            if name == "possesive_quantifier":
                return ""
            found = self.find(name)
            if found in stack:
                raise RuleError("pattern within itself: " + " > ".join([*stack, found]))
            if found not in self.done:
                self.done[found] = self.expand(normalised(self.patterns[found]), (*stack, found))
            inner = self.done[found]
            if not kind:
                return inner
            return f"({kind}{non_capturing(inner)})" if kind != "?:" else f"(?:{non_capturing(inner)})"

        return _MACRO.sub(put, pattern)


def for_language(rules: Iterable[Rule], language: str) -> list[Rule]:
    """Rules of no language or of this one; the hybrid language keeps those of its three."""
    wanted = set(HYBRID) if language == "ENDEFR" else {language}
    return [r for r in rules if not r.languages or wanted & set(r.languages)]


def ordered(rules: Iterable[Rule]) -> list[Rule]:
    """Orders times 1000, missing ones after the largest so far; views count on from their rule, default ones first; common rules
    come last."""
    out, last = [], 0
    for r in rules:
        order = r.order * 1000 if r.order is not None else (last // 1000 + 1) * 1000
        last = max(last, order)
        views = sorted(enumerate(r.views), key=lambda x: (not x[1].is_default, x[1].order if x[1].order is not None else x[0], x[0]))
        out.append(replace(r, order=order, views=tuple(replace(v, order=order + i) for i, (_, v) in enumerate(views))))
    return sorted(out, key=lambda r: (any(v.common for v in r.views), r.order))


def with_common_views(rules: list[Rule]) -> list[Rule]:
    """Views of the rule that ``common`` names are added, marked as common, on copies."""
    by_type = {r.type: r for r in rules if r.type}
    return [replace(r, views=r.views + tuple(replace(v, common=True) for v in by_type[r.common].views)) if r.common in by_type else r for r in rules]


@dataclass(frozen=True)
class Compiled:
    """A rule with all patterns expanded for the JVM."""

    rule: Rule
    pattern: str
    item: str = ""
    guard: str = ""
    skip: str = ""
    strict: str = ""
    trim: str = ""
    groups: int = 0


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Compiled, ...]
    language: str

    def added(self, *more: Rule, patterns: dict[str, str] | None = None) -> RuleSet:
        """The set with custom rules, which are compiled alone."""
        return RuleSet((*self.rules, *compile_rules(list(more), self.language, patterns).rules), self.language)

    def scannable(self, options: Options | None = None) -> RuleSet:
        """Rules that a run scans for: of the chosen types, no converters, forced ones if special rules are on, with the views
        of the chosen environments and targets; a rule without views, or with the table's alone, goes."""
        o, out = options or Options(), []
        for c in self.rules:
            r = c.rule
            if r.converter or (r.forced and not o.special_rules) or (o.types and r.type not in o.types):
                continue
            views = tuple(v for v in r.views if visible(v, o))
            if views and any(v.target != "table" for v in views):
                out.append(replace(c, rule=replace(r, views=views)))
        return RuleSet(tuple(out), self.language)

    def guards(self) -> dict[str, tuple[str, ...]]:
        """Guard pattern to the types that it stands before."""
        out: dict[str, tuple[str, ...]] = {}
        for c in self.rules:
            if c.guard:
                out[c.guard] = (*out.get(c.guard, ()), c.rule.type)
        return out


def visible(view: View, o: Options) -> bool:
    env = ALL in view.environments or ALL in o.environments or bool(o.environments & set(view.environments))
    target = o.targets is None or o.types == frozenset() or view.target in o.targets
    return env and target and not any(x in view.target for x in o.excluded_targets)


def compile_rules(rules: Iterable[Rule], language: str = "EN", patterns: dict[str, str] | None = None) -> RuleSet:
    """Macros expanded, orders set, common views added. A rule that can't be compiled is logged and left out."""
    rules = for_language(rules, language)
    macros = Macros({r.name: r.pattern for r in rules if r.name} | (patterns or {}), language)
    out = []
    for r in with_common_views(ordered(r for r in rules if r.type)):
        try:
            made = {k: to_java(macros.expand(normalised(p))) for k, p in (("pattern", r.pattern), ("item", r.item_pattern), ("guard", r.guard_pattern), ("skip", r.skip_pattern), ("strict", r.strict_pattern), ("trim", r.trim_pattern))}
            for p in made.values():
                lint(p)
            out.append(Compiled(r, **made, groups=group_count(made["pattern"])))
        except RuleError as e:
            log.warning("rule %s left out: %s", r.type, e)
    return RuleSet(tuple(out), language)


def lint(pattern: str) -> None:
    """Unbalanced groups and classes are errors; other findings are left to the engine."""
    depth, inside = 0, False
    from ..functions.regex import tokens

    for unit, inside in tokens(pattern):
        depth += 0 if inside else {"(": 1, ")": -1}.get(unit, 0)
        if depth < 0:
            break
    if depth or (inside and not pattern.endswith("]")):
        raise RuleError(f"unbalanced pattern {pattern[:60]}")


def full_pattern(c: Compiled, title_form: bool = False) -> str:
    """The rule's pattern with groups made non-capturing; title form: an optional ``[reference|title]`` around it."""
    bare = non_capturing(c.pattern)
    if not title_form:
        return bare
    plain = rf"(?:\[{bare}\]|{bare})" if not c.rule.forced else rf"\[{bare}\]"
    return rf"(?:\[{bare}\|[^\]\[|]+\]|{plain})"


# ---- forms


def _numbers(text: str | None) -> tuple[int, ...]:
    return tuple(int(x) for x in (text or "").split())


def _words(text: str | None) -> tuple[str, ...]:
    return tuple(x for x in re.split(r"[\s,]+", text or "") if x)


def rule_from_xml(node: ElementTree.Element) -> Rule:
    get, child = node.get, lambda n: (node.findtext(n) or "")
    views = tuple(
        View(v.get("target", ""), (v.text or "").strip(), v.get("condition", ""), v.get("label", ""), v.get("group-target", ""), v.get("base-target", ""), _words(v.get("environment")) or (ALL,), int(v.get("order")) if v.get("order") else None, False, v.get("default") in ("1", "true"), v.get("ld-condition", ""))
        for v in node.findall("view")
    )
    if not (child("pattern") or get("common")):
        raise RuleError("rule without a pattern")
    return Rule(
        type=get("type", ""), name=get("name", ""), pattern=child("pattern"), label=get("label", ""), base_type=get("base-type", ""), order=int(get("order")) if get("order") else None,
        languages=_words(get("lang")), item_pattern=child("item-pattern"), guard_pattern=child("guard-pattern"), skip_pattern=child("skip-pattern"), strict_pattern=child("strict-pattern"),
        trim_pattern=child("trim-pattern"), forced=get("forced") in ("1", "true"), converter=get("converter") in ("1", "true"), common=get("common", ""), ld_types=_words(get("ld")),
        list_prefix=_numbers(get("list-prefix")), list_shared=_numbers(get("list-shared")), list_identifiers=_numbers(get("list-identifiers")), list_core=_numbers(get("list-core-identifiers")),
        list_vars=_numbers(get("list-vars")), list_skip=_numbers(get("list-skip")), views=views, footnotes=tuple(Footnote((f.text or "").strip(), f.get("type", "")) for f in node.findall("footnote")),
    )


def rules_from_xml(text: str) -> list[Rule]:
    """All rules of a document; a faulty one is logged and left out."""
    out = []
    for node in ElementTree.fromstring(text).iter("rule"):
        try:
            out.append(rule_from_xml(node))
        except (RuleError, ValueError) as e:
            log.warning("rule left out: %s", e)
    return out


def load_rules(folder: str | Path) -> list[Rule]:
    """The rules of all .xml files below a folder; a faulty file is logged and left out."""
    out = []
    for path in sorted(Path(folder).rglob("*.xml")):
        try:
            out += rules_from_xml(path.read_text(encoding="utf-8"))
        except (OSError, UnicodeDecodeError, ElementTree.ParseError) as e:
            log.warning("%s left out: %s", path, e)
    return out


def save_json(rules: Iterable[Rule], path: str | Path) -> None:
    Path(path).write_text(json.dumps([asdict(r) for r in rules], ensure_ascii=False, indent=1), encoding="utf-8")


def load_json(path: str | Path) -> list[Rule]:
    out = []
    for r in json.loads(Path(path).read_text(encoding="utf-8")):
        r = {k: tuple(v) if isinstance(v, list) else v for k, v in r.items()}
        r["views"] = tuple(View(**(v | {"environments": tuple(v["environments"])})) for v in r["views"])
        r["footnotes"] = tuple(Footnote(**f) for f in r["footnotes"])
        out.append(Rule(**r))
    return out
