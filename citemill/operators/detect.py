"""Detection: guards, the scan for all rules at once, captures, views.

The scan is one pass of one pattern with a group per rule. On the fast path it stays in the JVM: matches are put between
sentinel characters, the text is cut at these, and a fold over the pieces gives positions (code points) and rules. Rules with a
skip pattern or the title form move the cursor back, which a single replacement can't; a run with such a rule scans Arrow batches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import replace
from functools import lru_cache, reduce
from itertools import product
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.bind import let
from ..functions.converters import text
from ..options import Optimizer, Options
from ..plans.rules import AFTER, BEFORE, Compiled, RuleSet, full_pattern
from ..plans.templates import Scope, condition, template
from ..sources.batches import bounded

START, STOP, NEXT = "\x01", "\x02", "\x03"
HIT = "array<struct<position:int,match:string,rule:int>>"
#: Patterns that are compiled ahead, one for each way in which guards and probes can fall out; beyond that a text's pattern is put
#: together from its rules', and compiled anew where it differs from that of the text before.
VARIANTS = 16
#: A pattern that matches nothing.
NOTHING = "(?!)"


def _frame(bounded: bool = True) -> tuple[str, str]:
    return rf"(?iu)(?![\r\n\x0B\f]){BEFORE if bounded else ''}(?:", rf"){AFTER if bounded else ''}"


def global_pattern(patterns: list[str], bounded: bool = True) -> str:
    """Leftmost match; where several rules match, the first in the list. No match starts at a line break."""
    body = "|".join(f"({p})" for p in patterns)
    return body.join(_frame(bounded))


def clean(c) -> Column:
    """The text with the sentinels replaced by spaces, in place."""
    return F.translate(text(c), START + STOP + NEXT, "   ")


def marked(c, pattern: Column | str, k: int) -> Column:
    """The text with each match put between sentinels, cut into the groups of its k rules."""
    by = START + NEXT.join(f"${i}" for i in range(1, k + 1)) + STOP
    return F.regexp_replace(clean(c), F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(by))


def hits(c, patterns: list[str], bounded: bool = True) -> Column:
    """All matches: position from 0, text, number of the rule from 0."""
    return _hits_of(marked(c, global_pattern(patterns, bounded), len(patterns)))


def _hits_of(marked_text: Column) -> Column:
    return let(F.split(marked_text, START, -1), lambda parts: F.filter(_placed(parts), lambda h: h["match"] != ""))


def _placed(parts: Column) -> Column:
    """The hits in the pieces of a marked text, with their places."""
    start = F.struct(F.length(F.element_at(parts, 1)).cast("int").alias("at"), F.array().cast(HIT).alias("out"))

    def step(a: Column, piece: Column) -> Column:
        # one group holds the match; as many signs stand before it as rules do
        def put(head: Column) -> Column:
            match, rule = F.trim(head, F.lit(NEXT)), F.length(head) - F.length(F.ltrim(head, F.lit(NEXT)))
            hit = F.struct(a["at"].alias("position"), match.alias("match"), rule.alias("rule"))
            # the sentinel between match and rest isn't part of the text, nor those between groups
            width = F.length(match) + F.length(piece) - F.length(head) - 1
            return F.struct((a["at"] + width).cast("int").alias("at"), F.concat(a["out"], F.array(hit)).alias("out"))

        return let(F.substring_index(piece, STOP, 1), put)

    return F.aggregate(F.slice(parts, 2, F.size(parts)), start, step, lambda a: a["out"])


def guard_columns(rules: RuleSet) -> dict[str, Column]:
    """Types behind a guard, joined, to whether the guard occurs (at the end of a word)."""
    return {",".join(types): (lambda c, p=guard: _occurs(c, p)) for guard, types in rules.guards().items()}  # type: ignore[misc]


def guarded(df: DataFrame, rules: RuleSet, column: str = "text") -> DataFrame:
    """Adds ``open_types``: the types whose guard occurs, and those without a guard."""
    free = [c.rule.type for c in rules.rules if not c.guard]
    parts = [F.array(*[F.lit(t) for t in free]) if free else F.array().cast("array<string>")]
    for types, test in guard_columns(rules).items():
        listed = F.array(*[F.lit(t) for t in types.split(",")])
        parts.append(F.when(test(F.col(column)), listed).otherwise(F.array().cast("array<string>")))
    return df.withColumn("open_types", F.concat(*parts))


class Narrowing:
    """What guards and probes leave of the rules for each text.

    A guard that doesn't occur in a text closes the rules of its types there; of each group of optimizers the first whose probe
    doesn't occur rewrites the patterns. A text's variant is an array: 0 or 1 for each guard (open), a choice for each group.
    """

    def __init__(self, rules: RuleSet, optimizers: tuple[tuple[Optimizer, ...], ...] = (), guards: bool = True) -> None:
        self.rules = rules.rules
        self.guards = [(guard, frozenset(types)) for guard, types in rules.guards().items()] if guards else []
        self.groups = [g for g in optimizers if any(o.search in c.pattern for o in g for c in self.rules)]
        self.sizes = [2] * len(self.guards) + [len(g) + 1 for g in self.groups]
        self.count = math.prod(self.sizes)

    def variant(self, c: Column) -> Column:
        """The text's variant."""
        digits = [F.when(_occurs(c, guard), 1).otherwise(0) for guard, _ in self.guards]
        for group in self.groups:
            digit = F.lit(0)
            for i, o in reversed(list(enumerate(group, 1))):
                digit = F.when(~text(c).rlike(f"(?iu){o.probe}"), i).otherwise(digit)
            digits.append(digit)
        return F.array(*digits).cast("array<int>")

    def rewritten(self, pattern: str, choices: list[int]) -> str:
        for group, choice in zip(self.groups, choices, strict=True):
            if choice:
                pattern = pattern.replace(group[choice - 1].search, group[choice - 1].replacement)
        return pattern

    def left(self, digits: Sequence[int]) -> dict[int, Compiled]:
        """The rules that are open, by their number, with the patterns of the variant."""
        closed = frozenset().union(*[types for (_, types), digit in zip(self.guards, digits, strict=False) if not digit])
        choices = list(digits[len(self.guards) :])
        return {k: replace(c, pattern=self.rewritten(c.pattern, choices)) for k, c in enumerate(self.rules) if c.rule.type not in closed}

    def marked(self, c: Column, variant: Column) -> Column:
        """The text with the matches of the rules that are open for it between sentinels."""
        k = len(self.rules)
        if self.count <= VARIANTS:
            out = None
            for digits in product(*map(range, self.sizes)):
                left = self.left(digits)
                one = marked(c, global_pattern([full_pattern(left[i]) if i in left else NOTHING for i in range(k)]), k) if left else clean(c)
                same = reduce(and_, [self._digit(variant, i) == d for i, d in enumerate(digits)], F.lit(True))
                out = one if self.count == 1 else F.when(same, one) if out is None else out.when(same, one)
            return out
        start, end = _frame()
        return F.when(self._any_open(variant), marked(c, F.concat(F.lit(start), F.concat_ws("|", *[self._part(i, variant) for i in range(k)]), F.lit(end)), k)).otherwise(clean(c))

    def _digit(self, variant: Column, place: int) -> Column:
        return F.get(variant, F.lit(place))

    def _open(self, variant: Column, i: int) -> Column:
        out = F.lit(True)
        for place, (_, types) in enumerate(self.guards):
            if self.rules[i].rule.type in types:
                out = out & (self._digit(variant, place) == 1)
        return out

    def _any_open(self, variant: Column) -> Column:
        return reduce(or_, [self._open(variant, i) for i in range(len(self.rules))])

    def _part(self, i: int, variant: Column) -> Column:
        """The rule's part of the text's pattern: as many literals as the optimizers that touch it have choices."""
        c, out = self.rules[i], None
        touching = [g for g, group in enumerate(self.groups) if any(o.search in c.pattern for o in group)]
        for chosen in product(*[range(len(self.groups[g]) + 1) for g in touching]):
            choices = [0] * len(self.groups)
            same = F.lit(True)
            for g, digit in zip(touching, chosen, strict=True):
                choices[g] = digit
                same = same & (self._digit(variant, len(self.guards) + g) == digit)
            one = F.lit(f"({full_pattern(replace(c, pattern=self.rewritten(c.pattern, choices)))})")
            out = one if not touching else F.when(same, one) if out is None else out.when(same, one)
        return F.when(self._open(variant, i), out).otherwise(f"({NOTHING})")


@lru_cache(maxsize=1024)
def _probe(pattern: str):
    import regex

    return regex.compile(pattern.replace(r"\z", r"\Z"), regex.IGNORECASE)


def python_variant(narrowed: Narrowing, value: str) -> tuple[int, ...]:
    """`Narrowing.variant` of a text that is at hand in Python."""
    digits = [int(_probe(rf"(?:{guard})(?![\p{{L}}])").search(value) is not None) for guard, _ in narrowed.guards]
    for group in narrowed.groups:
        digits.append(next((i for i, o in enumerate(group, 1) if not _probe(o.probe).search(value)), 0))
    return tuple(digits)


def _occurs(c: Column, guard: str) -> Column:
    return text(c).rlike(rf"(?iu)(?:{guard})(?![\p{{L}}])")


def needs_cursor(rules: RuleSet, title_form: bool) -> bool:
    return title_form or any(c.skip for c in rules.rules)


@lru_cache(maxsize=64)
def _patterns(rules: tuple[Compiled, ...], title_form: bool) -> tuple:
    """The pattern of all rules, and each rule's own ones by name; compiled once per worker, not once per text."""
    import regex

    def compiled(pattern: str):
        return regex.compile(pattern.replace(r"\z", r"\Z").replace("(?iu)", "(?i)"))

    parts = [full_pattern(c, title_form and bool(c.rule.views)) for c in rules]
    return compiled(global_pattern(parts)), [{k: compiled("(?iu)" + p) for k in ("pattern", "trim", "skip", "strict") if (p := getattr(c, k))} for c in rules]


def scan_text(value: str, rules: Sequence[Compiled], strict: frozenset[str] = frozenset(), title_form: bool = False, limit: int = 255) -> list[tuple[int, str, int, str]]:
    """(position, match, rule, title) by a cursor: after each candidate trim, skip (back to one past its start), strict, title."""
    pattern, own = _patterns(tuple(rules), title_form)
    out, at = [], 0
    while m := pattern.search(value, at):
        if m.end() == m.start():
            at = m.end() + 1
            continue
        k = m.lastindex - 1
        match, title, at = m[0], "", m.end()
        if title_form and match.startswith("["):
            inner = match[1:-1]
            reference, _, title = inner.partition("|")
            if len(reference) > limit or len(title) > limit or (title and own[k]["pattern"].fullmatch(reference) is None):
                at = m.start() + 1
                continue
            match = reference
        if "trim" in own[k]:
            match = own[k]["trim"].sub("", match, count=1)
        if "skip" in own[k] and own[k]["skip"].search(match):
            at = m.start() + 1
            continue
        types = {rules[k].rule.type, rules[k].rule.base_type}
        if "strict" in own[k] and types & strict and not own[k]["strict"].search(match):
            continue
        out.append((m.start(), match, k, title))
    return out


def scan(df: DataFrame, rules: RuleSet, column: str = "text", options: Options | None = None, title_form: bool = False, cursor: bool | None = None) -> DataFrame:
    """The columns of df without the text, and position, match, rule (number in the set), title; one row per match.

    A text is scanned for the rules whose guards it passes, and dropped where there are none.
    """
    o = options or Options()
    chosen = rules.scannable(o)
    keep = [c for c in df.columns if c != column]
    if not chosen.rules:
        return df.select(*keep, F.lit(0).alias("position"), F.lit("").alias("match"), F.lit(0).alias("rule"), F.lit("").alias("title")).where("false")
    alone = len(chosen.guards()) == 1 and all(c.guard for c in chosen.rules)  # one guard before all: texts go or stay as a whole
    if alone:
        df = df.where(_occurs(F.col(column), chosen.rules[0].guard))
    narrowed = Narrowing(chosen, o.optimizers, guards=not alone)
    if cursor:
        return _cursor_scan(df, narrowed, column, keep, o, title_form)
    if cursor is None and needs_cursor(chosen, title_form):
        moved = cursor_moves(chosen, F.col(column), title_form)
        return _plain_scan(df.where(~moved), narrowed, column, keep, o).unionByName(_cursor_scan(df.where(moved), narrowed, column, keep, o, title_form))
    return _plain_scan(df, narrowed, column, keep, o)


def cursor_moves(rules: RuleSet, c: Column, title_form: bool) -> Column:
    """Whether a text can hold a candidate that moves the cursor back: one of a rule with a skip pattern, or a bracket where the
    title form is on (forced rules need one there). All other texts give the same by the plain scan."""
    parts = [full_pattern(r) for r in rules.rules if r.skip]
    if title_form and any(r.rule.forced for r in rules.rules):
        return F.lit(True)
    out = F.contains(text(c), F.lit("[")) if title_form else F.lit(False)
    return out | clean(c).rlike(global_pattern(parts)) if parts else out


def _plain_scan(df: DataFrame, narrowed: Narrowing, column: str, keep: list[str], o: Options) -> DataFrame:
    own = [*df.columns, "variant"]
    while own[-1].lower() in {c.lower() for c in df.columns}:
        own[-1] = "_" + own[-1]
    dealt = df.withColumn(own[-1], narrowed.variant(F.col(column))) if narrowed.count > 1 else df
    found = dealt.select(*keep, F.explode(_hits_of(narrowed.marked(F.col(column), F.col(own[-1]) if narrowed.count > 1 else F.lit(0)))).alias("_hit"))
    out = found.select(*keep, "_hit.position", "_hit.match", "_hit.rule", F.lit("").alias("title"))
    for k, c in enumerate(narrowed.rules):
        if c.trim:
            first = F.regexp_replace("match", rf"(?iu)\A((?s:.*?))(?:{c.trim})", "$1")
            out = out.withColumn("match", F.when(F.col("rule") == k, first).otherwise(F.col("match")))
        if c.strict and {c.rule.type, c.rule.base_type} & o.strict:
            out = out.where((F.col("rule") != k) | F.col("match").rlike(f"(?iu){c.strict}"))
    return out


def _cursor_scan(df: DataFrame, narrowed: Narrowing, column: str, keep: list[str], o: Options, title_form: bool) -> DataFrame:
    strict, limit = o.strict, o.reference_limit
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", position int, match string, rule int, title string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict[tuple[int, ...], tuple[list[int], tuple[Compiled, ...]]] = {}  # of each variant that occurs here
        for b in batches:
            row, found = [], []
            for i, (t, v) in enumerate(zip(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist(), strict=True)):
                if (key := tuple(v)) not in left:
                    open_ = narrowed.left(key)
                    left[key] = (list(open_), tuple(open_.values()))
                numbers, rules = left[key]
                got = [(p, m, numbers[k], title) for p, m, k, title in scan_text(t or "", rules, strict, title_form, limit)] if rules else []
                found += got
                row += [i] * len(got)
            taken = [b.column(j).take(pa.array(row, pa.int64())) for j in range(len(keep))]
            made = [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(taken + made, names=[*keep, "position", "match", "rule", "title"])

    return bounded(df.select(*keep, column, narrowed.variant(F.col(column)).alias("_variant"))).mapInArrow(run, schema)


def captures(match: Column, pattern: str, groups: int) -> Column:
    """[whole, $1, ...]: null where a group took no part. Several groups are had by one replacement of the whole text by them, but for
    a text that holds the sign between them."""
    p = f"(?iu){pattern}"
    each = lambda of: F.array(match, *[F.nullif(of(i), F.lit("")) for i in range(1, groups + 1)])
    by_one = each(lambda i: F.regexp_extract(match, p, i))
    if groups < 2:
        return by_one
    listed = F.regexp_replace(match, rf"(?iu)\A(?s:.*?)(?:{pattern})(?s:.*)\z", "".join(f"{NEXT}${i}" for i in range(1, groups + 1)))
    return F.when(F.contains(match, F.lit(NEXT)), by_one).otherwise(let(F.split(listed, NEXT, -1), lambda parts: each(lambda i: F.get(parts, F.lit(i)))))


#: A template that names an attribute of an earlier view.
NAMED = re.compile(r"\$[A-Za-z]")


def all_captures(rules: RuleSet, rule: Column, match: Column, asked: bool = False) -> Column:
    """The captures of a match by its own rule; with asked, of those rules alone whose conditions must be asked whether they show a view."""
    out = F.array().cast("array<string>")
    for k, c in reversed(list(enumerate(rules.rules))):
        if asked and _sure(c):
            continue
        out = F.when(rule == k, captures(match, c.pattern, c.groups)).otherwise(out)
    return out


def rendered(rules: RuleSet, rule: Column, groups: Column, attrs: bool = True) -> Column:
    """The alternatives of a match: its rule's views, in order, whose conditions hold and whose text isn't empty. Attributes that
    a view renders can be named by those after it. Without attrs the field of that name is left out.

    All views of all rules are one expression. It is evaluated as the body of a lambda function, outside the generated code of the
    stage, which would grow beyond what the JVM compiles and take the whole stage with it."""
    one = F.transform(F.array(F.struct(rule.alias("rule"), groups.alias("groups"))), lambda x: _rendered(rules, x["rule"], x["groups"], attrs))
    return F.element_at(one, 1)


def _rendered(rules: RuleSet, rule: Column, groups: Column, attrs: bool) -> Column:
    out = F.array().cast("array<struct<target:string,base_target:string,order:int,common:boolean,group_target:string,title:string,view:string>>")
    for k, c in reversed(list(enumerate(rules.rules))):
        before, views = F.lit(""), []
        for v in c.rule.views:
            named = NAMED.search(v.template + v.condition)
            scope = Scope(groups, ids.normalised(ids.attributes(before)) if named else None)
            view = F.when(condition(v.condition, scope), template(v.template, scope)).otherwise("")
            views.append(F.struct(F.lit(v.target).alias("target"), F.lit(v.base_target).alias("base_target"), F.lit(v.order).cast("int").alias("order"), F.lit(v.common).alias("common"), F.lit(v.group_target).alias("group_target"), ids.titled(F.lit(v.label), F.lit(v.group_target)).alias("title"), view.alias("view")))
            before = F.concat(before, F.lit(" "), view)
        if views:
            out = F.when(rule == k, F.array(*views)).otherwise(out)
    shown = F.filter(out, lambda x: x["view"] != "")
    return F.transform(shown, lambda x: x.withField("attrs", ids.attributes(x["view"]))) if attrs else shown


def any_view(rules: RuleSet, rule: Column, groups: Column) -> Column:
    """Whether some view of the match is shown and not empty; evaluated as ``rendered`` is, with the captures made once."""
    one = F.transform(F.array(F.struct(rule.alias("rule"), groups.alias("groups"))), lambda x: _any_view(rules, x["rule"], x["groups"]))
    return F.element_at(one, 1)


def _sure(c: Compiled) -> bool:
    """Whether some view of the rule is shown whatever the match is."""
    return any(not v.condition and re.sub(r"\{\{.*?\}\}|\$\d+", "", v.template, flags=re.S).strip() for v in c.rule.views)


def _any_view(rules: RuleSet, rule: Column, groups: Column) -> Column:
    out = F.lit(True)
    for k, c in enumerate(rules.rules):
        if not _sure(c):
            shown = F.lit(False)
            for v in c.rule.views:
                scope = Scope(groups, ids.normalised(ids.attributes(F.lit(""))))
                shown = shown | (condition(v.condition, scope) & (template(v.template, scope) != ""))
            out = F.when(rule == k, shown).otherwise(out)
    return out


def mentions(df: DataFrame, rules: RuleSet, key: str = "doc_id", column: str = "text", options: Options | None = None, title_form: bool = False, attrs: bool = True) -> DataFrame:
    """key, seq, rule_type, base_type, rule_label, match, context, position, alternatives; matches without any view are dropped.
    attrs: whether the alternatives carry their attributes, which cost more than their views."""
    o = options or Options()
    chosen = rules.scannable(o)
    found = scan(df.select(key, column), rules, column, o, title_form)
    label = lambda name: F.element_at(F.array(*[F.lit(getattr(c.rule, name)) for c in chosen.rules]), F.col("rule") + 1)
    # asked of the conditions, not of what is rendered: a filter on that would render everything twice
    shown = found if all(map(_sure, chosen.rules)) else found.where(any_view(chosen, F.col("rule"), all_captures(chosen, F.col("rule"), F.col("match"), asked=True)))
    out = shown.withColumn("groups", all_captures(chosen, F.col("rule"), F.col("match"))).withColumn("alternatives", rendered(chosen, F.col("rule"), F.col("groups"), attrs))
    return out.select(key, label("type").alias("rule_type"), label("base_type").alias("base_type"), label("label").alias("rule_label"), F.when(F.col("title") != "", F.col("title")).otherwise(F.col("match")).alias("match"), F.col("match").alias("context"), "position", "alternatives")


def has_visible(alternatives: Column) -> Column:
    """Some alternative is for another target than the table."""
    return F.exists(alternatives, lambda a: a["target"] != "table")


def within_limit(reference: Column, title: Column, o: Options) -> Column:
    """The text shown: the title, or the reference where the title is too long."""
    return F.when((title != "") & (F.length(title) <= o.title_limit), title).otherwise(reference)
