"""Rules kept as tables: a row for each rule, a row for each view. Filters, roll-ups and dependencies are plain DataFrame work, so a
catalogue of rules can be as large as any other table; patterns are compiled where the rows are.

rules: type, pattern[, name, order, language, ...]. views: type, target, environments (an array)[, base_type, label, base_target, common].
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import group_count, to_java
from ..operators.works import closure
from ..options import ALL, Options
from ..sources.batches import bounded
from .rules import Compiled, Macros, Rule, RuleError, full_pattern, lint, normalised

#: A reference to a named pattern.
REFERENCE = r"\{\{(?:\?[:=!])?\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}"


def compiled(rules: DataFrame, macros: dict[str, str], language: str = "EN", column: str = "pattern") -> DataFrame:
    """Adds ``compiled`` (the pattern with its named patterns put in), ``groups``, ``titled`` (with the title form around it) and
    ``error``; a faulty rule has an error and no pattern. macros: the named patterns, a dictionary of an application's own size."""
    schema = "`compiled` string, `groups` int, `titled` string, `error` string"
    names = [*rules.columns, "compiled", "groups", "titled", "error"]
    at = rules.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Macros(macros, language)
        for b in batches:
            out: list[tuple] = []
            for p in b.column(at).to_pylist():
                try:
                    pattern = to_java(known.expand(normalised(p or "")))
                    lint(pattern)
                    out.append((pattern, group_count(pattern), full_pattern(Compiled(Rule(), pattern), title_form=True), None))
                except RuleError as e:
                    out.append((None, None, None, str(e)))
            made = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=names)

    return bounded(rules).mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in rules.dtypes), schema]))


def visible(o: Options, target: str = "target", environments: str = "environments") -> Column:
    """Whether a run with these options shows a view: its environment, the chosen targets, none of the excluded ones."""
    any_env = F.array_contains(environments, ALL) | F.lit(ALL in o.environments) | F.arrays_overlap(environments, F.array(*[F.lit(e) for e in sorted(o.environments)]))
    out = any_env
    if o.targets is not None and o.types != frozenset():
        out = out & F.col(target).isin(*sorted(o.targets))
    for x in o.excluded_targets:
        out = out & ~F.contains(target, F.lit(x))
    return out


def shown(views: DataFrame, o: Options) -> DataFrame:
    """The views that a run with these options shows, of the chosen types."""
    kept = views.where(visible(o))
    return kept.where(F.col("type").isin(*sorted(o.types))) if o.types else kept


# ---- roll-ups and dependencies


def _listed(column: str) -> Column:
    return F.sort_array(F.collect_set(column))


def by_environment(views: DataFrame) -> DataFrame:
    """environment, types, targets: what each environment's views are of."""
    each = views.select("type", "target", F.explode("environments").alias("environment")).distinct()
    return each.groupBy("environment").agg(_listed("type").alias("types"), _listed("target").alias("targets"))


def by_rule(views: DataFrame) -> DataFrame:
    """type, targets: the targets of each type's views."""
    return views.select("type", "target").distinct().groupBy("type").agg(_listed("target").alias("targets"))


def by_base_type(views: DataFrame) -> DataFrame:
    """base_type (the type where there is none), types, targets without those of common views."""
    own = F.coalesce(F.nullif(F.col("base_type"), F.lit("")), F.col("type"))
    each = views.select(own.alias("base_type"), "type", F.when(~F.coalesce(F.col("common"), F.lit(False)), F.col("target")).alias("target")).distinct()
    return each.groupBy("base_type").agg(_listed("type").alias("types"), _listed("target").alias("targets"))


def references(rules: DataFrame, name: str = "name", column: str = "pattern") -> DataFrame:
    """src, dst: which rule's pattern puts in which named pattern."""
    found = F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(REFERENCE), F.lit(1)))
    return rules.select(F.col(name).alias("src"), F.explode(found).alias("dst"))


def dependencies(rules: DataFrame, name: str = "name", column: str = "pattern") -> DataFrame:
    """name, needs, steps: all named patterns that a rule's pattern needs, directly or through others, and how many references lie
    between. A pattern that needs itself is among its own."""
    found = closure(references(rules, name, column))
    return found.select(F.col("src").alias(name), F.col("dst").alias("needs"), F.col("depth").alias("steps"))


def needed_by_environment(rules: DataFrame, views: DataFrame, name: str = "name") -> DataFrame:
    """environment, name: the rules that its views are of, and all that these need."""
    used = views.select("type", F.explode("environments").alias("environment")).distinct().join(rules.select("type", name), "type").select("environment", name).distinct()
    needed = used.join(dependencies(rules, name), name).select("environment", F.col("needs").alias(name))
    return used.unionByName(needed).distinct()
