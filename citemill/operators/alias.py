"""Aliases: texts that stand for a reference are replaced before detection; matches get their own text and place back after it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.converters import text
from ..functions.regex import delimited, quote
from ..options import Alias, Aliases
from ..plans.rules import AFTER, BEFORE, RuleSet
from .detect import clean, hits, mentions


def tolerant(alias: str) -> str:
    """A pattern for an alias: any space, & or &amp;, any apostrophe."""
    out = quote(alias)
    for plain, pattern in ((" ", "[\\s\\u00A0\\u2002\\u2003\\u2009]+"), ("&", "&(?:amp;)?"), ("'", "['\\u2018\\u2019\\u02BC]")):
        out = out.replace(plain, pattern)
    return out


def _sorted(aliases: Aliases) -> list[Alias]:
    return sorted(aliases.active, key=lambda a: (-len(a.alias), a.alias))


def found(c, aliases: Aliases) -> Column:
    """Hits of the aliases, the longest first at each place; rule is the number in that order."""
    parts = [re.sub(r"\((?!\?)", "(?:", _body(a)) if a.is_regex else tolerant(a.alias) for a in _sorted(aliases)]
    return hits(c, parts)


def replaced(c, aliases: Aliases) -> Column:
    """The text with every alias replaced; a pattern's groups may stand in its replacement as {{ $n }}."""
    out = clean(c)
    plain = [a for a in _sorted(aliases) if not a.is_regex]
    if plain:
        known = F.create_map(*[F.lit(x) for a in plain for x in (_folded(a.alias), a.replacement)])
        pattern = f"(?iu){BEFORE}(?:{'|'.join(tolerant(a.alias) for a in plain)}){AFTER}"
        marked = F.split(F.regexp_replace(out, f"({pattern})", "\x01\x02$1\x01"), "\x01", -1)
        done = F.transform(marked, lambda p: F.when(p.startswith("\x02"), F.coalesce(F.try_element_at(known, folded(F.substring(p, F.lit(2), F.length(p)))), F.substring(p, F.lit(2), F.length(p)))).otherwise(p))
        out = F.array_join(done, "")
    for a in _sorted(aliases):
        if a.is_regex:
            out = F.regexp_replace(out, f"(?iu){BEFORE}(?:{_body(a)}){AFTER}", _by(a))
    return out


def _body(a: Alias) -> str:
    return delimited(a.alias)[0].replace("(?iu)", "")


def _by(a: Alias) -> str:
    """A pattern's replacement, its {{ $n }} as the engine writes them."""
    return re.sub(r"\{\{\s*\$(\d+)\s*\}\}", r"$\1", a.replacement)


def _rendered(aliases: list[Alias], rule: Column, source: Column) -> Column:
    """What a hit is replaced by."""
    out = F.element_at(F.array(*[F.lit(a.replacement) for a in aliases]), rule + 1)
    for k, a in enumerate(aliases):
        if a.is_regex:
            out = F.when(rule == k, F.regexp_replace(source, f"(?iu){_body(a)}", _by(a))).otherwise(out)
    return out


def _folded(alias: str) -> str:
    return re.sub(r"[\s ]+", " ", alias.replace("&amp;", "&").replace("’", "'").replace("‘", "'")).lower()


def folded(c: Column) -> Column:
    plain = F.translate(F.replace(c, F.lit("&amp;"), F.lit("&")), "’‘ʼ", "'''")
    return F.lower(F.regexp_replace(plain, "[\\s\\u00A0\\u2002\\u2003\\u2009]+", " "))


def offsets(df: DataFrame, aliases: Aliases, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, position in the text, source, replacement, delta (of lengths), replaced_position (in the text that results)."""
    ordered = _sorted(aliases)
    by = _rendered(ordered, F.col("h.rule"), F.col("h.match"))
    each = df.select(key, F.explode(found(F.col(column), aliases)).alias("h")).select(key, "h.position", F.col("h.match").alias("source"), by.alias("replacement"))
    delta = each.withColumn("delta", F.length("source") - F.length("replacement"))
    before = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return delta.withColumn("replaced_position", F.col("position") - F.coalesce(F.sum("delta").over(before), F.lit(0)))


def difference(source, replacement) -> Column:
    """Both without their common prefix; without a difference in the shorter length nothing is cut."""
    a, b = text(source), text(replacement)
    short = F.least(F.length(a), F.length(b))
    at = F.filter(F.sequence(F.lit(1), F.greatest(short, F.lit(1))), lambda i: (i <= short) & (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    cut = F.coalesce(F.array_min(at), F.lit(1))
    return F.struct(F.substring(a, cut, F.length(a)).alias("source"), F.substring(b, cut, F.length(b)).alias("replacement"))


def restored(found: DataFrame, moved: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mentions found in a replaced text, put back into the original one.

    A mention whose context holds a replaced alias gets the alias' own text; the first such alias counts. All positions shift by
    the differences of the aliases before. Aliases of a document are folded into one array, so the join is on the key alone.
    """
    per = moved.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("replaced_position", "position", "source", "replacement", "delta"))).alias("_a"))
    both = found.join(per, key, "left").withColumn("_a", F.coalesce("_a", F.array().cast("array<struct<replaced_position:int,position:int,source:string,replacement:string,delta:int>>")))
    start = F.col("position") - F.greatest(F.instr(F.col("context"), F.col("match")) - 1, F.lit(0))
    inside = F.filter("_a", lambda x: (x["replaced_position"] >= start) & (x["replaced_position"] < start + F.length("context")))
    shift = F.aggregate(F.filter("_a", lambda x: x["replaced_position"] < F.col("position")), F.lit(0), lambda s, x: (s + x["delta"]).cast("int"))
    out = both.withColumn("alias", F.get(inside, F.lit(0))).withColumn("position", (F.col("position") + shift).cast("int"))
    for c in ("match", "context"):
        out = out.withColumn(c, F.when(F.col("alias").isNotNull(), F.replace(F.col(c), F.col("alias.replacement"), F.col("alias.source"))).otherwise(F.col(c)))
    return out.drop("_a")


def from_works(works: DataFrame, titles: DataFrame, language: str) -> DataFrame:
    """Alias table of a catalogue: the short title in the language, else the identifier; one row per label, its greatest id."""
    named = works.join(titles.where(F.col("lang") == language), "celex", "left").select(F.coalesce("title", "celex").alias("label"), "celex")
    return named.where(~F.col("label").rlike("^[0-9]+\\z")).groupBy("label").agg(F.max("celex").alias("celex"))


def short_titles(titles: DataFrame, rules: RuleSet, within: int = 30, key: str = "celex", column: str = "title") -> DataFrame:
    """The first reference in each full title, if it begins within its first characters."""
    links = mentions(titles, rules, key, column).where(F.col("position") < within)
    return links.groupBy(key).agg(F.min_by("match", "position").alias("title"))


def layered(shared: DataFrame, local: DataFrame) -> DataFrame:
    """Alias tables united; a shared row replaces a local one of the same alias."""
    both = shared.withColumn("priority", F.lit(0)).unionByName(local.withColumn("priority", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy("alias").orderBy("priority", "replacement"))).where("_n = 1").drop("_n")
