"""Identifiers and attributes of mentions: maps carried natively, names without their prefixes and suffixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .converters import text

#: Names that only keep books.
BOOKKEEPING = ("data-title", "data-uuid", "data-type")
#: Precedence of identifiers when one is picked, and when their kind is named: the two differ.
PICK = ("celex", "ecli", "oj", "eli", "proc", "consil", "finlex-eli", "handoc", "cis")
KIND = ("celex", "ecli", "eli", "proc", "finlex-eli", "handoc", "cis", "consil", "oj")
SUFFIXES = ("", *(f"-{i}" for i in range(11)))


def attributes(html) -> Column:
    """name -> value of data-* attributes; empty and "null" values go, the last of a name wins."""
    found = r'\s(data-[a-z0-9-]+)="([^"]*)"'
    names, values = (F.regexp_extract_all(text(html), F.lit(found), F.lit(i)) for i in (1, 2))
    pairs = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda p: ~p["v"].isin("", "null") & ~p["k"].isin(*BOOKKEEPING))
    return last_wins(pairs)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def last_wins(pairs: Column) -> Column:
    """A map of (k, v) structs in which later ones replace earlier ones."""
    return F.map_from_entries(_let(pairs, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.greatest(F.size(ps), F.lit(1))), lambda q: q["k"] == p["k"]))))


def first_wins(pairs: Column) -> Column:
    return F.map_from_entries(_let(pairs, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, 1, i), lambda q: q["k"] == p["k"]))))


def merged(left: Column, right: Column) -> Column:
    """The entries of two maps; of a name in both the right one's value."""
    pairs = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    return last_wins(F.concat(pairs(left), pairs(right)))


def normalised(attrs: Column) -> Column:
    """Names without data-ref- or data-."""
    return F.transform_keys(attrs, lambda k, v: F.regexp_replace(k, "^data-(?:ref-)?", ""))


def unsuffixed(attrs: Column) -> Column:
    """Names without a numeric suffix; the first of those that meet wins."""
    entries = F.transform(F.map_entries(attrs), lambda e: F.struct(F.regexp_replace(e["key"], r"-[0-9]+$", "").alias("k"), e["value"].alias("v")))
    return first_wins(entries)


def celex_ids(attrs: Column) -> Column:
    """The distinct values of celex, celex-0 to celex-10, in that order."""
    return F.array_distinct(F.array_compact(F.array(*[F.try_element_at(attrs, F.lit("celex" + s)) for s in SUFFIXES])))


def urls(html) -> Column:
    return F.regexp_extract_all(text(html), F.lit(r'href="([^"]+)"'), F.lit(1))


def _value(attrs: Column, kind: str) -> Column:
    if kind == "celex":
        return F.try_element_at(celex_ids(attrs), F.lit(1))
    v = F.try_element_at(attrs, F.lit(kind))
    return F.when(v.startswith("ECLI:EU"), v) if kind == "ecli" else v


def _allowed(kind: str, modes: set[str] | None) -> bool:
    """Handoc and cis count only where their modes are on."""
    return kind not in ("handoc", "cis") or modes is None or kind in modes


def primary_id(attrs: Column, modes: set[str] | None = None) -> Column:
    return _let(attrs, lambda a: F.coalesce(*[_value(a, k) for k in PICK if _allowed(k, modes)]))


def id_type(attrs: Column, modes: set[str] | None = None) -> Column:
    def kind(a: Column) -> Column:
        out = F.lit(None).cast("string")
        for k in reversed(KIND):
            if _allowed(k, modes):
                out = F.when(_value(a, k).isNotNull(), k).otherwise(out)
        return out

    return _let(attrs, kind)


def id_list(attrs: Column) -> Column:
    """All identifiers of all kinds, distinct."""
    return _let(attrs, lambda a: F.array_distinct(F.concat(celex_ids(a), F.array_compact(F.array(*[_value(a, k) for k in PICK[1:]])))))


def marked(attrs: Column, marks: Column) -> Column:
    """The attributes whose names stand in an array."""
    return F.map_filter(attrs, lambda k, v: F.array_contains(marks, k))


def titled(title, group) -> Column:
    """"to X" with a group: "to GROUP X"."""
    t = text(title)
    return F.when(t.startswith("to ") & (text(group) != ""), F.concat(F.lit("to "), text(group), F.substring(t, F.lit(3), F.length(t)))).otherwise(t)
