"""Results: mentions grouped to nodes, sorted, numbered; and the flat form with local positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ids import urls

SORTS = ("count", "position", "reference", "type", "label")


def links_of(alternatives: Column, position: Column) -> Column:
    """array<struct<position, target, href>>: the links of a mention's views, each address once."""
    each = F.flatten(F.transform(alternatives, lambda a: F.transform(urls(a["view"]), lambda h: F.struct(position.alias("position"), a["target"].alias("target"), h.alias("href")))))
    return F.filter(each, lambda x, i: ~F.exists(F.slice(each, F.lit(1), i), lambda y: y["href"] == x["href"]))


def grouped(mentions: DataFrame, key: str = "doc_id", by: str = "match", detail: bool = False) -> DataFrame:
    """One row per document and reference: count, position of the first, all positions; the urls of the last occurrence. With
    detail also ``matches``, the occurrences with contexts and views, and ``links``, the last one's urls with their targets."""
    more = []
    if detail:
        shown = F.filter("alternatives", lambda a: a["target"] != "table")
        views = F.transform(shown, lambda a: F.struct(a["target"].alias("target"), a["view"].alias("view")))
        mentions = mentions.withColumn("_match", F.struct("position", "context", "match", views.alias("views"))).withColumn("_links", links_of(shown, F.col("position")))
        more = [F.sort_array(F.collect_list("_match")).alias("matches"), F.max_by("_links", "position").alias("links")]
    return mentions.groupBy(key, F.col(by).alias("reference")).agg(
        F.count(F.lit(1)).alias("count"),
        F.min("position").alias("position"),
        F.min_by("rule_type", "position").alias("type"),
        F.min_by("rule_label", "position").alias("label"),
        F.max_by("urls", "position").alias("urls"),
        F.sort_array(F.collect_list("position")).alias("positions"),
        *more,
    )


def numbered(nodes: DataFrame, sort: str = "position.asc", key: str = "doc_id") -> DataFrame:
    """Adds number: from 1 within the document, in the order of ``field.asc`` or ``field.desc``; an unknown field keeps the order
    of discovery. Ties go by position, then reference."""
    field, _, way = sort.partition(".")
    order = [F.col("position"), F.col("reference")]
    if field in SORTS:
        order.insert(0, F.col(field).desc() if way == "desc" else F.col(field).asc())
    return nodes.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def local_positions(mentions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds local_position: 0 at a new context, or past the end of the context before; else the distance from its start."""
    w = Window.partitionBy(key).orderBy("position", "match")
    before, at = F.lag("context").over(w), F.lag("position").over(w)
    same = (before == F.col("context")) & (F.col("position") - at <= F.length("context"))
    start = F.when(~F.coalesce(same, F.lit(False)), F.col("position"))
    run = mentions.withColumn("_start", start).withColumn("_start", F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.withColumn("local_position", F.col("position") - F.col("_start")).drop("_start")


def merged(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Occurrences of two results by match: positions joined, counts added."""
    both = a.select(key, "match", "position").unionByName(b.select(key, "match", "position"))
    return both.groupBy(key, "match").agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_set("position")).alias("positions"))


def catalogue(views: DataFrame) -> DataFrame:
    """Targets, base targets and environments by rule type."""
    return views.groupBy("type").agg(*[F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in ("target", "base_target", "environment")])


#: Rollups of a rule set: name, what it is by, what it lists.
ROLLUPS = (("types", None, "type"), ("targets", None, "target"), ("environments", None, "environment"), ("type_targets", "type", "target"), ("base_type_targets", "base_type", "target"), ("type_environments", "type", "environment"), ("environment_types", "environment", "type"))


def rollups(views: DataFrame) -> DataFrame:
    """rollup, key, values of views(type, base_type, target, environment): all lists of a rule set, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rollup"), (F.col(by) if by else F.lit("")).alias("key"), F.col(what).alias("value")) for name, by, what in ROLLUPS])).alias("r")
    return views.select(each).groupBy("r.rollup", "r.key").agg(F.sort_array(F.collect_set("r.value")).alias("values"))


def view_order(target: Column, wanted: list[str], order: Column) -> Column:
    """The place in a list of targets; others after it, in their own order."""
    at = F.array_position(F.array(*[F.lit(t) for t in wanted]), target)
    return F.when(at > 0, at).otherwise(F.lit(len(wanted)) + 1 + order)


def alternatives_union(left: Column, right: Column) -> Column:
    """Alternatives of both (structs with match, type, view and order), each match, type and view once, the first one staying; sorted
    by order, those without one last."""
    both = F.concat(left, right)
    same = lambda a, b: (a["match"] == b["match"]) & (a["type"] == b["type"]) & (a["view"] == b["view"])
    first = F.filter(both, lambda x, i: ~F.exists(F.slice(both, F.lit(1), i), lambda y: same(x, y)))
    placed = F.transform(first, lambda x, i: F.struct(x["order"].isNull().alias("none"), x["order"].alias("order"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(placed), lambda p: p["x"])


def target_groups(alternatives: Column, least: int = 2) -> Column:
    """Group targets that have several alternatives, and how many: a tooltip shows these under one heading."""
    own = F.filter(F.transform(alternatives, lambda a: a["group_target"]), lambda g: F.coalesce(g, F.lit("")) != "")
    counted = F.transform(F.array_distinct(own), lambda g: F.struct(g.alias("group_target"), F.size(F.filter(own, lambda x: x == g)).alias("n")))
    return F.filter(counted, lambda c: c["n"] >= least)


def view_attributes(target: Column, base_target: Column, settings: dict[str, dict[str, dict[str, str]]]) -> Column:
    """HTML attributes that a run adds to links: settings by rule type and target. A target (its base target, where it has one) takes
    those of the first rule type that names it; null where none does."""
    by: dict[str, dict[str, str]] = {}
    for targets in settings.values():
        for name, attrs in targets.items():
            by.setdefault(name, attrs)
    name, out = F.when(F.coalesce(base_target, F.lit("")) != "", base_target).otherwise(target), F.lit(None).cast("map<string,string>")
    for known, attrs in by.items():
        out = F.when(name == known, F.create_map(*[F.lit(x) for pair in attrs.items() for x in pair]).cast("map<string,string>")).otherwise(out)
    return out


#: Kinds of identifiers that linked data is asked for, in the names that attributes have.
KINDS = ("celex", "ecli", "eli", "proc", "finlex-eli", "handoc", "cis", "consil", "oj")


def linked_ids(attrs: DataFrame, key: str = "doc_id", column: str = "attrs") -> DataFrame:
    """key and an array of the identifiers of each kind in the attribute maps of a document; an ECLI counts only for the Union's
    courts, and only where there is no CELEX identifier."""
    value = lambda kind: F.nullif(F.try_element_at(F.col(column), F.lit(kind)), F.lit(""))
    ecli = F.when(value("celex").isNull() & value("ecli").startswith("ECLI:EU"), value("ecli"))
    each = attrs.select(key, *[(ecli if kind == "ecli" else value(kind)).alias(kind) for kind in KINDS])
    return each.groupBy(key).agg(*[F.sort_array(F.collect_set(kind)).alias(kind) for kind in KINDS])
