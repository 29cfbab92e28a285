"""Placeholders in views and the existence of their targets.

A resolver takes mentions that carry a marker, joins them with the works that could be meant, picks the best and puts its value in
the marker's place. Which row is the best is said by ``order``: the rows' own sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.converters import text
from ..functions.helpers import filled

SUB_NUMBERS = ("(01)", "(02)", "(03)")
INVALID = "INVALID"


def spaces(c) -> Column:
    """No-break spaces as plain ones."""
    return F.translate(text(c), "\u00a0\u202f", "  ")


def has_token(title, value) -> Column:
    return F.array_contains(F.split(spaces(title), " "), text(value))


def candidates(celex: Column, year: Column) -> Column:
    """Identifiers that an act's own may stand for: itself, its sub-numbers, and D as S before 2003."""
    own = [celex, *[F.concat(celex, F.lit(s)) for s in SUB_NUMBERS]]
    swapped = F.regexp_replace(celex, "^(3[0-9]{4})D", "$1S")
    return F.when(year < 2003, F.array(*own, swapped)).otherwise(F.array(*own))


def token_of(c) -> Column:
    """The first n/n in a text."""
    return F.regexp_extract(spaces(c), r"([0-9]+/[0-9]+)", 1)


def best(pairs: DataFrame, keys: list[str], fits: Column | None, order: Column, last: bool = True) -> DataFrame:
    """One row per key: among those that fit the last (or first) by order; if none fits the first by order."""
    fit = F.lit(True) if fits is None else F.coalesce(fits, F.lit(False))
    rank = F.when(fit, 0).otherwise(1)
    inner = F.when(fit, order if not last else -order).otherwise(order)
    w = Window.partitionBy(*keys).orderBy(rank, inner)
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def substituted(mentions: DataFrame, values: DataFrame, name: str, on: list[str], value: str = "value", column: str = "view", empty: str | None = None) -> DataFrame:
    """The marker ``name`` in a column filled with the value looked up, its default where there is none."""
    got = mentions.join(values.select(*on, F.col(value).alias("_v")), on, "left")
    v = F.col("_v") if empty is None else F.coalesce("_v", F.lit(empty))
    return got.withColumn(column, filled(F.col(column), name, v)).drop("_v")


def act_numbers(mentions: DataFrame, works: DataFrame) -> DataFrame:
    """celex of mentions(key, celex, year, context) by titles of works(celex, title, seq): the last whose first n/n is that of the
    context, else the first by seq."""
    wide = mentions.withColumn("_c", F.explode(candidates(F.col("celex"), F.col("year")))).join(works.select(F.col("celex").alias("_c"), F.col("title").alias("_title"), F.col("seq").alias("_seq")), "_c")
    chosen = best(wide, ["key"], token_of(F.col("_title")) == token_of(F.col("context")), F.col("_seq"))
    return chosen.select("key", F.col("_c").alias("value"))


def legacy_acts(mentions: DataFrame, works: DataFrame) -> DataFrame:
    """Acts before 1962, by author, number and type; the last of several."""
    return best(mentions.join(works, ["author", "number", "type"]), ["key"], None, F.col("seq")).select("key", F.col("eli").alias("value"))


def by_title_token(mentions: DataFrame, works: DataFrame, value: str) -> DataFrame:
    """Decisions of committees: the number is a word of the title. Titles are cut to words and joined on these, not compared one by
    one; the last of several."""
    words = works.select("*", F.explode(F.array_distinct(F.split(spaces(F.col("title")), " "))).alias("number"))
    return best(mentions.join(words, "number"), ["key"], None, F.col("seq")).select("key", F.col(value).alias("value"))


def by_title_number(mentions: DataFrame, works: DataFrame, pattern: str, value: str, group: int = 1, phrase: str | None = None) -> DataFrame:
    """Works whose title names the number by a pattern (and a phrase): the number is extracted once per work, then equi-joined."""
    keyed = works.withColumn("number", F.regexp_extract(F.upper(spaces(F.col("title"))), pattern, group)).where("number != ''")
    if phrase:
        keyed = keyed.where(F.upper("title").contains(phrase.upper()))
    return best(mentions.join(keyed, "number"), ["key"], None, F.col("seq")).select("key", F.col(value).alias("value"))


def un_regulations(mentions: DataFrame, works: DataFrame) -> DataFrame:
    return by_title_number(mentions, works, r"(?i)^(?:UN )?REGULATION NO\.? ?([0-9]+)\b", "eli")


def partnership_decisions(mentions: DataFrame, works: DataFrame, phrase: str) -> DataFrame:
    return by_title_number(mentions, works, r"\bNO ([0-9]+/[0-9]{4})\b", "eli", phrase=phrase)


def oj_elis(mentions: DataFrame, works: DataFrame) -> DataFrame:
    """ELI by date, year and number; without a CELEX id the value is INVALID, so that the existence filter drops it."""
    found = best(mentions.join(works, ["date", "year", "number"], "left"), ["key"], F.col("celex").isNotNull(), F.coalesce("seq", F.lit(0)))
    return found.select("key", F.coalesce("eli", F.lit(INVALID)).alias("value"))


def ecb_elis(mentions: DataFrame, works: DataFrame) -> DataFrame:
    """By the bank's own reference, else by the year and number in the CELEX id; null if neither an ELI nor a journal url is known."""
    own = mentions.join(works.select(F.col("reference").alias("_r"), "eli", "oj_url", "celex", "seq"), F.col("reference") == F.col("_r")).withColumn("_way", F.lit(0)).drop("_r")
    key = F.concat(F.lit("3"), F.col("year"), F.lit("O"), F.when(F.length("number") < 4, F.lpad(F.col("number"), 4, "0")).otherwise(F.col("number")))
    other = mentions.withColumn("_c", key).join(works.select(F.regexp_extract("celex", r"^(3[0-9]{4}O[0-9]{4,})", 1).alias("_c"), "eli", "oj_url", "celex", "seq"), "_c").withColumn("_way", F.lit(1)).drop("_c")
    both = own.unionByName(other)
    return best(both, ["key"], F.col("_way") == 0, F.col("seq"), last=False).select("key", F.coalesce("eli", "oj_url").alias("value"))


def ecb_guidelines(urls: Column) -> Column:
    """CELEX id of a guideline from the year and number in its url."""
    year, number = (F.regexp_extract(urls, r"/([0-9]{4})/([0-9]+)", i) for i in (1, 2))
    return F.when(year != "", F.concat(F.lit("3"), year, F.lit("O"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)))


def case_orders(mentions: DataFrame, works: DataFrame) -> DataFrame:
    """Orders in a case: label and a point in the last part of the title, and the first ten characters of the id."""
    last = F.substring_index("title", "#", -1)
    cut = lambda c: F.substring(c, 1, 10)
    right = works.select(cut(F.col("celex")).alias("_ten"), F.col("celex").alias("_c"), last.alias("_last"), F.col("seq").alias("_seq"))
    pairs = mentions.withColumn("_ten", cut(F.col("celex"))).join(right, "_ten")
    fit = F.col("_last").contains(F.concat(F.col("label"), F.lit(".")))
    return best(pairs.where(fit), ["key"], None, F.col("_seq")).select("key", F.col("_c").alias("value"))


def joined_judgments(mentions: DataFrame, joined: DataFrame) -> DataFrame:
    """The main case of a label; mentions without one lose their target."""
    return mentions.join(joined, "label", "left").select("key", F.col("main").alias("value"), F.col("main").isNotNull().alias("kept"))


def base_url(column, name: str = "ELI_BASE_URL", url: str = "") -> Column:
    """The marker of a site's address filled with the run's own, or with nothing."""
    return F.regexp_replace(text(column), r"\{\{\s*" + name + r"\s*(?:\|[^}]*)?\}\}", url.replace("\\", "\\\\").replace("$", "\\$"))


def existing_journals(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """mentions(key, oj, uriserv) whose journal is known and has a document at their address: an equi-join on the journal, then one
    test of the address per pair; celex of the document where it has one."""
    pairs = mentions.join(known.select("oj", F.col("celex").alias("_celex"), F.col("url").alias("_url")), "oj").where(F.contains("_url", F.col("uriserv")))
    return pairs.groupBy(*mentions.columns).agg(F.min("_celex").alias("celex"))


def existing_council(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """mentions(key, consil) whose Council document is known; ids there carry their kind in front."""
    ids = known.where(F.col("id").startswith("consil:")).select(F.substring("id", F.lit(8), F.length("id")).alias("consil")).distinct()
    return mentions.join(ids, "consil", "left_semi")


def existing_targets(mentions: DataFrame, known: DataFrame | None, kind: str = "celex") -> DataFrame:
    """Alternatives whose id isn't known go; if the lookup failed (None), only those marked as active go.

    mentions(doc_id, position, alternatives array<struct<id, id_type, active, ...>>).
    """
    active = lambda a: a["active"]
    if known is None:
        return mentions.withColumn("alternatives", F.filter("alternatives", lambda a: (a["id_type"] != kind) | ~active(a)))
    asked = mentions.select(F.explode("alternatives").alias("a")).where(F.col("a.id_type") == kind).select(F.col("a.id").alias("id")).distinct()
    gone = asked.join(known.select("id").distinct(), "id", "left_anti")
    flat = mentions.select("doc_id", "position", F.posexplode_outer("alternatives").alias("_i", "_a"))
    marked = flat.withColumn("id", F.col("_a.id")).join(gone.withColumn("_gone", F.lit(True)), "id", "left")
    kept = F.col("_a").isNotNull() & ~(F.coalesce("_gone", F.lit(False)) & (F.col("_a.id_type") == kind))
    back = marked.groupBy("doc_id", "position").agg(F.sort_array(F.collect_list(F.when(kept, F.struct("_i", "_a")))).alias("_l"))
    return mentions.drop("alternatives").join(back.select("doc_id", "position", F.transform("_l", lambda x: x["_a"]).alias("alternatives")), ["doc_id", "position"])


def without_inert(alternatives: Column, linked_data: bool) -> Column:
    """Without linked data, targets marked as active that share an id with another one go."""
    if linked_data:
        return alternatives
    return F.filter(alternatives, lambda a: ~(a["active"] & (F.size(F.filter(alternatives, lambda b: b["id"] == a["id"])) > 1)))
