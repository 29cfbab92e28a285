"""Linked data: lookups in a local catalogue of works, each a function of DataFrames.

Tables (columns beyond these are allowed):
  works(celex, eli, ecli, oj, type, author, number, year, date, date_force, date_validity, force, published)
  expressions(celex, lang, title, seq)          consolidations(celex, consolidated, eli, date)
  repeals(celex, repealed_by[, date])           citations(source, target, fragment_source, fragment_target)
  bases(celex, basis)                           dossiers(proc, celex, date, title, lang, seq[, adopted, published])
  subjects(celex, kind, label, lang)            corrections(celex, published_lang)
  journal(oj, celex[, label, url, date])        joined(main, labels)
  act_text(celex, eli, lang, html)
Dates are texts yyyy-mm-dd or DATEs. A missing row is status ``missing``; a table that isn't given is ``failed``.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.helpers import fragment

CITATION_LIMIT = 501
# The lines on the state of a procedure.
COMPLETED, ONGOING = "✔ Completed", "↻ Ongoing"


@dataclass(frozen=True)
class Catalogue:
    """The tables that a run has; lookups in one that is None fail."""

    works: DataFrame | None = None
    expressions: DataFrame | None = None
    consolidations: DataFrame | None = None
    repeals: DataFrame | None = None
    citations: DataFrame | None = None
    bases: DataFrame | None = None
    dossiers: DataFrame | None = None
    subjects: DataFrame | None = None
    corrections: DataFrame | None = None
    journal: DataFrame | None = None
    joined: DataFrame | None = None
    act_text: DataFrame | None = None

    def healthy(self) -> bool:
        return self.works is not None and bool(self.works.limit(1).take(1))


def in_language(rows: DataFrame, keys: list[str], wanted: list[str], order: str = "seq", lang: str = "lang") -> DataFrame:
    """One row per key: the first wanted language that has one; of repeats in it the last by order."""
    rank = F.array_position(F.array(*[F.lit(x) for x in wanted]), F.col(lang))
    w = Window.partitionBy(*keys).orderBy("_rank", F.col(order).desc())
    return rows.withColumn("_rank", rank).where("_rank > 0").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def latest(versions: DataFrame, key: str, by: str) -> DataFrame:
    """Versions without a newer one; equals stay together."""
    return versions.withColumn("_r", F.rank().over(Window.partitionBy(key).orderBy(F.col(by).desc()))).where("_r = 1").drop("_r")


def latest_by_anti_join(versions: DataFrame, key: str, by: str) -> DataFrame:
    """The same, as an anti join with newer versions."""
    newest = versions.groupBy(key).agg(F.max(by).alias("_top"))
    older = versions.join(newest, key).where(F.col(by) < F.col("_top")).select(key, by).distinct()
    return versions.join(older, [key, by], "left_anti")


def last_before(requests: DataFrame, versions: DataFrame, key: str, at: str, by: str) -> DataFrame:
    """requests with ``fit`` (the last version not after their time, as a struct) and ``newest`` (the last one of all).

    Requests and versions are one table in the order of key and time, cut into ranges of rows; so a key with very many versions spans
    many tasks. In each range the last version so far is carried on from row to row; a small table (a row for each key and range) says
    what earlier ranges end with. No version is ever held beside all others of its key, and no pair is a row.
    """
    asked, own = F.struct(*[F.col(c) for c in requests.columns]), F.struct(F.col(by), *[F.col(c) for c in versions.columns if c not in (key, by)])
    rows = versions.select(F.col(key).alias("k"), F.col(by).alias("t"), F.lit(0).alias("kind"), own.alias("v"), F.lit(None).alias("r"))
    both = rows.unionByName(requests.select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(1).alias("kind"), F.lit(None).alias("v"), asked.alias("r")))
    dealt = _settled(both.repartitionByRange("k", "t", "kind").withColumn("part", F.spark_partition_id()))
    ends = dealt.groupBy("k", "part").agg(F.max(F.when(F.col("t").isNotNull(), F.col("v"))).alias("end"), F.max("v").alias("top"))
    parts = Window.partitionBy("k").orderBy("part")
    carried = ends.select("k", "part", F.last("end", ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.max("top").over(Window.partitionBy("k")).alias("newest"))
    inside = Window.partitionBy("k", "part").orderBy("t", "kind", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = dealt.withColumn("own", F.last(F.when(F.col("t").isNotNull(), F.col("v")), ignorenulls=True).over(inside)).where("kind = 1")
    found = so_far.join(_settled(carried.select(F.col("k").alias("_key"), F.col("part").alias("_part"), "before", "newest")), F.expr("k <=> _key AND part = _part"))
    return found.select("r.*", F.coalesce("own", "before").alias("fit"), "newest")


def as_of(requests: DataFrame, versions: DataFrame, key: str, at: str, by: str) -> DataFrame:
    """requests with the version that holds at their date: the last not after it, else the newest one there is."""
    columns = [c for c in versions.columns if c != key]
    found = last_before(requests.where(F.col(key).isNotNull()), versions.where(F.col(key).isNotNull()), key, at, by).where("newest IS NOT NULL")
    held = F.coalesce("fit", "newest")
    return found.select(*requests.columns, *[held[c].alias(f"as_of_{c}") for c in columns])


def eli_as_of(requested: DataFrame, known: DataFrame, column: str = "eli") -> DataFrame:
    """requested ELIs and, as ``held``, the known one that their last segment (a date) asks for; ids of the official journal's form
    (/oj) take the newest."""
    root = lambda c: F.regexp_replace(c, "[^/]*$", "")
    versions = known.select(root(F.col(column)).alias("_root"), F.col(column).alias("_k")).where("_k IS NOT NULL").distinct()
    found = last_before(requested.withColumn("_root", root(F.col(column))), versions, "_root", column, "_k")
    newest = F.coalesce(F.col("newest._k"), F.col(column))
    return found.withColumn("held", F.when(F.col(column).endswith("/oj"), newest).otherwise(F.coalesce("fit._k", newest))).select(*requested.columns, "held")


def closure(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """src, dst, depth (the least) of everything reachable, within a depth if one is given, by doubling paths: as many joins as the
    longest way has bits. Cycles end, since only the shortest way to a node is kept.

    A shortest way of up to twice the length so far is a shortest one of just that length and a shorter one after it, so only the
    longest paths so far are carried on, and each way comes about once for each node in its middle. Paths lie by src from the first:
    they meet others and are made unique where they are, and only new ones travel.
    """
    known = F.col("src").isNotNull() & F.col("dst").isNotNull()  # said once at the root: no join adds it to one use of paths and not to another
    paths = edges.select("src", "dst").where(known).repartition("src").distinct().withColumn("depth", F.lit(1))
    far = 1
    while depth is None or far < depth:
        ends = paths.where(F.col("depth") == far).select(F.col("src").alias("start"), F.col("dst").alias("src"))
        if depth is None and not ends.take(1):
            break
        after = paths if depth is None or 2 * far <= depth else paths.where(F.col("depth") <= depth - far)
        longer = ends.join(after, "src").select(F.col("start").alias("src"), "dst", (F.col("depth") + far).alias("depth"))
        paths = paths.unionByName(longer.repartition("src")).groupBy("src", "dst").agg(F.min("depth").alias("depth"))
        far *= 2
        if depth is None:
            paths = _settled(paths)
    return paths.unionByName(edges.select("src", "dst").where(~known).distinct().withColumn("depth", F.lit(1)))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, the context's own folder or, with a local master, a new one."""
    context = spark.sparkContext._jsc.sc()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir().isDefined():
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="citemill-"))
    return folder or context.getCheckpointDir().get()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder below the shared one that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _settled(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def last_repealing(repeals: DataFrame) -> DataFrame:
    """celex, repealed_by: acts at the end of a chain of repeals, that nothing repeals in turn.

    Pointers jump: each act points to where the acts it points to point, so as many joins as the log of the longest chain reach all
    ends, with one row per act where one act repeals another. No simple way is longer than the acts are many, which ends cycles.
    """
    edges = repeals.select("celex", "repealed_by").distinct()
    repealed = edges.select(F.col("celex").alias("repealed_by"), F.lit(True).alias("open")).distinct()
    at = _settled(edges.join(repealed, "repealed_by", "left").select("celex", "repealed_by", F.col("open").isNotNull().alias("open")))
    for _ in range(repealed.count().bit_length()):
        if not at.where("open").take(1):
            break
        to = at.select(F.col("celex").alias("repealed_by"), F.col("repealed_by").alias("to"), F.col("open").alias("to_open"))
        jumped = at.where("open").join(to, "repealed_by").select("celex", F.col("to").alias("repealed_by"), F.col("to_open").alias("open"))
        at = _settled(at.where("NOT open").unionByName(jumped).distinct())
    return at.where("NOT open").select("celex", "repealed_by")


# ---- metadata of acts


def _wanted(ids: DataFrame, id_column: str) -> DataFrame:
    return ids.select(F.col(id_column)).distinct()


def unpublished(works: DataFrame, journal: DataFrame) -> DataFrame:
    """Works that no issue of the journal holds: acts that are published one by one."""
    return works.join(journal.select("celex").distinct(), "celex", "left_anti")


#: Repeals are followed step by step from the ids only if these ask for less than one in so many of them.
MUCH = 8


def reached(repeals: DataFrame, ids: DataFrame, rounds: int = 8) -> DataFrame:
    """The repeals that the ids can lead to, found step by step; where that takes too many steps, or ids ask for much of them, all."""
    edges = repeals.select("celex", "repealed_by").distinct()
    front = _settled(edges.join(_wanted(ids, "celex"), "celex", "left_semi"))
    if MUCH * front.count() > edges.count():
        return edges
    held = front
    for _ in range(rounds):
        found = edges.join(front.select(F.col("repealed_by").alias("celex")).distinct(), "celex", "left_semi")
        front = _settled(found.join(held.select("celex").distinct(), "celex", "left_anti"))
        if not front.take(1):
            return held
        held = held.unionByName(front)
    return edges


def _with_titles(out: DataFrame, c: Catalogue, language: str) -> DataFrame:
    """base_title, title (with the ECLI below it) and lang."""
    named = out.join(in_language(c.expressions, ["celex"], [language, "ENG", "FRA"]).select("celex", F.col("title").alias("base_title"), "lang"), "celex", "left")
    below = F.concat(F.lit("\nECLI identifier: "), F.col("ecli")) if "ecli" in out.columns else F.lit(None).cast("string")
    return named.withColumn("title", F.concat("base_title", F.coalesce(below, F.lit(""))))


def _with_journal(out: DataFrame, c: Catalogue) -> DataFrame:
    """oj_id, oj (its label), oj_url, oj_date of the issue; of several the first by id."""
    given = [x for x in ("label", "url", "date") if x in c.journal.columns]
    issue = F.min(F.struct("oj", *given)).alias("_j")
    own = c.journal.join(_wanted(out, "celex"), "celex", "left_semi").groupBy("celex").agg(issue)
    return out.join(own.select("celex", F.col("_j.oj").alias("oj_id"), *[F.col(f"_j.{x}").alias({"label": "oj", "url": "oj_url", "date": "oj_date"}[x]) for x in given]), "celex", "left")


def _with_repeals(out: DataFrame, c: Catalogue, ids: DataFrame, at: str | None) -> DataFrame:
    """The act that repeals an act itself, the last one of the chain, and the ELIs of both."""
    repeals = c.repeals.where(F.col("date") < F.lit(at)) if at and "date" in c.repeals.columns else c.repeals
    near = reached(repeals, ids)
    direct = near.groupBy("celex").agg(F.max("repealed_by").alias("repeal"))
    last = last_repealing(near).groupBy("celex").agg(F.max("repealed_by").alias("repealed_by"))
    out = out.join(direct, "celex", "left").join(last, "celex", "left")
    for act, eli in (("repeal", "repeal_eli"), ("repealed_by", "last_repeal_eli")):
        elis = c.works.groupBy(F.col("celex").alias(act)).agg(F.max("eli").alias(eli))
        out = out.join(elis, act, "left")
    return out


def celex_metadata(ids: DataFrame, c: Catalogue, language: str, at: str | None = None) -> DataFrame:
    """One row per id: the work, titles, first and last day of validity, the journal, the latest consolidation (before a day), the
    repealing act and the last one of its chain with their ELIs, the dossier and its title; status ok or missing."""
    works = c.works.join(_wanted(ids, "celex"), "celex", "left_semi")
    grouping = [x for x in works.columns if x not in ("date_force", "date_validity")]
    works = works.groupBy(*grouping).agg(F.min("date_force").alias("date_force"), F.max("date_validity").alias("date_validity"))
    out = _wanted(ids, "celex").join(works, "celex", "left").withColumn("status", F.when(F.col("date").isNull() & F.col("eli").isNull(), "missing").otherwise("ok"))
    if c.expressions is not None:
        out = _with_titles(out, c, language)
    if c.journal is not None:
        out = _with_journal(out.drop("oj"), c)
    if c.consolidations is not None:
        held = c.consolidations if not at else c.consolidations.where(F.col("date") < F.lit(at))
        newest = latest(held, "celex", "date").groupBy("celex").agg(F.max("consolidated").alias("consolidated"), F.max("eli").alias("consolidated_eli"), F.max("date").alias("consolidated_date"))
        out = out.join(newest, "celex", "left")
    if c.repeals is not None:
        out = _with_repeals(out, c, ids, at)
    if c.dossiers is not None:
        dossier = F.min(F.struct("proc", F.col("title").alias("dossier_title"))).alias("_d")
        out = out.join(c.dossiers.groupBy("celex").agg(dossier).select("celex", "_d.*"), "celex", "left")
    return out


def oj_metadata(ids: DataFrame, c: Catalogue, language: str) -> DataFrame:
    """As celex_metadata, by OJ label; the same work may be known under both."""
    found = c.journal.join(_wanted(ids, "oj"), "oj", "left_semi")
    meta = celex_metadata(found, Catalogue(**{**c.__dict__, "dossiers": None, "journal": None}), language)
    return _wanted(ids, "oj").join(found.join(meta.drop(*[x for x in found.columns if x != "celex"]), "celex"), "oj", "left")


def eli_metadata(ids: DataFrame, c: Catalogue, language: str) -> DataFrame:
    """By ELI, dates in the id taken to the version that holds then; with the initial act and the final consolidation."""
    known = c.consolidations.select("eli", "celex", "consolidated", "date").unionByName(c.works.select("eli", "celex", F.col("celex").alias("consolidated"), "date"))
    held = eli_as_of(_wanted(ids, "eli"), known)
    of = held.join(known.withColumnRenamed("eli", "held"), "held", "left")
    first = c.works.select("celex", F.col("eli").alias("initial_eli"), F.col("force").alias("initial_force"), F.col("date_validity").alias("initial_validity"))
    final = latest(c.consolidations, "celex", "date").groupBy("celex").agg(F.max("eli").alias("final_eli"), F.max("date").alias("final_date"))
    out = of.join(first, "celex", "left").join(final, "celex", "left")
    return out.join(in_language(c.expressions, ["celex"], [language, "ENG", "FRA"]).select("celex", "title"), "celex", "left")


def consolidations_of(elis: DataFrame, c: Catalogue) -> DataFrame:
    """All consolidations whose ELI begins with the root of an id; an equi-join on the root."""
    root = lambda x: F.regexp_extract(x, r"^(.*/eli/[^/]+/[^/]+/[^/]+)", 1)
    return c.consolidations.withColumn("root", root(F.col("eli"))).join(_wanted(elis, "eli").select(root(F.col("eli")).alias("root")).distinct(), "root", "left_semi")


def ecli_metadata(ids: DataFrame, c: Catalogue, language: str) -> DataFrame:
    works = c.works.where(~F.col("celex").contains("_")).join(_wanted(ids, "ecli"), "ecli", "left_semi")
    titles = in_language(c.expressions, ["celex"], [language, "ENG", "FRA"]).select("celex", "title")
    return _wanted(ids, "ecli").join(works.join(titles, "celex", "left"), "ecli", "left")


def procedures(ids: DataFrame, c: Catalogue, language: str) -> DataFrame:
    """The latest work of each dossier with its title: requested language, English, French; of repeats the last. Where the dossiers
    say whether they are adopted, the title ends with a line on that."""
    own = c.dossiers.join(_wanted(ids, "proc"), "proc", "left_semi")
    found = in_language(latest(own, "proc", "date"), ["proc"], [language, "ENG", "FRA"])
    if "adopted" not in found.columns:
        return found
    act = F.concat(F.lit(" (Adopted act: "), F.replace(F.col("published"), F.lit("celex:"), F.lit("")), F.lit(")")) if "published" in found.columns else F.lit(None).cast("string")
    line = F.when(F.col("adopted").cast("string") == "1", F.concat(F.lit(COMPLETED), F.coalesce(act, F.lit("")))).otherwise(ONGOING)
    return found.withColumn("title", F.concat(F.replace("title", F.lit("&#13;\n"), F.lit(" ")), F.lit("\n"), line))


council_documents = procedures


def national_elis(ids: DataFrame, acts: DataFrame) -> DataFrame:
    """National acts by ELI, the title with its dates; of repeats the last by seq."""
    own = acts.join(_wanted(ids, "eli"), "eli", "left_semi")
    last = own.withColumn("_n", F.row_number().over(Window.partitionBy("eli").orderBy(F.col("seq").desc()))).where("_n = 1").drop("_n")
    return last.withColumn("title", F.concat_ws(" ", "title", F.concat(F.lit("("), F.col("date").cast("string"), F.lit(")"))))


# ---- citations


def cited_by(c: Catalogue, celex: str, search: str | None = None, sector: str | None = None, limit: int = CITATION_LIMIT) -> DataFrame:
    """Acts that an act cites, with the fragments."""
    return _linked(c, F.col("source") == celex, "target", search, sector, limit, [])


def citing(c: Catalogue, celex: str, search: str | None = None, sector: str | None = None, limit: int = CITATION_LIMIT) -> DataFrame:
    """Acts that cite an act; summaries and information notes are left out."""
    return _linked(c, F.col("target") == celex, "source", search, sector, limit, ["_SUM", "_INF"])


def _linked(c: Catalogue, own: Column, other: str, search: str | None, sector: str | None, limit: int, without: list[str]) -> DataFrame:
    found = c.citations.where(own).select(F.col(other).alias("celex"), fragment(F.col("fragment_source"), F.col("source")).alias("from_part"), fragment(F.col("fragment_target"), F.col("target")).alias("to_part")).distinct()
    for x in without:
        found = found.where(~F.col("celex").contains(x))
    if sector:
        found = found.where(F.col("celex").startswith(sector))
    if search:
        titles = c.expressions.where(F.lower("title").contains(search.lower())).select("celex").distinct()
        found = found.join(titles, "celex", "left_semi")
    return found.orderBy("celex", "from_part", "to_part").limit(limit)


def bases_of(c: Catalogue, celex: str, limit: int = CITATION_LIMIT) -> DataFrame:
    return c.bases.where(F.col("celex") == celex).select(F.col("basis").alias("celex")).distinct().orderBy("celex").limit(limit)


def based_on(c: Catalogue, celex: str, limit: int = CITATION_LIMIT) -> DataFrame:
    return c.bases.where(F.col("basis") == celex).select("celex").distinct().orderBy("celex").limit(limit)


#: Parts into which the rows of one id are dealt before the first of each part are taken.
SALTS = 32


def first_of_each(rows: DataFrame, key: str, order: list[str], limit: int, asked: DataFrame | None = None) -> DataFrame:
    """The first different rows of each key by an order of all other columns; with asked only of the keys there. Each part of a key
    keeps its own first ones, before and after the shuffle, and the key's first are among these; so a key with very many rows is dealt
    over many tasks. Equal rows share a part. Rows are dealt by key alone, and meet those asked for, only after that."""
    salt = F.pmod(F.xxhash64(*order), F.lit(SALTS))
    own = Window.partitionBy(key, "_salt").orderBy(*order)
    part = rows.select(key, *order).withColumn("_salt", salt).withColumn("_n", F.dense_rank().over(own)).where(F.col("_n") <= limit)
    row = F.struct(*order)
    first = part.withColumn("_before", F.lag(row).over(own)).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(row)).drop("_salt", "_n", "_before")
    if asked is not None:
        first = first.join(_wanted(asked, "celex").withColumnRenamed("celex", key), key, "left_semi")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def cited_by_each(ids: DataFrame, c: Catalogue, search: str | None = None, sector: str | None = None, limit: int = CITATION_LIMIT) -> DataFrame:
    """id, celex, from_part, to_part: for each of the ids (celex), the first acts that it cites."""
    return _linked_each(ids, c, "source", "target", search, sector, limit, [])


def citing_each(ids: DataFrame, c: Catalogue, search: str | None = None, sector: str | None = None, limit: int = CITATION_LIMIT) -> DataFrame:
    """id, celex, from_part, to_part: for each of the ids (celex), the first acts that cite it."""
    return _linked_each(ids, c, "target", "source", search, sector, limit, ["_SUM", "_INF"])


def _linked_each(ids: DataFrame, c: Catalogue, own: str, other: str, search: str | None, sector: str | None, limit: int, without: list[str]) -> DataFrame:
    found = c.citations.select(F.col(own).alias("id"), F.col(other).alias("celex"), fragment(F.col("fragment_source"), F.col("source")).alias("from_part"), fragment(F.col("fragment_target"), F.col("target")).alias("to_part"))
    for x in without:
        found = found.where(~F.col("celex").contains(x))
    if sector:
        found = found.where(F.col("celex").startswith(sector))
    if search:
        titles = c.expressions.where(F.lower("title").contains(search.lower())).select("celex").distinct()
        found = found.join(titles, "celex", "left_semi")
    return first_of_each(found, "id", ["celex", "from_part", "to_part"], limit, ids)


def bases_of_each(ids: DataFrame, c: Catalogue, limit: int = CITATION_LIMIT) -> DataFrame:
    """id, celex: for each of the ids (celex), the first of its legal bases."""
    return first_of_each(c.bases.select(F.col("celex").alias("id"), F.col("basis").alias("celex")), "id", ["celex"], limit, ids)


def based_on_each(ids: DataFrame, c: Catalogue, limit: int = CITATION_LIMIT) -> DataFrame:
    """id, celex: for each of the ids (celex), the first acts that have it as a basis."""
    return first_of_each(c.bases.select(F.col("basis").alias("id"), "celex"), "id", ["celex"], limit, ids)


def classifications(ids: DataFrame, c: Catalogue, language: str) -> DataFrame:
    """EuroVoc concepts times subject matters of each work."""
    own = c.subjects.where(F.lower("lang") == language.lower()).join(_wanted(ids, "celex"), "celex", "left_semi")
    one = own.where("kind = 'eurovoc'").select("celex", F.col("label").alias("eurovoc"))
    two = own.where("kind = 'subject'").select("celex", F.col("label").alias("subject"))
    return one.join(two, "celex", "full")


def corrections(ids: DataFrame, c: Catalogue, language: str | None = None) -> DataFrame:
    """Corrigenda of each act, joined by commas; only those published in a language, if one is given."""
    own = c.corrections.withColumn("act", F.regexp_extract("celex", r"^(.*?)R\(", 1))
    if language:
        own = own.where(F.col("published_lang") == language)
    own = own.join(_wanted(ids, "celex").withColumnRenamed("celex", "act"), "act", "left_semi")
    return own.groupBy("act").agg(F.concat_ws(",", F.sort_array(F.collect_set("celex"))).alias("corrections"))


def joined_labels(title: Column) -> Column:
    """C-1/11 and C-2/11 from a title, as C-1/11,C-2/11."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(title, F.lit(r"([CTF]-[0-9]+/[0-9]{2})"), F.lit(1))), ",")


def joined_cases(c: Catalogue) -> DataFrame:
    """label, main: every case but the first of a joined judgment leads to the main one."""
    each = c.joined.select("main", F.posexplode(F.split("labels", ",")).alias("i", "label"))
    return each.where("i > 0").select("label", "main")


def existing(ids: DataFrame, known: DataFrame, column: str) -> DataFrame:
    return ids.join(known.select(column).distinct(), column, "left_semi")


def missing(ids: DataFrame, known: DataFrame, column: str) -> DataFrame:
    return ids.join(known.select(column).distinct(), column, "left_anti")


def point_in_time(rows: DataFrame, versions: DataFrame, key: str = "celex") -> DataFrame:
    """Rows replaced by their consolidation where there is one, but with the base row's force and repeal."""
    held = [x for x in rows.columns if x in ("force", "date_force", "date_validity", "repealed_by") or x == key]
    both = rows.join(versions.select(key, *[F.col(x).alias(f"_{x}") for x in versions.columns if x != key]), key, "left")
    out = [F.col(x) if x in held or x not in versions.columns else F.coalesce(F.col(f"_{x}"), F.col(x)).alias(x) for x in rows.columns]
    return both.select(*out, F.when(F.col(f"_{next(x for x in versions.columns if x != key)}").isNotNull(), F.col(key)).alias("original"))


def short_titles(rows: DataFrame, titles: DataFrame, treaty: Column) -> DataFrame:
    """Adds short_title; a treaty's own wins."""
    return rows.join(titles.select("celex", F.col("title").alias("_t")), "celex", "left").withColumn("short_title", F.coalesce(treaty, "_t")).drop("_t")


def full_titles(ids: DataFrame, c: Catalogue, language: str) -> DataFrame:
    """Titles of acts of sector 3; missing ones are null."""
    titles = in_language(c.expressions, ["celex"], [language]).select("celex", "title")
    return _wanted(ids, "celex").where(F.col("celex").startswith("3")).join(titles, "celex", "left")


def legal_text(ids: DataFrame, c: Catalogue, language: str) -> DataFrame:
    """The text by ELI where an id has one and it is held, else by CELEX."""
    texts = c.act_text.where(F.col("lang") == language)
    by_eli = ids.join(texts.select("eli", F.col("html").alias("_e")), "eli", "left")
    return by_eli.join(texts.select("celex", F.col("html").alias("_c")), "celex", "left").withColumn("html", F.coalesce("_e", "_c")).drop("_e", "_c")


#: Which of several rows of an id counts, by kind.
FIRST_WINS = ("celex", "ecli", "oj")


def one_per_id(rows: DataFrame) -> DataFrame:
    """rows(kind, id, seq, ...) to one per id: the first of some kinds, the last of the others."""
    first = F.col("kind").isin(*FIRST_WINS)
    w = Window.partitionBy("kind", "id").orderBy(F.when(first, F.col("seq")).otherwise(-F.col("seq")))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fetch_all(tables: dict[str, DataFrame | None], ids: DataFrame) -> DataFrame:
    """kind, id, title, status of ids(kind, id): all lookups in one. A kind whose table is missing failed: CELEX and ECLI ids then
    carry that status, others have no row."""
    parts = None
    for kind, rows in tables.items():
        own = ids.where(F.col("kind") == kind).select("kind", "id").distinct()
        if rows is None:
            got = own.withColumn("title", F.lit(None).cast("string")).withColumn("status", F.lit("failed")).where(F.lit(kind in ("celex", "ecli")))
        else:
            single = one_per_id(rows.withColumn("kind", F.lit(kind))).select("id", "title", F.lit(True).alias("_got"))
            got = own.join(single, "id", "left").select("kind", "id", "title", F.when(F.col("_got"), "ok").otherwise("missing").alias("status"))
        parts = got if parts is None else parts.unionByName(got)
    return parts


def attached(mentions: DataFrame, bindings: DataFrame) -> DataFrame:
    """Mentions with the metadata of their id."""
    return mentions.join(bindings.withColumnRenamed("id", "_id").withColumnRenamed("kind", "_kind"), (F.col("id") == F.col("_id")) & (F.col("id_type") == F.col("_kind")), "left").drop("_id", "_kind")
