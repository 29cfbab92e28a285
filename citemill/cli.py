"""python -m citemill --input FILE | --inputdir DIR | --inputtext TEXT: references as JSON, XML or HTML."""

from __future__ import annotations

import argparse
import datetime
import sys
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.functions import ids
from citemill.functions.converters import LANGUAGES
from citemill.operators import detect, html, nodes, works
from citemill.options import Options
from citemill.plans import builtin
from citemill.plans.rules import RuleSet, compile_rules, load_rules
from citemill.sources import named, readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Finds references to legal texts.")
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--input", help="a file")
    source.add_argument("--inputdir", help="a folder of txt, html and xml files")
    source.add_argument("--inputtext", help="the text itself")
    p.add_argument("--output", help="a folder for the result; without it, standard output")
    p.add_argument("--outputdir", help="with --inputdir: a folder for one result per file, under the file's name")
    p.add_argument("--format", choices=("json", "xml", "html"), default="json")
    p.add_argument("--rules", help="a folder of XML rules instead of the built-in ones")
    p.add_argument("--langsource", default="EN", help="language of the rules, two letters")
    p.add_argument("--language", "--langtarget", default="ENG", help="language of the links, two or three letters")
    p.add_argument("--types", "--ruletype", help="rule types, by commas")
    p.add_argument("--environments", "--environment", help="environments, by commas")
    p.add_argument("--targets", "--target", help="targets, by commas")
    p.add_argument("--exclude-targets", "--excludetarget", default="", help="parts of targets that are left out, by commas")
    p.add_argument("--linkeddata", action="store_true", help="attach metadata from the tables of --catalogue")
    p.add_argument("--linkeddatamode", default="all", help="kinds of metadata, by commas")
    p.add_argument("--catalogue", help="a folder of Parquet tables: works, expressions, repeals and so on")
    p.add_argument("--htmlmode", action="store_true", help="the input is HTML: only text nodes are read, links stay")
    p.add_argument("--sort", default="position.asc")
    p.add_argument("--point-in-time", "--pointintime", type=datetime.date.fromisoformat)
    p.add_argument("--strict", "--strictrules", default="", help="types whose strict patterns count, by commas")
    p.add_argument("--no-special-rules", action="store_true")
    p.add_argument("--title-form", action="store_true", help="also [reference|title]")
    return p


def parts(value: str | None) -> frozenset[str] | None:
    return frozenset(x for x in value.split(",") if x) if value else None


def three_letters(code: str) -> str:
    return next((long for long, short in LANGUAGES.items() if short == code.upper()), code.upper())


def options(a: argparse.Namespace) -> Options:
    made = Options(
        language=three_letters(a.language), types=parts(a.types), environments=parts(a.environments) or frozenset({"*"}), targets=parts(a.targets), excluded_targets=tuple(sorted(parts(a.exclude_targets) or ())),
        special_rules=not a.no_special_rules, strict=parts(a.strict) or frozenset(), sort=a.sort, point_in_time=a.point_in_time, scan="text" if a.htmlmode else "raw",
    )
    return made.with_modes(*sorted(parts(a.linkeddatamode) or ("all",))) if a.linkeddata else made


def catalogue(spark: SparkSession, folder: str) -> works.Catalogue:
    """The tables that a folder holds, by name."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [f.name for f in fields(works.Catalogue) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"{f.name}.parquet"))]
    return works.Catalogue(**{name: spark.read.parquet(f"{folder}/{name}.parquet") for name in there})


def found_in(docs: DataFrame, rules: RuleSet, o: Options, title_form: bool = False) -> DataFrame:
    """Mentions with their urls; of HTML those in its text nodes, at their places in the source."""
    if o.scan != "text":
        found = detect.mentions(docs, rules, options=o, title_form=title_form)
    else:
        nodes_ = html.text_nodes(docs, "doc_id", "text").withColumn("_node", F.struct("doc_id", "offset"))
        found = detect.mentions(nodes_.select("_node", "text"), rules, key="_node", options=o, title_form=title_form)
        found = found.withColumn("position", (F.col("position") + F.col("_node.offset")).cast("int")).withColumn("doc_id", F.col("_node.doc_id")).drop("_node")
    return found.withColumn("urls", F.flatten(F.transform("alternatives", lambda x: ids.urls(x["view"]))))


def result(docs: DataFrame, rules: RuleSet, o: Options, form: str, title_form: bool = False, tables: works.Catalogue | None = None) -> DataFrame:
    """doc_id and the result in a form."""
    keyed = docs.withColumn("doc_id", F.xxhash64(F.coalesce("path", F.lit("")))) if "doc_id" not in docs.columns else docs
    found = found_in(keyed, rules, o, title_form)
    if form == "html":
        link = F.struct("position", "match", F.coalesce(F.try_element_at("urls", F.lit(1)), F.lit("#")).alias("href"))
        per = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(link)).alias("links"))
        return html.linked_html(keyed.join(per, "doc_id", "left"), "doc_id", "text").withColumnRenamed("html", "value")
    listed = nodes.numbered(nodes.grouped(found.where(detect.has_visible(F.col("alternatives"))), detail=form == "xml"), o.sort)
    if form == "xml":
        return sinks.result_xml(listed).withColumnRenamed("xml", "value")
    if tables is not None and tables.works is not None and "celex" in o.linked_data:
        named = found.select("doc_id", F.col("match").alias("reference"), F.explode(F.transform("alternatives", lambda x: ids.primary_id(ids.normalised(x["attrs"])))).alias("celex")).distinct().where("celex IS NOT NULL")
        meta = works.celex_metadata(named.select("celex"), tables, o.language, str(o.point_in_time) if o.point_in_time else None)
        data = named.join(meta, "celex").groupBy("doc_id", "reference").agg(F.sort_array(F.collect_list(F.struct(*sorted(meta.columns)))).alias("metadata"))
        listed = listed.join(data, ["doc_id", "reference"], "left")
    extra = ["metadata"] * ("metadata" in listed.columns)
    return listed.select("doc_id", sinks.json_of(F.struct("number", "count", "reference", "type", "label", "urls", "positions", *extra)).alias("value"))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("references").getOrCreate()
    o = options(a)
    rules = compile_rules(load_rules(a.rules), a.langsource.upper()) if a.rules else builtin.rule_set(a.langsource.upper())
    if a.inputtext is not None:
        docs = readers.from_text(spark, a.inputtext)
    else:
        docs = readers.from_files(spark, a.input) if a.input else readers.from_folder(spark, a.inputdir)
    out = result(docs, rules, o, a.format, a.title_form, catalogue(spark, a.catalogue) if a.catalogue else None)
    if a.outputdir:
        if not a.inputdir:
            raise SystemExit("--outputdir goes with --inputdir")
        names = docs.select(F.xxhash64(F.coalesce("path", F.lit(""))).alias("doc_id"), F.substring_index("path", "/", -1).alias("name"))
        named.write_named(names.join(out.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("value")), "\n").alias("value")), "doc_id", "left"), a.outputdir, a.format)
    elif a.output:
        sinks.write(out.select("value"), "text", a.output)
    else:
        for r in out.toLocalIterator():
            print(r.value)
    return 0


if __name__ == "__main__":
    sys.exit(main())
