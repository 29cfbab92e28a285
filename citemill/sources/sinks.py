"""Sinks: JSON, XML and HTML forms of results, as Columns, and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.helpers import xml_escape


def json_of(node: Column) -> Column:
    """A struct as JSON, indented by two spaces."""
    return F.to_json(node, {"pretty": "true", "ignoreNullFields": "false"})


def _attr(name: str, value: Column) -> Column:
    return F.concat(F.lit(f' {name}="'), xml_escape(value), F.lit('"'))


def _element(name: str, inner: Column, **attrs: Column) -> Column:
    return F.concat(F.lit(f"<{name}"), *[_attr(k, v) for k, v in attrs.items()], F.lit(">"), inner, F.lit(f"</{name}>"))


def _joined(items: Column, form) -> Column:
    return F.array_join(F.transform(items, form), "")


def record_xml(number, count, reference, type_, label, matches, urls=None) -> Column:
    """One <record> of a result set. matches: array<struct<position, context, match, views array<struct<target, view>>>>; urls:
    array<struct<position, target, href>>, left out where there are none."""

    def view(v: Column) -> Column:
        return _element("view", F.concat(F.lit("<![CDATA["), F.replace(v["view"], F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>")), target=v["target"])

    def match(m: Column) -> Column:
        return _element("match", _joined(m["views"], view), position=m["position"], context=m["context"], reference=m["match"])

    def url(u: Column) -> Column:
        return _element("url", xml_escape(u["href"]), position=u["position"], target=u["target"])

    parts = [_element("reference", xml_escape(reference), count=count), _element("type", xml_escape(type_)), _element("libelle", xml_escape(label)), _element("matches", _joined(matches, match))]
    if urls is not None:
        parts.append(F.when(F.size(urls) > 0, _element("urls", _joined(urls, url))).otherwise(""))
    return _element("record", F.concat(*parts), number=number)


def result_xml(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, xml: a result set per document, of nodes with number, count, reference, type, label, matches and, where given, links."""
    urls = F.col("links") if "links" in nodes.columns else None
    each = nodes.select(key, "number", record_xml(F.col("number"), F.col("count"), F.col("reference"), F.col("type"), F.col("label"), F.col("matches"), urls).alias("r"))
    per = each.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("number", "r"))).alias("l"))
    return per.select(key, _element("resultset", _joined(F.col("l"), lambda x: x["r"]), size=F.col("n")).alias("xml"))


def decorated(attrs: Column, linked: Column) -> Column:
    """Attributes with metadata added: each of ``linked`` (name -> struct as JSON) as name-ld."""
    return F.map_concat(attrs, F.transform_keys(linked, lambda k, v: F.concat(k, F.lit("-ld"))))


def write(df: DataFrame, form: str, path: str) -> None:
    """form: json (lines), text (one column), parquet."""
    getattr(df.write.mode("errorifexists"), form)(path)
