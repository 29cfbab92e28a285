"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

Vectors are made of lines, of runs of lines with words, of runs of comment lines (headers), of windows as long as a notice in which
one of its strong words stands in its place (notices within long lines or across blocks), and of whole licence files. A vector
counts words (runs of a-z and 0-9, lower case), weighed by inverse document frequencies of all words over all lines of the corpus.
A vector takes the template of the highest cosine, from ``LEAST`` on; licence files are compared with whole licence texts too.

Vectors are narrowed without loss before they are weighed. The weakest words of a template span, together, less than LEAST of its
length, so by the Cauchy-Schwarz inequality a vector without any of its other, strong words has a cosine below LEAST; and so has one
whose words span less than LEAST of the template's length.

A file's own licence is that of its best vector. A file without one inherits from the licence file (by its name) in its own
directory or the nearest above; directories, not files, are joined with their ancestors. SQL functions only.

Defined results: a null text has no lines; a null path or directory part is ``none``; ties go to the first line, then to the
template first by name; repeated rows get equal results, and a directory with several licence files takes the best score, then
the first by name; a file without any licence has nulls; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, settled, stored, text_or_empty

LEAST = 0.6
DIGITS = 6
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-][a-z0-9.-]*)?$"

# Licence notices, as their stewards recommend them or as they are commonly put.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
]


def named(templates: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Templates by name#i, i counting from 0."""
    return [(f"{name}#{i:02d}", text) for i, (name, text) in enumerate(templates)]


def term_counts(templates: list[tuple[str, str]]) -> dict[str, dict[str, int]]:
    """Words and their counts by name#i."""
    return {name: dict(Counter(re.findall("[a-z0-9]+", text.lower()))) for name, text in named(templates)}


def words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), "[^a-z0-9]+"), "")


def strong_words(weights: dict[str, float], least: float = LEAST) -> set[str]:
    """All words but the weakest, which span together less than least of the length."""
    total, spanned, out = sum(w * w for w in weights.values()), 0.0, set()
    for term, w in sorted(weights.items(), key=lambda x: (x[1], x[0])):
        spanned += w * w
        if spanned >= (least * 0.999) ** 2 * total:
            out.add(term)
    return out


#: Words in so many lines of this many are sent to all workers: at most this many times the words of a mean line.
COMMON = 1000


COMMENT = r"^\s*(#|//|/?\*|--|;|%|<!--)"


@cache
def full_texts() -> dict[str, dict[str, int]]:
    """Word counts of whole licences, by name, name#full."""
    with open(Path(__file__).with_name("license_texts.json"), encoding="utf-8") as f:
        return {f"{k}#full": v for k, v in json.load(f).items()}


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, not wherever body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keyed(files: DataFrame) -> DataFrame:
    """Adds ``file``, 128 bits of path and text: it tells files of one path apart, and is shorter than both."""
    if "file" in files.columns:
        return files
    return files.withColumn("file", F.unhex(F.md5(F.concat_ws("\x00", F.coalesce("path", F.lit("")), text_or_empty()))))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, license_file: str = LICENSE_FILE) -> DataFrame:
    """file, path, line_no, template, score of the best vector of each file (path, text) that has one.

    Texts, and then the vectors made of them, are kept only if their words span enough of some template: all that is local to a
    row. What is left is weighed by joins with the frequencies of its words.
    """
    keys, counts, files = ["file", "path"], term_counts(templates), keyed(files)
    idf = _frequencies(files.select(F.explode(F.split("text", "\n")).alias("line")).select(words(F.col("line")).alias("words")).where(F.size("words") > 0))
    rows, strong = _template_shares(counts | full_texts(), idf, least)
    parts = _parts_of_length(rows, counts | full_texts())
    held = _held(templates, strong, parts, least)
    vocabulary = F.array(*[F.lit(t) for t in sorted({t for name in counts for t in parts[name]})])
    anchors = F.array(*[F.lit(t) for t in sorted({t for name in counts for t in strong[name]})])

    def reaching(terms: Column) -> Column:
        """The words of the notices among these, null where they span enough of none."""
        return _let(F.array_intersect(terms, vocabulary), lambda known: F.when(F.exists(held, lambda t: _reaches(t, known)), known))

    known = F.when(F.arrays_overlap(words(F.col("text")), anchors), reaching(words(F.col("text"))))
    few = stored(files.select(*keys, "text", known.alias("known")).where("known IS NOT NULL"), "license-files")
    runs = few.select(*keys, F.explode(F.filter(_line_units(F.col("text")), lambda u: reaching(u["words"]).isNotNull())).alias("u"))
    whole = _whole_files(files.where(F.regexp_extract("path", "([^/]*)$", 1).rlike(license_file)), keys, parts, least)
    units = runs.select(*keys, "u.line_no", "u.unit", "u.words").unionByName(_windows(few, keys, held)).unionByName(whole)
    vectors = stored(units.withColumn("v", F.monotonically_increasing_id()), "license-vectors")
    scored = vectors.select("v", *keys, "line_no").join(_scores(vectors, rows, set(counts), idf, least), "v")
    return stored(_best(scored, keys), "license-found")


def _line_units(text: Column) -> Column:
    """array<struct<line_no, unit, words>>: lines, runs of lines with words and runs of comment lines, by their first lines."""

    def of(lines: Column) -> Column:
        def unit(line_no: Column, name: str, terms: Column) -> Column:
            return F.struct(line_no.alias("line_no"), F.lit(name).alias("unit"), terms.alias("words"))

        def runs(name: str, inside) -> Column:
            within = lambda i: F.coalesce(inside(F.get(lines, i)), F.lit(False))
            number = F.transform(lines, lambda x: x["line_no"])
            first = F.filter(number, lambda i: within(i) & ~within(i - 1))
            last = F.filter(number, lambda i: within(i) & ~within(i + 1))
            made = F.zip_with(first, last, lambda a, z: F.when(z > a, unit(a, name, F.flatten(F.transform(F.slice(lines, a + 1, z - a + 1), lambda x: x["words"])))))
            return F.array_compact(made)

        single = F.transform(lines, lambda x: unit(x["line_no"], "line", x["words"]))
        every = F.concat(single, runs("run", lambda x: F.size(x["words"]) > 0), runs("comment", lambda x: x["comment"]))
        return F.filter(every, lambda u: F.size(u["words"]) > 0)

    cut = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line_no"), x.rlike(COMMENT).alias("comment"), words(x).alias("words")))
    return _let(cut, of)


def _parts_of_length(rows: list[tuple[str, str, float]], counts: dict[str, dict[str, int]]) -> dict[str, dict[str, float]]:
    """The share of a template's squared length that each of its words has, by template."""
    out: dict[str, dict[str, float]] = {}
    for name, t, share in rows:
        out.setdefault(name, {})[t] = share * counts[name][t]  # count * idf^2 / length, times count
    return {name: {t: x / sum(own.values()) for t, x in own.items()} for name, own in out.items()}


def _held(templates: list[tuple[str, str]], strong: dict[str, set[str]], parts: dict[str, dict[str, float]], least: float) -> Column:
    """A literal array with a struct for each template: its number of words, the strong ones with their places, the share of its
    squared length that each word has, and how much of it a vector must span."""
    out = []
    for name, text in named(templates):
        own = re.findall("[a-z0-9]+", text.lower())
        anchors = [F.struct(F.lit(t).alias("term"), F.lit(i).alias("place")) for i, t in enumerate(own) if t in strong[name]]
        squares = [F.struct(F.lit(t).alias("term"), F.lit(x).alias("part")) for t, x in parts[name].items()]
        out.append(F.struct(F.lit(len(own)).alias("size"), F.array(*anchors).alias("anchors"), F.array(*squares).alias("squares"), F.lit((least * 0.999) ** 2).alias("bound")))
    return F.array(*out)


def _reaches(template: Column, terms: Column) -> Column:
    """Whether the words of the template among these span at least least of its length: else the cosine is below least."""
    matched = F.filter(template["squares"], lambda x: F.array_contains(terms, x["term"]))
    return F.aggregate(matched, F.lit(0.0), lambda a, x: a + x["part"]) >= template["bound"]


def _windows(few: DataFrame, keys: list[str], held: Column) -> DataFrame:
    """keys, line_no, unit, words of the windows of few's texts in which a strong word of a template stands where it stands there,
    and which hold enough of its words."""
    by_line = F.transform(F.split("text", "\n"), lambda x, i: F.transform(words(x), lambda t: F.struct(i.alias("line_no"), t.alias("term"))))
    tokens = few.select(*keys, "known", F.flatten(by_line).alias("tokens"))
    fitting = F.filter(held, lambda t: (F.size("tokens") >= t["size"]) & _reaches(t, F.col("known")))
    near = tokens.withColumn("t", F.explode(fitting)).withColumn("terms", F.col("tokens.term"))
    starts = F.expr("""array_distinct(flatten(transform(filter(transform(terms, (t, i) -> struct(t, i)), y -> array_contains(t.anchors.term, y.t)),
        y -> transform(filter(t.anchors, a -> a.term = y.t), a -> y.i - a.place))))""")
    found = near.withColumn("starts", F.filter(starts, lambda s: (s >= 0) & (s + F.col("t.size") <= F.size("terms"))))
    cut = F.transform("starts", lambda s: F.struct(F.get("tokens", s)["line_no"].alias("line_no"), F.concat_ws("+", s, F.col("t.size")).alias("unit"), F.slice("terms", s + 1, F.col("t.size")).alias("words")))
    kept = F.filter(cut, lambda u: _reaches(F.col("t"), u["words"]))
    return found.select(*keys, F.explode(kept).alias("x")).select(*keys, "x.*").dropDuplicates([*keys, "line_no", "unit"])


def _whole_files(files: DataFrame, keys: list[str], parts: dict[str, dict[str, float]], least: float) -> DataFrame:
    """keys, line_no, unit, words of the files whose words span enough of some template, whole licences included."""
    whole = files.select(*keys, F.lit(0).alias("line_no"), F.lit("file").alias("unit"), words(F.col("text")).alias("words"))
    table = F.broadcast(files.sparkSession.createDataFrame([(name, t, x) for name, own in parts.items() for t, x in own.items()], "template string, term string, part double"))
    spans = whole.select("file", F.explode(F.array_distinct("words")).alias("term")).join(table, "term").groupBy("file", "template").agg(F.sum("part").alias("part"))
    reaching = spans.where(F.col("part") >= (least * 0.999) ** 2).select("file").distinct()
    return whole.join(reaching, "file", "left_semi")


#: Words in so many lines of this many are sent to all workers: at most this many times the words of a mean line.
COMMON = 1000


@dataclass(frozen=True)
class Frequencies:
    """Lines, and a table term, n: the lines that have the word."""

    total: int
    counts: DataFrame

    def weight(self, n: int) -> float:
        return math.log((self.total + 1) / (n + 1)) + 1

    def weights(self) -> DataFrame:
        return self.counts.select("term", "n", (F.log((F.lit(self.total) + 1) / (F.col("n") + 1)) + 1).alias("idf"))


def _frequencies(cut: DataFrame) -> Frequencies:
    counted = cut.select(F.explode(F.concat(F.array_distinct("words"), F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counted, "license-words")
    total = counts.where("term = ''").agg(F.max("n").alias("n")).first().n or 0
    return Frequencies(total, counts.where("term != ''"))


def _template_shares(counts: dict[str, dict[str, int]], idf: Frequencies, least: float) -> tuple[list[tuple[str, str, float]], dict[str, set[str]]]:
    """(template, term, share of the dot product per count in a line) and the strong words by template."""
    vocabulary = sorted({t for c in counts.values() for t in c})
    df = {r.term: r.n for r in idf.counts.where(F.col("term").isin(vocabulary)).collect()}  # a row for each word of the templates
    rows, strong = [], {}
    for name, c in counts.items():
        weights = {t: k * idf.weight(df.get(t, 0)) for t, k in c.items()}
        strong[name] = strong_words(weights, least)
        length = math.sqrt(sum(w * w for w in weights.values()))
        rows += [(name, t, w * idf.weight(df.get(t, 0)) / length) for t, w in weights.items()]
    return rows, strong


def _scores(vectors: DataFrame, rows: list[tuple[str, str, float]], notices: set[str], idf: Frequencies, least: float) -> DataFrame:
    """v, template, score from least on, of vectors (v, unit, words): whole files against all templates, others against notices.

    Of the frequencies, which grow with the words of the corpus, only those of the vectors' words are carried on.
    """
    table = [(name, t, x, name in notices) for name, t, x in rows]
    shares = F.broadcast(vectors.sparkSession.createDataFrame(table, "template string, term string, share double, notice boolean"))
    each = vectors.select("v", (F.col("unit") == "file").alias("whole"), F.explode("words").alias("term"))
    terms = stored(each.groupBy("v", "whole", "term").agg(F.count(F.lit(1)).alias("tf")), "license-terms")
    weights = stored(idf.weights().join(terms.select("term").distinct(), "term", "left_semi"), "license-weights")
    common = F.col("n") * COMMON >= idf.total
    first = terms.join(F.broadcast(weights.where(common).drop("n")), "term", "left")
    rest = first.where("idf IS NULL").drop("idf").join(weights.where(~common).drop("n"), "term")
    weighed = first.where("idf IS NOT NULL").unionByName(rest)
    length = weighed.groupBy("v").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("length"))
    dots = terms.join(shares, "term").where("whole OR notice").groupBy("v", "template").agg(F.sum(F.col("tf") * F.col("share")).alias("dot"))
    return dots.join(length, "v").select("v", "template", F.round(F.col("dot") / F.col("length"), DIGITS).alias("score")).where(F.col("score") >= least)


def _best(scored: DataFrame, keys: list[str]) -> DataFrame:
    best = F.min(F.struct((-F.col("score")).alias("s"), "line_no", "template")).alias("b")
    return scored.groupBy(*keys).agg(best).select(*keys, F.col("b.line_no").alias("line_no"), F.col("b.template").alias("template"), (-F.col("b.s")).alias("score"))


def directory(path: Column) -> Column:
    """Without the last part; the root is the empty string."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def resolved(files: DataFrame, found: DataFrame, license_file: str = LICENSE_FILE) -> DataFrame:
    """The columns of files and line_no, template, score, licensed_by (own file, or the directory it comes from), license."""
    on = "file" if "file" in files.columns else "path"
    license_of = F.regexp_replace(F.col("template"), "#[0-9a-z]+$", "")
    best = found.select("path", "template", "score").where(F.regexp_extract("path", "([^/]*)$", 1).rlike(license_file))
    given = best.select(directory(F.col("path")).alias("above"), F.struct((-F.col("score")).alias("s"), "path", license_of.alias("license")).alias("x"))
    # what directories give and get is stored, so that below both sides of a join are plain shuffles and Spark can split a hot one
    given = settled(given.groupBy("above").agg(F.min("x")["license"].alias("license")))
    dirs = files.select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    ancestors = dirs.select("dir", F.posexplode(F.array_distinct(up)).alias("depth", "above"))
    nearest = settled(ancestors.join(given, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "license")).alias("x")))
    own = files.join(found.select(on, "line_no", "template", "score"), on, "left").withColumn("dir", directory(F.col("path"))).join(nearest, "dir", "left")
    by = F.when(F.col("template").isNotNull(), F.lit("file")).when(F.col("x").isNotNull(), F.concat(F.lit("directory "), F.col("x.above")))
    return own.select(*files.columns, "line_no", "template", "score", by.alias("licensed_by"), F.coalesce(license_of, F.col("x.license")).alias("license"))


def document_path() -> Column:
    """Documents as a tree: source, thousands and fifties of ids; the first id of a fifty is the licence file."""
    part = lambda n: F.coalesce(F.floor(F.col("doc_id") / n).cast("string"), F.lit("none"))
    name = F.when(F.floor(F.col("doc_id") / 50) * 50 == F.col("doc_id"), F.lit("LICENSE")).otherwise(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    return F.concat_ws("/", F.coalesce(F.col("source"), F.lit("none")), part(1000), part(50), name)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without an id share a path, and so do repeated ids; their text tells them apart."""
    files = keyed(documents(spark, sf_dir, "doc_id", "text", "source").select("doc_id", document_path().alias("path"), text_or_empty().alias("text")))
    return resolved(files.drop("text"), scan(files.drop("doc_id"))).drop("file")


def _sql_values() -> tuple[str, str]:
    """Notices word by word, and the words of whole licences with their counts."""
    notices = ", ".join(f"('{name}', {i}, '{t}')" for name, text in named(TEMPLATES) for i, t in enumerate(re.findall("[a-z0-9]+", text.lower())))
    whole = ", ".join(f"('{name}', '{t}', {k})" for name, c in full_texts().items() for t, k in c.items())
    return notices, whole


_NOTICES, _WHOLE = _sql_values()
OP3_SQL = f"""
WITH place(template, i, term) AS (VALUES {_NOTICES}), whole(template, term, tf) AS (VALUES {_WHOLE}),
template AS (SELECT template, term, count(*) AS tf, true AS notice FROM place GROUP BY ALL UNION ALL SELECT template, term, tf, false FROM whole),
file AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS content, concat_ws('/', coalesce(source, 'none'), coalesce(CAST(doc_id // 1000 AS VARCHAR), 'none'),
    coalesce(CAST(doc_id // 50 AS VARCHAR), 'none'), CASE WHEN doc_id // 50 * 50 = doc_id THEN 'LICENSE' ELSE coalesce(CAST(doc_id AS VARCHAR), 'none') || '.txt' END) AS path FROM documents
), own AS (SELECT DISTINCT path, content, text FROM file),
cut AS (
  SELECT path, content, line_no, regexp_matches(line, '^\\s*(#|//|/?\\*|--|;|%|<!--)') AS comment, regexp_extract_all(lower(line), '[a-z0-9]+') AS w
  FROM (SELECT path, content, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM own)
), total AS (SELECT count(*) AS n FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM file) WHERE regexp_matches(lower(line), '[a-z0-9]')),
frequency AS (
  SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(line), '[a-z0-9]+'))) AS term FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM file)) GROUP BY term
), idf AS (
  SELECT term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT term FROM frequency UNION SELECT term FROM template) LEFT JOIN frequency USING (term) CROSS JOIN total
), side AS (
  SELECT template, term, notice, tf * idf AS weight, tf * idf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS share FROM template JOIN idf USING (term)
), strong AS (
  SELECT template, term FROM side WHERE notice
  QUALIFY sum(weight * weight) OVER (PARTITION BY template ORDER BY weight, term ROWS UNBOUNDED PRECEDING) >= pow({LEAST} * 0.999, 2) * sum(weight * weight) OVER (PARTITION BY template)
), token AS (
  SELECT path, content, line_no, term, row_number() OVER (PARTITION BY path, content ORDER BY line_no, k) - 1 AS i
  FROM (SELECT path, content, line_no, unnest(w) AS term, generate_subscripts(w, 1) AS k FROM cut)
), words AS (SELECT path, content, list(term ORDER BY i) AS w, list(line_no ORDER BY i) AS nos FROM token GROUP BY ALL),
run AS (
  SELECT *, sum(CASE WHEN len(w) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY path, content ORDER BY line_no) AS filled,
    sum(CASE WHEN comment THEN 0 ELSE 1 END) OVER (PARTITION BY path, content ORDER BY line_no) AS commented FROM cut
), start AS (
  SELECT DISTINCT path, content, token.i - place.i AS first, size FROM token JOIN place USING (term) JOIN strong USING (template, term)
  JOIN (SELECT template, count(*) AS size FROM place GROUP BY template) USING (template)
), unit AS (
  SELECT path, content, line_no, w, true AS notice FROM cut
  UNION ALL SELECT path, content, min(line_no), flatten(list(w ORDER BY line_no)), true FROM run WHERE len(w) > 0 GROUP BY path, content, filled HAVING count(*) > 1
  UNION ALL SELECT path, content, min(line_no), flatten(list(w ORDER BY line_no)), true FROM run WHERE comment GROUP BY path, content, commented HAVING count(*) > 1
  UNION ALL SELECT path, content, list_extract(nos, first + 1), list_slice(w, first + 1, first + size), true FROM start JOIN words USING (path, content) WHERE first >= 0 AND first + size <= len(w)
  UNION ALL SELECT path, content, 0, w, false FROM words WHERE regexp_matches(path, '(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([.-][a-z0-9.-]*)?$')
), numbered AS (SELECT *, row_number() OVER () AS u FROM unit),
term AS (SELECT u, term, count(*) AS tf FROM (SELECT u, unnest(w) AS term FROM numbered) GROUP BY ALL),
length AS (SELECT u, sqrt(sum(tf * idf * tf * idf)) AS length FROM term JOIN idf USING (term) GROUP BY u),
dot AS (SELECT u, template, side.notice AS notice, sum(tf * share) AS dot FROM term JOIN side USING (term) GROUP BY ALL),
scored AS (
  SELECT path, content, line_no, template, round(dot / length, {DIGITS}) AS score FROM dot JOIN length USING (u) JOIN numbered USING (u)
  WHERE dot.notice OR NOT numbered.notice
), best AS (
  SELECT * FROM scored WHERE score >= {LEAST} QUALIFY row_number() OVER (PARTITION BY path, content ORDER BY score DESC, line_no, template) = 1
), given AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS above, regexp_replace(template, '#[0-9a-z]+$', '') AS license
  FROM best WHERE path LIKE '%/LICENSE' QUALIFY row_number() OVER (PARTITION BY above ORDER BY score DESC, path, license) = 1
), up AS (
  SELECT DISTINCT path, unnest([regexp_replace(path, '/[^/]*$', ''), regexp_replace(path, '(/[^/]*){{2}}$', ''), regexp_replace(path, '(/[^/]*){{3}}$', ''), '']) AS above FROM file
), near AS (
  SELECT path, above, license FROM up JOIN given USING (above) QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(above) DESC) = 1
)
SELECT doc_id, path, CAST(line_no AS INTEGER) AS line_no, template, score,
  CASE WHEN template IS NOT NULL THEN 'file' WHEN near.above IS NOT NULL THEN 'directory ' || near.above END AS licensed_by,
  coalesce(regexp_replace(template, '#[0-9a-z]+$', ''), near.license) AS license
FROM file LEFT JOIN best USING (path, content) LEFT JOIN near USING (path)
"""
