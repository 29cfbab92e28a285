"""The corpus operators: edge cases, and brute force or the libraries themselves on small inputs."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from citemill.llm import encoding, fingerprints, language, licenses, matroska, near_duplicates, packing, registry, sentences, sharding, substrings, token_files
from citemill.llm.common import fresh_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the and of thing other little water under stone river mountain garden winter summer house people seven".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """id -> text: null, empty, blank, tiny, long, exact and near copies, shared passages, odd characters."""
    rng = random.Random(3)
    base, passage = words(rng, 300), words(rng, 60)
    near = base.split()
    near[100] = "changed"
    out = [None, "", " \t\n", "one", "1234 !!", base, base, " ".join(near), base.replace(" ", "\n", 40), words(rng, 20) + " " + passage, passage + " " + words(rng, 30), words(rng, 49), passage, words(rng, 5000)]
    out += ["日本語のテキスト и русский ещё", "İstanbul ﬁ Å é x", "a  b\n \nc\x1cd", "<|endoftext|> a's 12½", "😀 👍🏽 ▁mark", "x" * 3000]
    return dict(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    """The texts, a repeated row, a row without an id, and columns with the names that operators use inside."""
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in texts.items()]
    rows += [rows[5], (None, "no id at all", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("k", "row", "piece", "words", "payload", "key", "vslot", "n", "_k"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def sf(tmp_path_factory, docs):
    folder = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_table(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).collect() == []


def by_id(rows):
    return {r.doc_id: r for r in rows if r.doc_id is not None}


# ---- media


def test_media(spark, sf, texts):
    got = registry.QUERIES["op1_matroska"](spark, sf).collect()
    assert len(got) == len(texts) + 2 and {r.status for r in got} == {"ok"}
    for i, r in by_id(got).items():
        data = (texts[i] or "").encode()
        want = data + b"\0" * (max(64, math.ceil(len(data) / 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert json.loads(r.feature)["cues_hit"] == json.loads(r.feature)["cues"]


def element(n, body, unknown=False):
    return matroska._id(n) + (b"\x01" + b"\xff" * 7 if unknown else matroska._vint(len(body))) + body


@pytest.mark.parametrize("unknown", [False, True])
def test_foreign_files(unknown):
    m = matroska
    frames = [bytes([i]) * n for i, n in enumerate((300, 5, 700, 20))]
    blocks = [element(m.SIMPLE_BLOCK, m._vint(200) + b"\xff\xfe" + bytes([k << 1]) + m._laced(fs, k)) for k, fs in ((0, frames[:1]), (1, frames), (2, [b"ab", b"cd"]), (3, frames))]
    group = element(m.BLOCK_GROUP, element(m.BLOCK, m._vint(200) + b"\x00\x05\x00" + b"zz") + m._uint(m.BLOCK_DURATION, 7) + m._uint(m.REFERENCE, 1))
    void = element(0xEC, b"\0" * 9)
    cluster = element(m.CLUSTER, m._uint(m.TIMESTAMP, 100) + void + b"".join(blocks) + group, unknown)
    info = element(m.INFO, m._uint(m.TIMESTAMP_SCALE, 1000))
    file = element(m.EBML, element(m.DOC_TYPE, b"webm")) + element(m.SEGMENT, info + cluster + cluster + element(m.CUES, b""), unknown)
    got = m.parse(file)
    assert got.status == "ok" and len(got.clusters) == 2 and len(got.packets) == 24
    p = got.packets[:12]
    assert [file[x[3] : x[3] + x[4]] for x in p] == [frames[0], *frames, b"ab", b"cd", *frames, b"zz"]
    assert (p[0][0], p[0][1], p[-1][1], p[-1][2], p[-1][5]) == (200, 98_000, 105_000, 7_000, False)
    assert m.parse(file[:-30]).status.startswith(("damaged", "ok")) and m.parse(b"RIFF....").status != "ok" and m.parse(None).status == "empty"


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=9000), st.integers(0, 400))
def test_media_round_trip(data, cut):
    file = matroska.mux(matroska.padded(data))
    got = matroska.parse(file)
    assert got.status == "ok" and matroska.payload_of(file, got) == matroska.padded(data)
    assert matroska.parse(file[: len(file) - cut - 1]).status != "ok"  # and doesn't raise


def test_packet_table(spark, sf):
    rows = matroska.packet_table(matroska.store_texts(spark.read.parquet(f"{sf}/documents.parquet"), fields=("media",))).where("doc_id = 19").orderBy("timestamp_ns").collect()
    assert [r.timestamp_ns for r in rows] == [i * 64_000_000 for i in range(len(rows))] and sum(r["size"] for r in rows) == 3008


# ---- fingerprints


def test_fingerprints(spark, sf, texts):
    got = registry.QUERIES["op2_one_permutation"](spark, sf).collect()
    assert len(got) == len(texts) + 2
    rows = by_id(got)
    last = max(texts)
    order = sorted([*texts, 5], reverse=True)
    for i, r in rows.items():
        own = texts[i] or ""
        after = (texts[order[order.index(i) + (2 if i == 5 else 1)]] or "") if i else None
        if after is not None and i != 5:
            edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
            assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert rows[5].fingerprint == rows[6].fingerprint == rows[8].fingerprint and rows[0].fingerprint == rows[1].fingerprint
    assert rows[7].near_next > 0.95 and rows[13].near_next < 0.1
    assert next(r for r in got if r.doc_id is None).edited_sha256 == hashlib.sha256(("no id " + texts[last][:6]).encode()).hexdigest()


def test_fingerprint_likeness(spark):
    rng, rows, want = random.Random(1), [], []
    for _ in range(60):
        w = words(rng, 400).split()
        cut = rng.randint(0, 400)
        v = w[:cut] + words(rng, 400 - cut).split()
        a, b = ({tuple(x[i : i + 5]) for i in range(396)} for x in (w, v))
        rows.append((" ".join(w), " ".join(v)))
        want.append(len(a & b) / len(a | b))
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b")))).collect()]
    error = np.array(got) - np.array(want)
    assert abs(error.mean()) < 0.02 and error.std() < 0.05


def test_single_row_follows_itself(spark):
    df = spark.createDataFrame([(7, "abcd")], "doc_id long, text string")
    assert fingerprints.with_next(df, ["text"]).first().next_text == "abcd"


def test_many_runs(spark):
    df = spark.range(0, 3000, 3).selectExpr("id AS doc_id", "concat('t', id) AS text")
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(df, ["text"]).collect()}
    assert len(got) == 1000 and all(got[i] == f"t{i - 3 if i else 2997}" for i in got)


def test_ids_far_apart_and_hot(spark, monkeypatch):
    """Both ends of the range, an outlier, a doc_id that half of the rows have, and null: each row's next one by brute force."""
    monkeypatch.setattr(fingerprints, "RUN_ROWS", 8)
    monkeypatch.setattr(fingerprints, "BLOCK", 16)
    rows = [(i, f"t{i}") for i in range(400)] + [(77, f"hot{i}") for i in range(900)] + [(None, f"none{i}") for i in range(300)] + [(-(1 << 63), "least"), (9 * 10**18, "far"), ((1 << 63) - 1, "most")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))]
    made = fingerprints.with_next(df, ["text"])
    assert {r.text: r.next_text for r in made.collect()} == dict(zip(order, [*order[1:], order[0]], strict=True))
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 0.7 * len(rows)


def test_bins(spark):
    """Brute force: the least hash of each bin, the rest borrowed in the bin's own order."""
    rng = random.Random(6)
    texts = [words(rng, n) for n in (0, 3, 5, 30, 300, 2000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    steps, starts, _ = fingerprints._orders()
    for r in df.select(fingerprints.shingle_hashes(F.col("text")).alias("h"), fingerprints.fingerprint(F.col("text")).alias("f")).collect():
        least = {}
        for h in r.h:
            b = (h >> 64 - fingerprints.BIN_BITS) + fingerprints.BINS // 2
            least[b] = min(h, least.get(b, h))
        for b in range(fingerprints.BINS):
            own = b if b in least else next(j for t in range(fingerprints.BINS) if (j := (steps[b] * t + starts[b]) % fingerprints.BINS) in least)
            assert r.f[b] == least[own] % 256


# ---- licences


def test_licenses(spark):
    rows = [
        ("a/LICENSE", "x\nReleased under the MIT License."), ("a/b/c.txt", "code"), ("a/b/LICENSE.md", "nothing here"), ("a/b/d/e.py", "SPDX-License-Identifier: Apache-2.0"),
        ("z/f.txt", "code"), ("COPYING", "This work is licensed under the GNU General Public License, version 3."), ("n.txt", None), ("a/LICENSE", "x\nReleased under the MIT License."),
    ]
    files = spark.createDataFrame(rows, "path string, text string")
    found = licenses.scan(files.distinct())
    got = {r.path: (r.license, r.licensed_by) for r in licenses.resolved(files.select("path").distinct(), found).collect()}
    assert got["a/LICENSE"] == ("MIT", "file") and got["a/b/c.txt"] == ("MIT", "directory a") and got["a/b/d/e.py"] == ("Apache-2.0", "file")
    assert got["z/f.txt"] == ("GPL-3.0", "directory ") and got["n.txt"] == ("GPL-3.0", "directory ")


def brute_licenses(rows):
    """Best (line, template, score) by path: all lines, runs, comment blocks, windows and licence files against all templates."""
    tokens = lambda x: re.findall("[a-z0-9]+", x.lower())
    cut = {p: [(k, x, tokens(x)) for k, x in enumerate((t or "").split("\n"))] for p, t in rows}
    lines_ = [w for own in cut.values() for _, _, w in own if w]
    df = Counter(w for v in lines_ for w in set(v))
    idf = lambda w: math.log((len(lines_) + 1) / (df[w] + 1)) + 1
    size = lambda v: math.sqrt(sum((k * idf(w)) ** 2 for w, k in v.items()))
    notices = dict(licenses.named(licenses.TEMPLATES))
    strong = {n: licenses.strong_words({w: k * idf(w) for w, k in Counter(tokens(t)).items()}) for n, t in notices.items()}
    out = {}
    for p, own in cut.items():
        units = [(k, w, False) for k, _, w in own]
        for inside in (lambda x: bool(x[2]), lambda x: re.match(licenses.COMMENT, x[1])):
            run = []
            for x in [*own, (-1, "", [])]:
                if inside(x):
                    run.append(x)
                else:
                    units += [(run[0][0], sum((y[2] for y in run), []), False)] if len(run) > 1 else []
                    run = []
        flat = [(k, w) for k, _, ws in own for w in ws]
        for n, t in notices.items():
            for place, anchor in enumerate(tokens(t)):
                if anchor in strong[n]:
                    for i, (_, w) in enumerate(flat):
                        first, last = i - place, i - place + len(tokens(t))
                        if w == anchor and first >= 0 and last <= len(flat):
                            units.append((flat[first][0], [x for _, x in flat[first:last]], False))
        if re.match(licenses.LICENSE_FILE, p.split("/")[-1]):
            units.append((0, [w for _, w in flat], True))
        for k, w, whole in units:
            for n, c in [*((n, Counter(tokens(t))) for n, t in notices.items()), *(licenses.full_texts().items() if whole else ())]:
                v = Counter(w)
                score = round(sum(v[x] * m * idf(x) ** 2 for x, m in c.items()) / size(v) / size(c), licenses.DIGITS) if w else 0
                if score >= licenses.LEAST:
                    out[p] = min(out.get(p, (0, 0, "")), (-score, k, n))
    return {p: (k, n, round(-x, 5)) for p, (x, k, n) in out.items()}


def test_licenses_by_brute_force(spark):
    """Words that every line has must not weigh like rare ones; notices wrapped, within lines, and across blocks."""
    notice = "# Copyright 2021 Acme Corp. Licensed under the Apache License, Version 2.0"
    wrapped = "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */\nint x;"
    rows = [(f"f{i}.txt", f"# copyright 2021 of the acme corp {i}\nplain line {i % 7} of the project") for i in range(60)]
    rows += [("n.py", notice), ("e.txt", ""), ("z.txt", None), ("w.c", wrapped), ("LICENSE", "MIT License\n\n" + licenses.TEMPLATES[-1][1].replace(", ", ",\n"))]
    rows += [("long.txt", "some words before it " * 9 + "released under the MIT License. " + "and more behind " * 9), ("two.txt", "released under\n\nthe mit license")]
    got = {r.path: (r.line_no, r.template, round(r.score, 5)) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    want = brute_licenses(rows)
    assert got == want and {"n.py", "w.c", "LICENSE", "long.txt", "two.txt"} <= set(want)


def test_license_notices_beyond_lines(spark):
    import textwrap

    by = {f"{name}#{i:02d}": t for i, (name, t) in enumerate(licenses.TEMPLATES)}
    rows, want = [(f"x{i}.txt", f"plain words of file number {i}\nand the second line") for i in range(100)], {}
    for name, text in by.items():
        for width in (40, 50, 60):
            path = f"{name}/{width}.py"
            rows.append((path, "import os\n# Copyright Acme\n" + "\n".join("# " + x for x in textwrap.wrap(text, width)) + "\ncode = 1"))
            want[path] = name.split("#")[0]
        rows.append((f"{name}/long.txt", "well " * 80 + text + " and so on" * 60))
        want[f"{name}/long.txt"] = name.split("#")[0]
    got = {r.path: r.template.split("#")[0] for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == want


def test_license_files_whole(spark):
    """A text with the word counts of a whole licence, one word a line."""
    rows = [(f"{name}/{kind}", "\n".join(t for t, k in c.items() for _ in range(k))) for name, c in licenses.full_texts().items() for kind in ("LICENSE", "other.txt")]
    got = {r.path: r.template for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert all(got[f"{name}/LICENSE"] == name for name in licenses.full_texts())
    assert not any(t.endswith("#full") for p, t in got.items() if p.endswith("other.txt"))


def test_license_files_of_one_path(spark, tmp_path):
    """Texts without an id, and a repeated id: lines of different documents are no one line."""
    rows = [(None, f"other words {i} stand here in this line of text number {i}", "en", "s", 1) for i in range(30)]
    rows += [(None, "Licensed under CC BY 4.0", "en", "s", 1), (7, "Released under the MIT License.", "en", "s", 1), (7, "nothing", "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.license, r.licensed_by) for r in registry.QUERIES["op3_license_scan"](spark, str(tmp_path)).collect())
    assert got == {(None, None, None): 30, (None, "CC-BY-4.0", "file"): 1, (7, "MIT", "file"): 1, (7, None, None): 1}


def test_strong_words_lose_nothing():
    rng = random.Random(2)
    weights = {w: rng.random() * 5 for w in WORDS}
    strong = licenses.strong_words(weights)
    weak = sum(w * w for t, w in weights.items() if t not in strong)
    assert math.sqrt(weak / sum(w * w for w in weights.values())) < licenses.LEAST


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    q = c.sql(registry.ORACLE_SQL[name])
    mine = registry.QUERIES[name](spark, SF).select(*q.columns).collect()
    assert sorted(map(tuple, mine), key=repr) == sorted(q.fetchall(), key=repr)


# ---- substrings


def brute_substrings(texts, window=50):
    split = {i: (t or "").encode().split() for i, t in texts.items()}
    first = {}
    for i in sorted(split):
        for j in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][j : j + window]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    return out


def test_substrings(spark, sf, texts):
    got = registry.QUERIES["op4_super_kmers"](spark, sf).collect()
    assert len(got) == len(texts) + 2
    assert {i: tuple(r)[1:] for i, r in by_id(got).items()} == brute_substrings(texts)
    assert next(r for r in got if r.doc_id is None).n_removed == 0


def test_hot_minimisers(spark, monkeypatch):
    """Groups split by a second minimiser, and sorted in many parts, give the same."""
    rng = random.Random(9)
    line = words(rng, 70)
    texts = {i: words(rng, rng.randint(0, 60)) + " " + line + " " + words(rng, rng.randint(0, 60)) for i in range(40)}
    texts |= {100 + i: "same " * 120 + words(rng, 3) for i in range(3)}
    monkeypatch.setattr(substrings, "HOT", 2)
    monkeypatch.setattr(substrings, "SORTED", 1000)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = substrings.dedup_substrings(df).collect()
    want = brute_substrings(texts)
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got} == want


def test_names_of_several_minimisers(spark, monkeypatch):
    """Names that collide between minimisers are told apart: here few are left, none of which collide under one minimiser."""
    rng = random.Random(12)
    line = words(rng, 90)
    texts = {i: words(rng, 90) + " " + (line if i % 2 else "") for i in range(30)}
    whole = substrings.super_kmers
    names = whole(*substrings.word_hashes([t.encode() for t in texts.values()]))
    real = set(zip(names[3].tolist(), names[4].tolist(), strict=True))
    apart = lambda mask: len({(m, n & mask) for m, n in real}) == len(real) > 1.3 * len({n & mask for _, n in real})
    kept = next(np.uint64(63 << i) for i in range(58) if apart(63 << i))

    def few_names(*args):
        text, start, count, least, name = whole(*args)
        return text, start, count, least, name & kept

    monkeypatch.setattr(substrings, "super_kmers", few_names)
    got = substrings.dedup_substrings(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got} == brute_substrings(texts)


def test_layout_stays(spark):
    rng = random.Random(13)
    line = words(rng, 60)
    rows = [(1, f"one\n{line}\ntwo"), (2, f"  head\n\n{line}\n\ttail \n"), (3, None), (4, " \n")]
    got = {r.doc_id: r.kept for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), layout=True).collect()}
    assert got == {1: rows[0][1], 2: "  head\n\ntail \n", 3: "", 4: " \n"}


def alternating(n, one="A", two="B"):
    return "".join((one, two)[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("size", [512, 1024, 2048, 4096])
def test_long_words_that_alternate(spark, size):
    """Words that a polynomial hash modulo 2**64 takes for one."""
    a, b = alternating(size), alternating(size, "B", "A")
    hashes = substrings.word_hashes([f"{a} {b} {a}".encode()])[0]
    assert hashes[0] == hashes[2] != hashes[1]
    rng = random.Random(14)
    before, after = words(rng, 30), words(rng, 30)
    texts = {1: f"{before} {a} {after}", 2: f"{before} {b} {after}"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.dedup_substrings(df).collect()} == {1: 0, 2: 0}
    assert near_duplicates.similarity(*(near_duplicates._bag(t) for t in texts.values())) == pytest.approx(52 / 62)


def test_words_that_alternate(spark):
    """Texts of two words that alternate in the same way have the same minimisers, and are not one super-k-mer."""
    texts = {1: " ".join(alternating(1500)), 2: " ".join(alternating(1500, "B", "A")), 3: " ".join(alternating(700))}
    names = [set(substrings.super_kmers(*substrings.word_hashes([t.encode()]))[4].tolist()) for t in texts.values()]
    assert not names[0] & names[1]
    got = substrings.dedup_substrings(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got} == brute_substrings(texts)


def test_range_hashes():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, 300).astype(np.uint64)
    start = rng.integers(0, 200, 500)
    size = rng.integers(1, 100, 500)
    seen = {}
    for s, n, h in zip(start.tolist(), size.tolist(), substrings.range_hashes(x, start, size).tolist(), strict=True):
        assert seen.setdefault(h, x[s : s + n].tolist()) == x[s : s + n].tolist()
    assert len({tuple(v) for v in seen.values()}) == len(seen)


def test_rows_that_share_an_id(spark):
    """Each is judged by its own text, and never against the others; equal rows send their words once."""
    rng = random.Random(21)
    line, other = words(rng, 70), words(rng, 80)
    rows = [(5, line + f" end{i}") for i in range(30)] + [(5, other)] * 20 + [(7, line), (7, other), (7, words(rng, 60)), (3, other + " tail")]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(5, 71, 0): 30, (5, 80, 80): 20, (7, 70, 70): 1, (7, 80, 80): 1, (7, 60, 0): 1, (3, 81, 0): 1})


def test_first_holders():
    rng = random.Random(4)
    strings = [" ".join(rng.choice("ab") for _ in range(rng.randint(7, 30))).encode() for _ in range(30)]
    keys = np.array([rng.randint(0, 9) for _ in strings])
    least = {}
    for s, k in zip(strings, keys, strict=True):
        w = s.split()
        for j in range(len(w) - 6):
            least[tuple(w[j : j + 7])] = min(k, least.get(tuple(w[j : j + 7]), 99))
    for s, runs in zip(strings, substrings.first_holders(strings, keys, 7), strict=True):
        w = s.split()
        assert [least[tuple(w[j : j + 7])] for j in range(len(w) - 6)] == [k for a, z, k in runs for _ in range(a, z)]


# ---- languages


def test_languages(spark, sf):
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the house and the river of stones", "en"), ("das Haus und der Fluss mit Steinen", "de"), ("ночь и улица и фонарь", "ru"), (None, "en"), ("unlabelled", None)] * 5)], "doc_id long, text string, lang string")
    model = language.train(df)
    assert model.languages == ("de", "en", "ru")
    mixed = "the house and the river of stones and the house of stones das Haus und der Fluss mit Steinen und das Haus mit dem Fluss ночь улица"
    got = language.predict(spark.createDataFrame([(1, mixed), (2, None), (3, "12 !"), (4, "фонарь")], "doc_id long, text string"), model).collect()
    rows = by_id(got)
    assert [s.lang for s in rows[1].spans] == ["en", "de", "ru"] and mixed[rows[1].spans[2].start : rows[1].spans[2].end] == "ночь улица"
    assert (rows[2].lang_pred, rows[2].score) == (rows[3].lang_pred, rows[3].score) == (language.UND, 0.0)
    assert rows[4].lang_pred == "ru"
    everything = registry.QUERIES["op5_language_spans"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in everything if r.doc_id is not None)


def test_held_out_accuracy(spark):
    rows = registry.QUERIES["op5_language_spans"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_equal_languages_rank_by_name(spark):
    model = language.train(spark.createDataFrame([(1, "same words here", "xx"), (2, "same words here", "aa")], "doc_id long, text string, lang string"))
    assert language.identify(["same words"], model)[0] == ["aa"]


def test_gathered_and_sliced_batches():
    import pyarrow as pa

    from citemill.llm import common

    rng = random.Random(15)
    parts = [pa.RecordBatch.from_pydict({"i": list(range(k, k + n)), "t": ["x" * rng.randint(0, 9000) for _ in range(n)]}, pa.schema([("i", pa.int64()), ("t", pa.string())])) for k, n in ((0, 700), (700, 0), (700, 900), (1600, 900), (2500, 3))]
    joined = list(common.gathered(iter(parts)))
    assert [b.num_rows for b in joined][0] >= 1600 and [i for b in joined for i in b.column(0).to_pylist()] == list(range(2503))
    cut = [x for b in joined for x in common.sliced(b)]
    assert [i for b in cut for i in b.column(0).to_pylist()] == list(range(2503)) and max(b.num_rows for b in cut) <= common.ARROW_ROWS and max(b.nbytes for b in cut) < 2 * common.ARROW_BYTES
    assert list(common.gathered(iter([]))) == []


def test_parts_of_long_texts(spark, monkeypatch):
    """Cutting texts for memory changes nothing."""
    rng = random.Random(14)
    rows = [(i, words(rng, 50), "en") for i in range(20)] + [(50 + i, "das kleine Wasser und der große Fluß im Garten", "de") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    sample = [words(rng, 3000) + " das Wasser und der Fluß " * 40, "", "x" * 5000, "12 " * 3000, words(rng, 10)]
    whole = language.identify(sample, model)
    monkeypatch.setattr(language, "PART", 100)
    monkeypatch.setattr(language, "GROUP", 1000)
    assert language.identify(sample, model) == whole and len(whole[2][0]) == 2
    cut = language.train(df)
    assert cut.languages == model.languages and np.array_equal(cut.table, model.table)


def test_training_rows_are_bounded(spark):
    """Null and repeated ids don't fill the sample."""
    rows = [(i if i % 2 else None, f"das kleine wasser {i} und mehr", "de") for i in range(1500)] + [(7, f"the little water {i} and more", "en") for i in range(1000)] + [(None, "gleich", "de")] * 1500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trained = df.where("lang is not null").select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h")).where(F.pmod("h", F.lit(1 << 30)) < int(100 / 4000 * (1 << 30)))
    assert 20 < trained.distinct().count() < 160
    model = language.train(df, rows=100)
    assert model.languages == ("de", "en")


def test_too_many_languages(spark):
    rows = [(i, "text", f"l{i}") for i in range(language.LANGUAGES + 1)]
    with pytest.raises(ValueError):
        language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_viterbi():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 7, 3, 12]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(0, 3, (bounds[-1], 3)).astype(np.float32)
    got = language.viterbi(scores, bounds, 4.0)
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        import itertools

        if z - a <= 7:
            value = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 4.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))  # noqa: B023, E731
            best = max(itertools.product(range(3), repeat=int(z - a)), key=value, default=())
            assert abs(value(tuple(got[a:z])) - value(best)) < 1e-3


# ---- sharding


def test_sharding(spark, sf, texts):
    got = registry.QUERIES["op6_virtual_slots"](spark, sf).collect()
    assert len(got) == len(texts) + 2 and {r.law for r in got} == {"bytes"}
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
        assert r["size"] == 16 + len((texts[r.doc_id] or "").encode() if r.doc_id is not None else b"no id at all")
    assert all(sorted(x) == list(range(len(x))) for x in per.values()) and set(per) <= set(range(40))


def test_sharding_of_documents(spark):
    """Checksums, sizes, and the law: shards of near equal bytes; the larger table has more rows than shards by far."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    total, places = Counter(), defaultdict(list)
    for r in registry.QUERIES["op6_virtual_slots"](spark, sf).collect():
        data = (texts[r.doc_id] or "").encode()
        assert (r.text_crc32, r["size"], r.grown_shard) == (zlib.crc32(data), len(data) + 16, None)
        total[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert len(total) == 40 and max(total.values()) - min(total.values()) < 0.005 * sum(total.values()) / 40
    assert all(sorted(x) == list(range(len(x))) for x in places.values())


def test_repeated_rows_get_places(spark, tmp_path):
    spark.createDataFrame([(7, "same", None, None, 4)] * 5 + [(None, "none", None, None, 4)] * 3, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = defaultdict(list)
    for r in registry.QUERIES["op6_virtual_slots"](spark, str(tmp_path)).collect():
        got[r.shard].append(r.slot)
    assert sum(map(len, got.values())) == 8 and max(map(len, got.values())) >= 5 and all(sorted(x) == list(range(len(x))) for x in got.values())


def test_law_holds_without_ids(spark, tmp_path):
    rows = [(i if i % 3 else None, "equal text of some length", None, None, 4) for i in range(9000)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    total, places = Counter(), defaultdict(list)
    for r in registry.QUERIES["op6_virtual_slots"](spark, str(tmp_path)).collect():
        total[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert len(total) == 40 and max(total.values()) - min(total.values()) <= 0.02 * sum(total.values()) / 40
    assert all(sorted(x) == list(range(len(x))) for x in places.values())


def test_slot_maps(spark):
    rng = random.Random(1)
    load = [rng.randint(0, 1000) for _ in range(sharding.SLOTS)]
    first = sharding.SlotMap.first(40)
    even = first.edited(load)
    total = [0] * 40
    for s, k in enumerate(even.shard):
        total[k] += load[s]
    assert max(total) - min(total) <= 1 and even.version == 2
    assert sum(a != b for a, b in zip(first.shard, even.shard, strict=True)) < sharding.SLOTS / 2
    more = even.edited(load, 41)
    assert max(more.shard) == 40 and more.version == 3
    path = fresh_path(spark, "maps")
    for m in (first, even, more):
        sharding.save_map(spark, m, path)
    assert sharding.load_map(spark, path, 2) == even


# ---- near duplicates


def brute_classes(texts):
    bags = {}
    for i, t in texts.items():
        w = (t or "").encode().split()
        bags[i] = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in texts:
        for j in texts:
            if i < j:
                both = sum((bags[i] & bags[j]).values())
                if both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in texts}


def test_near_duplicates(spark, sf, texts):
    got = registry.QUERIES["op7_bag_min_hash"](spark, sf).collect()
    assert {i: r.class_id for i, r in by_id(got).items()} == brute_classes(texts)
    missing = next(r for r in got if r.doc_id is None)
    assert missing.class_id is None and missing.stays
    kept = near_duplicates.dedup_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    assert Counter(r.doc_id for r in kept.collect()) == Counter([None, *[i for i, c in brute_classes(texts).items() if i == c]])


def test_near_duplicates_of_all_documents(spark):
    """The classes of a whole table against all of its pairs: overlaps are summed up by shared shingles."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bags, holders = {}, defaultdict(list)
    for i, t in texts.items():
        w = (t or "").encode().split()
        bags[i] = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
        for x, n in bags[i].items():
            holders[x].append((i, n))
    both = Counter()
    for own in holders.values():
        for k, (i, n) in enumerate(own):
            for j, m in own[k + 1 :]:
                both[i, j] += min(n, m)
    parent, size = {i: i for i in texts}, {i: sum(b.values()) for i, b in bags.items()}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = [p for p, n in both.items() if n >= 0.8 * (size[p[0]] + size[p[1]] - n)]
    for i, j in pairs:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in registry.QUERIES["op7_bag_min_hash"](spark, sf).collect()}
    assert len(pairs) > 50 and got == {i: root(i) for i in texts}


def test_edits_of_one_text(spark):
    rng = random.Random(8)
    base = words(rng, 200).split()
    texts = {}
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(200)] = f"edit{rng.random()}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.k: r.class_id for r in near_duplicates.near_duplicate_classes(df).collect()} == brute_classes(texts)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    hits, want = [], []
    for _ in range(25):
        n = 40
        a, b = rng.integers(0, 12, n), rng.integers(0, 12, n)
        shingles = rng.integers(0, 2**63, n).astype(np.uint64)
        text = np.repeat([0, 1], [int((a > 0).sum()), int((b > 0).sum())])
        s = near_duplicates.signatures(text, np.concatenate([shingles[a > 0], shingles[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 400)
        hits.append((s[0] == s[1]).mean())
        want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(np.array(hits) - np.array(want))) < 0.02


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in parent if root(i) != i}


def test_scripts_of_no_language(spark):
    """Unlabelled texts in a script that no labelled row has."""
    rows = [(i, f"das kleine wasser und der berg {i} im garten", "de") for i in range(40)] + [(100 + i, f"the little water and the mountain {i} in a garden", "en") for i in range(40)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    langs, scores, spans = language.identify(["日本語のテキスト", "Ελληνικά", "the garden 日本", "the little garden and the water", ""], model)
    assert langs == ["de", "de", "en", "en", "und"]  # only a text without letters is of no language; the score says the rest
    assert scores == [0.0, 0.0, pytest.approx(9 / 11), 1.0, 0.0]
    assert spans == [[], [], [{"lang": "en", "start": 0, "end": 10}], [{"lang": "en", "start": 0, "end": 31}], []]
    docs = spark.createDataFrame([(*r, "s", len(r[1])) for r in [*rows, (900, "日本語のテキスト", None)]], SCHEMA)
    assert 900 not in {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()}


# ---- packing, token files, pieces


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(name, texts, monkeypatch):
    rng = random.Random(7)
    odd = ["".join(rng.choice("ab 's\n\t  .,1é½\x85\xa0İ'") for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    bits = ["'", "'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "s", "re", " ", "  ", "\n", "\r\n", "\x0b", "B", "à", "ß", "ǆ", "1", "23", "²", "ª", "×", "_", "-", "!!", "€", "日", "\x1f", "\x00", "<|endoftext|>", "<|STARTOFTEXT|>", "x" * 300]
    odd += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    given_texts = [t or "" for t in texts.values()] + odd + [" ", "a\n \nb", "a   b ", "\n\n x", "’s it's'LL", "​"]
    library, own = tokenizer(name), encoding.Encoder(public_tokenizers.path(name))
    monkeypatch.setattr(encoding, "REMEMBERED", 500)
    for a in range(0, len(given_texts), 300):
        part = given_texts[a : a + 300]
        ids, at = own.encode(part, end=7)
        for i, t in enumerate(part):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids + [7], t


def test_other_tokenizers_take_texts_whole(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({"a": 0, "b": 1, "c": 2, "?": 3}, unk_token="?"))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    made.save(str(tmp_path / "words.json"))
    ids, at = encoding.Encoder(str(tmp_path / "words.json")).encode(["a b\x1fc", "", "c d"], end=9)
    assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [made.encode("a b\x1fc").ids + [9], [9], [2, 3, 9]]


def test_packing(spark, sf, texts):
    rows = registry.QUERIES["op8_minimum_bin_slack"](spark, sf).collect()
    library, per = tokenizer("byte_bpe_50k.json"), defaultdict(list)
    for r in rows:
        per[r.sequence_id].append((r.offset, r.length))
    for parts in per.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    for i, t in texts.items():
        if i == 5:
            continue
        ids, at = library.encode(t or "", add_special_tokens=False).ids + [2], 0
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert len(own) == math.ceil(len(ids) / 1024)
        for k, r in enumerate(own):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            assert k == 0 or r.length == 1024
            at += r.length
        assert at == len(ids)


def test_sequences(spark):
    df = spark.createDataFrame([(i, words(random.Random(i), 20 * i)) for i in range(30)], "doc_id long, text string")
    parts = packing.pieces(df, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True).cache()
    done = packing.sequences(packing.packed(parts)).collect()
    assert all(len(r.input_ids) == r.n_tokens <= 1024 for r in done) and sum(r.n_tokens for r in done) == parts.agg(F.sum("length")).first()[0]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=9), st.integers(0, 60))
def test_fullest(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
    got = packing.fullest(room, counts)
    assert sum(n * k for n, k in got) == max(sums) and all(k <= counts[n] for n, k in got)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=12))
def test_plan(counts):
    runs, used, fill = packing.plan(counts, 64), Counter(), Counter()
    for r in runs:
        used[r.length] += r.last - r.first
        for s in range((r.last - r.first) // r.per):
            fill[r.sequence + s] += r.per * r.length
    assert used == Counter(counts) and max(fill.values(), default=0) <= 64
    assert len(fill) <= 2 * sum(n * c for n, c in counts.items()) / 64 + 1  # two sequences hold more than one's capacity together


def test_token_files(spark, sf, texts):
    rows = registry.QUERIES["op9_token_files"](spark, sf).collect()
    library, at = tokenizer("word_bpe_49k.json"), 0
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in rows))
    order = [(False, 0, "no id at all"), *[(True, i, t) for i, t in sorted([*texts.items(), (5, texts[5])], key=lambda x: x[0])]]
    for (known, i, t), row in zip(order, got, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert row == (known, i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_with_ids(spark):
    df = spark.createDataFrame([(i, f"word{i} " * i) for i in range(50)], "doc_id long, text string")
    folder = fresh_path(spark, "tokens")
    shards = token_files.write_tokens(df, folder, public_tokenizers.path("word_bpe_49k.json"), dtype="<u4", shards=7)
    rows = token_files.read_tokens(spark, folder, with_ids=True).collect()
    assert len(shards) > 1 and all(len(r.ids) == r.n_tokens and r.ids[-1] == 1 for r in rows) and len(rows) == 50


def test_ids_beyond_16_bits(spark):
    df = spark.createDataFrame([(1, "one"), (2, None)], "doc_id long, text string")
    path, folder = public_tokenizers.path("word_bpe_49k.json"), fresh_path(spark, "tokens")
    token_files.write_tokens(df, folder, path, end_id=70_000)
    assert [r.ids[-1] for r in token_files.read_tokens(spark, folder, with_ids=True).collect()] == [70_000, 70_000]
    assert token_files.narrowest(path) == "<u2"
    with pytest.raises(Exception, match="does not fit"):
        token_files.write_tokens(df, fresh_path(spark, "tokens"), path, dtype="<u2", end_id=70_000)


def test_rows_of_one_key_are_dealt(spark):
    df = spark.createDataFrame([(None, f"text number {i}") for i in range(400)], "doc_id long, text string")
    folder = fresh_path(spark, "tokens")
    shards = token_files.write_tokens(df, folder, public_tokenizers.path("word_bpe_49k.json"), shards=6)
    assert len(shards) > 3 and sum(s["n_docs"] for s in shards) == 400
    rows = sorted((r.start, r.n_tokens) for r in token_files.read_tokens(spark, folder).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:], strict=False))


def test_pieces_equal_the_library(spark, sf, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(11)
    sample = [t or "" for t in texts.values()] + ["".join(rng.choice("abcdefgh etnoia.,-'éü\n0123ABC   ▁") for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    own = sentences.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    ids, at = own.encode(sample)
    wanted = library.encode(sample)
    assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)] == wanted
    assert own.decode(ids, at) == library.decode(wanted)
    rows = by_id(registry.QUERIES["op10_shared_prefix"](spark, sf).collect())
    for i, t in texts.items():
        assert (rows[i].n_ids, rows[i].ids_crc32) == (len(library.encode(t or "")), zlib.crc32(np.array(library.encode(t or ""), "<u4").tobytes()))
        assert rows[i].text_sha256 == hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abc", max_size=9), max_size=8))
def test_unigram_pieces(given_words):
    rng = random.Random(5)
    names = [a + b + c for a in "abc" for b in ["", *"abc"] for c in ["", "a", "c"]][:30]
    scores = {n: -rng.random() * 8 for n in dict.fromkeys(names) if n != "b"}
    own = sentences.Pieces([("<unk>", 0.0, sentences.UNKNOWN), *[(n, s, sentences.NORMAL) for n, s in scores.items()]], sentences.UNIGRAM, False)

    def best(word):
        if not word:
            return 0.0
        cuts = [scores.get(word[:n], own.low if n == 1 else None) for n in range(1, len(word) + 1)]
        return max(s + best(word[n:]) for n, s in enumerate(cuts, 1) if s is not None)

    for word, pieces in own.segments(sorted(set(given_words))):
        assert "".join(pieces) == word and abs(sum(scores.get(p, own.low) for p in pieces) - best(word)) < 1e-9


# ---- the pipeline


def test_pipeline(spark, sf, texts):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf).cache()
        kept.append({r.doc_id for r in df.select("doc_id").collect()})
        if name != "packing":
            assert df.columns == corpus_pipeline.COLUMNS
    assert {0, 1, 2, 4}.isdisjoint(kept[0]) and {3, 5, 6, 9, 11, 13, None} <= kept[0]
    assert 6 not in kept[1] and 7 not in kept[1] and {5, 9, 10, 11, 13} <= kept[1]
    assert 12 not in kept[2] and {5, 9, 10, 11, 13} <= kept[2] == kept[3]
    assert corpus_pipeline.run(spark, sf).count() == df.count()


def test_pipeline_stages_by_brute_force(spark, sf, texts):
    """Each stage on what its predecessor kept: classes over all pairs, windows by hand, and the library's own ids."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(df)
    named = corpus_pipeline.identify_language(spark, df, sf).cache()
    found = language.identify([t or "" for t in texts.values()], model)
    kept = {i for i, lang, share in zip(texts, *found[:2], strict=True) if lang != language.UND and share >= corpus_pipeline.LEAST_SHARE}
    one = {r.doc_id: r.text for r in named.collect() if r.doc_id is not None}
    assert set(one) == kept and all(one[i] == texts[i] for i in one)

    unique = corpus_pipeline.drop_near_duplicates(spark, named, sf).cache()
    two = {r.doc_id: r.text for r in unique.collect() if r.doc_id is not None}
    assert two == {i: one[i] for i, c in brute_classes(one).items() if i == c}

    short = corpus_pipeline.drop_repeated_passages(spark, unique, sf).cache()
    three = {r.doc_id: r.text for r in short.collect() if r.doc_id is not None}
    cut = brute_substrings(two)
    assert set(three) == {i for i, (n, gone, _) in cut.items() if gone < n or not gone}
    assert all(hashlib.sha256(b" ".join(t.encode().split())).hexdigest() == cut[i][2] for i, t in three.items())

    library, pieces, rooms = tokenizer("byte_bpe_50k.json"), defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.pack(spark, short, sf).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
        rooms[r.sequence_id].append((r.offset, r.length))
    for i, t in three.items():
        ids, at = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4"), 0
        for start, length, crc in sorted(pieces[i]):
            assert start == at and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    for held in rooms.values():
        ends = [0, *np.cumsum([n for _, n in sorted(held)]).tolist()]
        assert [a for a, _ in sorted(held)] == ends[:-1] and ends[-1] <= packing.CAPACITY


def test_pipeline_leaves_clean_texts_alone(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, 80).replace(" ", "\n", 9), "en", "s", 1) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, "").cache()
    assert {r.doc_id: r.text for r in df.collect()} == {r[0]: r[1] for r in rows}
