"""Detection, lists, aliases, HTML, linked data on small inputs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citemill.operators import alias, detect, html, lists, nodes, resolve, works
from citemill.options import Aliases
from citemill.plans import builtin
from citemill.plans.rules import Rule, View, compile_rules
from citemill.sources import readers
from citemill.streaming import extract


def found(spark, text, **more):
    return [(r.position, r.match) for r in detect.scan(readers.from_text(spark, text), builtin.rule_set(), **more).orderBy("position").collect()]


def test_positions(spark):
    assert found(spark, "AC-12/10 C-12/10, OJ L 119, 4.5.2016 and T-36/04") == [(9, "C-12/10"), (18, "OJ L 119, 4.5.2016"), (41, "T-36/04")]
    assert found(spark, "😀 C-1/10\nC-2/10") == [(2, "C-1/10"), (9, "C-2/10")]
    assert found(spark, "") == [] and found(spark, "\x01C-1/10\x02") == [(1, "C-1/10")]


def test_both_scans_agree(spark):
    rng = random.Random(5)
    parts = ["C-12/10", "T-3/99", "Regulation (EU) 2016/679", "OJ L 1, 2.3.2004", " ", "\n", "x", "é", "😀", "/", "ECLI:EU:C:2011:1", "32016R0679", ", "]
    docs = spark.createDataFrame([(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(800)], "doc_id long, text string")
    one = detect.scan(docs, builtin.rule_set(), cursor=False).select("doc_id", "position", "match", "rule")
    two = detect.scan(docs, builtin.rule_set(), cursor=True).select("doc_id", "position", "match", "rule")
    a, b = sorted(map(tuple, one.collect())), sorted(map(tuple, two.collect()))
    assert a == b and len(a) > 400
    texts = dict(map(tuple, docs.collect()))
    assert all(texts[d][p : p + len(m)] == m for d, p, m, _ in a)


def test_guards_change_nothing(spark):
    text = "Regulation (EU) 2016/679 and C-1/10"
    full = builtin.rule_set()
    opened = detect.guarded(readers.from_text(spark, text), full).first().open_types
    assert {"act", "case", "celex"} <= set(opened) and "oj" not in opened
    assert found(spark, text) == [(0, "Regulation (EU) 2016/679"), (29, "C-1/10")]


def test_mentions_and_views(spark):
    rows = detect.mentions(readers.from_text(spark, "Directive (EU) 2016/680 in C-5/09, Verordnung (EU) Nr. 345/2013"), builtin.rule_set()).orderBy("position").collect()
    assert [(r.rule_type, r.alternatives[0].attrs) for r in rows] == [("act", {"data-celex": "32016L0680"}), ("case", {"data-celex": "62009CJ0005"})]


def test_skip_and_strict(spark):
    rules = compile_rules([Rule("x", pattern=r"(?:\d )?\d+/\d+", skip_pattern=r"^\d ", views=(View("p", "$0"),))])
    rows = detect.scan(readers.from_text(spark, "9 1/2"), rules).collect()
    assert [(r.position, r.match) for r in rows] == [(2, "1/2")]


ARTICLES = lists.Slots(prefix=(3,), shared=(4, 5), identifiers=(1, 2), core=(1,), variables=(6,), skip=())


def item(text, level1=None, level2=None, act=None, year=None, number=None, bare=None):
    return [text, level1, level2, act, year, number, bare]


def completed(spark, found, slots):
    df = spark.createDataFrame([(found,)], "groups array<array<string>>")
    return lists.resolved(df, slots).first()[0]


def test_lists(spark):
    got = completed(spark, [item("articles 101", "101"), item("102 of the TFEU", "102", act="TFEU")], ARTICLES)
    assert [g[3] for g in got] == ["TFEU", "TFEU"]
    one = lists.Slots(prefix=(3,), shared=(4, 5), identifiers=(1, 2), core=(1,), variables=(2,))
    got = completed(spark, [item("Article 25(6)", "25", "6"), item("(7)", None, "7"), item("(8) of Regulation (EU) 2018/1725", None, "8", "Regulation", "2018", "1725")], one)
    assert [(g[1], g[2], g[3], g[4], g[5]) for g in got] == [("25", n, "Regulation", "2018", "1725") for n in "678"]
    assert completed(spark, [], one) == [] and completed(spark, None, one) is None


# whole text, article, paragraph or point, act, year, number, bare value, bare value in brackets
NESTED = lists.Slots(prefix=(3,), shared=(4, 5), identifiers=(1, 2, 6, 7), core=(1,), variables=(6, 7))


def nested(text):
    import re

    pattern = r"(?:(?:articles?|paragraphs?|points?) )?(?:(\d+)(?:\((\w+)\))|(\d+)|\((\w+)\)|\b([a-z])\))(?: of (Dir(?:ective)?|TFEU)\.?(?: (\d+)/(\d+))?)?"
    out = []
    for m in re.finditer(pattern, text):
        a, b, bare, bracket, letter, act, year, no = m.groups()
        named = m[0].startswith("article") and bare
        out.append([m[0], a or (bare if named else None), b, act, year, no, None if named else bare, bracket or letter])
    return out


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("articles 101 and 102 of TFEU", [("101", None), ("102", None)]),
        ("articles 5, 6, 7 of Dir 78/99", [("5", None), ("6", None), ("7", None)]),
        ("article 25(6), (7) and (8) of Directive 2018/1725", [("25", "6"), ("25", "7"), ("25", "8")]),
        ("article 3(12) and 4 of Dir 497/2018", [("3", "12"), ("4", None)]),
        ("article 3(12), 4 and 5 of Dir 497/2018", [("3", "12"), ("4", None), ("5", None)]),
        ("article 15(a) and (b) of Dir 1/2", [("15", "a"), ("15", "b")]),
        ("article 15(a) and b) of Dir 1/2", [("15", "a"), ("15", "b")]),
        ("article 5 of Dir 1/2, 6 and 7", [("5", None), ("6", None), ("7", None)]),
    ],
)
def test_nested_lists(spark, text, want):
    got = completed(spark, nested(text), NESTED)
    assert [(g[1], g[2]) for g in got] == want
    assert len({(g[3], g[4], g[5]) for g in got}) == 1 and got[0][3]


def test_list_levels_and_skips(spark):
    """A skipped level goes to articles, not to points; a lone value finds the source's deeper level."""
    skip = lists.Slots(prefix=(3,), shared=(4, 5), identifiers=(1, 2, 6), core=(1,), variables=(6,), skip=(2,))
    blank = lambda text, **at: [text, *(at.get(f"g{i}") for i in range(1, 7))]
    second = lambda source, to, slots: completed(spark, [source, to], slots)[1][1:3]
    source = blank("article 15(a)", g1="15", g2="a", g3="Dir")
    assert second(source, blank("(b)", g6="b"), skip) == ["15", "b"]
    assert second(source, blank("16", g6="16"), skip) == ["16", None]
    dotted = blank("32.4", g1="32", g2="4", g3="Dir")
    assert second(dotted, blank("33", g6="33"), skip) == ["33", None]
    lettered = lists.Slots(prefix=(3,), identifiers=(1, 2, 6), variables=(6,))
    assert second(blank("paragraph 5 point a Dir", g1="5", g2="a", g3="Dir"), blank("7", g6="7"), lettered) == ["7", None]
    assert second(blank("article 5 paragraph 6 Dir", g1="5", g2="6", g3="Dir"), blank("7", g6="7"), lettered) == ["5", "7"]
    # points 5 and 7 of article 2(3): the first point takes article and the level of the point from the last item
    points = lists.Slots(prefix=(3,), identifiers=(1, 2, 6), core=(1,), variables=(6,))
    got = completed(spark, [blank("points 5", g6="5"), blank("7 of article 2 Dir", g1="2", g2="7", g3="Dir")], points)
    assert [(g[1], g[2], g[3]) for g in got] == [("2", "5", "Dir"), ("2", "7", "Dir")]
    got = completed(spark, [blank("5", g6="5"), blank("32.4 Dir", g1="32", g2="4", g3="Dir")], points)
    assert got[0] == blank("5", g3="Dir", g6="5")  # nothing of a source with a dot but the act


def test_list_shapes(spark):
    texts = ["articles 25(6)", "(4a)", "b)", "32.4", "15 (b)", "Annex IV", "5 of Dir"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(lists.shape(F.col("t"))).collect()
    assert [r[0] for r in got] == ["~_#(#)", "(#@)", "@)", "#.#", "#_(@)", "^_^", "#_~_^"]


def test_alias_positions(spark):
    """Sentinels in the text, and patterns whose replacement names groups: places in the replaced text are where it stands."""
    a = Aliases().added("GDPR", "Regulation (EU) 2016/679").added(r"/Reg\.? (\d+)\/(\d+)/", "R {{ $2 }}/{{ $1 }}")
    for raw in ("a\x01\x02b GDPR and Reg. 7/2010 GDPR", "Reg. 12/2011, Reg 1/2, GDPR"):
        docs = readers.from_text(spark, raw)
        text = docs.select(alias.replaced(F.col("text"), a)).first()[0]
        rows = alias.offsets(docs, a).orderBy("position").collect()
        assert len(rows) == 3 and all(text[r.replaced_position :].startswith(r.replacement) for r in rows)
        assert all(raw[r.position :].startswith(r.source) for r in rows)


def test_trim_takes_the_first_hit(spark):
    rules = compile_rules([Rule("x", pattern=r"[a-c]{2}(?:-[a-c]{2})*", trim_pattern="-[a-c]{2}", views=(View("p", "$0"),))])
    docs = readers.from_text(spark, "see aa-bb-cc here")
    assert [detect.scan(docs, rules, cursor=c).first().match for c in (False, True)] == ["aa-cc", "aa-cc"]


def test_closure_without_a_bound(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(70, 35), (200, 201)], "src long, dst long")
    got = {(r.src, r.dst): r.depth for r in works.closure(edges).collect()}
    assert got[0, 70] == 70 and got[70, 35] == 1 and got[50, 36] == 22 and got[200, 201] == 1 and (0, 200) not in got
    assert len(got) == 35 * 34 // 2 + 35 * 36 + 36 * 36 + 1


def test_aliases(spark):
    a = Aliases().added("GDPR", "Regulation (EU) 2016/679").added(r"/Reg\.? (\d+)\/(\d+)/", "Regulation (EU) {{ $2 }}/{{ $1 }}")
    docs = readers.from_text(spark, "Article 3 of GDPR is now repealed; C-99/99, xGDPR, Reg. 7/2010")
    text = docs.select(alias.replaced(F.col("text"), a)).first()[0]
    assert text == "Article 3 of Regulation (EU) 2016/679 is now repealed; C-99/99, xGDPR, Regulation (EU) 2010/7"
    plain = Aliases().added("GDPR", "Regulation (EU) 2016/679")
    changed = docs.select("doc_id", alias.replaced(F.col("text"), plain).alias("text"))
    moved = alias.offsets(docs, plain).withColumn("replaced_position", F.col("replaced_position").cast("int"))
    back = alias.restored(detect.mentions(changed, builtin.rule_set()), moved).orderBy("position").collect()
    assert [(r.position, r.match) for r in back] == [(13, "GDPR"), (35, "C-99/99")]
    spaced = readers.from_text(spark, "the Data  Act").select(alias.replaced(F.col("text"), Aliases().added("Data Act", "X"))).first()[0]
    assert spaced == "the X"


def test_nodes(spark):
    docs = readers.from_text(spark, "C-1/10 T-2/10 C-1/10")
    rows = detect.mentions(docs, builtin.rule_set()).withColumn("urls", F.array())
    got = nodes.numbered(nodes.grouped(rows), "count.desc").orderBy("number").collect()
    assert [(r.reference, r["count"], r.position, r.positions) for r in got] == [("C-1/10", 2, 0, [0, 14]), ("T-2/10", 1, 7, [7])]


def test_html(spark):
    page = '<html><head><title>C-1/10</title></head><body><p>see C-1/10 &amp; <a href="x">C-1/10</a><script>C-1/10</script></p></body></html>'
    texts = html.text_nodes_of(page)
    assert [t for _, t, _ in texts] == ["C-1/10", "see C-1/10 & "]
    at = page.index("see") + 4
    done = html.linked_html_of(page, [(at, "C-1/10", "u"), (page.index("C-1/10"), "C-1/10", "v")])
    assert done.count('<a href="u">C-1/10</a>') == 1 and 'href="v"' not in done
    links = F.array(F.struct(F.lit(2).alias("position"), F.lit("b").alias("match"), F.lit("u").alias("href")))
    assert spark.range(1).select(html.linked_text(F.lit("a b <c"), links)).first()[0] == 'a <a href="u">b</a> &lt;c'


ACT = '<div id="art_1"><p class="title">Article 1</p><div id="001.001">1. First <table><tr><td>(a)</td><td>point a</td></tr></table></div><div id="001.002">2. Second</div></div><div id="anx_I"><p>Annex text</p></div>'


def test_act_parts():
    part = lambda **k: html.subdivision(ACT, html.Part(**k), "32016R0679")
    assert part(article="1", paragraph="2")["content"] == "2. Second"
    assert part(article="1", paragraph="9")["error"] == html.PARAGRAPH_NOT_FOUND
    assert part(article="1", paragraph="1", point="a")["content"] == "(a)point a"
    assert part(article="1", point="z")["error"] == html.POINT_NOT_FOUND
    assert part(article="7")["error"] == html.NOT_FOUND
    assert part(annex="I")["content"] == "Annex text"
    assert [s["id"] for s in part(article="1")["subdivisions"]] == ["art_1", "anx_I"]
    legacy = "<p>Article 1</p><p>One.</p><p>Article 2</p><p>Two.</p>"
    assert html.subdivision(legacy, html.Part(article="1"))["content"] == "One."
    assert html.case_paragraph('<p><a id="point3">3</a> Third.</p>', "3") == "Third."
    assert html.paragraph_slice(["1. a", "b", "2. c"], 1) == ["1. a", "b"]


def test_works(spark):
    repeals = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "celex string, repealed_by string")
    assert sorted(map(tuple, works.last_repealing(repeals).collect())) == [("a", "c"), ("b", "c")]
    ids = spark.createDataFrame([("a",), ("z",)], "celex string")
    rows = spark.createDataFrame([("a", "e1", "2000-01-01", "2000-02-01", "2010-01-01", "1"), ("a", "e1", "2000-01-01", "2000-03-01", "2011-01-01", "1")], "celex string, eli string, date string, date_force string, date_validity string, force string")
    titles = spark.createDataFrame([("a", "FRA", "f", 1), ("a", "ENG", "old", 1), ("a", "ENG", "new", 2)], "celex string, lang string, title string, seq int")
    got = {r.celex: r for r in works.celex_metadata(ids, works.Catalogue(works=rows, expressions=titles, repeals=repeals), "DEU").collect()}
    assert (got["a"].title, got["a"].date_force, got["a"].date_validity, got["a"].repealed_by, got["a"].status) == ("new", "2000-02-01", "2011-01-01", "c", "ok")
    assert got["z"].status == "missing"
    assert not works.Catalogue().healthy() and works.Catalogue(works=rows).healthy()
    known = spark.createDataFrame([("h/reg/1/2001-01-01",), ("h/reg/1/2005-01-01",)], "eli string")
    asked = spark.createDataFrame([("h/reg/1/2003-01-01",), ("h/reg/1/1999-01-01",), ("h/reg/1/oj",), ("h/reg/2/oj",)], "eli string")
    assert {r.eli: r.held for r in works.eli_as_of(asked, known).collect()} == {"h/reg/1/2003-01-01": "h/reg/1/2001-01-01", "h/reg/1/1999-01-01": "h/reg/1/2005-01-01", "h/reg/1/oj": "h/reg/1/2005-01-01", "h/reg/2/oj": "h/reg/2/oj"}


def test_resolvers(spark):
    mentions = spark.createDataFrame([(1, "32008D0070", 2008, "Decision No 70/2008/EC")], "key int, celex string, year int, context string")
    rows = spark.createDataFrame([("32008D0070", "Decision 5/6", 1), ("32008D0070(01)", "Decision No 70/2008/EC on things", 2)], "celex string, title string, seq int")
    assert resolve.act_numbers(mentions, rows).first().value == "32008D0070(01)"
    ojs = resolve.oj_elis(spark.createDataFrame([(1, "d", 2000, 5)], "key int, date string, year int, number int"), spark.createDataFrame([], "date string, year int, number int, celex string, eli string, seq int"))
    assert ojs.first().value == resolve.INVALID
    labels = spark.createDataFrame([("6", "C-229/11,C-230/11")], "main string, labels string")
    joined = works.joined_cases(works.Catalogue(joined=labels))
    got = resolve.joined_judgments(spark.createDataFrame([(1, "C-230/11"), (2, "C-9/11")], "key int, label string"), joined)
    assert sorted((r.key, r.value, r.kept) for r in got.collect()) == [(1, "6", True), (2, None, False)]


def test_folder_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a.txt", "C-1/10"), ("b.md", "C-2/10"), ("c.html", "<p>C-3/10</p>")):
        (tmp_path / "in" / name).write_text(text)
    assert readers.from_folder(spark, str(tmp_path / "in")).count() == 2
    docs = spark.createDataFrame([(i, f"C-{i}/10") for i in range(1, 9)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    stream = extract.extract(extract.read_documents(spark, str(tmp_path / "docs")), builtin.rule_set())
    extract.write(stream.select("doc_id", "position", "match"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    batch = detect.mentions(docs, builtin.rule_set()).select("doc_id", "position", "match")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["C-1/10", " ", "T-22/99", "x", "9", "/", "[C-1/10|a title]", "\n"]), max_size=12))
def test_cursor_scan_never_overlaps(parts):
    text, rules = "".join(parts), list(builtin.rule_set().scannable().rules)
    end = 0
    for at, match, _, _ in detect.scan_text(text, rules):
        assert at >= end and text[at : at + len(match)] == match
        end = at + len(match)


def test_cli(spark, tmp_path, capsys):
    from citemill import cli

    assert cli.main(["--inputtext", "see C-1/10 & T-2/10", "--format", "xml", "--sort", "reference.desc"]) == 0
    out = capsys.readouterr().out
    assert out.startswith('<resultset size="2"><record number="1"><reference count="1">T-2/10')
    assert cli.main(["--inputtext", "<p>see C-1/10</p>", "--format", "html", "--output", str(tmp_path / "o")]) == 0
    assert '">C-1/10</a></p>' in spark.read.text(str(tmp_path / "o")).first()[0]
    assert cli.options(cli.parser().parse_args(["--inputtext", "", "--types", "a,b"])).types == {"a", "b"}
    page = "<p title='C-9/10'>see C-1/10 <a href='x'>C-2/10</a></p>"
    assert cli.main(["--inputtext", page, "--htmlmode"]) == 0
    out = capsys.readouterr().out
    assert "C-1/10" in out and "C-2/10" not in out and "C-9/10" not in out and f"[ {page.index('C-1/10')} ]" in out
    (tmp_path / "in").mkdir()
    for name, text in (("a.txt", "see C-1/10"), ("b b.html", "<p>T-2/10</p>"), ("c.bin", "C-3/10")):
        (tmp_path / "in" / name).write_text(text)
    assert cli.main(["--inputdir", str(tmp_path / "in"), "--outputdir", str(tmp_path / "named"), "--format", "html"]) == 0
    written = {p.name: p.read_text("utf-8") for p in (tmp_path / "named").iterdir()}
    assert {name: ">C-1/10<" in t or ">T-2/10<" in t for name, t in written.items()} == {"a.txt.html": True, "b b.html.html": True}
    spark.createDataFrame([("62010CJ0001", "eli", "2010-01-01", "2010-01-01", "2010-01-01")], "celex string, eli string, date string, date_force string, date_validity string").write.parquet(str(tmp_path / "tables" / "works.parquet"))
    assert cli.main(["--inputtext", "see C-1/10", "--linkeddata", "--linkeddatamode", "celex", "--catalogue", str(tmp_path / "tables"), "--langtarget", "DE"]) == 0
    assert '"status" : "ok"' in capsys.readouterr().out
    with pytest.raises(ValueError):
        cli.options(cli.parser().parse_args(["--inputtext", "", "--linkeddata", "--linkeddatamode", "nothing"]))


def test_module_runs_from_anywhere(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    got = subprocess.run([sys.executable, "-m", "citemill", "--inputtext", "see C-1/10"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True)
    assert got.returncode == 0 and '"reference" : "C-1/10"' in got.stdout, got.stderr


def test_no_stage_beyond_the_compiler():
    """No generated code that the JVM refuses; its log goes to the standard error of a process of its own."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
from pyspark.sql import SparkSession
from citemill.plans import catalog
spark = SparkSession.builder.master("local[2]").config(map={"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}).getOrCreate()
for name in ("scan_positions", "nodes_grouped", "nodes_merged", "oj_label_translate", "short_titles", "nodes_xml", "judgment_titles", "celex_metadata"):
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
"""
    got = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
    assert "ailed to compile" not in got.stderr and "64 KB" not in got.stderr


def test_scan_plan_stays_in_the_jvm(spark):
    df = detect.scan(readers.from_text(spark, "C-1/10"), builtin.rule_set())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_last_repealing_without_bound(spark):
    """Chains of 1 to 100 links, forks, and cycles with and without a way out, against a search."""
    edges = [(f"c{n}-{i}", f"c{n}-{i + 1}") for n in (1, 2, 31, 64, 100) for i in range(n)]
    edges += [("f", "c100-0"), ("f", "c31-5"), ("x", "y"), ("y", "x"), ("p", "q"), ("q", "p"), ("q", "c64-0"), ("s", "s")]
    onward, want = {}, set()
    for a, b in edges:
        onward.setdefault(a, []).append(b)
    for a in onward:
        seen, left = set(), [a]
        while left:
            for b in onward.get(left.pop(), []):
                if b not in seen:
                    seen.add(b)
                    left.append(b)
        want |= {(a, b) for b in seen if b not in onward}
    got = works.last_repealing(spark.createDataFrame(edges, "celex string, repealed_by string")).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_last_repealing_of_all_orders(spark):
    from citemill.plans import catalog

    sf = "/root/testdata/sf0.001"
    keys = {r[0] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect()}
    got = dict(map(tuple, catalog.QUERIES["last_repealing"](spark, sf).collect()))
    assert got.keys() == keys and all(v not in keys and (v - k) % 7 == 0 and all(x in keys for x in range(k, v, 7)) for k, v in got.items())


def test_repeal_closure_of_all_orders(spark):
    from citemill.plans import catalog

    sf = "/root/testdata/sf0.001"
    keys = {r[0] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect()}
    want = {(k, k + 7 * d, d) for k in keys for d in range(1, 21) if all(k + 7 * i in keys for i in range(d))}
    got = set(map(tuple, catalog.QUERIES["repeal_closure"](spark, sf).collect()))
    assert got == want and {k for k, _, _ in got} == keys


def test_corrections_of_all_customers(spark):
    from citemill.plans import catalog

    sf = "/root/testdata/sf0.01"
    orders = {(r[0], r[1]) for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey").collect()}
    known = {r[0] for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()}
    got = {r.act: r.corrections for r in catalog.QUERIES["corrections_list"](spark, sf).collect()}
    want = {f"3{c}": ",".join(sorted(f"3{c}R({k})" for x, k in orders if x == c)) for c in {x for x, _ in orders} & known}
    assert got == want and max(known) > 200 and len(got) > 200
