"""Aliases, rules and files as tables; guards and probes by text; lists for many ids; as-of lookups with hot keys."""

import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from citemill.operators import alias, alias_table, detect, html, tables, works
from citemill.options import Aliases, Optimizer, Options
from citemill.plans import rule_tables
from citemill.plans.rules import Rule, View, compile_rules
from citemill.sources import named, readers

VIEW = (View("p", "$0"),)


def by_texts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


# ---- guards and probes


def rules_of(n):
    """The first two have guards, and would shadow the third."""
    more = [Rule(type=f"t{i}", pattern=rf"{'abcdefgh'[i]}\d", guard_pattern=f"g{i}", order=10 + i, views=VIEW) for i in range(n)]
    return compile_rules([Rule(type="long", pattern=r"x\d+ of y", guard_pattern="long", order=1, views=VIEW), Rule(type="mid", pattern=r"x\d+", guard_pattern="mid|both", order=2, views=VIEW), Rule(type="free", pattern=r"\w\d", order=3, views=VIEW), *more])


def want(text, n):
    """What the rules that are open give, by a plain loop."""
    open_ = lambda g: re.search(rf"(?:{g})(?![^\W\d_])", text, re.I)
    known = [("long", r"x\d+ of y", "long"), ("mid", r"x\d+", "mid|both"), ("free", r"\w\d", "")] + [(f"t{i}", rf"{'abcdefgh'[i]}\d", f"g{i}") for i in range(n)]
    left = [(t, p) for t, p, g in known if not g or open_(g)]
    out, at = [], 0
    pattern = re.compile(r"(?<![\w/])(?:" + "|".join(f"({p})" for _, p in left) + r")(?![\w/])", re.I)
    while m := pattern.search(text, at):
        out.append((m.start(), m[0], left[m.lastindex - 1][0]))
        at = m.end()
    return out


@pytest.mark.parametrize("n", [0, 5])  # five more guards: patterns are put together per text
@pytest.mark.parametrize("cursor", [None, True])
def test_guards_close_rules_by_text(spark, n, cursor):
    texts = [f"x1 of y, a2 x22 {' '.join(w)}" for w in product(["long", ""], ["mid", "both", "midst", ""], ["g0", "g4 g1", ""])] + ["", "long", "b1 x5 g1"]
    rules = rules_of(n)
    types = [c.rule.type for c in rules.rules]
    got = {i: [] for i in range(len(texts))}
    for r in detect.scan(by_texts(spark, texts), rules, cursor=cursor).orderBy("position").collect():
        got[r.doc_id].append((r.position, r.match, types[r.rule]))
    assert got == {i: want(t, n) for i, t in enumerate(texts)}
    narrowed = detect.Narrowing(rules)
    assert (narrowed.count > detect.VARIANTS) == (n > 2)
    variants = by_texts(spark, texts).select("doc_id", narrowed.variant(F.col("text")).alias("v")).collect()
    assert all(tuple(r.v) == detect.python_variant(narrowed, texts[r.doc_id]) for r in variants)


def test_probes_rewrite_patterns(spark):
    optimizers = ((Optimizer("slow", "(?:slow|q)", "q"), Optimizer("never", "(?:slow|q)", "wrong")), (Optimizer("[0-9]", r"\d*", ""),))
    rules = compile_rules([Rule(type="a", pattern=r"(?:slow|q)-\d*", guard_pattern="-", order=1, views=VIEW), Rule(type="b", pattern=r"z\d*", order=2, views=VIEW)])
    texts = ["slow-1 q-2 z", "q-2 z3", "q- z", "slow- z", "z slow", ""]
    plain, fast = (sorted(map(tuple, detect.scan(by_texts(spark, texts), rules, options=Options(optimizers=o)).collect())) for o in ((), (optimizers[0][:1],)))
    assert plain == fast and len(plain) > 8
    left = detect.Narrowing(rules, optimizers).left((1, 1, 1))
    assert [c.pattern for c in left.values()] == ["q-", "z"]
    assert [c.pattern for c in detect.Narrowing(rules, optimizers).left((1, 2, 0)).values()] == [r"wrong-\d*", r"z\d*"]


def test_scan_in_sql(spark):
    rules = rules_of(1)
    tables.register_scan(spark, rules, "scan_them")
    docs = by_texts(spark, ["x1 of y long", "x1 of y mid", "a1 g0", None, ""])
    got = spark.sql("SELECT d.doc_id, s.position, s.match, s.rule FROM {docs} d, LATERAL scan_them(d.text) s", docs=docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, detect.scan(docs, rules).select("doc_id", "position", "match", "rule").collect()))


# ---- aliases as a table


@pytest.mark.parametrize("largest", [0, 1 << 20])
def test_alias_table(spark, largest):
    known = [("Data Act", "R1"), ("Act", "R2"), ("GDPR", "R3"), ("R&D", "R4"), ("l'acte", "R5"), ("(EU)", "R6"), ("No 5", "R7"), ("5 6", "R8"), ("", "none"), (" ", "none")]
    texts = ["the Data \n Act and act, ACT.", "GDPR/x GDPRs aGDPR GDPR", "R&amp;D R & D r&D", "L’acte l 'acte", "x(EU) (EU)y ((EU)) (EU)", "No 5 6 and 5 6", "", None, "Data Actor data act", "Data Act"]
    df = by_texts(spark, texts)
    aliases = spark.createDataFrame(known, "alias string, replacement string")
    got = {r.doc_id: r.text for r in alias_table.replaced(df, aliases, largest=largest).collect()}
    assert got == {0: "the R1 and R2, R2.", 1: "GDPR/x GDPRs aGDPR R3", 2: "R4 R & D R4", 3: "R5 l 'acte", 4: "x(EU) (EU)y (R6) R6", 5: "R7 6 and R8", 6: "", 7: None, 8: "Data Actor R1", 9: "R1"}


@pytest.mark.parametrize("largest", [0, 1 << 20])
def test_alias_table_is_like_the_pattern(spark, largest):
    rng = random.Random(6)
    names = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 6))).strip() for _ in range(40)]
    names = sorted({n for n in names if n and "  " not in n})
    texts = [re.sub(" +", " ", "".join(rng.choice("ab .") for _ in range(60))) for _ in range(60)]
    aliases = Aliases()
    for n in names:
        aliases = aliases.added(n, f"<{n}>")
    want = {r.doc_id: r.t for r in by_texts(spark, texts).select("doc_id", alias.replaced(F.col("text"), aliases).alias("t")).collect()}
    rows = spark.createDataFrame([(n, f"<{n}>") for n in names], "alias string, replacement string")
    assert {r.doc_id: r.text for r in alias_table.replaced(by_texts(spark, texts), rows, largest=largest).collect()} == want


# ---- rules as tables


def test_rule_dependencies(spark):
    rows = [("a", "{{ b }}x{{?= c }}"), ("b", "{{?: c }}"), ("c", "z"), ("d", "{{ e }}"), ("e", "{{ d }}"), ("f", "plain {2}")]
    rules = spark.createDataFrame([(f"t{n}", n, p) for n, p in rows], "type string, name string, pattern string")
    assert {tuple(r) for r in rule_tables.dependencies(rules).collect()} == {("a", "b", 1), ("a", "c", 1), ("b", "c", 1), ("d", "e", 1), ("d", "d", 2), ("e", "d", 1), ("e", "e", 2)}
    views = spark.createDataFrame([("ta", ["x"]), ("tf", ["x", "y"])], "type string, environments array<string>")
    assert {tuple(r) for r in rule_tables.needed_by_environment(rules, views).collect()} == {("x", "a"), ("x", "b"), ("x", "c"), ("x", "f"), ("y", "f")}


def test_rule_tables(spark):
    views = spark.createDataFrame([("a", "eurlex", ["*"], None, False), ("a", "curia", ["court"], "", True), ("b", "table", ["court", "x"], "base", None)], "type string, target string, environments array<string>, base_type string, common boolean")
    assert [r.target for r in rule_tables.shown(views, Options(environments=frozenset({"court"}), targets=frozenset({"eurlex", "table"}))).collect()] == ["eurlex", "table"]
    assert [r.target for r in rule_tables.shown(views, Options(excluded_targets=("cur",), types=frozenset({"a"}))).collect()] == ["eurlex"]
    assert {r.base_type: (r.types, r.targets) for r in rule_tables.by_base_type(views).collect()} == {"a": (["a"], ["eurlex"]), "base": (["b"], ["table"])}
    assert {r.environment: r.types for r in rule_tables.by_environment(views).collect()} == {"*": ["a"], "court": ["a", "b"], "x": ["b"]}
    rules = spark.createDataFrame([("{{ n }}/(x)",), ("(",), ("{{ none }}",), (None,)], "pattern string")
    assert [(r.compiled, r.groups, r.error) for r in rule_tables.compiled(rules, {"n": r"(\d+)"}).collect()][:3] == [(r"(\d+)/(x)", 2, None), (None, None, "unbalanced pattern ("), (None, None, "unknown pattern none")]


# ---- contexts in pages


def test_contexts_in_pages():
    by = {"C-1/10": "<i>C-1/10</i>", "C-1/10 P": "<b>C-1/10 P</b>", "A & B": "<u>A&amp;B</u>"}
    source = '<html><head>C-1/10</head><body title="C-1/10"><p>C-1/10, C-1/10 P; C-1/105 xC-1/10</p><a href="#">C-1/10</a><b>C-1/10</b>5 A &amp; B A&nbsp;&amp; B<script>C-1/10</script></body></html>'
    want = '<html><head>C-1/10</head><body title="C-1/10"><p><i>C-1/10</i>, <b>C-1/10 P</b>; C-1/105 xC-1/10</p><a href="#">C-1/10</a><b><i>C-1/10</i></b>5 <u>A&amp;B</u> A&nbsp;&amp; B<script>C-1/10</script></body></html>'
    assert html.with_contexts_of(source, by) == want
    assert html.with_contexts_of("", by) == "" and html.with_contexts_of(source, {}) == source


# ---- files under their own names


def test_named_files(spark, tmp_path):
    rows = [("a.txt", "one"), ("b/c.txt", ""), ("b/é d.txt", "zwei\nü"), ("e.txt", None)]
    df = spark.createDataFrame(rows, "name string, value string").repartition(3)
    named.write_named(df, f"{tmp_path}/out")
    read = lambda: {str(p.relative_to(tmp_path / "out")): p.read_text("utf-8") for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert read() == {n: v or "" for n, v in rows}
    assert not list((tmp_path / "out").glob(".job*"))
    for bad in ([("a.txt", "again")], [("x", "1"), ("x", "2")], [("../x", "1")], [("/x", "1")]):
        with pytest.raises(Exception, match="file|name"):
            named.write_named(spark.createDataFrame(bad, "name string, value string"), f"{tmp_path}/out")
    assert read() == {n: v or "" for n, v in rows}


def test_lost_attempts_leave_nothing(tmp_path):
    """An attempt that wrote files and was lost isn't committed; the other attempt's files are."""
    from pyspark.sql import Row

    writer = named.NamedFilesWriter(str(tmp_path), False)
    writer.write(iter([Row(name="a", value="lost"), Row(name="b", value="lost")]))
    done = writer.write(iter([Row(name="a", value="kept"), Row(name="b", value="kept too")]))
    other = writer.write(iter([]))
    writer.commit([done, None, other])
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"a": "kept", "b": "kept too"}
    again = named.NamedFilesWriter(str(tmp_path), False)
    again.abort([again.write(iter([Row(name="c", value="x")]))])
    assert {p.name for p in tmp_path.iterdir()} == {"a", "b"}


# ---- many ids, many versions


def test_first_of_each(spark):
    rng = random.Random(1)
    rows = [("hot", f"{rng.randint(0, 10**6):07d}") for _ in range(4000)] + [(f"k{i % 50}", str(i)) for i in range(300)] + [(None, "x")]
    rows = sorted(set(rows), key=repr)
    got = sorted(map(tuple, works.first_of_each(spark.createDataFrame(rows, "k string, v string"), "k", ["v"], 7).collect()), key=repr)
    by = {}
    for k, v in sorted(rows, key=lambda r: r[1]):
        by.setdefault(k, []).append(v)
    assert got == sorted([(k, v) for k, vs in by.items() for v in vs[:7]], key=repr)


def test_as_of_with_a_hot_key(spark):
    """Versions of one key over many ranges, some of them without a version or without a request."""
    rng = random.Random(2)
    versions = [("hot", rng.randint(0, 50_000), f"v{i}") for i in range(20_000)] + [("a", 5, "x"), ("a", 5, "y"), ("a", None, "zz"), ("b", None, "null"), ("c", 9, "c")]
    requests = [("hot", rng.randint(-10, 60_000), i) for i in range(3000)] + [("a", 5, 1), ("a", 4, 2), ("a", None, 3), ("b", 1, 4), ("none", 1, 5), (None, 1, 6), ("c", 8, 7)]
    by = {}
    for k, t, v in versions:
        by.setdefault(k, []).append((t is not None, t, v))
    want = []
    for k, at, i in requests:
        if k in by:
            own = sorted(by[k], key=lambda x: (x[0], x[1] or 0, x[2]))
            fit = [x for x in own if x[0] and at is not None and x[1] <= at]
            want.append((k, at, i, *(fit or own)[-1][1:]))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = works.as_of(spark.createDataFrame(requests, "k string, at int, i int"), spark.createDataFrame(versions, "k string, t int, v string"), "k", "at", "t")
        assert got.columns == ["k", "at", "i", "as_of_t", "as_of_v"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
