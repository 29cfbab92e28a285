"""What queries move and hold does not outgrow their input; results on keys larger than those of the small tables."""

import pytest
from pyspark.sql import functions as F

from citemill.operators import works


def shuffled(spark, df) -> int:
    """Records that a run of df writes to shuffles."""
    store, args = spark.sparkContext._jsc.sc().statusStore(), (None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    done = lambda: (lambda got: {got.apply(i).stageId(): got.apply(i).shuffleWriteRecords() for i in range(got.size())})(store.stageList(*args))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = set(done())
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in done().items() if k not in before)


def test_closure_moves_each_path_about_once(spark):
    edges = spark.range(2000).selectExpr("id AS src", "id + 1 AS dst")
    got = works.closure(edges, 20)
    assert shuffled(spark, got) < 2 * 20 * 2000 and got.count() == sum(min(20, 2000 - i) for i in range(2000))


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8, None])
def test_closure_is_the_shortest_way(spark, depth):
    """Forks, cycles and edges without an end, against a search by breadth."""
    edges = [(a, b) for a in range(12) for b in {(a * 5 + 1) % 12, (a * 7 + 3) % 12, a + 1}] + [(3, None), (None, 3), (3, None), (20, 20)]
    onward, want = {}, {(a, b, 1) for a, b in edges if a is None or b is None}
    for a, b in edges:
        if a is not None and b is not None:
            onward.setdefault(a, set()).add(b)
    for a in onward:
        seen, front, n = set(), {a}, 0
        while front and (depth is None or n < depth):
            n += 1
            front = {b for x in front for b in onward.get(x, ())} - seen
            seen |= front
            want |= {(a, b, n) for b in front}
    got = works.closure(spark.createDataFrame(edges, "src long, dst long"), depth).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_bank_acts_with_numbers_of_more_than_four_digits(spark):
    from citemill.operators import resolve

    mentions = spark.createDataFrame([(n, "none", "2011", str(n)) for n in (7, 1234, 12345, 12349, 123456)], "key long, reference string, year string, number string")
    rows = spark.createDataFrame([("x", f"eli/{n}", None, f"32011O{n:04}", 1) for n in (123456, 12349, 12345, 1234, 7)], "reference string, eli string, oj_url string, celex string, seq int")
    assert {r.key: r.value for r in resolve.ecb_elis(mentions, rows).collect()} == {n: f"eli/{n}" for n in (7, 1234, 12345, 12349, 123456)}


def test_references_without_a_semicolon(spark):
    from citemill.operators import html

    page = "<p>a &amp b</p><p>c &amp;&copy;&#65;&nosuch; d&amp</p>"
    assert [t for _, t, _ in html.text_nodes_of(page, closed=True)] == ["a &amp b", "c &©A&nosuch; d&amp"]
    assert [t for _, t, _ in html.text_nodes_of(page)] == ["a & b", "c &©A&nosuch; d&"]
    rows = html.text_nodes(spark.createDataFrame([(1, page)], "id int, html string"), "id", closed=True)
    assert sorted(r.text for r in rows.collect()) == ["a &amp b", "c &©A&nosuch; d&amp"]


def test_large_alias_table_is_not_broadcast(spark):
    from citemill.plans import catalog

    for name in ("alias_dictionary_join",):
        df = catalog.QUERIES[name](spark, "/root/testdata/sf0.01")
        assert df.count()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_lists_of_a_hot_act_are_dealt_over_tasks(spark):
    import re

    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = spark.range(40_000).selectExpr("if(id % 2 = 0, 'hot', concat('a', id % 100)) AS source", "concat('3', id % 15000) AS target", "'A1' AS fragment_source", "'P1' AS fragment_target")
    c = works.Catalogue(citations=rows, bases=rows.selectExpr("source AS celex", "target AS basis"))
    try:
        for got, own in ((works.cited_by_each(rows.selectExpr("source AS celex"), c), ["hot"]), (works.bases_of_each(rows.selectExpr("source AS celex").where("source = 'hot'"), c), ["hot"])):
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert re.search(r"hashpartitioning\(id#\d+, _salt#\d+", plan), plan
            want = sorted({f"3{i % 15000}" for i in range(0, 40_000, 2)})[:501]
            assert sorted(r.celex for r in got.collect() if r.id in own) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_local_positions_sort_once(spark):
    from citemill.operators import nodes

    rows = [("d", None, "x", "a"), ("d", None, "x", "b"), ("d", 5, "x", "c"), ("d", 6, "x", "d"), ("d", 7, "x", "d"), ("d", 9, "yyyy", "e"), ("d", 11, "yyyy", "f"), ("d", 30, "yyyy", "g"), ("e", 4, None, "a"), ("e", 5, None, "b")]
    got = nodes.local_positions(spark.createDataFrame(rows, "doc_id string, position int, context string, match string"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert {(r.doc_id, r.position, r.match): r.local_position for r in got.collect()} == {("d", None, "a"): None, ("d", None, "b"): None, ("d", 5, "c"): 0, ("d", 6, "d"): 1, ("d", 7, "d"): 2, ("d", 9, "e"): 0, ("d", 11, "f"): 2, ("d", 30, "g"): 0, ("e", 4, "a"): 0, ("e", 5, "b"): 0}


def test_costly_rows_of_one_file_are_dealt_out(spark):
    """A small file is read by one task; parts of acts and titles are made in as many as there are cores."""
    from citemill.plans import catalog

    for name in ("act_parts", "judgment_titles"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("RoundRobinPartitioning(4)") >= 1


def test_nodes_do_not_work_out_attributes(spark):
    from citemill.plans import queries_scan

    found = queries_scan.order_mentions(spark, "/root/testdata/sf0.001")
    assert "attrs" not in found.schema["alternatives"].dataType.elementType.names and found.where("size(urls) = 0").count() == 0


def test_runs_that_are_no_alias_do_not_travel(spark):
    from citemill.operators import alias_table

    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('a b c d e f g h i j k l m n o p q r s t Item ', id % 500, ' u v w') AS text")
    known = spark.range(500).selectExpr("concat('item ', id) AS alias", "concat('<', id, '>') AS replacement")
    got = alias_table.replaced(docs, known, largest=0)
    assert shuffled(spark, got) < 5 * 2000
    assert {r.doc_id: r.text for r in got.collect()} == {i: f"a b c d e f g h i j k l m n o p q r s t <{i % 500}> u v w" for i in range(2000)}


def test_parts_of_a_table_are_of_bounded_size(spark):
    from citemill.sources.readers import spread

    one = spark.range(0, 1000, 1, 1)
    assert spread(one, rows=10).rdd.getNumPartitions() == 100 and spread(one).rdd.getNumPartitions() == 4
    uneven = spark.range(0, 1000, 1, 200).where("id < 500")
    assert max(spread(uneven, rows=100).rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()) < 150


def test_captures_are_made_once_and_where_asked(spark):
    from citemill.operators import detect
    from citemill.plans import builtin

    rules = builtin.rule_set()
    df = spark.createDataFrame([("C-12/09", 0), ("Regulation (EU) 2016/679", 2), ("a\x03C-12/09", 0), ("none", 0)], "match string, rule int")
    plain = [detect.captures(F.col("match"), c.pattern, c.groups) for c in (rules.rules[0], rules.rules[2])]
    assert [tuple(r) for r in df.select(*plain).collect()] == [
        (["C-12/09", "C", "12", "09"], ["C-12/09", None, None, None]), (["Regulation (EU) 2016/679", None, None, None], ["Regulation (EU) 2016/679", "Regulation", "2016", "679"]),
        (["a\x03C-12/09", "C", "12", "09"], ["a\x03C-12/09", None, None, None]), (["none", None, None, None], ["none", None, None, None]),
    ]
    assert [len(r.g) for r in df.select(detect.all_captures(rules, F.col("rule"), F.col("match"), asked=True).alias("g")).collect()] == [0, 4, 0, 0]


def test_primary_id_works_out_attributes_once(spark):
    from citemill.functions import ids

    df = spark.createDataFrame([("<a data-celex-1=\"x\" data-oj=\"y\">",)], "v string").select(ids.primary_id(ids.normalised(ids.attributes(F.col("v")))).alias("id"))
    assert df._jdf.queryExecution().analyzed().toString().count("transform_keys") == 1 and df.first().id == "x"


def test_equal_lists_are_read_once(spark):
    from citemill.operators import lists

    rows = spark.range(1000).selectExpr("id AS doc_id", "concat('articles 1, 2 and ', id % 3, ' of Act 9') AS match").unionByName(spark.sql("SELECT 1000L AS doc_id, 'none' AS match"))
    slots = lists.Slots(prefix=(2,), shared=(3,), identifiers=(1,), core=(1,), variables=(1,))
    item = "(?:articles )?([0-9]+)(?: of (Act) ([0-9]+))?"
    got = lists.read(rows, item, 3, slots)
    assert shuffled(spark, got) < 3 * 1000
    each = lists.items(rows.withColumn("position", F.lit(0)), item, 3).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("item", "groups"))).alias("l"))
    want = {r.doc_id: r.groups for r in lists.resolved(each.select("doc_id", F.transform("l", lambda x: x["groups"]).alias("groups")), slots).collect()}
    assert {r.doc_id: r.groups for r in got.collect()} == want | {1000: []}


def test_repeals_of_many_ids_are_not_followed_step_by_step(spark):
    edges = spark.range(64).selectExpr("concat('a', id) AS celex", "concat('a', id + 1) AS repealed_by")
    assert works.reached(edges, edges.where("celex < 'a5'")).count() == 64
    assert works.reached(edges, edges.where("celex = 'a60'")).count() == 4


def test_table_function_gives_rows_without_arrow(spark):
    """With Arrow each text's few matches are a batch of their own."""
    from pyspark.util import PythonEvalType

    from citemill.operators import tables
    from citemill.plans import builtin

    assert tables.scan_function(builtin.rule_set()).evalType == PythonEvalType.SQL_TABLE_UDF
