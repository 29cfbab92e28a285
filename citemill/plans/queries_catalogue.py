"""Queries on language, rule, resolver, metadata and result operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import converters as C
from ..functions import helpers as H
from ..functions import ids, titles
from ..functions.regex import SPACE
from ..operators import alias, detect, html, nodes, resolve, works
from ..options import Aliases, Options
from ..sources import named, readers, sinks
from ..sources.readers import spread, table
from . import rule_tables
from .rules import compile_rules, rules_from_xml

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _sql(spark, sf_dir, name: str, *columns: str):
    return table(spark, sf_dir, name).selectExpr(*columns)


# ---- converters and helpers


@query("""SELECT n_nationkey, '/deu' AS lang, 'DE' AS iso2, 'FR' AS other2, 'deu' AS iso3, 'ENG' AS other3, '/DE' AS slash2, '' AS none2, '/deu' AS slash3,
CASE n_nationkey % 3 WHEN 0 THEN 'EN-FR' WHEN 1 THEN 'DE' ELSE '' END AS many, CASE n_nationkey % 3 WHEN 0 THEN 'EN-FR' WHEN 1 THEN 'DE' ELSE 'EN' END AS many_or_one,
CASE n_nationkey % 3 WHEN 0 THEN 'MT' ELSE 'HR' END AS to2, CASE n_nationkey % 3 WHEN 0 THEN 'MLT' ELSE 'HRV' END AS to3 FROM nation""")
def language_codes(spark, sf_dir):
    many = F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'ENG-XXX-fra' WHEN 1 THEN 'DEU' ELSE 'none' END")
    two, three = F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'mt' ELSE 'HR' END"), F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'MLT' ELSE 'hrv' END")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", C.lang(language_iso3="deu").alias("lang"), C.lang_iso2(language_iso3="deu").alias("iso2"), C.lang_iso2(default="FR", language_iso3="XYZ").alias("other2"),
        C.lang_iso3(language_iso3="deu").alias("iso3"), C.lang_iso3(language_iso3="XYZ").alias("other3"), C.lang_iso_a2(language_iso3="deu").alias("slash2"), C.lang_iso_a2(language_iso3="XYZ").alias("none2"),
        C.lang_iso_a3(language_iso3="deu").alias("slash3"), C.multi_lang_iso2(languages=many).alias("many"), C.multi_lang_iso2_or_lang_iso2(languages=many).alias("many_or_one"), H.iso2(three).alias("to2"), H.iso3(two).alias("to3"),
    )


@query("""SELECT p_partkey, p_name AS chars, concat(p_name, ' & x') AS plain, CASE WHEN p_size % 2 = 0 THEN 'a%20b' ELSE p_brand END AS given, replace(replace(p_type, ' ', '-'), '#', '') AS one_by_one,
CASE p_size % 3 WHEN 0 THEN 'IX' WHEN 1 THEN 'XII' ELSE 'V' END AS ascii, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '4' ELSE '10' END AS roman, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS num FROM part""")
def text_converters(spark, sf_dir):
    e = F.expr
    return table(spark, sf_dir, "part").select(
        "p_partkey", C.trim(e("concat('-*', p_name, '--')"), "-*").alias("chars"), C.trim(e("concat('&nbsp; ', p_name, ' &amp; x\\t')")).alias("plain"), C.default(e("CASE WHEN p_size % 2 = 1 THEN p_brand END"), "a b").alias("given"),
        C.replace(C.replace(F.col("p_type"), "/ /g", "-"), "#").alias("one_by_one"), C.ascii_roman(e("CASE p_size % 3 WHEN 0 THEN 'ιχ' WHEN 1 THEN 'χii' ELSE 'v' END")).alias("ascii"),
        C.roman(e("CASE p_size % 4 WHEN 0 THEN 'i' WHEN 1 THEN 'v' WHEN 2 THEN 'iv' ELSE 'x' END")).alias("roman"), C.cast_to_number(e("CASE WHEN p_size % 2 = 0 THEN concat('', p_size) ELSE 'x' END")).alias("num"),
    )


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE p_brand END AS chosen, regexp_matches(p_type, '(?i)brass') AS hit, p_size % 2 = 1 AS negated, p_brand = 'Brand#11' AS same, p_brand <> 'Brand#11' AS other,
p_name AS kept, CASE p_size % 7 WHEN 0 THEN '3' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '7' ELSE '' END AS ordinal, upper(p_name) AS named FROM part""")
def test_converters(spark, sf_dir):
    e, even = F.expr, F.expr("CASE WHEN p_size % 2 = 0 THEN 'x' ELSE '' END")
    return table(spark, sf_dir, "part").select(
        "p_partkey", C.replace_if(F.col("p_brand"), even, "yes").alias("chosen"), C.match(F.col("p_type"), "/brass/i").alias("hit"), C.not_(even).alias("negated"), C.equals(F.col("p_brand"), "Brand#11").alias("same"),
        C.nequals(F.col("p_brand"), "Brand#11").alias("other"), C.debug(F.col("p_name")).alias("kept"), C.numeration(e("CASE p_size % 7 WHEN 0 THEN 'Third' WHEN 1 THEN 'first' WHEN 2 THEN 'SECOND' WHEN 3 THEN '7' ELSE 'ninth' END")).alias("ordinal"),
        C.REGISTRY["upper"](F.col("p_name")).alias("named"),
    )


@query("""SELECT p_partkey, concat('eaa ', p_name) AS folded, CASE WHEN p_size % 2 = 0 THEN concat('Artikel ', p_size) ELSE concat('Article ', p_size) END AS label,
CASE WHEN p_size % 2 = 0 THEN ['b', 'b', 'c'] ELSE ['a', 'b'] END AS shared FROM part""")
def search_and_labels(spark, sf_dir):
    known = F.create_map(F.lit("EN"), F.lit("Article {{ n }}"), F.lit("DE"), F.lit("Artikel {{ n }}"))
    a = F.expr("CASE WHEN p_size % 2 = 0 THEN array('b', 'c') ELSE array('a', 'b') END")
    b = F.expr("CASE WHEN p_size % 2 = 0 THEN array('b', 'x', 'b', 'c') ELSE array('b', 'a') END")
    label = H.translated(known, F.expr("CASE WHEN p_size % 2 = 0 THEN 'DE' ELSE 'FR' END"), {"n": F.col("p_size")})
    return table(spark, sf_dir, "part").select("p_partkey", H.folded(F.concat(F.lit("Éàâ   "), F.upper("p_name"))).alias("folded"), label.alias("label"), H.intersect(a, b).alias("shared"))


_JUDGMENTS = "CASE {k} WHEN 0 THEN concat('Judgment of the Court (Fifth Chamber) of ', {d}, ' December 2000. # A') WHEN 1 THEN concat('Urteil des Gerichts (Vierte Kammer) vom ', {d}, '. Dezember 2013, A') WHEN 2 THEN concat('Domstolens dom (Første Afdeling) af ', {d}, '. oktober 2015, A') ELSE concat('2015 m. spalio ', {d}, ' d. Teisingumo Teismo (pirmoji kolegija) sprendimas.') END"


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('Judgment of ', p_size % 28 + 1, ' December 2000. # A') WHEN 1 THEN concat('Urteil vom ', p_size % 28 + 1, '. Dezember 2013, A') WHEN 2 THEN concat('Dom af ', p_size % 28 + 1, '. oktober 2015, A')
ELSE concat('2015 m. spalio ', p_size % 28 + 1, ' d. sprendimas.') END AS title, concat('Directive ', p_size, ' on ', p_type, ' (x)') AS note FROM part""")
def judgment_titles(spark, sf_dir):
    """Titles without the court in four languages, and titles without notes on recasts and the EEA."""
    title = F.expr(_JUDGMENTS.format(k="p_partkey % 4", d="(p_size % 28 + 1)"))
    own = [titles.case_title(title, code) for code in ("EN", "DE", "DA", "LT")]
    shown = F.when(F.col("p_partkey") % 4 == 0, own[0]).when(F.col("p_partkey") % 4 == 1, own[1]).when(F.col("p_partkey") % 4 == 2, own[2]).when(F.col("p_partkey") % 4 == 3, own[3])
    note = H.footnote_text(F.expr("concat('Directive ', p_size, ' on ', p_type, ' (recast) (Text with EEA relevance)(Neufassung) ( x )')"))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", shown.alias("title"), note.alias("note"))


# ---- rules


_MACROS = {"digits": r"(\d+)", "word_DE": "Artikel", "word": "Article  # the word\n  ", "pair": "{{ digits }}/{{?: digits }}"}
_RULE = r"CASE p_partkey % 5 WHEN 0 THEN concat('{{ word }}\\s({{?: digits }})/({{ digits }})x', p_size) WHEN 1 THEN concat('x{{?= digits }}(?:a|b)(c)', p_size) WHEN 2 THEN '{{ nothing }}' WHEN 3 THEN concat('(', p_size) ELSE concat('{{ pair }} #', p_size) END"


@query(r"""SELECT language, p_partkey, replace(CASE p_partkey % 5 WHEN 0 THEN concat('WORD[ ]((?:(?:\d+)))/((\d+))x', p_size) WHEN 1 THEN concat('x(?=(?:\d+))(?:a|b)(c)', p_size) WHEN 4 THEN '(\d+)/(?:(?:\d+))' END, 'WORD', CASE language WHEN 'DE' THEN 'Artikel' ELSE 'Article' END) AS pattern,
CAST(CASE p_partkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 4 THEN 1 END AS INTEGER) AS groups, CASE p_partkey % 5 WHEN 1 THEN concat('(?:\[x(?=(?:\d+))(?:a|b)(?:c)', p_size, '\|[^\]\[|]+\]|(?:\[x(?=(?:\d+))(?:a|b)(?:c)', p_size, '\]|x(?=(?:\d+))(?:a|b)(?:c)', p_size, '))') END AS titled,
CASE p_partkey % 5 WHEN 2 THEN 'unknown pattern nothing' WHEN 3 THEN concat('unbalanced pattern (', p_size) END AS error FROM part CROSS JOIN (VALUES ('EN'), ('DE')) l(language)""")
def rule_compilation(spark, sf_dir):
    """A rule for each part, compiled for two languages: named patterns by language and kind, comments gone, groups, the title form, and
    what is wrong with faulty rules. The class of white space is shown as a space."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_RULE} AS pattern")
    both = [rule_tables.compiled(rows, _MACROS, language).withColumn("language", F.lit(language)) for language in ("EN", "DE")]
    shown = F.replace("compiled", F.lit(SPACE), F.lit(" "))
    return both[0].unionByName(both[1]).select("language", "p_partkey", shown.alias("pattern"), "groups", F.when(F.col("p_partkey") % 5 == 1, F.col("titled")).alias("titled"), "error")


#: Parts as views: a type for each brand, a target for each size, environments by the key.
_VIEW_COLUMNS = {"type": "p_brand", "target": "concat(CASE p_size % 3 WHEN 0 THEN 'eurlex' WHEN 1 THEN 'curia' ELSE 'table' END, CASE WHEN p_size > 40 THEN '-old' ELSE '' END)", "environments": "CASE p_partkey % 4 WHEN 0 THEN {a}'*'{z} WHEN 1 THEN {a}'court', 'press'{z} WHEN 2 THEN {a}'archive'{z} ELSE {a}'court'{z} END"}


def _views(spark, sf_dir):
    columns = [f"{e.format(a='array(', z=')')} AS {c}" for c, e in _VIEW_COLUMNS.items()]
    return table(spark, sf_dir, "part").selectExpr("p_partkey", *columns, "CASE WHEN p_size % 2 = 0 THEN p_type END AS base_type", "p_size = 7 AS common")


_VIEW_ROWS = "views AS (SELECT p_partkey, " + ", ".join(f"{e.format(a='[', z=']')} AS {c}" for c, e in _VIEW_COLUMNS.items()) + ", CASE WHEN p_size % 2 = 0 THEN p_type END AS base_type, p_size = 7 AS common, p_size FROM part)"


@query(f"WITH {_VIEW_ROWS} SELECT p_partkey, type, target FROM views WHERE list_has_any(environments, ['*', 'court']) AND target IN ('eurlex', 'curia', 'table')")
def env_target_filter(spark, sf_dir):
    return rule_tables.shown(_views(spark, sf_dir), Options(environments=frozenset({"court"}), targets=frozenset({"eurlex", "curia", "table"}))).select("p_partkey", "type", "target")


@query(f"WITH {_VIEW_ROWS} SELECT p_partkey, type, target FROM views WHERE NOT contains(target, 'eurlex')")
def exclude_target(spark, sf_dir):
    return rule_tables.shown(_views(spark, sf_dir), Options(excluded_targets=("eurlex",))).select("p_partkey", "type", "target")


@query(f"WITH {_VIEW_ROWS} SELECT type, list_sort(list(DISTINCT target)) AS targets, list_sort(list(DISTINCT e)) AS environments FROM (SELECT type, target, unnest(environments) AS e FROM views) GROUP BY type")
def catalog_rollup(spark, sf_dir):
    each = _views(spark, sf_dir).withColumn("environment", F.explode("environments")).withColumn("base_target", F.col("target"))
    return nodes.catalogue(each).select("type", "targets", "environments")


@query(f"WITH {_VIEW_ROWS} SELECT p_partkey, CAST(CASE target WHEN 'curia' THEN 1 WHEN 'eurlex' THEN 2 ELSE 3 + length(target) END AS BIGINT) AS place FROM views")
def view_order(spark, sf_dir):
    return _views(spark, sf_dir).select("p_partkey", nodes.view_order(F.col("target"), ["curia", "eurlex"], F.length("target")).cast("long").alias("place"))


@query(f"""WITH {_VIEW_ROWS}, each AS (SELECT *, unnest(environments) AS e FROM views)
SELECT 'environment' AS map, e AS key, list_sort(list(DISTINCT type)) AS types, list_sort(list(DISTINCT target)) AS targets FROM each GROUP BY e
UNION ALL SELECT 'rule', type, [type], list_sort(list(DISTINCT target)) FROM views GROUP BY type
UNION ALL SELECT 'base', coalesce(base_type, type), list_sort(list(DISTINCT type)), coalesce(list_sort(list(DISTINCT target) FILTER (NOT common)), []) FROM views GROUP BY coalesce(base_type, type)""")
def filter_dependencies(spark, sf_dir):
    """Which types and targets an environment has, which targets a type, which types and targets a base type."""
    views = _views(spark, sf_dir)
    named = lambda df, kind, key: df.select(F.lit(kind).alias("map"), F.col(key).alias("key"), "types", "targets")
    rules = rule_tables.by_rule(views).withColumn("types", F.array("type"))
    return named(rule_tables.by_environment(views), "environment", "environment").unionByName(named(rules, "rule", "type")).unionByName(named(rule_tables.by_base_type(views), "base", "base_type"))


_REFERRING = "CASE WHEN p_partkey % 8 < 7 THEN concat('a{{?: p', p_partkey + 1, ' }}b', CASE WHEN p_partkey % 8 < 5 THEN concat('{{ p', p_partkey + 2, ' }}') ELSE '' END) ELSE 'c' END"


@query(f"""WITH {_VIEW_ROWS}, used AS (SELECT DISTINCT unnest(environments) AS environment, p_partkey FROM views)
SELECT DISTINCT environment, concat('p', p_partkey + i) AS name FROM used, (SELECT unnest(range(0, 8)) AS i) WHERE p_partkey % 8 + i < 8""")
def rule_dependencies(spark, sf_dir):
    """The rules of each environment's views and all named patterns that these need, directly or through others."""
    rules = table(spark, sf_dir, "part").selectExpr("concat('t', p_partkey) AS type", "concat('p', p_partkey) AS name", f"{_REFERRING} AS pattern")
    views = _views(spark, sf_dir).withColumn("type", F.concat(F.lit("t"), F.col("p_partkey")))
    return rule_tables.needed_by_environment(rules, views)


@query("""SELECT o_orderkey AS doc_id, CAST(4 AS INTEGER) AS position, concat('Article 5/', o_custkey) AS match, [concat('Article 5/', o_custkey), '5', concat('', o_custkey), concat('', o_custkey)] AS groups FROM orders
UNION ALL SELECT o_orderkey, CAST(5 + length(concat('Article 5/', o_custkey)) AS INTEGER), 'x1', ['x1', '1', NULL, NULL] FROM orders""")
def several_groups(spark, sf_dir):
    """Rules with several groups, nested ones too, beside each other: each match keeps its own rule's captures."""
    xml = r"<rules><rule type='two' order='1'><pattern>Article\s(\d+)/((\d+))</pattern><view target='p'>$0</view></rule><rule type='one' order='2'><pattern>x(\d)</pattern><view target='p'>$0</view></rule></rules>"
    rules = compile_rules(rules_from_xml(xml))
    docs = _sql(spark, sf_dir, "orders", "o_orderkey AS doc_id", "concat('See Article 5/', o_custkey, ' x1') AS text")
    found = detect.scan(docs, rules)
    caught = found.withColumn("g", detect.all_captures(rules, F.col("rule"), F.col("match")))
    return caught.select("doc_id", "position", "match", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get("g", i)).alias("groups"))


# ---- aliases


@query("""SELECT o_orderkey AS doc_id, concat('see Regulation (EU) 2016/', o_custkey, ', then the Data  Law') AS text FROM orders""")
def alias_patterns(spark, sf_dir):
    """A pattern with groups; the shared alias counts before the local one; removed aliases are gone."""
    a = Aliases().added(r"/Reg\.? (\d+)\/(\d+)/", "Regulation (EU) {{ $2 }}/{{ $1 }}").added("Data Act", "Data  Law").added("Data Act", "local", local=True).added("then", "gone").removed("then")
    docs = _sql(spark, sf_dir, "orders", "o_orderkey AS doc_id", "concat('see Reg. ', o_custkey, '/2016, then the Data Act') AS text")
    return docs.select("doc_id", alias.replaced(F.col("text"), a).alias("text"))


@query("SELECT o_orderkey, concat('b', o_custkey) AS source, concat('c', o_custkey) AS replacement FROM orders")
def alias_difference(spark, sf_dir):
    d = alias.difference(F.expr("concat('same ', o_orderkey, ' b', o_custkey)"), F.expr("concat('same ', o_orderkey, ' c', o_custkey)"))
    return table(spark, sf_dir, "orders").select("o_orderkey", d["source"].alias("source"), d["replacement"].alias("replacement"))


@query("""SELECT label, max(celex) AS celex FROM (SELECT CASE WHEN o_custkey % 3 = 0 THEN concat('Act ', o_custkey) ELSE concat('3', o_orderkey, 'R') END AS label, concat('3', o_orderkey, 'R') AS celex FROM orders) GROUP BY label""")
def alias_from_works(spark, sf_dir):
    rows = _sql(spark, sf_dir, "orders", "concat('3', o_orderkey, 'R') AS celex")
    titles = table(spark, sf_dir, "orders").where("o_custkey % 3 = 0").selectExpr("concat('3', o_orderkey, 'R') AS celex", "'ENG' AS lang", "concat('Act ', o_custkey) AS title")
    french = titles.withColumn("lang", F.lit("FRA")).withColumn("title", F.lit("Loi"))
    return alias.from_works(rows, titles.unionByName(french), "ENG")


# ---- resolvers of placeholders


@query("""WITH m AS (SELECT c_custkey AS key, concat('3', 1990 + c_custkey % 20, 'D', lpad(concat('', c_custkey), 4, '0')) AS celex, c_custkey % 2 AS own FROM customer)
SELECT key, CASE WHEN own = 1 THEN concat(celex, '(02)') ELSE celex END AS value FROM m""")
def act_sub_numbers(spark, sf_dir):
    """Of an act and its sub-numbers the last whose title begins with the number cited, else the first."""
    celex = "concat('3', 1990 + c_custkey % 20, 'D', lpad(concat('', c_custkey), 4, '0'))"
    mentions = _sql(spark, sf_dir, "customer", "c_custkey AS key", f"{celex} AS celex", "1990 + c_custkey % 20 AS year", "concat('Decision No ', c_custkey, '/', 1990 + c_custkey % 20) AS context")
    plain = _sql(spark, sf_dir, "customer", f"{celex} AS celex", "'Decision 0/0' AS title", "1 AS seq")
    cited = table(spark, sf_dir, "customer").where("c_custkey % 2 = 1").selectExpr(f"concat({celex}, '(01)', '') AS celex", "concat('On ', c_custkey, '/', 1990 + c_custkey % 20) AS title", "2 AS seq")
    last = cited.withColumn("celex", F.replace("celex", F.lit("(01)"), F.lit("(02)"))).withColumn("seq", F.lit(3))
    return resolve.act_numbers(mentions, plain.unionByName(cited).unionByName(last))


@query("SELECT p_partkey AS key, concat('eli/', max(o_orderkey)) AS value FROM part JOIN orders ON o_custkey = p_partkey GROUP BY p_partkey")
def legacy_acts(spark, sf_dir):
    mentions = _sql(spark, sf_dir, "part", "p_partkey AS key", "'com' AS author", "p_partkey AS number", "'reg' AS type")
    rows = _sql(spark, sf_dir, "orders", "CASE WHEN o_orderkey % 2 = 0 THEN 'com' ELSE 'com' END AS author", "o_custkey AS number", "'reg' AS type", "concat('eli/', o_orderkey) AS eli", "o_orderkey AS seq")
    others = rows.withColumn("author", F.lit("council")).withColumn("seq", F.col("seq") + 10**9)
    return resolve.legacy_acts(mentions, rows.unionByName(others))


@query("SELECT p_partkey AS key, concat('eli/', max(o_orderkey)) AS value FROM part JOIN orders ON o_orderkey % 500 = p_partkey WHERE o_custkey % 2 = 0 GROUP BY p_partkey")
def partnership_decisions(spark, sf_dir):
    mentions = _sql(spark, sf_dir, "part", "p_partkey AS key", "concat(p_partkey, '/2021') AS number")
    rows = _sql(spark, sf_dir, "orders", "concat('Decision No ', o_orderkey % 500, '/2021 of the ', CASE WHEN o_custkey % 2 = 0 THEN 'Partnership' ELSE 'Other' END, ' Council') AS title", "concat('eli/', o_orderkey) AS eli", "o_orderkey AS seq")
    return resolve.partnership_decisions(mentions, rows, "Partnership Council")


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN concat('eli/', c_custkey) ELSE 'INVALID' END AS value FROM customer")
def journal_elis(spark, sf_dir):
    mentions = _sql(spark, sf_dir, "customer", "c_custkey AS key", "'2000-01-02' AS date", "2000 AS year", "c_custkey AS number")
    rows = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").selectExpr("'2000-01-02' AS date", "2000 AS year", "c_custkey AS number", "concat('3', c_custkey) AS celex", "concat('eli/', c_custkey) AS eli", "1 AS seq")
    return resolve.oj_elis(mentions, rows)


@query("SELECT c_custkey AS key, CASE c_custkey % 3 WHEN 0 THEN concat('eli/', c_custkey) WHEN 1 THEN concat('oj/', c_custkey) ELSE concat('eli/by-number/', c_custkey) END AS value FROM customer")
def bank_elis(spark, sf_dir):
    """By the bank's reference, with the journal's address where there is no ELI; else by year and number in the identifier."""
    ref = "concat('ECB/2011/', c_custkey)"
    mentions = _sql(spark, sf_dir, "customer", "c_custkey AS key", f"{ref} AS reference", "'2011' AS year", "concat('', c_custkey) AS number")
    own = table(spark, sf_dir, "customer").where("c_custkey % 3 < 2").selectExpr(f"{ref} AS reference", "CASE WHEN c_custkey % 3 = 0 THEN concat('eli/', c_custkey) END AS eli", "concat('oj/', c_custkey) AS oj_url", "'x' AS celex", "2 AS seq")
    numbered = _sql(spark, sf_dir, "customer", "'none' AS reference", "concat('eli/by-number/', c_custkey) AS eli", "'oj' AS oj_url", "concat('32011O', CASE WHEN c_custkey < 1000 THEN lpad(concat('', c_custkey), 4, '0') ELSE concat('', c_custkey) END) AS celex", "1 AS seq")
    return resolve.ecb_elis(mentions, own.unionByName(numbered))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat('32011O', CASE WHEN c_custkey < 1000 THEN lpad(concat('', c_custkey), 4, '0') ELSE concat('', c_custkey) END) END AS celex FROM customer")
def bank_guidelines(spark, sf_dir):
    url = F.expr("CASE WHEN c_custkey % 2 = 0 THEN concat('http://x/eli/guideline/2011/', c_custkey, '/oj') ELSE 'http://x/none' END")
    return table(spark, sf_dir, "customer").select("c_custkey", resolve.ecb_guidelines(url).alias("celex"))


@query("SELECT c_custkey AS key, concat('6', 2001 + c_custkey // 10000, 'TO', lpad(concat('', c_custkey % 10000), 4, '0'), CASE WHEN c_custkey % 2 = 0 THEN '(02)' ELSE '' END) AS value FROM customer")
def case_orders(spark, sf_dir):
    year = "2001 + CAST(floor(c_custkey / 10000) AS INT)"
    celex = f"concat('6', {year}, 'TO', lpad(concat('', c_custkey % 10000), 4, '0'))"
    case = f"concat('Case T-', c_custkey % 10000, '/', {year})"
    mentions = _sql(spark, sf_dir, "customer", "c_custkey AS key", f"{celex} AS celex", f"{case} AS label")
    plain = _sql(spark, sf_dir, "customer", f"{celex} AS celex", f"concat('Order#A v B#', {case}, CASE WHEN c_custkey % 2 = 0 THEN ' R.' ELSE '.' END) AS title", "1 AS seq")
    second = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").selectExpr(f"concat({celex}, '(02)') AS celex", f"concat('Order#', {case}, '.') AS title", "2 AS seq")
    return resolve.case_orders(mentions, plain.unionByName(second))


@query("SELECT o_orderkey AS key, CASE WHEN o_custkey % 2 = 0 THEN concat('6', o_orderkey) END AS value, o_custkey % 2 = 0 AS kept FROM orders")
def joined_judgments(spark, sf_dir):
    mentions = _sql(spark, sf_dir, "orders", "o_orderkey AS key", "concat('C-', o_orderkey, '/11') AS label")
    joined = table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").selectExpr("concat('6', o_orderkey) AS main", "concat('C-', o_orderkey, '/11') AS label")
    return resolve.joined_judgments(mentions, joined)


@query("SELECT o_orderkey, concat('http://data.europa.eu/eli/reg/', o_custkey) AS url, concat('reg/', o_custkey) AS bare FROM orders")
def subdivision_base_url(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", resolve.base_url(F.expr("concat('{{ ELI_BASE_URL }}reg/', o_custkey)"), url="http://data.europa.eu/eli/").alias("url"), resolve.base_url(F.expr("concat('{{ ELI_BASE_URL|x }}reg/', o_custkey)")).alias("bare"))


@query("""SELECT o_orderkey AS key, concat('JO_', o_custkey) AS oj, concat('/uri/', o_orderkey, '/') AS uriserv, CASE WHEN o_orderkey % 2 = 0 THEN concat('3', o_orderkey) END AS celex FROM orders WHERE o_custkey % 3 = 0""")
def existing_journals(spark, sf_dir):
    mentions = _sql(spark, sf_dir, "orders", "o_orderkey AS key", "concat('JO_', o_custkey) AS oj", "concat('/uri/', o_orderkey, '/') AS uriserv")
    known = table(spark, sf_dir, "orders").where("o_custkey % 3 = 0").selectExpr("concat('JO_', o_custkey) AS oj", "CASE WHEN o_orderkey % 2 = 0 THEN concat('3', o_orderkey) END AS celex", "concat('http://x/uri/', o_orderkey, '/pdf') AS url")
    return resolve.existing_journals(mentions, known)


@query("SELECT o_orderkey AS key, concat('ST ', o_custkey) AS consil FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def existing_council(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_nationkey < 12").selectExpr("concat('consil:ST ', c_custkey) AS id").unionByName(_sql(spark, sf_dir, "customer", "concat('celex:ST ', c_custkey) AS id"))
    return resolve.existing_council(_sql(spark, sf_dir, "orders", "o_orderkey AS key", "concat('ST ', o_custkey) AS consil"), known).select("key", "consil")


@query("SELECT o_orderkey, CAST(CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS n, CAST(2 AS INTEGER) AS linked FROM orders")
def inert_targets(spark, sf_dir):
    pair = F.expr("array(named_struct('id', concat('', o_orderkey), 'active', false), named_struct('id', CASE WHEN o_custkey % 2 = 0 THEN concat('', o_orderkey) ELSE 'other' END, 'active', true))")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", pair.alias("a"))
    return rows.select("o_orderkey", F.size(resolve.without_inert(F.col("a"), False)).alias("n"), F.size(resolve.without_inert(F.col("a"), True)).alias("linked"))


# ---- files


@query("SELECT concat('set-', page_id % 7, '/page-', page_id, '.txt') AS name, concat(url, chr(10), length(html)) AS value FROM pages")
def named_files(spark, sf_dir):
    """A file for each page under its own name, written by a commit of all tasks, and read back."""
    rows = table(spark, sf_dir, "pages").selectExpr("concat('set-', page_id % 7, '/page-', page_id) AS name", "concat(url, chr(10), length(html)) AS value")
    folder = works.fresh_folder(spark, "named")
    named.write_named(rows, folder, "txt")
    back = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return back.select(F.regexp_extract("_metadata.file_path", r"(set-[0-9]+/[^/]+)$", 1).alias("name"), "value")


# ---- metadata


def _acts(spark, sf_dir) -> works.Catalogue:
    """Orders as acts: a title in two languages, consolidations, repeals in steps, an issue of the journal, a dossier, a text."""
    o = lambda *columns: _sql(spark, sf_dir, "orders", *columns)
    eng = o("concat('3', o_orderkey) AS celex", "'ENG' AS lang", "concat('Act ', o_orderkey) AS title", "1 AS seq")
    fra = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").selectExpr("concat('3', o_orderkey) AS celex", "'FRA' AS lang", "concat('Loi ', o_orderkey) AS title", "1 AS seq")
    return works.Catalogue(
        works=o("concat('3', o_orderkey) AS celex", "concat('eli/reg/', o_orderkey, '/oj') AS eli", "CASE WHEN o_orderkey % 5 = 0 THEN concat('ECLI:EU:', o_orderkey) END AS ecli", "cast(o_orderdate AS date) AS date", "cast(o_orderdate AS date) AS date_force", "date_add(cast(o_orderdate AS date), 30) AS date_validity", "'1' AS force"),
        expressions=eng.unionByName(fra).unionByName(eng.withColumn("title", F.concat("title", F.lit(" corrected"))).withColumn("seq", F.lit(2))),
        consolidations=o("concat('3', o_orderkey) AS celex", "concat('0', o_orderkey) AS consolidated", "concat('eli/reg/', o_orderkey, '/', o_custkey) AS eli", "date_add(cast(o_orderdate AS date), 10) AS date"),
        repeals=table(spark, sf_dir, "orders").where("o_orderkey % 10 < 8").selectExpr("concat('3', o_orderkey) AS celex", "concat('3', o_orderkey + 1) AS repealed_by"),
        journal=o("concat('JO_', o_orderkey) AS oj", "concat('3', o_orderkey) AS celex", "concat('OJ L ', o_orderkey) AS label", "concat('http://oj/', o_orderkey) AS url", "cast(o_orderdate AS date) AS date"),
        dossiers=table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").selectExpr("concat('P', o_custkey) AS proc", "concat('3', o_orderkey) AS celex", "o_orderdate AS date", "concat('File ', o_orderkey) AS title", "'ENG' AS lang", "o_orderkey AS seq", "o_custkey % 2 AS adopted", "concat('celex:3', o_orderkey) AS published"),
        act_text=o("concat('3', o_orderkey) AS celex", "concat('eli/reg/', o_orderkey, '/oj') AS eli", "'ENG' AS lang", "concat('<p>', o_orderkey, '</p>') AS html"),
    )


@query("""WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS day, o_orderkey // 10 * 10 AS ten, o_orderkey % 10 < 8 AS gone FROM orders),
ends AS (SELECT o.o_orderkey, min(o.ten + i) AS last FROM o CROSS JOIN (SELECT unnest(range(1, 9)) AS i) LEFT JOIN orders n ON n.o_orderkey = o.ten + i WHERE i > o.o_orderkey % 10 AND (i = 8 OR n.o_orderkey IS NULL) GROUP BY 1)
SELECT concat('3', o.o_orderkey) AS celex, 'ok' AS status, CASE WHEN o.o_orderkey % 2 = 0 THEN concat('Loi ', o.o_orderkey) ELSE concat('Act ', o.o_orderkey, ' corrected') END AS base_title,
concat(CASE WHEN o.o_orderkey % 2 = 0 THEN concat('Loi ', o.o_orderkey) ELSE concat('Act ', o.o_orderkey, ' corrected') END, CASE WHEN o.o_orderkey % 5 = 0 THEN concat(chr(10), 'ECLI identifier: ECLI:EU:', o.o_orderkey) ELSE '' END) AS title,
concat('JO_', o.o_orderkey) AS oj_id, concat('OJ L ', o.o_orderkey) AS oj, concat('http://oj/', o.o_orderkey) AS oj_url, day AS oj_date, day + 30 AS date_validity,
CASE WHEN day + 10 < DATE '1997-01-01' THEN concat('0', o.o_orderkey) END AS consolidated,
CASE WHEN gone THEN concat('3', o.o_orderkey + 1) END AS repeal, CASE WHEN gone THEN concat('3', last) END AS repealed_by,
CASE WHEN gone AND n.o_orderkey IS NOT NULL THEN concat('eli/reg/', n.o_orderkey, '/oj') END AS repeal_eli, CASE WHEN gone AND e.o_orderkey IS NOT NULL THEN concat('eli/reg/', e.o_orderkey, '/oj') END AS last_repeal_eli,
CASE WHEN o.o_orderkey % 2 = 0 THEN concat('P', o.o_custkey) END AS proc, CASE WHEN o.o_orderkey % 2 = 0 THEN concat('File ', o.o_orderkey) END AS dossier_title
FROM o LEFT JOIN ends USING (o_orderkey) LEFT JOIN orders n ON n.o_orderkey = o.o_orderkey + 1 LEFT JOIN orders e ON e.o_orderkey = last
UNION ALL SELECT '3none', 'missing', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""")
def celex_metadata(spark, sf_dir):
    """All columns of all acts, in French where there is a French title; consolidations before a day; chains of repeals, gaps included."""
    asked = table(spark, sf_dir, "orders").selectExpr("concat('3', o_orderkey) AS celex").unionByName(spark.range(1).selectExpr("'3none' AS celex"))
    got = works.celex_metadata(asked, _acts(spark, sf_dir), "FRA", "1997-01-01")
    return got.select("celex", "status", "base_title", "title", "oj_id", "oj", "oj_url", "oj_date", "date_validity", "consolidated", "repeal", "repealed_by", "repeal_eli", "last_repeal_eli", "proc", "dossier_title")


@query("SELECT concat('JO_', o_orderkey) AS oj, concat('3', o_orderkey) AS celex, concat('Act ', o_orderkey, ' corrected', CASE WHEN o_orderkey % 5 = 0 THEN concat(chr(10), 'ECLI identifier: ECLI:EU:', o_orderkey) ELSE '' END) AS title FROM orders")
def oj_metadata(spark, sf_dir):
    return works.oj_metadata(_sql(spark, sf_dir, "orders", "concat('JO_', o_orderkey) AS oj"), _acts(spark, sf_dir), "ENG").select("oj", "celex", "title")


@query("""SELECT concat('eli/reg/', o_orderkey, '/oj') AS eli, concat('eli/reg/', o_orderkey, '/', greatest(concat('', o_custkey), 'oj')) AS held, concat('eli/reg/', o_orderkey, '/oj') AS initial_eli, concat('eli/reg/', o_orderkey, '/', o_custkey) AS final_eli,
concat('Act ', o_orderkey, ' corrected') AS title FROM orders""")
def eli_metadata(spark, sf_dir):
    return works.eli_metadata(_sql(spark, sf_dir, "orders", "concat('eli/reg/', o_orderkey, '/oj') AS eli"), _acts(spark, sf_dir), "ENG").select("eli", "held", "initial_eli", "final_eli", "title")


@query("SELECT concat('0', o_orderkey) AS consolidated FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def consolidations_by_root(spark, sf_dir):
    """All versions below the roots of some ELIs."""
    held = _sql(spark, sf_dir, "orders", "concat('0', o_orderkey) AS consolidated", "concat('http://x/eli/reg/2000/', o_custkey, '/', o_orderkey) AS eli")
    asked = table(spark, sf_dir, "customer").where("c_nationkey < 5").selectExpr("concat('http://x/eli/reg/2000/', c_custkey, '/oj') AS eli")
    return works.consolidations_of(asked, works.Catalogue(consolidations=held)).select("consolidated")


@query("SELECT concat('ECLI:EU:', o_orderkey) AS ecli, CASE WHEN o_orderkey % 5 = 0 THEN concat('Act ', o_orderkey, ' corrected') END AS title FROM orders")
def ecli_metadata(spark, sf_dir):
    return works.ecli_metadata(_sql(spark, sf_dir, "orders", "concat('ECLI:EU:', o_orderkey) AS ecli"), _acts(spark, sf_dir), "ENG").select("ecli", "title")


@query("""SELECT proc, concat('File ', o_orderkey, chr(10), CASE WHEN o_custkey % 2 = 1 THEN concat('✔ Completed (Adopted act: 3', o_orderkey, ')') ELSE '↻ Ongoing' END) AS title
FROM (SELECT *, concat('P', o_custkey) AS proc FROM orders WHERE o_orderkey % 2 = 0) QUALIFY row_number() OVER (PARTITION BY proc ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def procedures(spark, sf_dir):
    return works.procedures(_sql(spark, sf_dir, "orders", "concat('P', o_custkey) AS proc"), _acts(spark, sf_dir), "DEU").select("proc", "title")


@query("SELECT concat('fi/', o_custkey) AS eli, concat('Laki ', max(o_orderkey), ' (', strftime(arg_max(o_orderdate, o_orderkey), '%Y-%m-%d'), ')') AS title FROM orders GROUP BY o_custkey")
def national_elis(spark, sf_dir):
    acts = _sql(spark, sf_dir, "orders", "concat('fi/', o_custkey) AS eli", "concat('Laki ', o_orderkey) AS title", "cast(o_orderdate AS date) AS date", "o_orderkey AS seq")
    return works.national_elis(_sql(spark, sf_dir, "customer", "concat('fi/', c_custkey) AS eli").unionByName(acts.select("eli")), acts).select("eli", "title")


@query("SELECT concat('3', o_orderkey) AS celex, CASE WHEN o_orderkey % 2 = 0 THEN concat('Loi ', o_orderkey) END AS title FROM orders")
def full_titles(spark, sf_dir):
    asked = _sql(spark, sf_dir, "orders", "concat('3', o_orderkey) AS celex").unionByName(_sql(spark, sf_dir, "orders", "concat('6', o_orderkey) AS celex"))
    return works.full_titles(asked, _acts(spark, sf_dir), "FRA")


@query("SELECT o_orderkey AS n, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE concat('<p>', o_orderkey, '</p>') END AS html FROM orders")
def legal_text(spark, sf_dir):
    """By ELI, by CELEX where the ELI isn't held, and none."""
    asked = _sql(spark, sf_dir, "orders", "o_orderkey AS n", "CASE WHEN o_orderkey % 3 = 0 THEN concat('eli/reg/', o_orderkey, '/oj') ELSE 'eli/none' END AS eli", "CASE WHEN o_orderkey % 3 = 2 THEN 'none' ELSE concat('3', o_orderkey) END AS celex")
    return works.legal_text(asked, _acts(spark, sf_dir), "ENG").select("n", "html")


@query("SELECT concat('', p_partkey) AS celex, CASE WHEN p_partkey % 3 = 0 THEN 'TEU' WHEN p_partkey % 3 = 1 THEN p_name END AS short_title FROM part")
def treaty_or_title(spark, sf_dir):
    rows = _sql(spark, sf_dir, "part", "concat('', p_partkey) AS celex", "CASE WHEN p_partkey % 3 = 0 THEN 'TEU' END AS treaty")
    titles = table(spark, sf_dir, "part").where("p_partkey % 3 < 2").selectExpr("concat('', p_partkey) AS celex", "p_name AS title")
    return works.short_titles(rows, titles, F.col("treaty")).select("celex", "short_title")


@query("SELECT concat('', c_custkey) AS celex FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def unpublished(spark, sf_dir):
    """Acts that no issue holds; issues are made of the dearest orders alone, so that there are some."""
    journal = table(spark, sf_dir, "orders").where("o_totalprice > 400000").selectExpr("concat('JO', o_orderkey) AS oj", "concat('', o_custkey) AS celex")
    return works.unpublished(_sql(spark, sf_dir, "customer", "concat('', c_custkey) AS celex"), journal)


# ---- results

_ALTERNATIVE = "named_struct('match', 'm', 'type', {t}, 'view', {v}, 'order', {o}, 'group_target', {g})"


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN ['a', 'b', 'c'] ELSE ['c', 'a', 'b'] END AS views, CASE WHEN o_custkey % 2 = 0 THEN [] ELSE ['g'] END AS groups FROM orders")
def alternatives_union(spark, sf_dir):
    """Alternatives of two results: each once, by order; and the groups that have several."""
    a = lambda v, o, g="''": _ALTERNATIVE.format(t="'t'", v=f"'{v}'", o=o, g=g)
    left = F.expr(f"array({a('b', 2)}, {a('c', 'CASE WHEN o_custkey % 2 = 1 THEN 0 END')})")
    right = F.expr(f"array({a('a', 1)}, {a('b', 7)}, {a('a', 1)})")
    grouped = F.expr(f"array({a('a', 1, 'CASE WHEN o_custkey % 2 = 1 THEN chr(103) END')}, {a('b', 2, 'chr(103)')}, {a('c', 3)})")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", nodes.alternatives_union(left, right).alias("u"), nodes.target_groups(grouped).alias("g"))
    return rows.select("o_orderkey", F.transform("u", lambda x: x["view"]).alias("views"), F.transform("g", lambda x: x["group_target"]).alias("groups"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '_self' WHEN 1 THEN '_blank' END AS opened FROM part")
def view_attributes(spark, sf_dir):
    settings = {"act": {"eurlex": {"target": "_self"}}, "case": {"eurlex": {"target": "_top"}, "curia": {"target": "_blank"}}}
    made = nodes.view_attributes(F.expr("CASE p_partkey % 3 WHEN 0 THEN 'eurlex-old' WHEN 1 THEN 'curia' ELSE 'other' END"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'eurlex' ELSE '' END"), settings)
    return table(spark, sf_dir, "part").select("p_partkey", F.try_element_at(made, F.lit("target")).alias("opened"))


@query("""SELECT o_custkey AS doc_id, coalesce(list_sort(list(DISTINCT concat('3', o_orderkey)) FILTER (o_orderkey % 2 = 0)), []) AS celex, coalesce(list_sort(list(DISTINCT concat('ECLI:EU:', o_orderkey)) FILTER (o_orderkey % 4 = 1)), []) AS ecli FROM orders GROUP BY o_custkey""")
def linked_ids(spark, sf_dir):
    """Identifiers of each kind by document; ECLIs only of the Union's courts, and only without a CELEX identifier."""
    attrs = "map('celex', CASE WHEN o_orderkey % 2 = 0 THEN concat('3', o_orderkey) ELSE '' END, 'ecli', CASE WHEN o_orderkey % 4 = 3 THEN 'ECLI:FR:1' ELSE concat('ECLI:EU:', o_orderkey) END) AS attrs"
    return nodes.linked_ids(_sql(spark, sf_dir, "orders", "o_custkey AS doc_id", attrs)).select("doc_id", "celex", "ecli")


@query("""SELECT o_orderkey, 'v1' AS kept, 'v0' AS first_kept, concat('c', o_custkey, '|J', o_custkey) AS all_ids, concat('k=1,l=', o_custkey, ',m=3') AS merged, 'to X Y' AS titled, 'z' AS plain, CAST(1 AS INTEGER) AS marked FROM orders""")
def attribute_maps(spark, sf_dir):
    """Names without numbers (the first wins), all identifiers of a mention, titles with their group, marked attributes."""
    html_ = F.lit('<a data-ref-x="v0" data-ref-x="v1" data-uuid="u" data-ref-empty="">')
    attrs = ids.normalised(ids.attributes(html_))
    numbered = ids.unsuffixed(F.create_map(F.lit("x-0"), F.lit("v0"), F.lit("x-1"), F.lit("v1")))
    own = F.create_map(F.lit("celex"), F.expr("concat('c', o_custkey)"), F.lit("oj"), F.expr("concat('J', o_custkey)"), F.lit("ecli"), F.lit("ECLI:FR:2"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", attrs["x"].alias("kept"), numbered["x"].alias("first_kept"), F.array_join(ids.id_list(own), "|").alias("all_ids"), ids.titled(F.lit("to Y"), F.lit("X")).alias("titled"), ids.titled(F.lit("z"), F.lit("X")).alias("plain"),
        F.size(ids.marked(own, F.array(F.lit("oj"), F.lit("none")))).alias("marked"),
        F.array_join(F.transform(F.array_sort(F.map_entries(ids.merged(F.create_map(F.lit("k"), F.lit("1"), F.lit("l"), F.lit("2")), F.create_map(F.lit("l"), F.col("o_custkey").cast("string"), F.lit("m"), F.lit("3"))))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("merged"),
    )


@query("SELECT o_orderkey, o_custkey % 2 = 0 AS visible, CASE WHEN length(concat('', o_custkey)) <= 3 THEN concat('', o_custkey) ELSE 'ref' END AS shown FROM orders")
def shown_titles(spark, sf_dir):
    targets = F.expr("array(named_struct('target', 'table'), named_struct('target', CASE WHEN o_custkey % 2 = 0 THEN 'page' ELSE 'table' END))")
    return table(spark, sf_dir, "orders").select("o_orderkey", detect.has_visible(targets).alias("visible"), detect.within_limit(F.lit("ref"), F.col("o_custkey").cast("string"), Options(title_limit=3)).alias("shown"))


@query("SELECT o_custkey AS doc_id, string_agg(concat('n', o_orderkey), chr(9) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey")
def texts_of_nodes(spark, sf_dir):
    return readers.from_nodes(_sql(spark, sf_dir, "orders", "o_custkey AS doc_id", "o_orderkey AS node", "concat('n', o_orderkey) AS text"))


@query("SELECT page_id, replace(html, '<b>', '<a href=\"keep\"></a>first <b>') AS html FROM pages")
def links_taken_out(spark, sf_dir):
    """Links that were put into pages, taken out again; others stay."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", html.unlinked(F.replace("html", F.lit("<b>"), F.lit('<a href="keep"></a><a href="x" data-initial="first">F.</a> <b>'))).alias("html"))


@query("SELECT page_id, replace(html, '<b>', 'note  <b>') AS html FROM pages")
def note_anchors(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.without_note_anchors(F.replace("html", F.lit("<b>"), F.lit('note <a href="#n1"> (12) </a> <b>'))).alias("html"))


_ACT = """concat('<div id="art_', n, '"><p class="title">Article ', n, '</p><div id="', lpad(n, 3, '0'), '.001">1. First ', o_custkey, '</div><div id="', lpad(n, 3, '0'), '.002">2. Second <table><tr><td>(a)</td><td>point ', o_orderkey, '</td></tr></table></div></div><div id="anx_I"><p>Annex ', o_custkey, '</p></div><p>Article 99</p><p>Last ', o_orderkey, '.</p>')"""


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN concat(lpad(concat('', o_custkey % 40 + 1), 3, '0'), '.001') WHEN 1 THEN concat(lpad(concat('', o_custkey % 40 + 1), 3, '0'), '.002') WHEN 2 THEN 'anx_I' WHEN 3 THEN concat('art_', o_custkey % 40 + 1) END AS id,
CASE o_orderkey % 6 WHEN 0 THEN concat('1. First ', o_custkey) WHEN 1 THEN concat('(a)point ', o_orderkey) WHEN 2 THEN concat('Annex ', o_custkey) WHEN 4 THEN concat('Last ', o_orderkey, '.') END AS content,
CASE o_orderkey % 6 WHEN 3 THEN 'paragraph.not.found' WHEN 5 THEN 'subdivision.not.found' END AS error, CAST(2 AS INTEGER) AS n_parts FROM orders""")
def act_parts(spark, sf_dir):
    """Paragraphs, points and annexes by their ids, an article by its heading, and parts that an act doesn't have."""
    rows = spread(table(spark, sf_dir, "orders")).selectExpr("o_orderkey", "o_custkey", "concat('', o_custkey % 40 + 1) AS n")
    part = """named_struct('annex', CASE WHEN o_orderkey % 6 = 2 THEN 'I' END, 'recital', '', 'article', CASE o_orderkey % 6 WHEN 2 THEN '' WHEN 4 THEN '99' WHEN 5 THEN '88' ELSE n END,
        'paragraph', CASE o_orderkey % 6 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 3 THEN '9' ELSE '' END, 'point', CASE WHEN o_orderkey % 6 = 1 THEN 'A' ELSE '' END)"""
    acts = rows.selectExpr("o_orderkey", f"{_ACT} AS html", f"{part} AS part", "'32016R0679' AS celex")
    got = html.act_parts(acts, "o_orderkey")
    return got.select("o_orderkey", "id", F.when(F.col("error").isNull(), F.col("content")).alias("content"), "error", F.size("subdivisions").alias("n_parts"))


@query("SELECT o_orderkey, 'b' AS a, concat('{\"title\":\"t', o_custkey, '\"}') AS ld FROM orders")
def decorated(spark, sf_dir):
    made = sinks.decorated(F.create_map(F.lit("data-a"), F.lit("b")), F.create_map(F.lit("data-celex"), F.to_json(F.struct(F.expr("concat('t', o_custkey)").alias("title")))))
    return table(spark, sf_dir, "orders").select("o_orderkey", made["data-a"].alias("a"), made["data-celex-ld"].alias("ld"))


@query("""WITH v AS (SELECT concat('t', p_size % 5) AS type, concat('b', p_size % 2) AS base_type, p_brand AS target, CASE WHEN p_partkey % 3 = 0 THEN '*' ELSE 'court' END AS environment FROM part),
r AS (SELECT 'types' AS rollup, '' AS key, type AS value FROM v UNION ALL SELECT 'targets', '', target FROM v UNION ALL SELECT 'environments', '', environment FROM v UNION ALL SELECT 'type_targets', type, target FROM v
UNION ALL SELECT 'base_type_targets', base_type, target FROM v UNION ALL SELECT 'type_environments', type, environment FROM v UNION ALL SELECT 'environment_types', environment, type FROM v)
SELECT rollup, key, list_sort(list(DISTINCT value)) AS values FROM r GROUP BY ALL""")
def rule_rollups(spark, sf_dir):
    return nodes.rollups(_sql(spark, sf_dir, "part", "concat('t', p_size % 5) AS type", "concat('b', p_size % 2) AS base_type", "p_brand AS target", "CASE WHEN p_partkey % 3 = 0 THEN '*' ELSE 'court' END AS environment"))
