"""Queries on detection, lists, aliases and nodes, with their SQL twins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import alias, alias_table, detect, lists, nodes, tables, works
from ..options import Aliases, Optimizer, Options
from ..sources.readers import spread, table
from ..streaming import extract
from . import builtin, texts
from .rules import Rule, RuleSet, View, compile_rules

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders")).selectExpr("o_orderkey AS doc_id", f"{texts.TEXT} AS text")


def only(*types: str) -> RuleSet:
    full = builtin.rule_set()
    return RuleSet(tuple(c for c in full.rules if c.rule.type in types), full.language)


def simple(pattern: str, type_: str = "x", **more) -> RuleSet:
    return compile_rules([Rule(type=type_, pattern=pattern, views=(View("page", "$0", is_default=True),), **more)])


def order_mentions(spark: SparkSession, sf_dir: str, *types: str, attrs: bool = False) -> DataFrame:
    found = detect.mentions(order_texts(spark, sf_dir), only(*types) if types else builtin.rule_set(), attrs=attrs)
    return found.withColumn("urls", F.flatten(F.transform("alternatives", lambda a: ids.urls(a["view"]))))


_DOCS = f"docs AS ({texts.DOCS})"
_CASES = f"{_DOCS}, hits AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[CTF]-[0-9]{{1,4}}/[0-9]{{2}}')) AS match FROM docs)"
_PARTS = f"""base AS (SELECT o_orderkey AS doc_id, {texts.TEXT} AS text, {texts.CASE} AS a, {texts.JOURNAL} AS b, {texts.COURT} AS c, {texts.ACT} AS d FROM orders),
placed AS (
  SELECT doc_id, text, 'case' AS rule_type, a AS match, 8 AS position FROM base
  UNION ALL SELECT doc_id, text, 'oj', b, 8 + length(a) + 5 FROM base
  UNION ALL SELECT doc_id, text, 'case', c, 8 + length(a) + 5 + length(b) + 5 FROM base
  UNION ALL SELECT doc_id, text, 'act', d, 8 + length(a) + 5 + length(b) + 5 + length(c) + 4 FROM base
  UNION ALL SELECT doc_id, text, 'case', a, 8 + length(a) + 5 + length(b) + 5 + length(c) + 4 + length(d) + 7 FROM base)"""


@query(f"WITH {_CASES} SELECT match, count(*) AS n FROM hits GROUP BY match")
def scan_case_refs(spark, sf_dir):
    return detect.scan(order_texts(spark, sf_dir), only("case")).groupBy("match").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PARTS} SELECT match, rule_type, min(CAST(o_orderdate AS DATE)) AS first_day, count(*) AS n FROM placed JOIN orders ON o_orderkey = doc_id GROUP BY match, rule_type")
def stream_mentions(spark, sf_dir):
    """Mentions of a stream of documents with the day of each, drained and summed up."""
    schema = table(spark, sf_dir, "orders").schema
    orders = spark.readStream.schema(schema).parquet(f"{sf_dir}/order[s].parquet")  # a pattern: a stream of one plain path wants a folder
    docs = orders.selectExpr("o_orderkey AS doc_id", f"{texts.TEXT} AS text", "cast(o_orderdate AS date) AS day")
    found = extract.extract(docs, builtin.rule_set(), event_time="day").select("day", "match", "rule_type")
    return extract.drained(found, works.shared_folder(spark)).groupBy("match", "rule_type").agg(F.min("day").alias("first_day"), F.count(F.lit(1)).alias("n"))


@query("""WITH h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, (SELECT max(ts) FROM events) AS newest FROM events GROUP BY ALL)
SELECT strftime(start, '%Y-%m-%d %H') AS hour, 'case' AS rule_type, n FROM h WHERE start + INTERVAL 1 HOUR <= newest - INTERVAL 10 MINUTE""")
def stream_windows(spark, sf_dir):
    """References of a stream counted by hour of event time; hours that the watermark has not passed are still open."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    docs = events.selectExpr("event_id AS doc_id", "concat('see C-', event_id % 99 + 1, '/10') AS text", "cast(ts AS timestamp) AS ts")
    counts = extract.reference_counts(extract.extract(docs, only("case"), event_time="ts"), "ts", width="1 hour")
    done = extract.drained(counts, works.shared_folder(spark))
    return done.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "rule_type", "n")


@query(f"WITH {_PARTS} SELECT doc_id, CAST(position AS INTEGER) AS position, match, rule_type FROM placed")
def scan_positions(spark, sf_dir):
    return order_mentions(spark, sf_dir).select("doc_id", "position", "match", "rule_type")


@query(f"WITH {_PARTS} SELECT doc_id, CAST(position AS INTEGER) AS position, match, CASE rule_type WHEN 'case' THEN 0 ELSE 1 END AS rule FROM placed WHERE rule_type <> 'act'")
def multi_rule_priority(spark, sf_dir):
    """Two rules match at the same place: the first one by order wins."""
    shadowed = only("case", "oj")
    broad = simple("[A-Z]{1,2}(?: L)?[- ][0-9]{1,4}(?:/[0-9]{2}|, [0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{4})", "broad").rules
    rules = RuleSet((*[c for c in shadowed.rules if c.rule.type == "case"], *broad), "EN")
    return detect.scan(order_texts(spark, sf_dir), rules).select("doc_id", "position", "match", "rule")


_GUARDS = {"license": "licen[sc]es?", "mail": "@[a-z0-9-]+", "ip": "[0-9]{1,3}(?:\\.[0-9]{1,3}){3}"}


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(text, '(?i)({g})([^\\p{{L}}]|$)') AS {n}" for n, g in _GUARDS.items()) + " FROM documents")
def guard_prefilter(spark, sf_dir):
    """The types whose guard opens, by the guards of a rule set."""
    rules = compile_rules([Rule(type=n, pattern=g, guard_pattern=g, views=(View("page", "$0"),)) for n, g in _GUARDS.items()])
    opened = detect.guarded(table(spark, sf_dir, "documents").select("doc_id", "text"), rules)
    return opened.select("doc_id", *[F.array_contains("open_types", n).alias(n) for n in _GUARDS])


def _documents_scan(spark, sf_dir, pattern: str, guard: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return detect.scan(docs, simple(pattern, guard_pattern=guard)).select("doc_id", "match").groupBy("doc_id", "match").agg(F.count(F.lit(1)).alias("n"))


def _documents_sql(pattern: str) -> str:
    return f"SELECT doc_id, match, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS match FROM documents) GROUP BY ALL"


_IP = "[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}"
_MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+"


@query(_documents_sql(_IP))
def scan_ipv4(spark, sf_dir):
    return _documents_scan(spark, sf_dir, _IP, "[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}")


@query(_documents_sql(_MAIL))
def scan_email(spark, sf_dir):
    return _documents_scan(spark, sf_dir, _MAIL, "[^@]@[A-Za-z0-9.-]+")


# ---- rules that guards close and probes rewrite, text by text

_NARROWED = "concat('C-', o_custkey, '/10 and OJ C-', o_orderkey % 90 + 10, '/11', CASE o_orderkey % 3 WHEN 0 THEN ' of the Court' WHEN 1 THEN ' in the Journal' ELSE '' END)"


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licen[sc]es?([^\\p{{L}}]|$)') THEN regexp_extract_all(text, '{_IP}') ELSE [] END AS ips, regexp_extract_all(text, '{_MAIL}') AS mails FROM documents)
SELECT 'orders' AS source, o_orderkey AS doc_id, m AS match, rule_type, CAST(1 AS BIGINT) AS n FROM (SELECT o_orderkey, unnest([concat('C-', o_custkey, '/10'), concat(CASE o_orderkey % 3 WHEN 1 THEN 'OJ ' ELSE '' END, 'C-', o_orderkey % 90 + 10, '/11')]) AS m,
  unnest(['case', CASE o_orderkey % 3 WHEN 1 THEN 'journal' ELSE 'case' END]) AS rule_type FROM orders WHERE o_orderkey % 3 < 2)
UNION ALL SELECT 'documents', doc_id, match, rule_type, count(*) FROM (SELECT doc_id, unnest(ips) AS match, 'ip' AS rule_type FROM d UNION ALL SELECT doc_id, unnest(mails), 'mail' FROM d) GROUP BY ALL""")
def guard_narrowed(spark, sf_dir):
    """A rule that its guard closes neither matches in a text nor shadows others: what looks like a journal is a case where no
    journal is named, and addresses of machines count only beside a licence."""
    view = (View("page", "$0"),)
    journals = compile_rules([Rule(type="journal", pattern="(?:OJ )?C-[0-9]+/11", guard_pattern="Journal", order=1, views=view), Rule(type="case", pattern="C-[0-9]+/[0-9]+", guard_pattern="Court|Journal", order=2, views=view)])
    hosts = compile_rules([Rule(type="ip", pattern=_IP, guard_pattern="licen[sc]es?", order=1, views=view), Rule(type="mail", pattern=_MAIL, order=2, views=view)])
    orders = table(spark, sf_dir, "orders").selectExpr("'orders' AS source", "o_orderkey AS doc_id", f"{_NARROWED} AS text")
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), "doc_id", "text")
    found = detect.scan(orders, journals).withColumn("rule_type", F.element_at(F.array(F.lit("journal"), F.lit("case")), F.col("rule") + 1))
    found = found.unionByName(detect.scan(docs, hosts).withColumn("rule_type", F.element_at(F.array(F.lit("ip"), F.lit("mail")), F.col("rule") + 1)))
    return found.groupBy("source", "doc_id", "match", "rule_type").agg(F.count(F.lit(1)).alias("n"))


_LABELS = "(?:[CTF]-|case number |affaire numéro |Rechtssache Nummer )"
#: Long labels are looked for once a text; where there are none, the pattern has the short ones alone.
SHORT_LABELS = ((Optimizer("number|numéro|Nummer", _LABELS, "[CTF]-"),),)
_LABELLED = "concat('On ', CASE o_orderkey % 5 WHEN 0 THEN 'case number ' WHEN 1 THEN 'Rechtssache Nummer ' ELSE 'T-' END, o_custkey, '/09 and C-', o_orderkey % 900, '/10')"


@query("""SELECT o_orderkey AS doc_id, CAST(position AS INTEGER) AS position, match FROM (SELECT o_orderkey, unnest([3, 3 + length(l) + 5]) AS position, unnest([l, concat('C-', o_orderkey % 900, '/10')]) AS match
  FROM (SELECT o_orderkey, concat(CASE o_orderkey % 5 WHEN 0 THEN 'case number ' WHEN 1 THEN 'Rechtssache Nummer ' ELSE 'T-' END, o_custkey, '/09') AS l FROM orders))""")
def pattern_optimised(spark, sf_dir):
    """Parts of patterns replaced for texts in which a probe misses; the matches are the same."""
    docs = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"{_LABELLED} AS text")
    return detect.scan(docs, simple(_LABELS + "[0-9]{1,6}/[0-9]{2}"), options=Options(optimizers=SHORT_LABELS)).select("doc_id", "position", "match")


@query("SELECT doc_id, match, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)[^\\r\\n\\x0B\\f]*licen[sc]e[^\\r\\n\\x0B\\f]*')) AS match FROM documents) GROUP BY ALL")
def scan_license_lines(spark, sf_dir):
    """Whole lines that name a licence, by the scan."""
    rules = simple("[^\\r\\n\\x0B\\f]*licen[sc]e[^\\r\\n\\x0B\\f]*", guard_pattern="licen[sc]e[^\\r\\n]*")
    return detect.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), rules).groupBy("doc_id", "match").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey AS doc_id, CAST(CASE p_partkey % 4 WHEN 0 THEN 4 ELSE 0 END AS INTEGER) AS position, 'C-1/10' AS match FROM part WHERE p_partkey % 4 <> 1
UNION ALL SELECT p_partkey, 9, 'C-1/10' FROM part WHERE p_partkey % 4 = 1""")
def boundary_predicate(spark, sf_dir):
    """C-1/10 glued to a letter or digit is no match; the free one beside it is."""
    text = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'see C-1/10 now' WHEN 1 THEN 'AC-1/105 C-1/10' WHEN 2 THEN 'C-1/10' ELSE 'C-1/10, xC-1/10 C-1/10y' END")
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    return detect.scan(docs, only("case")).select("doc_id", "position", "match")


@query(f"WITH {_CASES} SELECT doc_id, match FROM hits WHERE match LIKE 'C-%'")
def strict_filter(spark, sf_dir):
    rules = simple("[CTF]-[0-9]{1,4}/[0-9]{2}", "case", strict_pattern="^C-")
    return detect.scan(order_texts(spark, sf_dir), rules, options=Options(strict=frozenset({"case"}))).select("doc_id", "match")


@query(f"WITH {_CASES} SELECT doc_id, regexp_replace(match, '/[0-9]{{2}}$', '') AS match FROM hits")
def trim_match(spark, sf_dir):
    rules = simple("[CTF]-[0-9]{1,4}/[0-9]{2}", "case", trim_pattern="/[0-9]{2}$")
    return detect.scan(order_texts(spark, sf_dir), rules).select("doc_id", "match")


@query("""SELECT p_partkey AS doc_id, CAST(2 AS INTEGER) AS position, concat(p_size, '/', p_size + 1) AS match FROM part""")
def skip_rewind(spark, sf_dir):
    """9 1/2 as a whole is skipped; from one past its start on, 1/2 is found."""
    docs = table(spark, sf_dir, "part").selectExpr("p_partkey AS doc_id", "concat('9 ', p_size, '/', p_size + 1) AS text")
    rules = simple("(?:[0-9] )?[0-9]+/[0-9]+", skip_pattern="^[0-9] ")
    return detect.scan(docs, rules).select("doc_id", "position", "match")


@query(f"WITH {_PARTS} SELECT doc_id, CAST(position AS INTEGER) AS position, match FROM placed")
def cursor_scan(spark, sf_dir):
    """The Arrow path on the texts of scan_positions."""
    return detect.scan(order_texts(spark, sf_dir), builtin.rule_set(), cursor=True).select("doc_id", "position", "match")


@query("SELECT p_partkey AS doc_id, CAST(4 AS INTEGER) AS position, 'C-1/10' AS match, CASE WHEN p_partkey % 2 = 0 THEN concat('part ', p_size) ELSE '' END AS title FROM part")
def title_form(spark, sf_dir):
    docs = table(spark, sf_dir, "part").selectExpr("p_partkey AS doc_id", "CASE WHEN p_partkey % 2 = 0 THEN concat('see [C-1/10|part ', p_size, ']') ELSE 'see C-1/10' END AS text")
    return detect.scan(docs, only("case"), title_form=True).select("doc_id", "position", "match", "title")


@query(f"WITH {_PARTS} SELECT doc_id, CAST(position AS INTEGER) AS position, match, rule_type FROM placed")
def scan_lateral(spark, sf_dir):
    """The scan as a table function in SQL text."""
    tables.register_scan(spark, builtin.rule_set())
    return spark.sql("SELECT d.doc_id, s.position, s.match, s.rule_type FROM {docs} d, LATERAL scan_rules(d.text) s", docs=order_texts(spark, sf_dir))


# ---- views


@query(f"""WITH {_PARTS} SELECT doc_id, match, concat('3', regexp_extract(match, '([0-9]{{4}})/([0-9]+)', 1), 'R', lpad(regexp_extract(match, '([0-9]{{4}})/([0-9]+)', 2), 4, '0')) AS celex FROM placed WHERE rule_type = 'act'""")
def view_rendering(spark, sf_dir):
    found = order_mentions(spark, sf_dir, "act", attrs=True)
    return found.select("doc_id", "match", ids.primary_id(ids.normalised(F.col("alternatives")[0]["attrs"])).alias("celex"))


@query(f"""WITH {_PARTS}, r AS (SELECT doc_id, rule_type, match FROM placed WHERE rule_type = 'case')
SELECT doc_id, match, concat('6', CASE WHEN CAST(right(match, 2) AS INTEGER) <= 57 THEN '20' ELSE '19' END, right(match, 2), left(match, 1), 'J', lpad(regexp_extract(match, '-([0-9]+)/', 1), 4, '0')) AS celex FROM r""")
def case_celex(spark, sf_dir):
    found = order_mentions(spark, sf_dir, "case", attrs=True)
    return found.select("doc_id", "match", ids.primary_id(ids.normalised(F.col("alternatives")[0]["attrs"])).alias("celex"))


@query(f"WITH {_PARTS} SELECT doc_id, match FROM placed WHERE rule_type = 'oj'")
def type_filter(spark, sf_dir):
    return detect.scan(order_texts(spark, sf_dir), builtin.rule_set(), options=Options(types=frozenset({"oj"}))).select("doc_id", "match")


# ---- lists

_LISTS = f"lists AS (SELECT o_orderkey AS doc_id, CAST(o_custkey % 7 + 1 AS INTEGER) AS line, {texts.ARTICLES} AS match FROM orders)"
_LIST_ITEM = "(?:(articles?) )?([0-9]+)(?: of (Directive) \\(EU\\) ([0-9]{4})/([0-9]+))?"


def _lists(spark, sf_dir) -> DataFrame:
    rows = spread(table(spark, sf_dir, "orders")).selectExpr("o_orderkey AS doc_id", "CAST(o_custkey % 7 + 1 AS INT) AS line", f"{texts.ARTICLES} AS match")
    return lists.items(rows.withColumn("position", F.col("line")), _LIST_ITEM, 5)


@query(f"""WITH {_LISTS}, n AS (SELECT doc_id, line, match, unnest([0, 1, 2]) AS item FROM lists)
SELECT doc_id, line AS parent, CAST(item AS INTEGER) AS item, CASE item WHEN 0 THEN concat('articles ', line) WHEN 1 THEN concat('', line + 1) ELSE concat(line + 2, regexp_extract(match, ' of Directive.*', 0)) END AS match,
CAST(CASE item WHEN 0 THEN 0 WHEN 1 THEN 9 + length(concat('', line)) + 2 ELSE 9 + length(concat('', line)) + 2 + length(concat('', line + 1)) + 5 END AS INTEGER) AS local_position FROM n""")
def list_items(spark, sf_dir):
    return _lists(spark, sf_dir).select("doc_id", "parent", "item", "match", "local_position")


@query(f"""WITH {_LISTS}, n AS (SELECT doc_id, line, match, unnest([0, 1, 2]) AS item FROM lists)
SELECT doc_id, line AS parent, CAST(item AS INTEGER) AS item, 'articles' AS label FROM n""")
def list_carry_core(spark, sf_dir):
    own = F.get("groups", F.lit(1))
    return _lists(spark, sf_dir).select("doc_id", "parent", "item", lists.carried_forward(own, ["doc_id", "parent"], "item").alias("label"))


@query(f"""WITH {_LISTS}, n AS (SELECT doc_id, line, match, unnest([0, 1, 2]) AS item FROM lists)
SELECT doc_id, line AS parent, CAST(item AS INTEGER) AS item, regexp_extract(match, '2015/([0-9]+)', 1) AS number FROM n""")
def list_inverted(spark, sf_dir):
    return _lists(spark, sf_dir).select("doc_id", "parent", "item", lists.carried_back(F.get("groups", F.lit(5)), ["doc_id", "parent"], "item").alias("number"))


_NESTED = "concat(CASE o_custkey % 4 WHEN 0 THEN concat('articles ', n, ', ', n + 1, ' and ', n + 2) WHEN 1 THEN concat('article ', n, '(1), (2) and (3)') WHEN 2 THEN concat('article ', n, '(12) and ', n + 1) ELSE concat('article ', n, '(a) and (b)') END, ' of Directive (EU) 2015/', o_orderkey % 900 + 1)"
_NESTED_ITEM = "(?:articles? ([0-9]+)(?:\\(([0-9]+|[a-z])\\))?|\\(([0-9]+|[a-z])\\)|([0-9]+))(?: of (Directive) \\(EU\\) ([0-9]{4})/([0-9]+))?"


@query("""WITH l AS (SELECT o_orderkey AS doc_id, o_custkey % 4 AS form, o_custkey % 7 + 1 AS n, o_orderkey % 900 + 1 AS no FROM orders),
e AS (SELECT *, unnest(CASE WHEN form < 2 THEN [0, 1, 2] ELSE [0, 1] END) AS item FROM l)
SELECT doc_id, CAST(item AS INTEGER) AS item, concat('Directive 2015/', no, ' article ', CASE WHEN form IN (0, 2) THEN n + item ELSE n END,
  CASE form WHEN 0 THEN '' WHEN 1 THEN concat('(', item + 1, ')') WHEN 2 THEN CASE item WHEN 0 THEN '(12)' ELSE '' END ELSE CASE item WHEN 0 THEN '(a)' ELSE '(b)' END END) AS reference FROM e""")
def list_resolved(spark, sf_dir):
    """Articles, paragraphs and points in brackets: items of a list in one row, completed, and unfolded."""
    rows = spread(table(spark, sf_dir, "orders")).selectExpr("o_orderkey AS doc_id", "0 AS position", "o_custkey", "o_orderkey", "o_custkey % 7 + 1 AS n").selectExpr("doc_id", "position", f"{_NESTED} AS match")
    slots = lists.Slots(prefix=(5,), shared=(6, 7), identifiers=(1, 2, 3, 4), core=(1,), variables=(3, 4))
    # a plain posexplode would have the size asked first, for which all is worked out once more
    each = lists.read(rows, _NESTED_ITEM, 7, slots).select("doc_id", F.posexplode_outer("groups").alias("item", "g")).where("item IS NOT NULL")
    level = F.coalesce(F.concat(F.lit("("), F.get("g", F.lit(2)), F.lit(")")), F.lit(""))
    return each.select("doc_id", "item", F.concat(F.col("g")[5], F.lit(" "), F.col("g")[6], F.lit("/"), F.col("g")[7], F.lit(" article "), F.col("g")[1], level).alias("reference"))


@query(f"WITH {_PARTS} SELECT doc_id, match AS context, list_sort(list(CAST(position AS INTEGER))) AS positions FROM placed GROUP BY doc_id, match")
def offsets_by_context(spark, sf_dir):
    found = lists.offsets_by_context(order_mentions(spark, sf_dir))
    return found.select("doc_id", "context", F.transform("offsets", lambda o: o["position"]).alias("positions"))


# ---- aliases

_NAMED_TEXT = "concat('see No ', o_orderkey % 5000, ' and  Item ', o_custkey, '-b, not Item', o_custkey, ' nor Item ', o_custkey, '-bc')"


@query("""WITH a AS (SELECT concat('no ', p_partkey) AS alias, concat('<', min(p_name), '>') AS replacement FROM part GROUP BY p_partkey UNION ALL SELECT concat('item ', p_partkey, '-b'), concat('{', min(p_brand), '}') FROM part GROUP BY p_partkey UNION ALL SELECT concat('item ', p_partkey), concat('[', p_partkey, ']') FROM part)
SELECT o_orderkey AS doc_id, concat('see ', coalesce(x.replacement, concat('No ', o_orderkey % 5000)), ' and  ', coalesce(y.replacement, concat('Item ', o_custkey, '-b')), ', not Item', o_custkey, ' nor ', CASE WHEN z.replacement IS NULL THEN concat('Item ', o_custkey) ELSE z.replacement END, '-bc') AS text
FROM orders LEFT JOIN a x ON x.alias = concat('no ', o_orderkey % 5000) LEFT JOIN a y ON y.alias = concat('item ', o_custkey, '-b') LEFT JOIN a z ON z.alias = concat('item ', o_custkey)""")
def alias_dictionary(spark, sf_dir):
    """Three aliases for each part as a table: the longest counts, capitals and the kind of white space don't matter."""
    known = _alias_rows(spark, sf_dir)
    docs = spread(table(spark, sf_dir, "orders")).selectExpr("o_orderkey AS doc_id", f"{_NAMED_TEXT} AS text")
    return alias_table.replaced(docs, known)


def _alias_rows(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    kinds = ("concat('No ', p_partkey) AS alias", "concat('<', p_name, '>') AS replacement"), ("concat('Item ', p_partkey, '-B') AS alias", "concat('{', p_brand, '}') AS replacement"), ("concat('item ', p_partkey) AS alias", "concat('[', p_partkey, ']') AS replacement")
    return part.selectExpr(*kinds[0]).unionByName(part.selectExpr(*kinds[1])).unionByName(part.selectExpr(*kinds[2]))


@query("""WITH a AS (SELECT DISTINCT p_partkey FROM part)
SELECT o_orderkey AS doc_id, CAST(4 AS INTEGER) AS position, concat('No ', o_orderkey % 5000) AS source FROM orders WHERE o_orderkey % 5000 IN (FROM a)
UNION ALL SELECT o_orderkey, CAST(12 + length(concat('', o_orderkey % 5000)) + 1 AS INTEGER), concat('Item ', o_custkey, '-b') FROM orders WHERE o_custkey IN (FROM a)
UNION ALL SELECT o_orderkey, CAST(12 + length(concat('', o_orderkey % 5000)) + 1 + length(concat('Item ', o_custkey, '-b, not Item', o_custkey, ' nor ')) AS INTEGER), concat('Item ', o_custkey) FROM orders WHERE o_custkey IN (FROM a)""")
def alias_dictionary_join(spark, sf_dir):
    """The same aliases found by the join of runs of tokens, as beyond the size that is sent to all workers."""
    docs = spread(table(spark, sf_dir, "orders")).selectExpr("o_orderkey AS doc_id", f"{_NAMED_TEXT} AS text")
    return alias_table.found(docs, _alias_rows(spark, sf_dir), largest=0).select("doc_id", "position", "source")


_ALIASES = Aliases().added("GDPR", "Regulation (EU) 2016/679").added("Data Act", "Regulation (EU) 2023/2854").added("Act", "Regulation (EU) 1/1")
_ALIAS_TEXT = "concat('Article ', o_custkey % 9 + 1, ' of GDPR and the Data Act, case ', o_orderkey, ' GDPR')"


def _alias_docs(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "orders")).selectExpr("o_orderkey AS doc_id", f"{_ALIAS_TEXT} AS text")


@query(f"SELECT o_orderkey AS doc_id, replace(replace({_ALIAS_TEXT}, 'GDPR', 'Regulation (EU) 2016/679'), 'Data Act', 'Regulation (EU) 2023/2854') AS text FROM orders")
def alias_replace(spark, sf_dir):
    return _alias_docs(spark, sf_dir).select("doc_id", alias.replaced(F.col("text"), _ALIASES).alias("text"))


@query(f"""WITH t AS (SELECT o_orderkey AS doc_id, {_ALIAS_TEXT} AS text FROM orders), p AS (
  SELECT doc_id, 13 AS position, 'GDPR' AS source, 0 AS before FROM t UNION ALL SELECT doc_id, 26, 'Data Act', -20 FROM t
  UNION ALL SELECT doc_id, length(text) - 4, 'GDPR', -20 - 17 FROM t)
SELECT doc_id, CAST(position AS INTEGER) AS position, source, CAST(length(source) - CASE source WHEN 'GDPR' THEN 24 ELSE 25 END AS INTEGER) AS delta, CAST(position - before AS BIGINT) AS replaced_position FROM p""")
def alias_offsets(spark, sf_dir):
    found = alias.offsets(_alias_docs(spark, sf_dir), _ALIASES)
    return found.select("doc_id", "position", "source", "delta", "replaced_position")


@query(f"""WITH t AS (SELECT o_orderkey AS doc_id, {_ALIAS_TEXT} AS text FROM orders)
SELECT doc_id, CAST(13 AS INTEGER) AS position, 'GDPR' AS match FROM t UNION ALL SELECT doc_id, 26, 'Data Act' FROM t UNION ALL SELECT doc_id, CAST(length(text) - 4 AS INTEGER), 'GDPR' FROM t""")
def alias_restored(spark, sf_dir):
    """Acts found in the replaced text, at the places and with the texts of the original."""
    docs = _alias_docs(spark, sf_dir)
    changed = docs.select("doc_id", alias.replaced(F.col("text"), _ALIASES).alias("text"))
    moved = alias.offsets(docs, _ALIASES).withColumn("replaced_position", F.col("replaced_position").cast("int"))
    return alias.restored(detect.mentions(changed, only("act")), moved).select("doc_id", "position", "match")


@query(f"SELECT o_orderkey AS celex, {texts.ACT} AS title FROM orders WHERE o_orderkey % 2 = 0")
def short_titles(spark, sf_dir):
    """Titles that begin with an act, and titles that name one late."""
    title = f"CASE WHEN o_orderkey % 2 = 0 THEN concat('Having regard to ', {texts.ACT}, ' on ', {texts.CASE}) ELSE concat('Having regard to the opinion of the Committee on ', {texts.ACT}) END AS title"
    return alias.short_titles(table(spark, sf_dir, "orders").selectExpr("o_orderkey AS celex", title), builtin.rule_set())


@query("SELECT p_partkey AS alias, concat('shared ', p_size) AS replacement, CAST(0 AS INTEGER) AS priority FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, concat('local ', p_size), 1 FROM part WHERE p_partkey % 3 <> 0")
def alias_layers(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    shared = part.where("p_partkey % 3 = 0").selectExpr("p_partkey AS alias", "concat('shared ', p_size) AS replacement")
    return alias.layered(shared, part.selectExpr("p_partkey AS alias", "concat('local ', p_size) AS replacement"))


# ---- nodes

_NODES = f"{_PARTS}, nodes AS (SELECT doc_id, match AS reference, count(*) AS count, CAST(min(position) AS INTEGER) AS position, min(rule_type) AS type FROM placed GROUP BY doc_id, match)"


@query(f"WITH {_NODES} SELECT * FROM nodes")
def nodes_grouped(spark, sf_dir):
    return nodes.grouped(order_mentions(spark, sf_dir)).select("doc_id", "reference", "count", "position", "type")


@query(f"WITH {_NODES} SELECT doc_id, reference, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, position, reference) AS INTEGER) AS number FROM nodes")
def nodes_sorted(spark, sf_dir):
    found = nodes.grouped(order_mentions(spark, sf_dir))
    return nodes.numbered(found, "count.desc").select("doc_id", "reference", "number")


@query("""WITH v AS (SELECT doc_id, CAST(i * 10 AS INTEGER) AS position, CASE WHEN i <= 3 THEN 'a long context of references' ELSE 'short' END AS context FROM (SELECT o_orderkey AS doc_id, unnest(range(1, 8)) AS i FROM orders))
SELECT doc_id, position, CAST(CASE WHEN context = 'short' THEN 0 ELSE position - 10 END AS INTEGER) AS local_position FROM v""")
def nodes_ordered_local(spark, sf_dir):
    each = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "explode(sequence(1, 7)) AS i")
    rows = each.selectExpr("doc_id", "CAST(i * 10 AS INT) AS position", "CASE WHEN i <= 3 THEN 'a long context of references' ELSE 'short' END AS context", "concat('m', i) AS match")
    return nodes.local_positions(rows).select("doc_id", "position", "local_position")


@query(f"WITH {_PARTS}, m AS (SELECT doc_id, match, position FROM placed WHERE rule_type = 'case' UNION ALL SELECT doc_id, match, position FROM placed) SELECT doc_id, match, count(*) AS count, list_sort(list(DISTINCT CAST(position AS INTEGER))) AS positions FROM m GROUP BY doc_id, match")
def nodes_merged(spark, sf_dir):
    return nodes.merged(order_mentions(spark, sf_dir, "case"), order_mentions(spark, sf_dir))


#: An option set that queries and tests share.
COURT = replace(Options(), environments=frozenset({"court"}))
