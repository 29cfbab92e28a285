"""Queries on the linked-data operators over catalogues made from the tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.helpers import filled
from ..operators import resolve, works
from ..sources.readers import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _sql(spark, sf_dir, name: str, *columns: str):
    return table(spark, sf_dir, name).selectExpr(*columns)


def _versions(spark, sf_dir):
    return _sql(spark, sf_dir, "orders", "o_custkey AS act", "o_orderkey AS version", "cast(o_orderdate AS date) AS day")


@query("SELECT o_custkey AS act, o_orderkey AS version FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) = 1")
def latest_consolidation(spark, sf_dir):
    return works.latest(_versions(spark, sf_dir), "act", "day").select("act", "version")


@query("SELECT o_custkey AS act, o_orderkey AS version FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_custkey = o.o_custkey AND n.o_orderdate > o.o_orderdate)")
def latest_by_anti_join(spark, sf_dir):
    return works.latest_by_anti_join(_versions(spark, sf_dir), "act", "day").select("act", "version")


_ASOF = """WITH v AS (SELECT o_custkey AS act, CAST(o_orderdate AS DATE) AS day, max(o_orderkey) AS version FROM orders GROUP BY ALL),
r AS (SELECT event_id, user_id % 1500 AS act, DATE '1995-01-01' + CAST(event_id % 2400 AS INTEGER) AS at FROM events),
n AS (SELECT act, max(day) AS day FROM v GROUP BY act), p AS (SELECT r.*, (SELECT max(day) FROM v WHERE v.act = r.act AND v.day <= r.at) AS d FROM r)
SELECT event_id, v.day AS as_of_day, v.version AS as_of_version FROM p JOIN n USING (act) JOIN v ON v.act = p.act AND v.day = coalesce(p.d, n.day)"""


@query(_ASOF)
def asof_consolidation(spark, sf_dir):
    versions = _versions(spark, sf_dir).groupBy("act", "day").agg(F.max("version").alias("version"))
    requests = _sql(spark, sf_dir, "events", "event_id", "user_id % 1500 AS act", "date_add(date'1995-01-01', cast(event_id % 2400 AS int)) AS at")
    return works.as_of(requests, versions, "act", "at", "day").select("event_id", "as_of_day", "as_of_version")


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS src, o_orderkey + 7 AS dst FROM orders), c AS (
  SELECT src, dst, 1 AS depth FROM e UNION ALL SELECT c.src, e.dst, c.depth + 1 FROM c JOIN e ON c.dst = e.src WHERE c.depth < 20)
SELECT src, dst, CAST(min(depth) AS INTEGER) AS depth FROM c GROUP BY src, dst""")
def repeal_closure(spark, sf_dir):
    """Everything up to 20 repeals away, of all orders."""
    return works.closure(_sql(spark, sf_dir, "orders", "o_orderkey AS src", "o_orderkey + 7 AS dst"), 20)


@query("""WITH e AS (SELECT DISTINCT o_orderkey + 7 AS dst FROM orders WHERE o_orderkey + 7 NOT IN (SELECT o_orderkey FROM orders))
SELECT o_orderkey AS celex, min(dst) AS repealed_by FROM orders JOIN e ON dst % 7 = o_orderkey % 7 AND dst > o_orderkey GROUP BY o_orderkey""")
def last_repealing(spark, sf_dir):
    """The end of each order's chain of steps of 7, however long; in SQL, the next number of the chain that is no order."""
    return works.last_repealing(_sql(spark, sf_dir, "orders", "o_orderkey AS celex", "o_orderkey + 7 AS repealed_by"))


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def existence_filter(spark, sf_dir):
    ids = _sql(spark, sf_dir, "orders", "o_custkey AS id").distinct()
    return works.existing(ids, table(spark, sf_dir, "customer").where("c_nationkey < 12").selectExpr("c_custkey AS id"), "id")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def missing_ids(spark, sf_dir):
    known = table(spark, sf_dir, "orders").where("o_totalprice > 400000").selectExpr("o_custkey AS id")
    return works.missing(_sql(spark, sf_dir, "customer", "c_custkey AS id"), known, "id")


@query("""SELECT source, lang, doc_id FROM documents WHERE lang IN ('de', 'en', 'fr')
QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 ELSE 3 END, doc_id DESC) = 1""")
def lang_fallback(spark, sf_dir):
    rows = _sql(spark, sf_dir, "documents", "source", "lang", "doc_id")
    return works.in_language(rows, ["source"], ["de", "en", "fr"], order="doc_id")


def _citations(spark, sf_dir):
    rows = _sql(spark, sf_dir, "lineitem", "concat('3', l_orderkey % 50) AS source", "concat('3', l_partkey) AS target", "concat('A', l_linenumber) AS fragment_source", "concat('P', l_linenumber) AS fragment_target")
    return works.Catalogue(citations=rows, bases=_sql(spark, sf_dir, "lineitem", "concat('', l_orderkey) AS celex", "concat('', l_partkey) AS basis"))


@query("SELECT DISTINCT concat('3', l_partkey) AS celex, concat('art. ', l_linenumber) AS from_part, concat('par. ', l_linenumber) AS to_part FROM lineitem WHERE l_orderkey % 50 = 7 ORDER BY ALL LIMIT 501")
def cited_by_limit(spark, sf_dir):
    return works.cited_by(_citations(spark, sf_dir), "37")


@query("SELECT DISTINCT concat('3', l_orderkey % 50) AS celex, concat('art. ', l_linenumber) AS from_part, concat('par. ', l_linenumber) AS to_part FROM lineitem WHERE l_partkey = 12 ORDER BY ALL LIMIT 501")
def citing(spark, sf_dir):
    return works.citing(_citations(spark, sf_dir), "312", sector="3")


@query("SELECT DISTINCT concat('', l_orderkey) AS celex FROM lineitem WHERE l_partkey = 12 ORDER BY 1 LIMIT 501")
def based_on(spark, sf_dir):
    return works.based_on(_citations(spark, sf_dir), "12")


@query("SELECT DISTINCT concat('', l_partkey) AS celex FROM lineitem WHERE l_orderkey = 12 ORDER BY 1 LIMIT 501")
def bases_of(spark, sf_dir):
    return works.bases_of(_citations(spark, sf_dir), "12")


@query("""WITH c AS (SELECT DISTINCT concat('3', l_orderkey % 50) AS id, concat('3', l_partkey) AS celex, concat('art. ', l_linenumber) AS from_part, concat('par. ', l_linenumber) AS to_part FROM lineitem)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY celex, from_part, to_part) <= 501""")
def cited_by_each(spark, sf_dir):
    """The first 501 citations of every act at once."""
    c = _citations(spark, sf_dir)
    return works.cited_by_each(c.citations.select(F.col("source").alias("celex")), c)


@query("""WITH c AS (SELECT DISTINCT concat('3', l_partkey) AS id, concat('3', l_orderkey % 50) AS celex, concat('art. ', l_linenumber) AS from_part, concat('par. ', l_linenumber) AS to_part FROM lineitem)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY celex, from_part, to_part) <= 20""")
def citing_each(spark, sf_dir):
    """The first 20 acts that cite each act."""
    c = _citations(spark, sf_dir)
    return works.citing_each(c.citations.select(F.col("target").alias("celex")), c, limit=20)


@query("""SELECT * FROM (SELECT 'bases' AS kind, concat('', l_orderkey) AS id, concat('', l_partkey) AS celex FROM lineitem UNION SELECT 'based', concat('', l_partkey), concat('', l_orderkey) FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY kind, id ORDER BY celex) <= CASE kind WHEN 'bases' THEN 3 ELSE 501 END""")
def bases_of_each(spark, sf_dir):
    """The first three bases of each act, and the first 501 acts on each basis."""
    c = _citations(spark, sf_dir)
    own = works.bases_of_each(c.bases.select("celex"), c, limit=3).withColumn("kind", F.lit("bases"))
    return own.unionByName(works.based_on_each(c.bases.select(F.col("basis").alias("celex")), c).withColumn("kind", F.lit("based")))


@query("SELECT concat('3', o_custkey) AS act, string_agg(concat('3', o_custkey, 'R(', o_orderkey, ')'), ',' ORDER BY concat('3', o_custkey, 'R(', o_orderkey, ')')) AS corrections FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey")
def corrections_list(spark, sf_dir):
    rows = _sql(spark, sf_dir, "orders", "concat('3', o_custkey, 'R(', o_orderkey, ')') AS celex", "'ENG' AS published_lang")
    return works.corrections(_sql(spark, sf_dir, "customer", "concat('3', c_custkey) AS celex"), works.Catalogue(corrections=rows), "ENG")


@query("""WITH v AS (SELECT o_custkey AS celex, max(o_totalprice) AS title FROM orders GROUP BY 1)
SELECT c_custkey AS celex, c_acctbal AS force, coalesce(title, c_nationkey) AS title, CASE WHEN title IS NOT NULL THEN c_custkey END AS original FROM customer LEFT JOIN v ON celex = c_custkey""")
def pit_override(spark, sf_dir):
    base = _sql(spark, sf_dir, "customer", "c_custkey AS celex", "c_acctbal AS force", "cast(c_nationkey AS double) AS title")
    versions = _sql(spark, sf_dir, "orders", "o_custkey AS celex", "o_totalprice AS title").groupBy("celex").agg(F.max("title").alias("title")).withColumn("force", F.lit(0.0))
    return works.point_in_time(base, versions)


@query("""SELECT concat('', c_custkey) AS celex, min(CAST(o_orderdate AS DATE)) AS date_force, max(CAST(o_orderdate AS DATE)) AS date_validity, CASE WHEN count(o_custkey) > 0 THEN 'ok' ELSE 'missing' END AS status
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def min_max_force(spark, sf_dir):
    """Metadata of works that have several days of force and validity."""
    rows = _sql(spark, sf_dir, "orders", "concat('', o_custkey) AS celex", "concat('eli/', o_custkey) AS eli", "cast(NULL AS date) AS date", "cast(o_orderdate AS date) AS date_force", "cast(o_orderdate AS date) AS date_validity")
    asked = _sql(spark, sf_dir, "customer", "concat('', c_custkey) AS celex")
    return works.celex_metadata(asked, works.Catalogue(works=rows), "ENG").select("celex", "date_force", "date_validity", "status")


@query("SELECT concat('C-', o_orderkey + 1, '/11') AS label, concat('6', o_orderkey) AS main FROM orders UNION ALL SELECT concat('C-', o_orderkey + 2, '/11'), concat('6', o_orderkey) FROM orders")
def joined_cases(spark, sf_dir):
    title = F.expr("concat('Joined Cases C-', o_orderkey, '/11, C-', o_orderkey + 1, '/11 and C-', o_orderkey + 2, '/11')")
    rows = table(spark, sf_dir, "orders").select(F.expr("concat('6', o_orderkey)").alias("main"), works.joined_labels(title).alias("labels"))
    return works.joined_cases(works.Catalogue(joined=rows))


@query("SELECT o_orderkey, concat('x/', CASE WHEN o_custkey % 3 = 0 THEN 'none' ELSE concat('', o_custkey) END, '/', o_orderkey) AS view FROM orders")
def placeholder_fill(spark, sf_dir):
    value = F.expr("CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('', o_custkey) END")
    return table(spark, sf_dir, "orders").select("o_orderkey", filled(F.expr("concat('x/{{ CELEX_NO|none }}/', o_orderkey)"), "CELEX_NO", value).alias("view"))


@query("""WITH m AS (SELECT c_custkey AS key, concat('Act ', c_nationkey, '/', 10) AS context FROM customer), w AS (SELECT o_custkey AS key, o_orderkey AS seq, concat('On ', o_orderkey % 25, '/10 of it') AS title FROM orders)
SELECT key, concat('', key) AS value, CAST(first(seq ORDER BY CASE WHEN regexp_extract(title, '[0-9]+/[0-9]+') = regexp_extract(context, '[0-9]+/[0-9]+') THEN 0 ELSE 1 END, CASE WHEN regexp_extract(title, '[0-9]+/[0-9]+') = regexp_extract(context, '[0-9]+/[0-9]+') THEN -seq ELSE seq END) AS BIGINT) AS seq FROM m JOIN w USING (key) GROUP BY key""")
def optimal_binding(spark, sf_dir):
    mentions = _sql(spark, sf_dir, "customer", "c_custkey AS key", "concat('Act ', c_nationkey, '/', 10) AS context")
    rows = _sql(spark, sf_dir, "orders", "o_custkey AS key", "o_orderkey AS seq", "concat('On ', o_orderkey % 25, '/10 of it') AS title")
    pairs = mentions.join(rows, "key")
    best = resolve.best(pairs, ["key"], resolve.token_of(F.col("title")) == resolve.token_of(F.col("context")), F.col("seq"))
    return best.select("key", F.col("key").cast("string").alias("value"), "seq")


@query("SELECT p_partkey AS key, concat('eli/', max(o_orderkey)) AS value FROM part JOIN orders ON o_orderkey % 500 = p_partkey GROUP BY p_partkey")
def title_token(spark, sf_dir):
    mentions = _sql(spark, sf_dir, "part", "p_partkey AS key", "concat(p_partkey, '/20') AS number")
    rows = _sql(spark, sf_dir, "orders", "concat('Decision ', o_orderkey % 500, '/20 of the Committee') AS title", "concat('eli/', o_orderkey) AS eli", "o_orderkey AS seq")
    return resolve.by_title_token(mentions, rows, "eli")


@query("SELECT p_partkey AS key, concat('eli/', max(o_orderkey)) AS value FROM part JOIN orders ON o_orderkey % 500 = p_partkey GROUP BY p_partkey")
def un_regulations(spark, sf_dir):
    mentions = _sql(spark, sf_dir, "part", "p_partkey AS key", "concat('', p_partkey) AS number")
    rows = _sql(spark, sf_dir, "orders", "concat('UN Regulation No ', o_orderkey % 500, ' on things') AS title", "concat('eli/', o_orderkey) AS eli", "o_orderkey AS seq")
    return resolve.un_regulations(mentions, rows)


@query("""SELECT concat('http://x/eli/reg/', o_custkey, '/', strftime(o_orderdate, '%Y-%m-%d')) AS eli, concat('http://x/eli/reg/', o_custkey, '/', coalesce((SELECT max(strftime(k.o_orderdate, '%Y-%m-%d')) FROM orders k WHERE k.o_custkey = o.o_custkey AND k.o_orderkey % 2 = 0 AND strftime(k.o_orderdate, '%Y-%m-%d') <= strftime(o.o_orderdate, '%Y-%m-%d')),
 (SELECT max(strftime(k.o_orderdate, '%Y-%m-%d')) FROM orders k WHERE k.o_custkey = o.o_custkey AND k.o_orderkey % 2 = 0), strftime(o.o_orderdate, '%Y-%m-%d'))) AS held FROM orders o""")
def eli_as_of(spark, sf_dir):
    eli = "concat('http://x/eli/reg/', o_custkey, '/', date_format(o_orderdate, 'yyyy-MM-dd')) AS eli"
    known = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").selectExpr(eli)
    return works.eli_as_of(_sql(spark, sf_dir, "orders", eli), known).select("eli", "held")


@query("SELECT DISTINCT n_name AS eurovoc, r_name AS subject, concat('3', n_regionkey) AS celex FROM nation JOIN region ON n_regionkey = r_regionkey")
def classifications(spark, sf_dir):
    one = _sql(spark, sf_dir, "nation", "concat('3', n_regionkey) AS celex", "'eurovoc' AS kind", "n_name AS label", "'en' AS lang")
    two = _sql(spark, sf_dir, "region", "concat('3', r_regionkey) AS celex", "'subject' AS kind", "r_name AS label", "'en' AS lang")
    both = one.unionByName(two)
    return works.classifications(both, works.Catalogue(subjects=both), "EN")


_FETCH = """SELECT kind, id, title, CASE WHEN title IS NULL THEN 'missing' ELSE 'ok' END AS status FROM (
  SELECT DISTINCT 'celex' AS kind, concat('', o_custkey) AS id, (SELECT 't' || min(k.o_orderkey) FROM orders k WHERE k.o_custkey = o.o_custkey AND k.o_custkey % 2 = 0) AS title FROM orders o
  UNION ALL SELECT DISTINCT 'proc', concat('', o_custkey), (SELECT 't' || max(k.o_orderkey) FROM orders k WHERE k.o_custkey = o.o_custkey AND k.o_custkey % 2 = 0) FROM orders o)"""


@query(_FETCH)
def fetch_all(spark, sf_dir):
    """First row wins for CELEX ids, the last for procedures."""
    rows = table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").selectExpr("concat('', o_custkey) AS id", "concat('t', o_orderkey) AS title", "o_orderkey AS seq")
    asked = _sql(spark, sf_dir, "orders", "concat('', o_custkey) AS id")
    ids = asked.withColumn("kind", F.lit("celex")).unionByName(asked.withColumn("kind", F.lit("proc")))
    return works.fetch_all({"celex": rows, "proc": rows, "oj": None}, ids)


@query("""SELECT o_orderkey AS doc_id, 7 AS position, CAST(CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n FROM orders""")
def existing_targets(spark, sf_dir):
    pair = "array(named_struct('id', concat('', o_custkey), 'id_type', 'celex', 'active', true), named_struct('id', concat('', o_orderkey), 'id_type', 'oj', 'active', false)) AS alternatives"
    mentions = _sql(spark, sf_dir, "orders", "o_orderkey AS doc_id", "7 AS position", pair)
    known = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").selectExpr("concat('', c_custkey) AS id")
    return resolve.existing_targets(mentions, known).select("doc_id", "position", F.size("alternatives").alias("n"))


@query("SELECT o_orderkey AS doc_id, c_name AS title, CASE WHEN c_name IS NULL THEN 'missing' ELSE 'ok' END AS status FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey < 12")
def metadata_attach(spark, sf_dir):
    mentions = _sql(spark, sf_dir, "orders", "o_orderkey AS doc_id", "concat('', o_custkey) AS id", "'celex' AS id_type")
    rows = table(spark, sf_dir, "customer").where("c_nationkey < 12").selectExpr("'celex' AS kind", "concat('', c_custkey) AS id", "c_name AS title")
    return works.attached(mentions, rows).select("doc_id", "title", F.when(F.col("title").isNull(), "missing").otherwise("ok").alias("status"))
