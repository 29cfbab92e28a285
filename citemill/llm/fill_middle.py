"""Fill-in-the-middle by SQL: DuckDB runs inside Spark's Arrow map, one connection a task, one table a batch.

A text is cut into tokens (white space with the word behind it, or white space at the end). Three 32-bit numbers and a fourth
from the sha256 of seed and document id give the two cuts, whether the text is rearranged, and how. Each Arrow batch is
registered as a table; one SQL statement cuts, rearranges, and where asked takes the output apart again, and hands Arrow back.
No row is ever a Python object, and no text leaves its task. DuckDB runs with one thread and a bound on its memory, which a
single text of many MB raises in proportion; a batch holds at most the rows and bytes that the session allows, or one longer
text.

Defined results: a null text is the empty text; the empty text, and a text that holds one of the three marks, stays as it is
(form plain); a null id stands for the empty string in the hash; rows with one id get the same numbers, each for its own text;
an empty table gives an empty result; other columns are carried on where asked for and ignored else, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, session, text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SEED = 42
#: Per cent of texts that are rearranged, and of those the per cent with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
#: What a task's DuckDB may hold: so many MB, and where one text is longer than a batch should be, so many times its size.
MEMORY_MB, MEMORY_X = 512, 64

SHAPES = {"texts": "output string, restored string", "digests": "output_sha256 string, restored_sha256 string"}


def statement(seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, digests: bool = False, source: str = "batch") -> str:
    """The SQL over a table of k and text (not null)."""
    asked = "sha256(output) AS output_sha256, sha256(restored) AS restored_sha256" if digests else "output, restored"
    word = lambda i: f"CAST('0x' || substr(hash, {8 * i + 1}, 8) AS BIGINT)"
    return f"""
WITH cut AS (
  SELECT *, regexp_extract_all(text, '{TOKEN}') AS tokens, sha256('{seed}:' || coalesce(CAST(k AS VARCHAR), '')) AS hash FROM {source}
), dealt AS (
  SELECT *, CAST(len(tokens) AS BIGINT) AS n, {word(0)} AS h1, {word(1)} AS h2, {word(2)} AS h3, {word(3)} AS h4 FROM cut
), placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {rate} THEN 'plain'
         WHEN h4 % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form
  FROM dealt
), parts AS (
  SELECT *, array_to_string(list_slice(tokens, 1, a), '') AS prefix, array_to_string(list_slice(tokens, a + 1, z), '') AS middle,
    array_to_string(list_slice(tokens, z + 1, n), '') AS suffix FROM placed
), written AS (
  SELECT *, CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
    ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output FROM parts
), read AS (
  SELECT *, substr(output, {len(PREFIX) + 1}) AS body, CASE form WHEN 'psm' THEN '{SUFFIX}' ELSE '{PREFIX}' END AS mark FROM written
), halves AS (
  SELECT *, split_part(body, mark, 1) AS one, split_part(body, mark, 2) AS two FROM read
), back AS (
  SELECT *, CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN one || split_part(two, '{MIDDLE}', 2) || split_part(two, '{MIDDLE}', 1)
    ELSE split_part(two, '{MIDDLE}', 1) || split_part(two, '{MIDDLE}', 2) || one END AS restored FROM halves
)
SELECT k, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars, {asked}"""


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, digests: bool = False, keep: list[str] | None = None) -> DataFrame:
    """The key, the columns of keep, n (tokens), form, prefix_chars, middle_chars, and output and restored: the rearranged text and
    the text that is rebuilt from it and the form; with digests, the sha256 of both in their place."""
    session(df.sparkSession)
    keep = keep or []
    held = [f"_{i}" for i in range(len(keep))]
    source = df.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("text"), *[F.col(c).alias(h) for c, h in zip(keep, held, strict=True)])
    kinds = dict(source.dtypes)
    made = "n long, form string, prefix_chars long, middle_chars long, " + SHAPES["digests" if digests else "texts"]
    sql = statement(seed, rate, suffix_first, digests) + "".join(f", {h}" for h in held) + "\nFROM back"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False}) as base:
            for b in batches:
                base.execute(f"SET memory_limit = '{max(MEMORY_MB, MEMORY_X * b.nbytes >> 20)}MB'")
                base.register("batch", b)
                yield from base.sql(sql).to_arrow_table().to_batches()
                base.unregister("batch")

    done = source.mapInArrow(run, ", ".join(["k long", made, *(f"{h} {kinds[h]}" for h in held)]))
    columns = [c.split()[0] for c in made.split(", ")]
    return done.select(F.col("k").alias(key), *[F.col(h).alias(c) for h, c in zip(held, keep, strict=True)], *columns)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(documents(spark, sf_dir, "doc_id", "text"), digests=True)


OP12_SQL = f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS w, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), dealt AS (
  SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(w) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(w) + 1) AS y,
    CAST('0x' || h[17:24] AS BIGINT) % 100 AS r, CAST('0x' || h[25:32] AS BIGINT) % 100 AS s FROM cut
), formed AS (
  SELECT *, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR r >= 50 THEN 'plain' WHEN s < 80 THEN 'spm' ELSE 'psm' END AS form,
    coalesce(list_aggregate(w[1:least(x, y)], 'string_agg', ''), '') AS p, coalesce(list_aggregate(w[least(x, y) + 1:greatest(x, y)], 'string_agg', ''), '') AS m,
    coalesce(list_aggregate(w[greatest(x, y) + 1:], 'string_agg', ''), '') AS e FROM dealt
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', e, '<M>', m) ELSE concat('<S>', e, '<P>', p, '<M>', m) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM formed
"""
