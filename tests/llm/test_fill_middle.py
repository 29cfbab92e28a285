"""Fill-in-the-middle: the rule in plain Python on odd texts, SQL on a whole table, and the round trip."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from citemill.llm import fill_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [None, "", " ", " \t\n", "one", "a b", "a  b\n \nc\x1cd e\x00f  ", "x <P> y", "<S>", "tail <M>", "< <P a< S> M> < <M b c d< <S", "é 👍🏽 ünï 日本語  x", "word " * 300, "x" * 5000, "y " * 200_000]


def by_hand(key, text, seed=42, rate=50, first=80):
    text = text or ""
    words = TOKEN.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, z = sorted((h[0] % (len(words) + 1), h[1] % (len(words) + 1)))
    p, m, s = "".join(words[:a]), "".join(words[a:z]), "".join(words[z:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(words), "plain", None, None, text
    return (len(words), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < first else (len(words), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("rate,first", [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_by_hand(spark, rate, first):
    rows = [(i if i % 11 else None, t) for i, t in enumerate(TEXTS * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("k", "n", "form", "tokens", "hash", "prefix", "batch", "_0"):
        df = df.withColumn(name, F.lit("clash"))
    got = fill_middle.fill_in_middle(df, rate=rate, suffix_first=first, keep=["batch"]).collect()
    assert all(r.batch == "clash" for r in got)
    seen = sorted((repr(r.doc_id), r.n, r.form, r.prefix_chars or 0, r.middle_chars or 0, r.output) for r in got)
    want = sorted((repr(k), n, form, p or 0, m or 0, out) for k, t in rows for n, form, p, m, out in [by_hand(k, t, rate=rate, first=first)])
    assert seen == want
    assert sorted(r.restored for r in got) == sorted(t or "" for _, t in rows)
    assert all((r.prefix_chars is None) == (r.form == "plain") for r in got)


def test_digests_are_of_the_texts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    texts = {r.doc_id: r for r in fill_middle.fill_in_middle(df).collect()}
    for r in fill_middle.fill_in_middle(df, digests=True).collect():
        assert r.output_sha256 == hashlib.sha256(texts[r.doc_id].output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert sorted(map(tuple, fill_middle.op12_fill_middle(spark, folder).collect())) == sorted(duckdb.sql(fill_middle.OP12_SQL).fetchall())
