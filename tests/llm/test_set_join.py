"""The n-gram Jaccard join: brute force over all pairs, the pigeonhole argument itself, and SQL on a whole table."""

import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citemill.llm import set_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = "the and of thing other little water under stone river mountain garden winter summer house people seven".split()


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def by_hand(rows):
    """[(id, n, component)] over all pairs."""
    sets = [(k, shingles(t)) for k, t in rows]
    root = {k: k for k, _ in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 90 * len(x | y):
                a, b = sorted((top(a), top(b)))
                root[b] = a
                a = sets[i][0]
    return sorted((repr(k), len(x), repr(None if k is None else top(k))) for k, x in sets)


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"e{rng.randint(0, 10**9)}"
    return out


def made(rng):
    texts = [None, "", " \t\n", "one", "One", "one two", "ONE TWO", "one two three", "É x y", "é x y", "x" * 5000, "a b c " * 400]
    for size in (10, 12, 20, 31, 60, 200):
        base = [f"{rng.choice(WORDS)}{rng.randint(0, 40)}" for _ in range(size)]
        texts += [" ".join(base[:-1]), " ".join(base), " ".join([*base, "more"]), "\n".join(base).upper()]
        texts += [" ".join(edited(rng, base, rng.randint(0, max(1, size // 30)))) for _ in range(25)]
    chain = [f"w{i}" for i in range(120)]
    for i in range(12):  # each links with the next only
        texts.append(" ".join(chain))
        chain[i * 9] = f"other{i}"
        chain[i * 9 + 4] = f"another{i}"
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 10**6)}" for _ in range(rng.randint(5, 90))) for _ in range(40)]
    texts += [" ".join(f"{rng.choice(WORDS)}" for _ in range(rng.randint(1, 40))) for _ in range(30)]
    return texts + texts[:40]


def answer(df):
    return sorted((repr(r.k), r.n_shingles, repr(r.component_id)) for r in set_join.set_components(df).collect())


@pytest.mark.parametrize("small", [False, True])
def test_by_hand(spark, monkeypatch, small):
    if small:  # many groups and blocks a family
        monkeypatch.setattr(set_join, "MEMBERS", 3)
        monkeypatch.setattr(set_join, "BLOCK_GROUPS", 2)
    rng = random.Random(9)
    rows = [(1000 - i, t) for i, t in enumerate(made(rng))]
    rng.shuffle(rows)
    rows += [(None, "one two"), (None, "p1 p2 p3"), rows[0], (2000, "one two three"), (2000, "É x y"), (2000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("k", "n", "g", "gid", "part", "parts", "root", "f"):
        df = df.withColumn(name, F.lit("clash"))
    assert answer(df) == by_hand(rows)


def test_edits_of_one_text_around_the_threshold(spark):
    rng = random.Random(4)
    base = [f"{rng.choice(WORDS)}{rng.randint(0, 40)}" for _ in range(150)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 4, 5])))) for i in range(700)]
    assert answer(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == by_hand(rows)


SIZES = st.integers(1, 400)


@settings(max_examples=400, deadline=None)
@given(SIZES, st.integers(0, 40), st.integers(0, 40), st.integers(0, 2**32), st.booleans())
def test_sets_that_link_share_a_part(size, less, more, seed, crowded):
    rng = np.random.default_rng(seed)
    top = 1 << 40 if crowded else 1 << 63  # crowded: nearly all parts are empty
    pool = np.unique(rng.integers(0, top, size + more, dtype=np.uint64))
    x, y = np.sort(pool[: max(1, len(pool) - more)]), np.sort(pool[min(less, len(pool) - 1) :])
    both = len(np.intersect1d(x, y))
    if 100 * both < 90 * (len(x) + len(y) - both) or (len(x) == len(y) == both):
        return
    text, part = set_join.part_hashes(np.concatenate([x, y]), np.cumsum([0, len(x), len(y)]))
    assert {*part[text == 0].tolist()} & {*part[text == 1].tolist()}


def test_parts_are_few():
    rng = np.random.default_rng(1)
    for size in (30, 100, 1000, 20000):
        sets = [np.sort(rng.integers(0, 1 << 63, size, dtype=np.uint64) * 2) for _ in range(5)]
        text, _ = set_join.part_hashes(np.concatenate(sets), np.arange(6) * size)
        assert len(text) / 5 < 0.45 * size


def test_counts_in_slices(monkeypatch):
    monkeypatch.setattr(set_join, "SLICE", 7)
    x, y = (np.random.default_rng(i).random((n, 100)) < 0.4 for i, n in ((1, 5), (2, 9)))
    assert (set_join.shared_counts(x, y) == x.astype(int) @ y.astype(int).T).all()


def test_groups_that_are_not_reached_stay_closed():
    a = set_join.Group.of([1, 2], [np.arange(100, dtype=np.uint64), np.arange(3, 100, dtype=np.uint64)])
    far = set_join.Group.of([3, 4], [np.arange(50, 150, dtype=np.uint64), np.arange(200, 300, dtype=np.uint64)])
    near = set_join.Group.of([5, 6], [np.arange(2, 102, dtype=np.uint64), np.arange(500, 900, dtype=np.uint64)])
    assert not far.reached(a).any() and near.reached(a).all() and near.reached(far).tolist() == [False, False]
    for g in (a, far, near):
        g.roots = g.keys
    assert [x.tolist() for x in set_join.opened(a, near)] == [[0, 1], [0, 0]]
    back = set_join.Group.read(near.keys, near.union.view(np.int64), near.bits(), near.keys)
    assert (back.has == near.has).all() and back.union.tolist() == near.union.tolist()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_sql(spark, folder):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert sorted(map(tuple, set_join.op11_set_join(spark, folder).collect())) == sorted(duckdb.sql(set_join.OP11_SQL).fetchall())
