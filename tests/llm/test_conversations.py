"""Repair of conversations: a shortest path over whole conversations, straight from the rules, against the matrix scan."""

import hashlib
import heapq
import itertools
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citemill.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        deal = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if deal == 1:
            text = ""
        if deal == 2:
            text = "".join(c for c in text if c not in ".!?")
        if deal == 4:
            role = "user"
        out += [] if deal == 0 else [(conv, turn, role, text)] * (2 if deal == 3 else 1)
    return out


def shortest(turns):
    """turns: (initial, must go, truncated). Dijkstra over (turns read, state of the roles so far) by cost, then audit."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    queue, seen = [(0, "", 0, "")], set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(turns) and state in ("", "a"):
            return cost, audit
        for r in "ua":
            if r in after[state]:
                heapq.heappush(queue, (cost + 2, audit + "I", i, after[state][r]))
        if i < len(turns):
            initial, gone, short = turns[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state))
            if not gone:
                if initial in after[state]:
                    heapq.heappush(queue, (cost + short, audit + "K", i + 1, after[state][initial]))
                for r in "ua":
                    if r in after[state]:
                        heapq.heappush(queue, (cost + 2 + short, audit + "R", i + 1, after[state][r]))
    raise AssertionError("no path")


def by_hand(rows):
    """conv -> gaps, blank, duplicate, truncated, illegal, cost, audit, digest."""
    by = defaultdict(list)
    for row in harmed(rows):
        by[row[0]].append(row)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))
        seen, faults, kinds = set(), dict(blank=0, duplicate=0, truncated=0), []
        for _, _, role, text in mine:
            left = text.rstrip(BLANK)
            fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            kinds.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        numbers = [r[1] for r in mine if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(kinds))
        cost, audit = shortest(kinds)
        said, state, i = [], "", 0
        need = {"": "u", "s": "u", "u": "a", "a": "u"}
        for letter in audit:
            if letter == "I":
                state = need[state]
                said.append(("user:" if state == "u" else "assistant:"))
                continue
            _, _, role, text = mine[i]
            i += 1
            if letter == "R":
                state = need[state]
                role = "user" if state == "u" else "assistant"
            elif letter == "K":
                state = role[0]
            if letter != "D":
                said.append(f"{role}:{text}")
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def found(df):
    return {r.conv_id: tuple(r)[1:] for r in conversations.repair_conversations(conversations.damaged(df)).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_by_hand(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None, "\nodd"])
            text = rng.choice(["Yes.", "No! ", "Why", "  ", "", None, f"So {rng.random()}?", f"it goes {rng.random()}", "é.\x0b", "a "])
            rows.append((conv, rng.choice([turn, turn * 3, None]) if conv % 3 else turn, role, text))
    rows += [(None, 0, "user", "x."), (None, 1, "assistant", "y."), (None, None, None, None)]
    rows += [(500, t, r, x) for t, r, x in [(0, "user", "a.")] * 5 + [(1, "assistant", "b")] * 3]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("conv", "kind", "place", "audit", "h", "tag", "gone", "deal"):
        df = df.withColumn(name, F.lit("clash"))
    assert found(df) == by_hand(rows)


def test_long_conversations_span_partitions(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", f"n {t}.", f"cut {t}"])) for t in range(3000)]
    rows += [(8, 5, "user", "copy.")] * 2000 + [(9, None, "assistant", f"{i % 40}.") for i in range(600)] + [(c, 0, "user", "x" * 50_000) for c in range(20, 24)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        parts = conversations.products(conversations.flagged(conversations.damaged(df))).where("conv = 7").select("place").distinct().count()
        assert parts > conversations.FAN // 2
        assert found(df) == by_hand(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


KINDS = st.lists(st.sampled_from("suaSUA-_x "), max_size=24).map("".join)


@settings(max_examples=300, deadline=None)
@given(KINDS)
def test_matrices_give_the_shortest_path(kinds):
    turns = [(k.lower() if k.lower() in "sua" else "-", k == "x", int(k == "_" or k.isupper())) for k in kinds if k != " "]
    assert conversations.cheapest(conversations.multiplied(kinds)) == shortest(turns)


@settings(max_examples=100, deadline=None)
@given(KINDS, KINDS, KINDS)
def test_products_are_associative(a, b, c):
    x, y, z = (conversations.multiplied(k) for k in (a, b, c))
    assert conversations.product(conversations.product(x, y), z) == conversations.product(x, conversations.product(y, z))


def test_repaired_turns_read_as_they_should(spark):
    folder = "/root/testdata/sf0.001"
    turns = conversations.damaged(spark.read.parquet(f"{folder}/conversations.parquet"))
    roles = defaultdict(list)
    for r in sorted(conversations.repaired_turns(turns, conversations.repairs(turns)).collect(), key=lambda r: (r.conv, r.place)):
        assert r.place == len(roles[r.conv])
        roles[r.conv].append(r.role[0])
    for said in roles.values():
        said = "".join(said).removeprefix("s")
        assert said == "ua" * (len(said) // 2) and said


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{folder}/conversations.parquet'").fetchall()
    want = by_hand(rows)
    assert {r.conv_id: tuple(r)[1:] for r in conversations.op13_structure_repair(spark, folder).collect()} == want
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    assert {r[0]: r[1:] for r in duckdb.sql(conversations.OP13_SQL).fetchall()} == want
