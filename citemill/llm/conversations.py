"""Repair of conversation structure by a min-plus scan over matrices.

A conversation's roles should read: a system turn at most, then pairs of user and assistant. An automaton of four states reads
the initials; a turn may be kept, given another role, or deleted, and empty turns may be inserted anywhere. The cheapest edits
are a shortest path, and among the cheapest the one whose letters (the audit) come first in ASCII order.

Each turn is a 4x4 matrix whose entry (s, t) is the cheapest (cost, audit) that leads from state s to t: any insertions (their
closure, a fixed matrix), then the turn's own edit. Matrices multiply by adding costs and joining audits and taking the least.
That is associative: of two audits of equal cost for the same turns neither begins with the other, as what is longer has
insertions that cost more, so the order of two audits stays when others are put around them.

1. Turns are dealt by ranges of (conversation, turn), so a long conversation spans many partitions. A partition multiplies the
   turns of each conversation it holds, in a balanced tree, and sums up what else is asked (counts, turns, initials at the ends).
2. Products of one conversation are put together FAN at a time in rounds, until one is left. No task ever holds more of a
   conversation than its audits.
3. For the repaired texts each conversation's audit is sent ahead of its turns, which follow in order and are written or hashed
   as they pass. A sha256 is one chain over its input, so a conversation's digest is the work of one task; it keeps one batch.

Faults, the first counts: blank (no ink), duplicate (role and text seen earlier in the conversation), truncated (the last ink
isn't one of .!?).

Defined results: a null role or text is one space (which no role begins with, so such a turn is changed or deleted); a null
turn comes before all others and doesn't count for gaps; null conversation ids are one conversation; turns with one number go
by role, then by a digest of the text, equal rows side by side; a row repeated in the input counts as a duplicate; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import session, settled

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
CUT_SHORT = 1
#: Products that are put together in one round.
FAN = 16
#: Turns whose product is remembered as a whole.
RUN = 8

# The automaton. States: nothing yet, after a system turn, after a user turn, after an assistant turn (0 and 3 may end).
STATES = 4
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
LEGAL = ("su", "ua", "au")
NAMES = {"u": "user", "a": "assistant"}

#: (cost, audit) from state to state; None where no edits lead there.
Matrix = tuple[tuple[tuple[int, str] | None, ...], ...]

IDENTITY: Matrix = tuple(tuple((0, "") if s == t else None for t in range(STATES)) for s in range(STATES))


def product(x: Matrix, y: Matrix) -> Matrix:
    out = []
    for row in x:
        line: list[tuple[int, str] | None] = [None] * STATES
        for one, steps in zip(row, y, strict=True):
            if one is None:
                continue
            cost, audit = one
            for t, two in enumerate(steps):
                if two is not None:
                    total = cost + two[0]
                    if (now := line[t]) is None or total < now[0] or total == now[0] and audit + two[1] < now[1]:
                        line[t] = (total, audit + two[1])
        out.append(tuple(line))
    return tuple(out)


def _inserted() -> Matrix:
    """The closure of insertions: none, or one and more."""
    step: Matrix = tuple(tuple((INSERT, "I") if t in [NEXT[s].get(r) for r in NAMES] else None for t in range(STATES)) for s in range(STATES))
    closed = IDENTITY
    for _ in range(STATES):
        closed = tuple(tuple(min((e for e in (p, q) if e is not None), default=None) for p, q in zip(*rows, strict=True)) for rows in zip(IDENTITY, product(closed, step), strict=True))
    return closed


INSERTED = _inserted()


def edits(kind: str) -> Matrix:
    """The turn's own edits. kind: its initial if that is one of s, u, a, in capitals if it is truncated; - for another initial,
    _ if that is truncated; x for a turn that must go; space for none."""
    if kind == " ":
        return IDENTITY
    extra = CUT_SHORT if kind == "_" or kind.isupper() else 0
    out = []
    for s in range(STATES):
        line: list[tuple[int, str] | None] = [None] * STATES
        line[s] = (DELETE, "D")
        if kind != "x":
            ways = [(REROLE + extra, "R", NEXT[s].get(r)) for r in NAMES] + [(KEEP + extra, "K", NEXT[s].get(kind.lower()))]
            for cost, letter, t in ways:
                if t is not None and (line[t] is None or (cost, letter) < line[t]):
                    line[t] = (cost, letter)
        out.append(tuple(line))
    return tuple(out)


@lru_cache(100_000)
def multiplied(kinds: str) -> Matrix:
    """The product of a few turns, each with the insertions before it."""
    if len(kinds) > 1:
        half = len(kinds) // 2
        return product(multiplied(kinds[:half]), multiplied(kinds[half:]))
    return IDENTITY if kinds in ("", " ") else product(INSERTED, edits(kinds))


class Products:
    """Products of runs in order, joined in a balanced tree: at most one of each size is held."""

    def __init__(self) -> None:
        self.held: list[tuple[int, Matrix]] = []

    def add(self, m: Matrix) -> None:
        size = 1
        while self.held and self.held[-1][0] == size:
            m = product(self.held.pop()[1], m)
            size *= 2
        self.held.append((size, m))

    def total(self) -> Matrix:
        out = IDENTITY
        for _, m in reversed(self.held):
            out = product(m, out)
        return out


def cheapest(total: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation: insertions after the last turn, and an end that is allowed."""
    ended = product(total, INSERTED)[0]
    return min(ended[t] for t in ENDS if ended[t] is not None)


# ---- turns


def damaged(df: DataFrame) -> DataFrame:
    """conv, turn, role, text, gone: the turns after damage by the crc32 of conversation and turn; dropped turns stay as markers."""
    space = F.lit(" ")
    base = df.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")])
    deal = F.crc32(F.encode(F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)), "UTF-8")) % 20
    text = F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("deal") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("deal") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = base.withColumn("deal", deal).select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("deal") == 0).alias("gone"), F.explode(copies).alias("copy"))
    return dealt.drop("copy")


def whole(df: DataFrame) -> DataFrame:
    """conv, turn, role, text, gone of a table of turns as it is."""
    space = F.lit(" ")
    return df.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")], F.lit(False).alias("gone"))


def _digest(column: str = "text") -> Column:
    return F.unhex(F.md5(F.encode(column, "UTF-8")))


#: The order of a conversation's turns, nulls first; a tag of its own sets equal rows apart.
ORDER = ("conv", "turn", "role", "h")


def flagged(turns: DataFrame) -> DataFrame:
    """conv, turn, role, h (digest of the text), tag, gone, blank, truncated, duplicate: turns without their texts."""
    ink = F.rtrim(F.translate("text", "\t\n\x0b\f\r", "     "))
    faults = [(F.length(ink) == 0).alias("blank"), (~F.substring(ink, -1, 1).isin(".", "!", "?")).alias("truncated")]
    # stored, so that a tag means the same row wherever it is used
    slim = settled(turns.select("conv", "turn", "role", _digest().alias("h"), F.monotonically_increasing_id().alias("tag"), "gone", *faults))
    own = ["conv", "role", "h"]
    first = F.min(F.struct("turn", "tag")).alias("first")
    # only what occurs more than once is joined; it is stored, so that below both sides of the join are plain shuffles and Spark
    # can split a hot text
    often = settled(slim.where("not gone").groupBy(*own).agg(first, F.count(F.lit(1)).alias("c")).where("c > 1").select(*[F.col(c).alias(f"_{c}") for c in own], "first"))
    joined = slim.join(often, F.expr(" AND ".join(f"{c} <=> _{c}" for c in own)), "left").select(*slim.columns, "first")
    return joined.withColumn("duplicate", F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.struct("turn", "tag"))).drop("first")


def kinds_of(column_role: str = "role") -> Column:
    """The letter of `edits` for each turn."""
    initial = F.substring(column_role, 1, 1)
    known = initial.isin("s", "u", "a")
    plain = F.when(known, initial).otherwise("-")
    short = F.when(known, F.upper(initial)).otherwise("_")
    return F.when(F.col("gone"), " ").when(F.col("blank") | F.col("duplicate"), "x").when(F.col("truncated"), short).otherwise(plain)


# ---- products of runs

SUMS = ("blank", "duplicate", "truncated", "illegal", "turns")
ELEMENT = pa.schema(
    [("conv", pa.int64()), ("place", pa.int64()), *((c, pa.int64()) for c in SUMS), ("low", pa.int64()), ("high", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)
ELEMENT_DDL = "conv long, place long, " + ", ".join(f"{c} long" for c in SUMS) + ", low long, high long, first string, last string, costs array<long>, audits array<string>"


class Run:
    """What is known of consecutive turns of a conversation: counts, the first and last turn number, the initials at both ends,
    and the product of their matrices."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.sums, self.low, self.high, self.first, self.last = conv, dict.fromkeys(SUMS, 0), None, None, None, None
        self.kinds, self.products = "", Products()

    def take(self, turn: int | None, initial: str, kind: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if kind == " ":
            return
        self.join(turn, turn, int(turn is not None), initial, initial)
        for name, fault in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated)):
            if fault:
                self.sums[name] += 1
                break
        self.kinds += kind
        if len(self.kinds) == RUN:
            self.products.add(multiplied(self.kinds))
            self.kinds = ""

    def join(self, low: int | None, high: int | None, turns: int, first: str | None, last: str | None) -> None:
        """Turn numbers and initials of what comes next; numbers rise, so a number that both have is the last and the first."""
        if low is not None:
            self.sums["turns"] += turns - (self.high == low)
            self.low = low if self.low is None else self.low
            self.high = high
        if first is not None:
            self.sums["illegal"] += self.last is not None and self.last + first not in LEGAL
            self.first = first if self.first is None else self.first
            self.last = last

    def take_run(self, sums: dict[str, int], low: int | None, high: int | None, ends: tuple[str | None, str | None], total: Matrix) -> None:
        turns = sums["turns"]
        for name in SUMS:
            self.sums[name] += sums[name] if name != "turns" else 0
        self.join(low, high, turns, *ends)
        self.products.add(total)

    def total(self) -> Matrix:
        if self.kinds:
            self.products.add(multiplied(self.kinds))
            self.kinds = ""
        return self.products.total()

    def row(self, place: int) -> dict:
        total = self.total()
        flat = [e for line in total for e in line]
        known = {"low": self.low, "high": self.high, "first": self.first, "last": self.last}
        return {"conv": self.conv, "place": place, **self.sums, **known, "costs": [e and e[0] for e in flat], "audits": [e and e[1] for e in flat]}


def _matrix(costs: list[int | None], audits: list[str | None]) -> Matrix:
    flat = [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]
    return tuple(tuple(flat[i : i + STATES]) for i in range(0, len(flat), STATES))


def _written(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=ELEMENT)


#: Rows and letters of audits in one batch of products.
AT_ONCE, LETTERS = 1000, 1 << 20


def _runs(items: Iterator[tuple], begin, take) -> Iterator[pa.RecordBatch]:
    """One row for each run of items with one group (their first field); begin(item) makes a run and its place."""
    run, group, place, out, letters = None, None, 0, [], 0
    for x in items:
        if run is None or x[0] != group:
            if run is not None:
                out.append(run.row(place))
                letters += sum(len(a) for a in out[-1]["audits"] if a)
                if len(out) >= AT_ONCE or letters >= LETTERS:
                    yield _written(out)
                    out, letters = [], 0
            group = x[0]
            run, place = begin(x)
        take(run, x)
    if run is not None:
        out.append(run.row(place))
    if out:
        yield _written(out)


def products(slim: DataFrame) -> DataFrame:
    """A product for each conversation in each partition; places count partitions."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()

        def items() -> Iterator[tuple]:
            for b in batches:
                for conv, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield (conv,), conv, rest

        yield from _runs(items(), lambda x: (Run(x[1]), place), lambda run, x: run.take(*x[2]))

    wide = slim.select(*ORDER, "tag", F.substring("role", 1, 1).alias("initial"), kinds_of().alias("kind"), "blank", "duplicate", "truncated")
    dealt = wide.repartitionByRange(*ORDER, "tag").sortWithinPartitions(*ORDER, "tag")
    return dealt.select("conv", "turn", "initial", "kind", "blank", "duplicate", "truncated").mapInArrow(run, ELEMENT_DDL)


def put_together(elements: DataFrame) -> DataFrame:
    """FAN products in order become one; places count these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple]:
            for b in batches:
                for r in b.to_pylist():
                    yield (r["conv"], r["place"] // FAN), r

        def take(run: Run, x: tuple) -> None:
            r = x[1]
            run.take_run({c: r[c] for c in SUMS}, r["low"], r["high"], (r["first"], r["last"]), _matrix(r["costs"], r["audits"]))

        yield from _runs(items(), lambda x: (Run(x[1]["conv"]), x[0][1]), take)

    bucket = F.expr(f"place div {FAN}")
    return elements.repartition("conv", bucket).sortWithinPartitions("conv", "place").mapInArrow(run, ELEMENT_DDL)


def repairs(turns: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit of turns (conv, turn, role, text, gone)."""
    elements = settled(products(flagged(turns)))
    parts = 1 + (elements.agg(F.max("place")).first()[0] or 0)
    while parts > 1:
        elements, parts = put_together(elements), -(-parts // FAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [cheapest(_matrix(c, a)) for c, a in zip(b.column("costs").to_pylist(), b.column("audits").to_pylist(), strict=True)]
            made = [pa.array([x[0] for x in best], pa.int64()), pa.array([x[1] for x in best], pa.string())]
            columns = [b.column(c) for c in ("conv", "low", "high", *SUMS)]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=["conv", "low", "high", *SUMS, "cost", "audit"])

    done = elements.mapInArrow(run, "conv long, low long, high long, " + ", ".join(f"{c} long" for c in SUMS) + ", cost long, audit string")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    return done.select("conv", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")


# ---- repaired texts


class Replay:
    """Turns that come out of an audit as the turns of the conversation pass by."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self.changed(), ""

    def changed(self) -> str:
        letter = next(r for r in NAMES if r in NEXT[self.state])
        self.state = NEXT[self.state][letter]
        return NAMES[letter]

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self.changed(), text
        elif edit == "K":
            self.state = NEXT[self.state][role[0]]
            yield role, text


def _passing(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its turns in order; conv, audit (of the first row), role, text."""
    ahead = found.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    behind = turns.where("not gone").select("conv", F.lit(1).alias("kind"), "turn", "role", "text", F.lit(None).cast("string").alias("audit"))
    both = ahead.unionByName(behind)
    return both.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", _digest()).select("conv", "audit", "role", "text")


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv, place (from 0), role, text: the turns after the edits of found (conv, audit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, conv, place = None, None, 0

        def put(rows: list[tuple], new: Iterator[tuple[str, str]]) -> None:
            nonlocal place
            for role, text in new:
                rows.append((conv, place, role, text))
                place += 1

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["conv", "place", "role", "text"])

        for b in batches:
            rows: list[tuple] = []
            for c, audit, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if audit is not None:
                    if replay:
                        put(rows, replay.inserted())
                    replay, conv, place = Replay(audit), c, 0
                else:
                    put(rows, replay.turn(role, text))
            yield batch(rows)
        if replay:
            rows = []
            put(rows, replay.inserted())
            yield batch(rows)

    return _passing(turns, found).mapInArrow(run, "conv long, place long, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of conversations with a turn left; turns of a conversation must come one after the other, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv, open_ = None, None, False
        for b in batches:
            ids, out = [], []
            for c, place, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if place == 0:
                    if open_:
                        ids.append(conv)
                        out.append(state.hexdigest())
                    state, conv, open_ = hashlib.sha256(), c, True
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["conv", "repaired_sha256"])
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()])], names=["conv", "repaired_sha256"])

    return repaired.mapInArrow(run, "conv long, repaired_sha256 string")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of turns (conv, turn, role, text, gone)."""
    session(turns.sparkSession)
    found = settled(repairs(turns))
    written = digests(repaired_turns(turns, found))
    joined = found.join(written.withColumnRenamed("conv", "_conv"), F.expr("conv <=> _conv"), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(session(spark).read.parquet(f"{sf_dir}/conversations.parquet")))


#: The same by the shortest path itself: a recursion over the turns of a conversation with four states.
OP13_SQL = r"""
WITH RECURSIVE step AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM conversations
), dealt AS (
  SELECT * EXCLUDE (bytes, t), xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS deal FROM named CROSS JOIN step
), harmed AS (
  SELECT conv_id, turn, CASE deal WHEN 4 THEN 'user' ELSE role END AS role, CASE deal WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE deal WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM dealt WHERE deal <> 0
), inked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS ink FROM harmed
), turns AS (
  SELECT *, CASE WHEN ink = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, substr(role, 1, 1) AS r,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM inked
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM turns GROUP BY conv_id
), goes(s, r, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserted(s, t, cost, letters, lines) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']),
  (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:'])),
edits AS (
  SELECT conv_id, i, s, s AS t, 3 AS cost, 'D' AS letter, []::VARCHAR[] AS lines FROM turns CROSS JOIN (SELECT unnest(range(4)) AS s)
  UNION ALL SELECT conv_id, i, s, t, CAST(fault = 'truncated' AS INTEGER), 'K', [role || ':' || text] FROM turns JOIN goes USING (r) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, i, s, t, 2 + CAST(fault = 'truncated' AS INTEGER), 'R', [CASE g.r WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] FROM turns, goes g WHERE g.r <> 's' AND fault NOT IN ('blank', 'duplicate')
), cheapest AS (
  SELECT e.conv_id, e.i, v.s, e.t, min({'cost': v.cost + e.cost, 'audit': v.letters || e.letter, 'lines': list_concat(v.lines, e.lines)}) AS e FROM inserted v JOIN edits e ON e.s = v.t GROUP BY e.conv_id, e.i, v.s, e.t
), path AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS p FROM counted
  UNION ALL
  SELECT c.conv_id, c.i, c.t, min({'cost': p.p.cost + c.e.cost, 'audit': p.p.audit || c.e.audit, 'lines': list_concat(p.p.lines, c.e.lines)})
  FROM path p JOIN cheapest c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.i = p.i + 1 AND c.s = p.s GROUP BY c.conv_id, c.i, c.t
), ended AS (
  SELECT p.conv_id, min({'cost': p.p.cost + v.cost, 'audit': p.p.audit || v.letters, 'lines': list_concat(p.p.lines, v.lines)}) AS p
  FROM path p JOIN counted n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = n.n JOIN inserted v ON v.s = p.s WHERE v.t IN (0, 3) GROUP BY p.conv_id
)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(e.p.cost, 0) AS BIGINT) AS cost, coalesce(e.p.audit, '') AS audit, sha256(coalesce(array_to_string(e.p.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM k.conv_id
"""
