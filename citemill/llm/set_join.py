"""Exact n-gram Jaccard join by a token-group matrix.

A document is the set of its word shingles. Two documents link when 100 * intersection >= PERCENT * union. Wanted are the
components of these links, exactly, so no link may be lost and no pair of alike texts need be written out.

1. Equal sets are collapsed first: they are one node.
2. Which sets can link at all? Two sets of at most h shingles each that link differ in at most k of them (2h/19 at 90 per cent).
   Cut the range of shingle hashes into more than k parts: in one part at least, both hold the very same shingles. So each set
   sends one hash for each part that it has shingles in, and only sets that share a part are looked at any further. Parts that
   are empty in both say nothing; there is a surplus of parts for them, and a set with more empty parts than the surplus is cut
   a second time by another hash (and a third time, and so on), so the argument holds for every pair. Sizes are dealt into
   levels, and a set near the upper end of a level is cut by the next level's rule too. A part holds some eight shingles, so a
   passage that many documents share doesn't make their parts equal.
3. Sets are partitioned into groups of similar ones: with the set with which they share most parts, in groups of bounded size.
   The token-group matrix is stored with a row for each group: the union of its shingles, and which member has which (bits).
   Links inside a group are found as its row is made.
4. Components of these links come next. Where a part is still shared by several components, the groups of its sets are compared,
   in blocks of bounded size: the overlap of a query with a group's union bounds its overlap with every member, groups that it
   cannot reach stay closed, and only in those that qualify intersections are counted. No pair of a group is ever a row.

Shingles and parts are told apart by 64-bit hashes; equal sets by 128 bits.

Defined results: A-Z are lower-cased; a text of fewer words than a shingle is one shingle of all its words; a text without words
and a null text have no shingle and link with nothing; a document without an id links with nothing and its component is null;
rows with one id are one document with the links of each, and each row has its own n_shingles; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, released, session, settled, stored, text_or_empty
from .near_duplicates import components
from .substrings import NO_ID, PART, _mixed, _parts, _signed, run_hashes, word_hashes

SHINGLE = 3
PERCENT = 90
#: Steps of set sizes between levels, and how often a set with many empty parts is cut anew before empty parts count as well.
STEP = 1.5
CUTS = 6
#: Members and shingles of a group (about; a larger set is a group of its own), groups and shingles of a block.
MEMBERS, TOKENS = 64, 1 << 18
BLOCK_GROUPS, BLOCK_TOKENS = 32, 1 << 21
#: Columns that are multiplied at once; sums of so many ones are exact in float32.
SLICE = 4096

_U = np.uint64


def differing(total: int, percent: int = PERCENT) -> int:
    """How many shingles two sets with so many together can differ in and still link: (1 - p) / (1 + p) of them."""
    return total * (100 - percent) // (100 + percent)


def levels(largest: int) -> list[int]:
    """The least size of each level."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, int(out[-1] * STEP)))
    return out


def parts_of(end: int, percent: int = PERCENT) -> tuple[int, int]:
    """Parts and surplus of the level of sizes below end; no parts where sets that link are equal."""
    k = differing(2 * (end - 1), percent)
    if k == 0:
        return 0, 0
    surplus = 1 + k // 100
    return k + 1 + surplus, surplus


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the texts' bounds among them."""
    hashes, bounds = word_hashes([t.lower() for t in texts])
    runs = run_hashes(hashes, size)
    out = []
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if z - a >= size:
            own = np.sort(runs[a : z - size + 1])
            new = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own[new])
        else:
            whole = np.zeros(min(1, z - a), np.uint64)
            for j in range(a, z):
                whole = _mixed(whole * _U(0xA0761D6478BD642F) + hashes[j : j + 1])
            out.append(_mixed(whole + _U(z - a)))
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.cumsum([0, *map(len, out)])


def _summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.empty(0, np.uint64)


def _cut(hashes: np.ndarray, owner: np.ndarray, level: int, count: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """owner, hash of each part that has shingles. hashes are sorted within each owner, by the place that the turn gives them."""
    place = hashes if turn == 0 else _mixed(hashes ^ _U(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    if turn:
        order = np.lexsort((place, owner))
        hashes, owner, place = hashes[order], owner[order], place[order]
    part = ((place >> _U(32)) * _U(count) >> _U(32)).astype(np.int64)
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    named = part[start].astype(np.uint64) + _U((level * CUTS * 2 + turn + 1) << 40)
    return owner[start], _mixed(_summed(_mixed(hashes + _U(0x9E3779B97F4A7C15)), start) + _mixed(named))


def part_hashes(tokens: np.ndarray, bounds: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """text, hash: sets that link have one in common, unless they are equal."""
    size = np.diff(bounds)
    least = levels(int(size.max(initial=0)) * 100 // percent + 1)
    own = np.searchsorted(least, size, side="right") - 1
    texts, out = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for level in range(len(least) - 1):
        count, surplus = parts_of(least[level + 1], percent)
        # of the level itself, and of the one below where a partner can be so large
        near = (own == level) | (own == level - 1) & (size * 100 // percent >= least[level])
        which = np.flatnonzero(near & (size > 0)) if count else []
        for turn in range(CUTS + 1):
            if not len(which):
                break
            owner = np.repeat(np.arange(len(which)), size[which])
            at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in which])
            of, hashed = _cut(tokens[at], owner, level, count, turn)
            texts.append(which[of])
            out.append(hashed)
            empty = count - np.bincount(of, minlength=len(which))
            which = which[empty > surplus]
        if len(which):
            # empty in both at every turn: say so
            for i in which:
                has = ((_mixed(tokens[bounds[i] : bounds[i + 1]] ^ _U(CUTS * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> _U(32)) * _U(count) >> _U(32)).astype(np.int64)
                lacks = np.setdiff1d(np.arange(count), has).astype(np.uint64)
                texts.append(np.full(len(lacks), i))
                out.append(_mixed(lacks + _U(level << 32 | 1 << 62)))
    return np.concatenate(texts), np.concatenate(out)


def described(keyed: DataFrame) -> DataFrame:
    """k, n (shingles), d1 and d2 (a digest of the set), parts."""
    schema = pa.schema([("k", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("parts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode() for t in b.column(1).to_pylist()]
            for a, z in _parts([len(t) for t in texts], PART):
                tokens, bounds = shingle_sets(texts[a:z])
                full = np.flatnonzero(np.diff(bounds))
                sums = np.zeros((2, z - a), np.uint64)
                for i, seed in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
                    sums[i, full] = _summed(_mixed(tokens ^ _U(seed)), bounds[full])
                text, hashed = part_hashes(tokens, bounds)
                order = np.argsort(text, kind="stable")
                edges = np.searchsorted(text[order], np.arange(z - a + 1))
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), _signed(hashed[order]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(np.diff(bounds).astype(np.int64)), _signed(sums[0]), _signed(sums[1]), lists.cast(schema.field("parts").type)], schema=schema)

    return keyed.mapInArrow(run, "k long, n long, d1 long, d2 long, parts array<long>")


# ---- the token-group matrix


def forest(size: int, one: np.ndarray, two: np.ndarray, label: np.ndarray | None = None) -> list[int]:
    """Places among the links (one, two) that join nodes not joined before; label joins some of them beforehand."""
    parent = list(range(size)) if label is None else np.unique(label, return_inverse=True)[1].tolist()
    start = parent[:]
    root = list(range(size))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, (a, b) in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
        a, b = top(start[a]), top(start[b])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append(i)
    return out


def shared_counts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ones that rows of x and rows of y (booleans over the same columns) have in common, exactly."""
    out = np.zeros((len(x), len(y)), np.int64)
    for a in range(0, x.shape[1], SLICE):
        out += (x[:, a : a + SLICE].astype(np.float32) @ y[:, a : a + SLICE].astype(np.float32).T).astype(np.int64)
    return out


def linked(both: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return 100 * both >= percent * (n[:, None] + m[None, :] - both)


class Group:
    """A row of the matrix: keys and sizes of the members, the union of their shingles (sorted), and a bit for each member and
    shingle."""

    def __init__(self, keys: np.ndarray, union: np.ndarray, has: np.ndarray, roots: np.ndarray | None = None) -> None:
        self.keys, self.union, self.has, self.roots = keys, union, has, roots
        self.sizes = has.sum(axis=1)

    @classmethod
    def of(cls, keys: list[int], sets: list[np.ndarray]) -> Group:
        union, at = np.unique(np.concatenate(sets), return_inverse=True)
        has = np.zeros((len(sets), len(union)), bool)
        has[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), at] = True
        return cls(np.array(keys, np.int64), union, has)

    @classmethod
    def read(cls, keys: np.ndarray, union: np.ndarray, bits: bytes, roots: np.ndarray) -> Group:
        has = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(len(keys), -1), axis=1, count=len(union)).astype(bool)
        return cls(keys, union.view(np.uint64), has, roots)

    def bits(self) -> bytes:
        return np.packbits(self.has, axis=1).tobytes()

    def links(self, percent: int = PERCENT) -> list[tuple[int, int]]:
        """Links that join all members that are joined inside the group, no more than it takes."""
        one, two = np.nonzero(np.triu(linked(shared_counts(self.has, self.has), self.sizes, self.sizes, percent), 1))
        return [(int(self.keys[one[i]]), int(self.keys[two[i]])) for i in forest(len(self.keys), one, two)]

    def reached(self, queries: Group, percent: int = PERCENT) -> np.ndarray:
        """Which queries can link with a member at all: so much of a query must lie in the union, and sizes must fit."""
        inside = np.isin(queries.union, self.union, assume_unique=True)
        bound = queries.has[:, inside].sum(axis=1)
        lo, hi = self.sizes.min(), self.sizes.max()
        return (100 * bound >= percent * np.maximum(queries.sizes, lo)) & (percent * queries.sizes <= 100 * hi)


def opened(queries: Group, group: Group, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Members of queries and of group that link and have different roots; the group is opened for the queries that reach it."""
    none = np.empty(0, np.int64)
    if len({*queries.roots.tolist(), *group.roots.tolist()}) == 1:
        return none, none
    asked = np.flatnonzero(group.reached(queries, percent))
    back = np.flatnonzero(queries.reached(group, percent)) if len(asked) else none
    if not len(back):
        return none, none
    _, x, y = np.intersect1d(queries.union, group.union, assume_unique=True, return_indices=True)
    both = shared_counts(queries.has[np.ix_(asked, x)], group.has[np.ix_(back, y)])
    fits = linked(both, queries.sizes[asked], group.sizes[back], percent) & (queries.roots[asked][:, None] != group.roots[back][None, :])
    one, two = np.nonzero(fits)
    return asked[one], back[two]


def links_between(groups: list[tuple[int, Group]], i: int, j: int) -> list[tuple[int, int]]:
    """Links between members of different groups that join different roots, no more than it takes. Of two blocks i and j (the
    groups' first fields) only groups of different blocks are compared."""
    keys = np.concatenate([g.keys for _, g in groups])
    roots = np.concatenate([g.roots for _, g in groups])
    start = np.cumsum([0, *(len(g.keys) for _, g in groups)])
    ones, twos = [], []
    for p, (block, queries) in enumerate(groups):
        for q in range(p + 1, len(groups)):
            if i == j or groups[q][0] != block:
                one, two = opened(queries, groups[q][1])
                ones.append(start[p] + one)
                twos.append(start[q] + two)
    if not ones:
        return []
    one, two = np.concatenate(ones), np.concatenate(twos)
    return [(int(keys[one[x]]), int(keys[two[x]])) for x in forest(len(keys), one, two, roots)]


GROUP = pa.schema([("gid", pa.int64()), ("keys", pa.list_(pa.int64())), ("union", pa.list_(pa.int64())), ("bits", pa.binary()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])
GROUP_DDL = "gid long, keys array<long>, union array<long>, bits binary, a array<long>, b array<long>"


def grouped(placed: DataFrame, keyed: DataFrame) -> DataFrame:
    """The matrix, a row for each group of placed (g, sub, k, own: the group's own members; the others are guests): gid (its least
    own member), keys, union, bits, and a, b: links inside."""

    def row(keys: list[int], own: list[bool], texts: list[bytes]) -> dict:
        tokens, bounds = shingle_sets(texts)
        group = Group.of(keys, [tokens[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)])
        links = group.links()
        gid = min(k for k, o in zip(keys, own, strict=True) if o)
        return {"gid": gid, "keys": group.keys, "union": group.union.view(np.int64), "bits": group.bits(), "a": [x for x, _ in links], "b": [y for _, y in links]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = ([], [], []), None

        def done() -> pa.RecordBatch:
            made = row(*held)
            for x in held:
                x.clear()
            return pa.RecordBatch.from_pylist([made], schema=GROUP)

        for b in batches:
            for g, sub, k, own, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last is not None and last != (g, sub):
                    yield done()
                last = (g, sub)
                if not held[0] or held[0][-1] != k:
                    for x, v in zip(held, (k, own, text.encode()), strict=True):
                        x.append(v)
        if held[0]:
            yield done()

    rows = placed.join(keyed, "k").select("g", "sub", "k", "own", "text")
    return rows.repartition("g", "sub").sortWithinPartitions("g", "sub", "k").mapInArrow(run, GROUP_DDL)


def met_in_blocks(matrix: DataFrame, rooted: DataFrame, families: DataFrame) -> DataFrame:
    """a, b: links between groups of a family (families: gid, f), in blocks of a bounded number of groups and shingles."""
    size = F.size("union").cast("long")
    mine = matrix.select("gid", "keys", "union", "bits").join(families, "gid")
    # stored, for the join with all groups of a family
    cuts = settled(mine.groupBy("f").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK_GROUPS))), F.ceil(F.sum(size) / F.lit(float(BLOCK_TOKENS)))).cast("int").alias("cuts")))
    roots = rooted.groupBy("gid").agg(F.map_from_entries(F.collect_list(F.struct("k", "root"))).alias("roots"))
    dealt = mine.join(cuts, "f").withColumn("i", F.pmod(F.xxhash64("gid"), F.col("cuts")).cast("int")).join(roots, "gid")
    own = F.expr("transform(keys, k -> coalesce(roots[k], k))").alias("roots")
    met = dealt.select("f", "i", "gid", "keys", own, "union", "bits", F.explode(F.expr("transform(sequence(0, cuts - 1), j -> struct(least(i, j) AS x, greatest(i, j) AS y))")).alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, Group]] = []
        last = None

        def done() -> list[tuple[int, int]]:
            out = links_between(held, last[1], last[2]) if len(held) > 1 else []
            held.clear()
            return out

        def batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for b in batches:
            links = []
            f, x, y, i = (b.column(c).to_pylist() for c in range(4))
            for r in range(b.num_rows):
                if last is not None and last != (f[r], x[r], y[r]):
                    links += done()
                last = (f[r], x[r], y[r])
                keys, roots, union = (b.column(c)[r].values.to_numpy() for c in (4, 5, 6))
                held.append((i[r], Group.read(keys, union, b.column(7)[r].as_py(), roots)))
            yield batch(links)
        yield batch(done())

    rows = met.select("f", F.col("g.x").alias("x"), F.col("g.y").alias("y"), "i", "keys", "roots", "union", "bits", "gid")
    dealt = rows.repartition("f", "x", "y").sortWithinPartitions("f", "x", "y", "gid").drop("gid")
    return dealt.mapInArrow(run, "a long, b long")


def set_components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: k (null without a key), n_shingles, component_id (the least key that links reach)."""
    spark = session(df.sparkSession)
    keyed = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("k"), text_or_empty(text).alias("text"))
    sets = stored(described(keyed), "sets")
    full = sets.where((F.col("n") > 0) & (F.col("k") != NO_ID))
    same = ["d1", "d2", "n"]
    # equal sets are one node, named by its least key; stored, so that hot sets and parts can be split in the joins below
    nodes = stored(full.groupBy(*same).agg(F.min("k").alias("rep"), F.first("parts").alias("parts")), "nodes")
    members = nodes.select(F.col("rep").alias("k"), "n", F.explode("parts").alias("part"))
    shared = settled(members.groupBy("part").agg(F.min("k").alias("centre"), F.count(F.lit(1)).alias("c")).where("c > 1").select("part", "centre"))
    inside = stored(members.join(shared, "part"), "shared-parts")
    released(spark)
    # a set joins the group of the centre with which it shares most parts; a centre is a guest in its own group
    votes = inside.groupBy("k", "n", "centre").agg(F.count(F.lit(1)).alias("c"))
    own = settled(votes.groupBy("k", "n").agg(F.min(F.struct((-F.col("c")).alias("c"), "centre")).alias("best")).select("k", "n", F.col("best.centre").alias("g")))
    cuts = settled(own.groupBy("g").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(float(MEMBERS))), F.ceil(F.sum("n") / F.lit(float(TOKENS)))).cast("int").alias("cuts")))
    placed = own.join(cuts, "g").select("g", F.pmod(F.xxhash64("k"), F.col("cuts")).cast("int").alias("sub"), "k", F.lit(True).alias("own"))
    placed = settled(placed)
    guests = placed.where("k != g").select("g", "sub").distinct().select("g", "sub", F.col("g").alias("k"), F.lit(False).alias("own"))
    matrix = stored(grouped(placed.unionByName(guests), keyed), "groups")
    released(spark)
    # rows with one key and different sets are one document
    reps = full.select("k", *same).join(nodes.select(*same, "rep"), same).select("k", "rep")
    several = settled(reps.groupBy("k").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a < hi").select("k", "a"))
    twice = reps.join(several, "k").where("rep != a").select("a", F.col("rep").alias("b"))
    within = matrix.select(F.explode(F.arrays_zip("a", "b")).alias("x")).select("x.a", "x.b")
    links = settled(within.union(twice))
    roots = components(links)
    # parts that several components share: their groups are compared
    gids = settled(placed.groupBy("g", "sub").agg(F.min("k").alias("gid")))
    where = settled(placed.join(gids, ["g", "sub"]).select("k", "gid").join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k")))
    seen = inside.select("part", "k").join(where, "k")
    open_ = settled(seen.groupBy("part").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("gid").alias("b")).where("lo < hi").select("part", "b"))
    edges = settled(seen.join(open_, "part").select(F.col("gid").alias("a"), "b").where("a != b").distinct())
    released(spark)
    if edges.take(1):
        families = components(edges).select(F.col("node").alias("gid"), F.col("root").alias("f"))
        families = settled(families.union(families.select(F.col("f").alias("gid"), "f")).distinct())
        links = settled(links.union(met_in_blocks(matrix, where, families)))
        roots = components(links)
    named = nodes.select(*same, "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("root", "rep").alias("root"))
    classed = full.select("k", *same).join(settled(named), same)
    alone = sets.where((F.col("n") == 0) | (F.col("k") == NO_ID)).select("k", "n", F.col("k").alias("root"))
    every = classed.select("k", "n", "root").union(alone)
    # a key may have rows without shingles beside others
    least = settled(every.groupBy("k").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min(F.when(F.col("n") > 0, F.col("root"))).alias("linked")).where("least < most").select("k", F.coalesce("linked", "least").alias("linked")))
    done = every.join(least, "k", "left").withColumn("root", F.least(F.coalesce("linked", "root"), F.col("k")))
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return done.select(shown("k").alias("k"), F.col("n").alias("n_shingles"), shown("root").alias("component_id"))


def op11_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_components(documents(spark, sf_dir, "doc_id", "text")).withColumnRenamed("k", "doc_id")


OP11_SQL = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + {SHINGLE - 1}], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM split WHERE len(w) > 0)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes u ON u.doc_id = a JOIN sizes v ON v.doc_id = b WHERE 100 * c >= {PERCENT} * (u.n + v.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(b) AS component_id FROM documents LEFT JOIN sizes USING (doc_id) JOIN reach ON a = doc_id GROUP BY doc_id
"""
