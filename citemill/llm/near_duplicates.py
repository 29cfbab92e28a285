"""Near-duplicate documents by BagMinHash on shingles of five words with their multiplicities.

Signatures. The weight axis of each shingle is cut into the octaves (0,1], (1,2], (2,4], (4,8] and so on, and each octave has
its own Poisson process, seeded by shingle and octave, whose points carry a time, a slot and a weight level within the octave.
A shingle of weight w takes part with the points of levels up to w: the octaves below w whole, the one that holds w thinned.
A slot keeps its earliest point, so two bags agree in a slot with the probability of their weighted Jaccard similarity,
unbiased at every weight. Points of a shingle come in order of time and end once they are later than all slots of the document.

Links. Equal texts are collapsed first. Signatures are cut into bands; in each band's bucket all members are compared with the
least one, exactly, by their whole bags; linked documents form components. Buckets that hold several components stay open: their
documents are compared across components, in blocks of bounded size by products of matrices, and components are joined anew.
Left out of that without loss are documents with so many shingles of their own that no overlap can reach the similarity. So every
pair that shares a band is linked, joined by other links, or found too different, and no pair of a bucket is ever a row but those
with its least member.

Defined results: a null text is the empty text, all empty texts are equal; texts of fewer than five words are one shingle of
all their words; a document without an id is a class of its own (class_id null) and always stays; rows with one id are one
document; ties: the smallest id names the class and stays; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, released, session, settled, text_or_empty, unused
from .substrings import NO_ID, PART, _mixed, _parts, _signed, run_hashes, word_hashes

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 28, 5  # a pair at 0.8 shares no band with a probability of 1.5e-5
SLOTS = BANDS * ROWS
#: Documents and shingles a block, and columns that are multiplied at once.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
SLICE = 2048

_U = np.uint64


def bags(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, shingle hash, multiplicity; sorted by text, then hash."""
    hashes, bounds = word_hashes(texts)
    runs, n = run_hashes(hashes, size), np.diff(bounds)
    text = np.repeat(np.arange(len(texts)), np.maximum(n - size + 1, 0))
    first = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(np.maximum(n - size + 1, 0))[:-1]]), np.maximum(n - size + 1, 0))
    own = runs[first + np.arange(len(text))] if len(text) else np.empty(0, np.uint64)
    short = np.flatnonzero(n < size)
    whole = np.zeros(len(short), np.uint64)
    for j in range(size - 1):
        has = n[short] > j
        whole[has] = _mixed(whole[has] * _U(0xA0761D6478BD642F) + hashes[bounds[short[has]] + j])
    text, own = np.concatenate([text, short]), np.concatenate([own, _mixed(whole + n[short].astype(np.uint64))])
    order = np.lexsort((own, text))
    text, own = text[order], own[order]
    new = np.ones(len(own), bool)
    new[1:] = (text[1:] != text[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    return text[at], own[at], np.diff(np.append(at, len(own)))


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, slots: int = SLOTS) -> np.ndarray:
    """[text, slot]: the name of the earliest point. Weights are positive whole numbers."""
    octaves = np.ceil(np.log2(weight)).astype(np.int64) + 1
    of = np.repeat(np.arange(len(weight)), octaves)
    octave = np.arange(len(of)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    floor = np.where(octave > 0, 1 << np.maximum(octave - 1, 0), 0)
    width = np.maximum(floor, 1)
    room = np.minimum(weight[of] - floor, width)  # levels of the octave that the weight takes in
    doc, rate = text[of], width * float(slots)
    seed = _mixed(shingle[of] + octave.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    time = np.zeros(len(of))
    earliest, names = np.full(texts * slots, np.inf), np.zeros(texts * slots, np.uint64)
    latest = np.full(texts, np.inf)
    turn = 0
    while len(doc):
        turn += 1
        point = _mixed(seed + _U(turn * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        more = _mixed(point)
        time = time - np.log(((point >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        slot = ((more >> _U(32)) * _U(slots) >> _U(32)).astype(np.int64)
        taken = time <= latest[doc]
        if (room < width).any():
            taken &= ((more & _U(0xFFFFFFFF)) * width.astype(np.uint64) >> _U(32)).astype(np.int64) < room
        at, when = doc[taken] * slots + slot[taken], time[taken]
        np.minimum.at(earliest, at, when)
        won = earliest[at] == when
        names[at[won]] = point[taken][won]
        if turn < 8 or turn % 8 == 0:
            latest = earliest.reshape(texts, slots).max(axis=1)
            left = time <= latest[doc]
            if not left.all():
                doc, rate, seed, time, room, width = (x[left] for x in (doc, rate, seed, time, room, width))
    return names.reshape(texts, slots)


def band_keys(names: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """[text, band]: a hash of the band's number and its names."""
    parts = names.reshape(len(names), -1, rows)
    key = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2])
    for r in range(rows):
        key = _mixed(key * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (sorted hashes, counts)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    both = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    return bags([text.encode()])[1:]


def signed_documents(keyed: DataFrame) -> DataFrame:
    """k, digest of the text, n (shingles), bands."""
    schema = pa.schema([("k", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode() for t in b.column(2).to_pylist()]
            for a, z in _parts([len(t) for t in texts], PART):
                bag = bags(texts[a:z])
                keys = band_keys(signatures(*bag, z - a))
                n = np.bincount(bag[0], weights=bag[2], minlength=z - a).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), _signed(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), pa.array(n), lists.cast(schema.field("bands").type)], schema=schema)

    source = keyed.where(F.col("k") != NO_ID).select("k", F.unhex(F.md5("text")).alias("digest"), "text")
    return source.mapInArrow(run, "k long, digest binary, n long, bands array<long>")


def verified(pairs: DataFrame, keyed: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose bags have at least that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bag = None, None
        for b in batches:
            a_ids, b_ids, a_texts, b_texts = (c.to_pylist() for c in b.columns)
            good = []
            for i, (y, s, t) in enumerate(zip(b_ids, a_texts, b_texts, strict=True)):
                if (y, t) != held:
                    held, bag = (y, t), _bag(t)
                if similarity(_bag(s), bag) >= least:
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a_ids[i] for i in good], pa.int64()), pa.array([b_ids[i] for i in good], pa.int64())], names=["a", "b"])

    texts = keyed.select("k", "text")
    one = pairs.join(texts.withColumnRenamed("k", "a").withColumnRenamed("text", "s"), "a")
    both = one.join(texts.withColumnRenamed("k", "b").withColumnRenamed("text", "t"), "b")
    return both.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def lone_shingles(open_: DataFrame, keyed: DataFrame) -> DataFrame:
    """k, lone: of each document in open_ (k), the shingles that no other one there has, with their multiplicities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode() for t in b.column(1).to_pylist()]
            for a, z in _parts([len(t) for t in texts], PART):
                text, shingle, weight = bags(texts[a:z])
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(b.column(0))[a:z][text]), _signed(shingle), pa.array(weight.astype(np.int64))], names=["k", "shingle", "weight"])

    rows = keyed.join(open_, "k").dropDuplicates(["k"]).select("k", "text").mapInArrow(run, "k long, shingle long, weight long")
    alone = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("k").alias("k"), F.sum("weight").alias("w")).where("c = 1")
    return alone.groupBy("k").agg(F.sum("w").alias("lone"))


def links_among(keys: list[int], roots: list[int], texts: list[str], least: float) -> list[tuple[int, int]]:
    """Links that join all documents of different roots which are similar, no more than it takes; overlaps are products of
    matrices with a row per document and a column per shingle and count (its first, its second occurrence), in slices."""
    text, shingle, weight = bags([t.encode() for t in texts])
    each = np.repeat(np.arange(len(text)), weight)
    count = np.arange(len(each)) - np.repeat(np.cumsum(weight) - weight, weight)
    _, column, often = np.unique(_mixed(shingle[each] + count.astype(np.uint64)), return_inverse=True, return_counts=True)
    size = np.bincount(text, weights=weight, minlength=len(keys))
    shared = often[column] > 1
    row, column = text[each][shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(keys), len(keys)), np.int64)
    for a in range(0, int(column.max(initial=-1)) + 1, SLICE):
        lo, hi = np.searchsorted(column, (a, a + SLICE))
        part = np.zeros((len(keys), SLICE), np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        both += (part @ part.T).astype(np.int64)  # of SLICE ones at most, so exact
    label = np.unique(np.array(roots), return_inverse=True)[1]
    alike = (both >= least * (size[:, None] + size[None, :] - both)) & (label[:, None] < label[None, :])
    one, two = np.nonzero(alike)
    _, first = np.unique(label[one] * (label.max(initial=0) + 1) + label[two], return_index=True)
    parent = list(range(int(label.max(initial=0)) + 1))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i in first.tolist():
        a, b = top(int(label[one[i]])), top(int(label[two[i]]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((keys[one[i]], keys[two[i]]))
    return out


def linked_in_blocks(together: DataFrame, keyed: DataFrame, least: float) -> DataFrame:
    """a, b of together (k, root, n, b: the least document of a bucket of k): documents that buckets join, directly or not, are a
    family; families are cut into blocks, and two blocks meet in one group of bounded size. No pair is a row."""
    family = components(together.select(F.col("k").alias("a"), "b"))
    own = together.select("k", "root", "n").distinct().join(family.select(F.col("node").alias("k"), F.col("root").alias("f")), "k", "left").withColumn("f", F.coalesce("f", "k"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))), F.ceil(F.sum("n") / F.lit(float(BLOCK_SHINGLES))))
    cuts = own.groupBy("f").agg(blocks.cast("int").alias("cuts"))
    mine = own.join(cuts, "f").withColumn("i", F.pmod(F.xxhash64("k"), F.col("cuts")).cast("int"))
    met = mine.select("k", "root", "f", F.explode(F.expr("transform(sequence(0, cuts - 1), j -> struct(least(i, j) AS i, greatest(i, j) AS j))")).alias("g"))
    rows = met.join(keyed.select("k", "text").dropDuplicates(["k"]), "k").select("f", "g.i", "g.j", "k", "root", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(group: list[tuple]) -> list[tuple[int, int]]:
            return links_among([r[3] for r in group], [r[4] for r in group], [r[5] for r in group], least) if len(group) > 1 else []

        group: list[tuple] = []
        for b in batches:
            links = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and group[-1][:3] != r[:3]:
                    links += done(group)
                    group = []
                group.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])
        links = done(group)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.repartition("f", "i", "j").sortWithinPartitions("f", "i", "j", "k").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) by alternating large and small stars, until nothing changes."""
    links = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())

    def state_of(rows: DataFrame):
        """Equal for equal sets of distinct rows."""
        return rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    state = state_of(links)
    while True:
        both = links.union(links.select("v", "u"))
        # stored, so that each side of the join is a plain shuffle and Spark can split a node with very many links
        least = settled(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(below).where("u != v").distinct()
        new, before = settled(small), state
        state = state_of(new)
        if state == before:
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        links = new
        released(edges.sparkSession)


def near_duplicate_classes(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """k (NO_ID stands for a null key) and class_id for each document: the least key of its class."""
    session(df.sparkSession)
    keyed = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("k"), text_or_empty(text).alias("text"))
    signs = settled(signed_documents(keyed))
    # groups and buckets are stored, so that below each side of a join is a plain shuffle and Spark can split hot texts and bands
    groups = settled(signs.groupBy("digest").agg(F.min("k").alias("rep"), F.min("n").alias("n"), F.first("bands").alias("bands")))
    members = groups.select(F.col("rep").alias("k"), "n", F.explode(F.array_distinct("bands")).alias("band"))
    buckets = settled(members.groupBy("band").agg(F.min("k").alias("centre"), F.count(F.lit(1)).alias("members")).where("members > 1"))
    inside = settled(members.join(buckets, "band").select("band", "k", "n", "centre", "members"))
    centres = inside.where("k = centre").select("band", F.col("n").alias("m"))
    alike = f"least(n, m) >= {least} * greatest(n, m)"
    stars = settled(inside.where("k != centre").join(centres, "band").where(alike).select(F.col("k").alias("a"), F.col("centre").alias("b")).distinct())
    linked = settled(verified(stars, keyed, least))
    released(df.sparkSession)
    roots = components(linked)
    placed = inside.where("members > 2").join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k")).select("band", "k", "n", "root")
    mixed = settled(placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band"))
    open_ = settled(placed.join(mixed, "band"))
    lone = lone_shingles(open_.select("k").distinct(), keyed)
    # an overlap is at most what others share: o of n shingles are in no text with a similarity over o / n
    left = settled(open_.join(lone, "k", "left").withColumn("o", F.col("n") - F.coalesce("lone", F.lit(0))).where(f"o >= {least} * n").select("band", "k", "root", "n"))
    still = settled(left.groupBy("band").agg(F.min("k").alias("b"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi"))
    together = settled(left.join(still, "band").select("k", "root", "n", "b"))
    found = settled(linked_in_blocks(together, keyed, least))
    released(df.sparkSession)
    if found.take(1):
        roots = components(linked.union(found))
    # rows with one id and different texts are one document
    same = signs.join(groups.select("digest", "rep"), "digest").select("k", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    classes = same.groupBy("k").agg(F.min(F.coalesce("root", "rep")).alias("class_id"))
    return classes


def dedup_documents(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """The rows of df whose key names their class, one row per key; rows without a key stay."""
    own = unused(df, "k")
    kept = settled(near_duplicate_classes(df, key, text, least).where("k = class_id").select(F.col("k").alias(own)))
    released(df.sparkSession)
    keyed = df.withColumn(own, F.col(key).cast("long"))
    with_key = keyed.join(kept, own, "left_semi").dropDuplicates([own])
    return with_key.unionByName(keyed.where(F.col(own).isNull())).select(*df.columns)


def op7_bag_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    classes = near_duplicate_classes(docs)
    found = docs.select("doc_id").join(classes.withColumnRenamed("k", "doc_id"), "doc_id", "left")
    return found.select("doc_id", "class_id", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)).alias("stays"))
