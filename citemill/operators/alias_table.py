"""Aliases kept as a table (alias, replacement): dictionaries of any size.

Texts and aliases are cut into the same tokens: runs of letters or digits, and each other sign. An alias is found where its tokens
stand in a text with white space in the same places (of any kind and length); capitals and the kinds of apostrophes don't
matter. At each place the longest alias counts, and hits don't overlap: the leftmost one wins.

A dictionary up to ``LARGEST`` bytes is sent to all workers as an automaton over tokens, and texts are read once where they are. Beyond
that, runs of tokens are joined with the aliases by hash: of a text those runs travel that have as many tokens as some alias and
pass a sieve of the aliases' hashes.
Both give the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.converters import text
from ..sources.batches import bounded

#: Bytes of aliases and replacements that are sent to every worker.
LARGEST = 32 * 1024 * 1024
#: Bits of the sieve that runs of a text pass before they travel, as a power of two (32 MB); beyond that it lets more others through.
MOST_BITS = 28
#: Between the tokens of an alias in one string; no token holds it.
APART = "\n"
#: Token: its sign of white space before it (_ or nothing), then what it says.
TOKEN = r"[\s ]*(?:[\p{L}0-9]+|[^\s ])"
_HIT = "array<struct<position:int,source:string,replacement:string>>"


def tokens(c: Column) -> Column:
    """The tokens of a text as they stand, white space before them included."""
    plain = F.translate(F.replace(text(c), F.lit("&amp;"), F.lit("&")), "‘’ʼ", "'''")
    return F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0))


def keys(found: Column) -> Column:
    """What is compared: lower case, one sign for any white space before a token."""
    return F.transform(found, lambda t: F.lower(F.regexp_replace(t, r"\A[\s ]+", "_")))


def dictionary(aliases: DataFrame) -> DataFrame:
    """keys (of the alias), replacement: one row per alias, of equal ones the least replacement."""
    own = F.regexp_replace(F.trim("alias"), r"\A[\s ]+", "")
    cut = aliases.select(keys(tokens(own)).alias("keys"), F.col("replacement").cast("string").alias("replacement")).where(F.size("keys") > 0)
    return cut.groupBy("keys").agg(F.min("replacement").alias("replacement"))


def _size(known: DataFrame) -> int:
    """Bytes of the dictionary, and none of its rows."""
    return known.agg(F.sum(F.octet_length(F.array_join("keys", " ")) + F.octet_length("replacement"))).first()[0] or 0


def found(df: DataFrame, aliases: DataFrame, key: str = "doc_id", column: str = "text", largest: int = LARGEST) -> DataFrame:
    """key, position (code points), source, replacement of each hit; the key must name a row of df."""
    known = dictionary(aliases)
    if _size(known) > largest:
        return _with_hits(df.select(key, column), known, key, column).select(key, F.inline("_h"))
    return _by_automaton(df.select(key, tokens(F.col(column)).alias("t")).withColumn("k", keys(F.col("t"))), known, key)


def _ends_free(t: list[str], start: int, end: int) -> bool:
    """No letter, digit or slash touches the hit; tokens are whole runs, so only a slash or a hit that begins or ends with a sign can."""
    before, after = (t[start - 1][-1:] if start and not t[start][:1].isspace() else ""), (t[end][:1] if end < len(t) else "")
    first, last = t[start].strip()[:1], t[end - 1][-1:]
    touches = lambda c, other: c == "/" or c != "" and c.isalnum() and not other.isalnum()
    return not (touches(before, first) or touches(after, last))


def _by_automaton(cut: DataFrame, known: DataFrame, key: str) -> DataFrame:
    rows = known.toArrow()
    trie: dict = {}
    for run_, by in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        node = trie
        for k in run_:
            node = node.setdefault(k, {})
        node[""] = by
    sent = cut.sparkSession.sparkContext.broadcast(trie)
    kind = dict(cut.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, out = [], []
            for r, (t, k) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                starts, at, i = [0], 0, 0
                for x in t:
                    at += len(x)
                    starts.append(at)
                while i < len(k):
                    node, best = sent.value.get(k[i].removeprefix("_")), 0
                    j = i + 1
                    while node is not None:
                        if "" in node and _ends_free(t, i, j):
                            best, by = j, node[""]
                        node, j = (node.get(k[j]) if j < len(k) else None), j + 1
                    if best:
                        lead = len(t[i]) - len(t[i].lstrip())
                        row.append(r)
                        out.append((starts[i] + lead, "".join(t[i:best])[lead:], by))
                        i = best
                    else:
                        i += 1
            made = [pa.array([o[n] for o in out], kind_) for n, kind_ in enumerate((pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *made], names=["key", "position", "source", "replacement"])

    return bounded(cut).mapInArrow(run, f"key {kind}, position int, source string, replacement string").withColumnRenamed("key", key)


def _free(t: Column, i: Column, n: Column) -> Column:
    """The same as `_ends_free`, as a condition on tokens i to i + n - 1."""
    alnum = r"[\p{L}0-9]"
    before = F.when((i > 0) & ~F.get(t, i).rlike(r"\A[\s ]"), F.substring(F.get(t, i - 1), -1, 1)).otherwise("")
    after = F.coalesce(F.substring(F.get(t, i + n), 1, 1), F.lit(""))
    first, last = F.regexp_extract(F.get(t, i), r"\A[\s ]*(.)", 1), F.substring(F.get(t, i + n - 1), -1, 1)
    touches = lambda c, other: (c == "/") | c.rlike(alnum) & ~other.rlike(alnum)
    return ~(touches(before, first) | touches(after, last))


def _bare(token: Column) -> Column:
    """A token without its sign of white space."""
    return F.when(F.startswith(token, F.lit("_")), F.substring(token, F.lit(2), F.length(token))).otherwise(token)


def _first_bare(run_: Column) -> Column:
    return F.concat(F.array(_bare(F.element_at(run_, 1))), F.slice(run_, 2, F.greatest(F.size(run_) - 1, F.lit(0))))


def _sieve(hashes: DataFrame, n: int) -> np.ndarray:
    """Bits that the hashes of n aliases set, two each; at most 2 ** MOST_BITS, however large the dictionary is."""
    bits = min(MOST_BITS, max(15, (16 * n).bit_length()))
    places = F.array(*[F.shiftrightunsigned("h", by).bitwiseAND(F.lit((1 << bits) - 1)) for by in (0, 32)])
    each = hashes.select(F.explode(places).alias("p")).select(F.shiftright("p", 15).alias("block"), F.col("p").bitwiseAND(F.lit(32767)).alias("bit")).repartition("block")
    out = np.zeros(1 << bits - 3, np.uint8)
    for block, found_ in each.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("b")).collect():
        out[block * 4096 : (block + 1) * 4096] = np.frombuffer(found_, np.uint8)
    return out


def _run_hashes(first: np.ndarray, own: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """The hashes of runs of n tokens, made of the tokens' (the first one's without its white space)."""
    h = first[start] + np.uint64(n)
    for j in range(1, n):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + own[start + j]
    return h ^ (h >> np.uint64(29))


def _named(known: DataFrame) -> DataFrame:
    """h, said, replacement: the hash of each alias' tokens, and these in one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, sizes = b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64), b.column(0).value_lengths().to_numpy(zero_copy_only=False)
            begins, h = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.uint64)
            for n in np.unique(sizes):
                h[sizes == n] = _run_hashes(own, own, begins[sizes == n], int(n))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(1), b.column(2)], names=["h", "said", "replacement"])

    sent = known.select(F.transform("keys", lambda x: F.xxhash64(x)).alias("own"), F.array_join("keys", APART).alias("said"), "replacement")
    return bounded(sent).mapInArrow(run, "h bigint, said string, replacement string")


def _runs(cut: DataFrame, sieve: np.ndarray, lengths: list[int], key: str) -> DataFrame:
    """key, i, n, h: the runs of tokens (the i-th and n - 1 after it) whose hash h may be that of an alias."""
    per = cut.select(key, F.transform("k", lambda x: F.xxhash64(_bare(x))).alias("first"), F.transform("k", lambda x: F.xxhash64(x)).alias("own"))
    sent = cut.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, last = sent.value, np.uint64(8 * len(sent.value) - 1)
        for b in batches:
            first, own = (b.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in (1, 2))
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            place, left = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row], np.cumsum(sizes)[row] - np.arange(len(row))
            out = []
            for n in lengths:
                start = np.flatnonzero(left >= n)
                h = _run_hashes(first, own, start, n)
                there = np.ones(len(h), bool)
                for by in (0, 32):
                    p = (h >> np.uint64(by)) & last
                    there &= (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                start = start[there]
                out.append((row[start], place[start], np.full(len(start), n), h[there].view(np.int64)))
            rows, *made = (np.concatenate(x) for x in zip(*out, strict=True))
            made = [pa.array(x, kind_) for x, kind_ in zip(made, (pa.int32(), pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *made], names=["key", "i", "n", "h"])

    return bounded(per).mapInArrow(run, f"key {dict(cut.dtypes)[key]}, i int, n int, h bigint").withColumnRenamed("key", key)


def _with_hits(df: DataFrame, known: DataFrame, key: str, column: str) -> DataFrame:
    """df and `_h`, the hits in each of its texts in order; null in a text without a run that is an alias.

    Runs pass a sieve of bounded size where they are, so that of all runs those travel that are aliases, and few others. Texts travel
    once, without their tokens, to the runs that were found.
    """
    counted = known.groupBy(F.size("keys").alias("n")).count().collect()  # as many rows as aliases have lengths
    lengths = sorted(r[0] for r in counted)
    names = _named(known)
    cut = df.select(key, keys(tokens(F.col(column))).alias("k"))
    each = _runs(cut, _sieve(names.select("h"), sum(r[1] for r in counted)), lengths, key)
    # A dictionary of this size is never sent to the driver and all workers, however small its rows are guessed to be.
    met = each.join(names.hint("merge"), "h").select(key, "i", (-F.col("n")).alias("m"), "said", "replacement")
    hit = met.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "m", "said", "replacement"))).alias("_h"))
    state = f"struct<at:int,place:int,out:{_HIT}>"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("place"), F.array().cast(_HIT).alias("out")).cast(state)

    def placed(t: Column, k: Column) -> Column:
        def step(s: Column, h: Column) -> Column:
            n, i = -h["m"], h["i"]
            run_ = F.array_join(F.slice(t, i + 1, n), "")
            before = s["place"] + F.length(F.array_join(F.slice(t, s["at"] + 1, i - s["at"]), ""))
            lead = F.length(run_) - F.length(F.regexp_replace(run_, r"\A[\s ]+", ""))
            one = lambda w: F.struct((w["before"] + w["lead"]).alias("position"), F.substring(w["run"], w["lead"] + 1, F.length(w["run"])).alias("source"), h["replacement"].alias("replacement"))
            after = lambda w: F.struct((i + n).alias("at"), (w["before"] + F.length(w["run"])).alias("place"), F.concat(s["out"], F.array(one(w))).alias("out")).cast(state)
            fits = (i >= s["at"]) & (F.array_join(_first_bare(F.slice(k, i + 1, n)), APART) == h["said"]) & _free(t, i, n)
            return F.when(fits, let(F.struct(before.alias("before"), lead.alias("lead"), run_.alias("run")), after)).otherwise(s)

        return F.aggregate("_h", start, step, lambda s: s["out"])

    own = lambda t: let(keys(t), lambda k: placed(t, k))
    return df.join(hit.hint("merge"), key, "left").withColumn("_h", F.when(F.col("_h").isNotNull(), let(tokens(F.col(column)), own)))


def replaced(df: DataFrame, aliases: DataFrame, key: str = "doc_id", column: str = "text", largest: int = LARGEST) -> DataFrame:
    """df with every alias of the column replaced."""
    known = dictionary(aliases)
    if _size(known) > largest:
        both = _with_hits(df, known, key, column)
    else:
        cut = df.select(key, tokens(F.col(column)).alias("t")).withColumn("k", keys(F.col("t")))
        hits = _by_automaton(cut, known, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("position", "source", "replacement"))).alias("_h"))
        both = df.join(hits.hint("merge"), key, "left")
    c = F.translate(F.replace(text(F.col(column)), F.lit("&amp;"), F.lit("&")), "‘’ʼ", "'''")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, h: F.struct((h["position"] + F.length(h["source"])).cast("int").alias("at"), F.concat(s["out"], F.substring(c, s["at"] + 1, h["position"] - s["at"]), h["replacement"]).alias("out"))
    whole = lambda hits: let(F.aggregate(hits, start, step), lambda done: F.concat(done["out"], F.substring(c, done["at"] + 1, F.length(c))))
    return both.withColumn(column, F.when(F.size("_h") > 0, whole(F.col("_h"))).otherwise(F.col(column))).drop("_h").select(*df.columns)
