"""Substring deduplication by super-k-mer partitioning.

Windows are ``window`` consecutive words of one document. A window's minimiser is the least hash among its runs of
``MINIMISER`` words; consecutive windows with the same minimiser form a super-k-mer. Equal windows have equal minimisers,
wherever they stand, so the bucket of a minimiser sees every occurrence of its windows.

1. Each super-k-mer sends its minimiser and a hash of its words; the least and the greatest document of either are kept.
2. Where a minimiser occurs in more than one document, each distinct super-k-mer travels once, as one packed string of its
   words, from its least document to the minimiser's bucket.
3. A bucket ranks its windows by sorting: ranks of one word, two, four and so on give exact ranks of whole windows. The
   least document of every rank is the answer for that window.
4. Runs of windows with one answer go back by super-k-mer to all documents that hold it, and cover words there.

Words that are covered by a window which also starts in a document with a smaller id are removed.

A minimiser with more than ``HOT`` distinct super-k-mers is split by a second minimiser over ``SECOND`` words, which differs
with what stands around the shared words; its windows travel in shorter strings to buckets of both minimisers. No window is
dropped in any case.

Defined results: a null text has no words; a document without an id neither loses words nor causes a loss; rows with equal
ids are each judged by their own text and never against each other; equal texts keep the one with the smallest id; documents
with fewer words than a window stay whole; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, session, text_or_empty

WINDOW = 50
MINIMISER = 8
SECOND = 40
HOT = 20_000
#: Bytes of text whose words are hashed at once, and bytes of packed strings that are sorted at once.
PART = 2_000_000
SORTED = 4_000_000
NO_ID = -(1 << 63)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


_BASE, _STEP = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
#: Bytes of the longest word that is hashed in blocks; the first bytes of a block that holds so many.
LONG_WORD = 256
_LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the texts' bounds among the words. White space is 0x20 and 0x09 to 0x0D. Words are taken in
    blocks of eight bytes, each mixed into the state of those before; very long words are left to BLAKE2b."""
    joined = b"\n".join([*texts, bytes(8)])
    data = np.frombuffer(joined, np.uint8)[:-8]
    blank = (data == 32) | (data - np.uint8(9) < 5)
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(data) and not blank[0]:
        edges = np.concatenate([[0], edges])
    start, end = edges[::2], edges[1::2]
    size = end - start
    eight = np.ndarray(max(0, len(joined) - 7), "<u8", joined, strides=(1,))
    hashes, open_ = _mixed(size.astype(np.uint64) * _STEP), np.flatnonzero(size <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        open_ = open_[size[open_] > at]
        if not len(open_):
            break
        block = eight[start[open_] + at] & _LEFT[np.minimum(size[open_] - at, 8)]
        hashes[open_] = _mixed((hashes[open_] ^ block) * _BASE + _STEP)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        hashes[i] = int.from_bytes(blake2b(joined[start[i] : end[i]], digest_size=8).digest(), "little")
    return hashes, np.concatenate([[0], np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))]).astype(np.int64)


def run_hashes(x: np.ndarray, n: int) -> np.ndarray:
    """For each place, a hash of the n hashes from there; shorter by n - 1."""
    done, out, rest = 1, x, n
    parts: list[tuple[np.ndarray, int]] = []
    while rest:
        if rest & 1:
            parts.append((out, done))
        rest >>= 1
        if rest:
            out = _mixed(out[:-done] * _STEP + out[done:]) if len(out) > done else out[:0]
            done *= 2
    size, at, total = max(0, len(x) - n + 1), 0, np.zeros(max(0, len(x) - n + 1), np.uint64)
    for part, length in parts:
        total = _mixed(total * _BASE + part[at : at + size])
        at += length
    return total


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    done, out = 1, x
    while done * 2 <= n:
        out = np.minimum(out[:-done], out[done:]) if len(out) > done else out[:0]
        done *= 2
    size = max(0, len(x) - n + 1)
    return np.minimum(out[:size], out[n - done : n - done + size])


def super_kmers(hashes: np.ndarray, bounds: np.ndarray, window: int = WINDOW, size: int = MINIMISER) -> tuple[np.ndarray, ...]:
    """text, first window, number of windows, minimiser, hash of the words of each super-k-mer."""
    least = sliding_min(run_hashes(hashes, size), window - size + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    inside = np.arange(len(least)) + window <= bounds[text + 1]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    if not len(start):
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    of = np.cumsum(new)[inside] - 1
    count = np.bincount(of)
    return text[start], start - bounds[text[start]], count, least[start], range_hashes(hashes, start, count + window - 1)


def range_hashes(hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each range of hashes: of its size and of its first and last 2**k hashes, which together cover it."""
    out, level = np.zeros(len(start), np.uint64), np.frexp(size)[1] - 1
    done, k = hashes, 0
    while True:
        own = np.flatnonzero(level == k)
        a, z = done[start[own]], done[start[own] + size[own] - (1 << k)]
        out[own] = _mixed((_mixed(a * _BASE + z) ^ size[own].astype(np.uint64)) * _STEP)
        if k >= level.max(initial=0):
            return out
        done, k = _mixed(done[: -(1 << k)] * _STEP + _mixed(done[1 << k :] + _BASE)), k + 1


def _parts(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive groups of about limit, one at least in each."""
    a, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(sizes):
        yield a, len(sizes)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def occurrences(keyed: DataFrame, window: int) -> DataFrame:
    """k, row, minimiser, name, start, windows for each super-k-mer of keyed (k, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows, texts = (c.to_pylist() if i == 2 else np.asarray(c) for i, c in enumerate(b.columns))
            texts = [t.encode() for t in texts]
            for a, z in _parts([len(t) for t in texts], PART):
                text, start, count, least, name = super_kmers(*word_hashes(texts[a:z]), window)
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:z][text]), pa.array(rows[a:z][text]), _signed(least), _signed(name), pa.array(start), pa.array(count.astype(np.int64))], names=["k", "row", "minimiser", "name", "start", "windows"])

    return keyed.where(F.col("k") != NO_ID).mapInArrow(run, "k long, row long, minimiser long, name long, start long, windows long")


def _sent(keyed: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """bucket, minimiser, name, at, k, words: the packed strings that wanted (k, row, names) asks of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((c, pa.int64()) for c in ("bucket", "minimiser", "name", "at", "k")), ("words", pa.binary())])
        for b in batches:
            keys, texts, wants = np.asarray(b.column(0)), [t.encode() for t in b.column(1).to_pylist()], b.column(2).to_pylist()
            for a, z in _parts([len(t) for t in texts], PART):
                hashes, bounds = word_hashes(texts[a:z])
                text, start, count, least, name = super_kmers(hashes, bounds, window)
                signed, marks, rows = name.view(np.int64).tolist(), least.view(np.int64).tolist(), []
                edges = np.searchsorted(text, np.arange(z - a + 1))
                for i in range(z - a):
                    asked = {(x["minimiser"], x["name"]): x["hot"] for x in wants[a + i]}
                    words = texts[a + i].split() if asked else []
                    for j in range(edges[i], edges[i + 1]):
                        hot = asked.pop((marks[j], signed[j]), None)
                        if hot is None:
                            continue
                        s, n = int(start[j]), int(count[j])
                        cuts = [(0, n, int(least[j]))]
                        if hot:
                            lo = int(bounds[i]) + s
                            second = sliding_min(run_hashes(_mixed(hashes[lo : lo + n + window - 1] ^ _STEP), SECOND), window - SECOND + 1)
                            turn = [0, *(np.flatnonzero(np.diff(second)) + 1).tolist(), n]
                            cuts = [(p, q, int(_mixed(second[p : p + 1] ^ least[j : j + 1])[0])) for p, q in zip(turn[:-1], turn[1:], strict=True)]
                        rows += [(bucket, marks[j], signed[j], p, int(keys[a + i]), b" ".join(words[s + p : s + q + window - 1])) for p, q, bucket in cuts]
                if rows:
                    c = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([_signed(np.array(c[0], np.uint64)), *(pa.array(c[i], schema.field(i).type) for i in range(1, len(schema)))], schema=schema)

    joined = keyed.join(wanted, ["k", "row"]).select("k", "text", "names")
    return joined.mapInArrow(run, "bucket long, minimiser long, name long, at long, k long, words binary")


def first_holders(strings: list[bytes], keys: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """For each packed string, runs (first window, end, least key among the strings with that window). Windows are compared
    by exact ranks: sorting pairs of ranks of n words gives the ranks of 2n."""
    split = [s.split(b" ") for s in strings]
    sizes = np.array([len(s) for s in split])
    rank = pd.factorize(np.array([w for s in split for w in s], object))[0].astype(np.int64)

    def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.unique(x * (int(y.max()) + 1) + y, return_inverse=True)[1] if len(x) else x

    done = 1
    while done * 2 <= window:
        rank = paired(rank[: max(0, len(rank) - done)], rank[done:])
        done *= 2
    if done < window:
        gap = window - done
        rank = paired(rank[: max(0, len(rank) - gap)], rank[gap:])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = sizes - window + 1
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    own = rank[at]
    least = np.full(int(own.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, own, np.repeat(keys, n))
    answer, edge = least[own], np.concatenate([[0], np.cumsum(n)])
    out = []
    for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        x = answer[a:z]
        turn = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), z - a]
        out.append([(p, q, int(x[p])) for p, q in zip(turn[:-1], turn[1:], strict=True)])
    return out


def _answers(sent: DataFrame, window: int) -> DataFrame:
    """minimiser, name, first, last, holder: runs of a super-k-mer's windows and their least document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            found = first_holders([r[5] for r in rows], np.array([r[4] for r in rows], np.int64), window)
            flat = [(*r[1:3], r[3] + a, r[3] + z, k) for r, runs in zip(rows, found, strict=True) for a, z, k in runs]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat, strict=True)], names=["minimiser", "name", "first", "last", "holder"])

        rows, held, last = [], 0, None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last and r[0] != last[0] and held > SORTED:
                    yield done(rows)
                    rows, held = [], 0
                if r[:4] != last:  # repeated rows send the same string
                    last = r[:4]
                    rows.append(r)
                    held += len(r[5])
        if rows:
            yield done(rows)

    dealt = sent.repartition("bucket").sortWithinPartitions("bucket", "minimiser", "name", "at")
    return dealt.mapInArrow(run, "minimiser long, name long, first long, last long, holder long")


def covered_spans(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """k, row, spans (first, last word) of the words that repeat an earlier document."""
    seen = occurrences(keyed, window)
    own = ["minimiser", "name"]  # a name is a hash of words and length: two super-k-mers are one only if their minimisers agree as well
    names = seen.groupBy(*own).agg(F.min("k").alias("least"), F.min_by("row", "k").alias("row"), F.max("k").alias("top")).withColumnRenamed("least", "k")
    shared = names.groupBy("minimiser").agg(F.min("k").alias("lo"), F.max("top").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    # by text, not by id alone: rows that share an id may be very many
    asked = names.join(shared, "minimiser").groupBy("k", "row").agg(F.collect_list(F.struct(*own, (F.col("n") > HOT).alias("hot"))).alias("names"))
    answers = _answers(_sent(keyed, asked, window), window)
    back = seen.join(answers, own).where(F.col("holder") < F.col("k"))
    span = F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last") + window - 1).alias("last"))
    return back.groupBy("k", "row").agg(F.collect_set(span).alias("spans"))


def without(text: bytes, gone: list[bool]) -> bytes:
    """The text without these words and the white space behind them; all other bytes as they are."""
    out, words = [], [m.span() for m in WORD.finditer(text)]
    starts = [a for a, _ in words] + [len(text)]
    out.append(text[: starts[0]])
    out += [text[starts[i] : starts[i + 1]] for i, g in enumerate(gone[: len(words)]) if not g]
    return b"".join(out)


def dedup_substrings(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, keep: list[str] | None = None, layout: bool = False) -> DataFrame:
    """The key, the columns of keep, n_words, n_removed and kept: the words left, joined by one space, or with layout the text
    without the words removed, its white space as it was."""
    session(df.sparkSession)
    keep = keep or []
    base = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("k"), text_or_empty(text).alias("text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    held = [f"_{i}" for i in range(len(keep))]
    rows = base.select("k", F.xxhash64("text").alias("row"), "text", *held)
    keyed = rows.select("k", "row", "text")  # dealt in one way, so that Spark can use one shuffle for both joins
    joined = rows.join(covered_spans(keyed, window), ["k", "row"], "left").select("text", "spans", "k", *held)
    fields = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for t, spans in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                words = t.encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():
                    gone[s["first"]] += 1
                    gone[s["last"]] -= 1
                lost = (np.cumsum(gone[:-1]) > 0).tolist()
                if layout:
                    left = without(t.encode(), lost).decode() if any(lost) else t
                else:
                    left = b" ".join(w for w, g in zip(words, lost, strict=True) if not g).decode()
                for column, value in zip(out, (len(words), sum(lost), left), strict=True):
                    column.append(value)
            made = [pa.array(c, kind) for c, (_, kind) in zip(out, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *made], names=["k", *held, *(n for n, _ in fields)])

    ddl = ", ".join(f"`{c}` {t}" for c, t in joined.dtypes[2:]) + ", n_words long, n_removed long, kept string"
    done = joined.mapInArrow(run, ddl)
    return done.select(F.when(F.col("k") != NO_ID, F.col("k")).alias(key), *[F.col(h).alias(c) for h, c in zip(held, keep, strict=True)], "n_words", "n_removed", "kept")


def op4_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_substrings(documents(spark, sf_dir, "doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 1))) AS i FROM split)
), firsts AS (
  SELECT h, min(doc_id) AS d FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM windows JOIN firsts USING (h) WHERE d < doc_id
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM split) ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""
