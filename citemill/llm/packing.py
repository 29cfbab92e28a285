"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. Only the lengths matter for the plan, so the plan is made on the
histogram of lengths: at most ``capacity`` numbers, whatever the corpus. Per bin, the longest remaining piece is set and a
bitset subset-sum dynamic program over the lengths that are left finds the fullest feasible combination; the combination is
removed as often as the counts allow, which stands for that many bins. Ranks within a length then lead each piece to its bin.

Defined results: a null or empty text is one piece that holds the end id; which pieces of equal length share a sequence depends
on their places in the stored table; repeated rows are packed like any; an empty table gives no pieces; other columns are
ignored, whatever their names. The ranking is dealt by length and place, so a length, an id or a null id that holds a third of
all pieces is ranked in many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, gathered, session, settled, text_or_empty
from .encoding import encoder

CAPACITY = 1024
END_ID = 2
SALTS = 64


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class Run:
    """Ranks first to last - 1 of a length: each bin from sequence on takes ``per`` of them, from ``offset`` on."""

    length: int
    first: int
    last: int
    sequence: int
    per: int
    offset: int


def fullest(room: int, counts: dict[int, int]) -> list[tuple[int, int]]:
    """The (length, number) pairs whose sum is the largest that fits into room; long lengths are tried first.

    Bit s of a reach is set where some selection sums to s. Counts are split into powers of two; going back through the
    reaches finds the selection.
    """
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for n in sorted((n for n in counts if n <= room), reverse=True):
        left, part = min(counts[n], room // n), 1
        while left:
            part = min(part, left)
            steps.append((reach, n, part))
            reach |= reach << n * part & mask
            left, part = left - part, part * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, n, part in reversed(steps):
        if not before >> total & 1:
            chosen[n] = chosen.get(n, 0) + part
            total -= n * part
    return sorted(chosen.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    counts, used, runs, sequence = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        held = {longest: 1}
        for n, k in fullest(capacity - longest, {n: c for n, c in counts.items() if c}):
            held[n] = held.get(n, 0) + k
        counts[longest] += 1
        times, offset = min(counts[n] // k for n, k in held.items()), 0
        for n, k in sorted(held.items(), reverse=True):
            runs.append(Run(n, used[n], used[n] + times * k, sequence, k, offset))
            used[n] += times * k
            counts[n] -= times * k
            if not counts[n]:
                del counts[n]
            offset += n * k
        sequence += times
    return runs


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and ids): a longer document's first piece takes what its full ones leave."""
    session(df.sparkSession)
    schema = pa.schema([("key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            keys = b.column(0).to_pylist()
            ids, bounds = encoder(path).encode(b.column(1).to_pylist(), end=end_id)
            ids = ids.astype("<u4")
            out: list[list] = [[] for _ in schema]
            for k, lo, hi in zip(keys, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                first = (hi - lo) % capacity or min(capacity, hi - lo)
                for i, a in enumerate([lo, *range(lo + first, hi, capacity)]):
                    z = lo + first if i == 0 else a + capacity
                    row = [k, i, a - lo, z - a, zlib.crc32(ids[a:z].tobytes())] + [ids[a:z].astype(np.int32)] * with_ids
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    ddl = "key long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return df.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("t")).mapInArrow(run, ddl).withColumnRenamed("key", key)


def packed(parts: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces. The pieces are read three times, and their places must stay: hand over a stored table."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")  # no key, so none can be hot
    salted = parts.withColumn("_salt", salt)
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")  # capacity x SALTS rows at most
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = sorted(plan(histogram, capacity), key=lambda r: (r.length, r.first))
    table = np.array([[r.length, r.first, r.sequence, r.per, r.offset] for r in runs], np.int64).reshape(-1, 5)
    own = Window.partitionBy("length", "_salt").orderBy(key, "piece", "start", "ids_crc32")
    ranked = salted.withColumn("_r", F.row_number().over(own)).join(F.broadcast(bases), ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_r") - 1)
    columns = parts.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = table[:, 0] << 44 | table[:, 1]
        for b in batches:
            length, rank = (np.asarray(b.column(name)) for name in ("length", "_rank"))
            if not len(length):
                continue
            _, first, sequence, per, offset = table[np.searchsorted(order, length << 44 | rank, side="right") - 1].T
            held = [b.column(c) for c in columns] + [pa.array(sequence + (rank - first) // per), pa.array(offset + (rank - first) % per * length)]
            yield pa.RecordBatch.from_arrays(held, names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in parts.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*columns, "_rank").mapInArrow(place, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, input_ids from packed pieces that carry ids: at most capacity tokens a row."""
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.flatten(F.transform(held, lambda x: x["ids"])).alias("input_ids"))


def op8_minimum_bin_slack(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    source = documents(spark, sf_dir, "doc_id", "text") if docs is None else docs
    return packed(settled(pieces(source, tokenizer_path("byte_bpe_50k.json"))))
