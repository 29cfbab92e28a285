"""Token files: flat unsigned integers and 64-bit document offsets.

Documents are range-partitioned and sorted by key; each task writes one shard: ``.bin`` holds its ids one after the other
(16 bits where all ids of the vocabulary fit, else 32; an id beyond the chosen width is an error), ``.idx`` the 64-bit offsets
of its documents and the end, ``.doc`` the keys. There are as many shards as hold ``SHARD_BYTES`` of text each, the session's
shuffle partitions at least. Shards in order are the whole sequence; the bases of shards are prefix sums of their totals (one
row per shard), kept in ``manifest.json``. Readers map the files into memory; in other stores they read them by ranges.

Files are written under a name of the attempt and renamed when whole, so a task that runs again leaves the same shard.

Defined results: a null or empty text holds the end id only; null keys come first; rows with equal keys are ordered by a hash
of the text, then the text, so that a key with very many rows is dealt over many shards; an empty table gives a manifest without shards; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_path, gathered, session, text_or_empty
from .encoding import encoder, parts
from .packing import tokenizer_path

END_ID = 1
SHARD_BYTES = 256 * 1024 * 1024
#: Documents and bytes of ids that a reader holds at once (a longer document is held alone).
READ_DOCS, READ_BYTES = 2000, 8 * 1024 * 1024
NO_KEY = np.iinfo(np.int64).min  # stands for a null key in .doc


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri.removeprefix('file:'))}" if not uri.startswith("file:/") or uri.startswith("file:///") else "file://" + uri.removeprefix("file:"))


def narrowest(path: str, end_id: int = END_ID) -> str:
    """The unsigned type that holds all ids of a tokenizer."""
    highest = max([end_id, *encoder(path).tokenizer.get_vocab().values()])
    return "<u2" if highest < 1 << 16 else "<u4"


def write_tokens(df: DataFrame, folder: str, path: str, dtype: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = END_ID, shards: int | None = None) -> list[dict]:
    """Writes the shards and the manifest; returns the shards' rows of the manifest."""
    spark = session(df.sparkSession)
    dtype = dtype or narrowest(path, end_id)
    most = np.iinfo(dtype).max
    rows = df.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t"))
    if not shards:
        held = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // SHARD_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(folder)
        fs.create_dir(root, recursive=True)
        name, mark, outs, at, docs = f"shard-{TaskContext.get().partitionId():06d}", uuid.uuid4().hex, None, 0, 0
        for b in gathered(batches):
            if not b.num_rows:
                continue
            if outs is None:
                outs = {x: fs.open_output_stream(f"{root}/.{name}.{mark}{x}") for x in (".bin", ".idx", ".doc")}
            ids, bounds = encoder(path).encode(b.column(1).to_pylist(), end=end_id)
            if int(ids.max()) > most:
                raise OverflowError(f"id {int(ids.max())} does not fit into {dtype}")
            outs[".bin"].write(ids.astype(dtype).tobytes())
            outs[".idx"].write((at + bounds[:-1]).astype("<u8").tobytes())
            outs[".doc"].write(np.array([NO_KEY if k is None else k for k in b.column(0).to_pylist()], "<i8").tobytes())
            at, docs = at + int(bounds[-1]), docs + b.num_rows
        if outs is None:
            return
        outs[".idx"].write(np.array([at], "<u8").tobytes())
        for x, f in outs.items():
            f.close()
            if fs.get_file_info(f"{root}/{name}{x}").type != pafs.FileType.NotFound:  # of an attempt that was lost afterwards
                fs.delete_file(f"{root}/{name}{x}")
            fs.move(f"{root}/.{name}.{mark}{x}", f"{root}/{name}{x}")
        yield pa.RecordBatch.from_pydict({"shard": [name], "n_docs": [docs], "n_tokens": [at]})

    sorted_rows = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(shards, "k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")
    found = sorted(sorted_rows.mapInArrow(write, "shard string, n_docs long, n_tokens long").collect(), key=lambda r: r.shard)  # one row per shard
    out, doc, token = [], 0, 0
    for r in found:
        out.append({"shard": r.shard, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "first_doc": doc, "first_token": token})
        doc, token = doc + r.n_docs, token + r.n_tokens
    fs, root = _place(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"dtype": dtype, "end_id": end_id, "n_docs": doc, "n_tokens": token, "shards": out}).encode())
    return out


def read_tokens(spark: SparkSession, folder: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """key, start, n_tokens, ids_crc32 (and ids) of each document, from the files; one task per shard at most."""
    fs, root = _place(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        made = json.loads(f.read())
    dtype = made["dtype"]
    schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def opened(fs: pafs.FileSystem, path: str, kind: str) -> Callable[[int, int], np.ndarray]:
        """Gives numbers from one place to another: views of the mapped file where the store is a file system, else reads."""
        width = np.dtype(kind).itemsize
        if not fs.get_file_info(path).size:
            return lambda lo, hi: np.empty(0, kind)
        if isinstance(fs, pafs.LocalFileSystem):
            with pa.memory_map(path) as f:
                whole = np.frombuffer(f.read_buffer(), kind)
            return lambda lo, hi: whole[lo:hi]
        f = fs.open_input_file(path)
        return lambda lo, hi: np.frombuffer(f.read_at((hi - lo) * width, lo * width), kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(folder)
        for b in batches:
            for name, base, docs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, offsets, keys = (opened(fs, f"{root}/{name}{x}", kind) for x, kind in ((".bin", dtype), (".idx", "<u8"), (".doc", "<i8")))
                for first in range(0, docs, READ_DOCS):
                    last = min(first + READ_DOCS, docs)
                    at, own = offsets(first, last + 1).astype(np.int64), keys(first, last)
                    for lo, hi in parts((np.diff(at) * np.dtype(dtype).itemsize).tolist(), READ_BYTES):
                        flat = ids(int(at[lo]), int(at[hi])).astype("<u4")
                        each = [flat[a:z] for a, z in zip((at[lo:hi] - at[lo]).tolist(), (at[lo + 1 : hi + 1] - at[lo]).tolist(), strict=True)]
                        columns = [pa.array([None if k == NO_KEY else k for k in own[lo:hi].tolist()], pa.int64()), pa.array(base + at[lo:hi]), pa.array(np.diff(at[lo : hi + 1])), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
                        if with_ids:
                            columns.append(pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = [(s["shard"], s["first_token"], s["n_docs"]) for s in made["shards"]]
    shards = spark.createDataFrame(rows, "shard string, base long, docs long").repartition(max(1, len(rows)))
    return shards.mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids).withColumnRenamed("key", key)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir, "doc_id", "text"), folder, tokenizer_path("word_bpe_49k.json"))
    return read_tokens(spark, folder)
