"""Shared helpers of the corpus operators: session settings, storage shared by the cluster, input columns."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bounds of one Arrow batch that crosses between the JVM and Python (both keep buffers of that size, outside the heap),
#: and of the batches that Python puts together where that pays; all hold at every input size.
ARROW_ROWS = 500
ARROW_BYTES = 2 * 1024 * 1024
GATHERED_ROWS = 2000
GATHERED_BYTES = 8 * 1024 * 1024


def session(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by rows and bytes, so that a run of long texts can't fill a worker. Plans read these settings when they
    run, so they stay for the session; a tighter bound that the caller has set stays as it is."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = re.fullmatch("([0-9]+)b?", spark.conf.get(f"spark.sql.execution.arrow.{name}"))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return spark


def gathered(batches: Iterator[pa.RecordBatch], rows: int = GATHERED_ROWS, size: int = GATHERED_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive batches joined, until they have so many rows or bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ARROW_ROWS and ARROW_BYTES at most."""
    step = max(1, min(ARROW_ROWS, batch.num_rows * ARROW_BYTES // max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, the one that the context has, or
    with a local master a new one. On a cluster there must be one: a machine's own folder is not seen by the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="citemill-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, narrowed to the given columns."""
    df = session(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffles and checkpoints of plans that are gone: it learns of them only when the driver
    collects its garbage, and loops would pile them up till then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later steps start from files."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
