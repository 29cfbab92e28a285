"""Streams: detection is local to a row, so a stream of documents takes the batch operators as they are."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import mentions
from ..options import Options
from ..plans.rules import RuleSet


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def extract(docs: DataFrame, rules: RuleSet, options: Options | None = None, event_time: str | None = None) -> DataFrame:
    """The mentions of a stream of documents (doc_id, text), with the column of their event time where one is named."""
    if event_time is None:
        return mentions(docs, rules, options=options)
    keyed = docs.select(F.struct("doc_id", event_time).alias("_key"), "text")
    found = mentions(keyed, rules, key="_key", options=options)
    return found.select("_key.*", *[c for c in found.columns if c != "_key"])


def reference_counts(found: DataFrame, event_time: str, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """References by type and window of event time; what comes later than the watermark is dropped."""
    window = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    return found.withWatermark(event_time, late).groupBy(window.alias("w"), "rule_type").agg(F.count(F.lit(1)).alias("n"))


def write(found: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """To Parquet; once: all there is, then the query ends."""
    out = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def drained(found: DataFrame, folder: str) -> DataFrame:
    """All that a stream gives by now, written below a shared folder by a query that ends, and read back."""
    place = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    write(found, f"{place}/out", f"{place}/state").awaitTermination()
    return found.sparkSession.read.schema(found.schema).parquet(f"{place}/out")
