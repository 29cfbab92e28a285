"""Sources: literal texts, files, folders, tables of the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("txt", "html", "xml")


def from_text(spark: SparkSession, value: str) -> DataFrame:
    """One document without a file."""
    return spark.createDataFrame([(0, None, value)], "doc_id long, path string, text string")


def from_nodes(nodes: DataFrame, key: str = "doc_id", order: str = "node", column: str = "text") -> DataFrame:
    """key and text of text nodes, those of a document joined by tabs in their order, so that no match crosses two of them."""
    per = nodes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, column))).alias("l"))
    return per.select(key, F.array_join(F.transform("l", lambda x: x[column]), "\t").alias("text"))


def from_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path and text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def from_folder(spark: SparkSession, path: str) -> DataFrame:
    """path and text of the txt, html and xml files of a folder, not of those below it; a file that can't be read has a null text."""
    kinds = "*.{" + ",".join(EXTENSIONS) + "}"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", kinds).load(path).select("path")
    found = spark.read.option("recursiveFileLookup", "false").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").option("pathGlobFilter", kinds).text(path, wholetext=True)
    read = found.select(F.url_decode(F.regexp_replace(F.input_file_name(), "[+]", "%2B")).alias("_path"), F.col("value").alias("text"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return listed.join(read, plain(F.col("path")) == plain(F.col("_path")), "left").select("path", "text")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a part of a table on which costly work is done: what a task does there takes about 10 seconds, however large the table is.
ROWS_OF_PART = 50_000


def spread(df: DataFrame, rows: int = ROWS_OF_PART) -> DataFrame:
    """A table dealt out before costly work on its rows: to all cores, and in parts of so many rows where it has more. One that comes in
    as many partitions stays as it is, unless it has more rows than its partitions should hold: those of a large file can be empty, as
    no row group is split."""
    cores, held = df.sparkSession.sparkContext.defaultParallelism, df.count()
    parts = max(cores, -(-held // rows))
    return df.repartition(parts) if held > rows * cores or df.rdd.getNumPartitions() < parts else df
