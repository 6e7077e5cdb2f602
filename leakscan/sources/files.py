"""Tables of files to scan: file_uri, content, language_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.operators.paths import language

#: Of a staged file.
MOST_BYTES = 10 * 1024 * 1024
#: Fewer stored bytes are not worth a task: the work on a row is large beside its size.
SPREAD_BYTES = 1 << 16
_SKIPPED = "/(?:node_modules|dist|build|\\.git|coverage)/"


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores if it has less than a split's bytes for each: one file or row group is one task however it is split.

    What is shuffled is bounded by a split a core; larger inputs stay as they are.
    """
    spark = df.sparkSession
    size, cores = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), spark.sparkContext.defaultParallelism
    parts = min(2 * cores, -(-size // SPREAD_BYTES))
    return df.repartition(parts) if 1 < parts and size < cores * (128 << 20) else df


def from_columns(df: DataFrame, uri: Column, content: Column) -> DataFrame:
    return spread(df).select(uri.alias("file_uri"), content.alias("content"), language(uri).alias("language_id"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return from_columns(spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", "text"), uri, F.col("text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_columns(spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "html"), F.col("url"), F.col("html"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.concat(F.lit("/chat/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    return from_columns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), uri, F.col("text"))


def workspace(spark: SparkSession, path: str) -> DataFrame:
    """All files under a folder but build output, of any size that a row can hold (2 GB); bytes are read as UTF-8.

    A larger file fails the read rather than going unscanned.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = rows.where(~F.col("path").rlike(_SKIPPED))
    return from_columns(rows, F.col("path"), F.col("content").cast("string"))


def staged(spark: SparkSession, files: list[tuple[str, str | None]]) -> DataFrame:
    """Staged files (path, text); unreadable ones (None) and those over MOST_BYTES are left out."""
    rows = spark.createDataFrame([f for f in files if f[1] is not None], "path string, text string")
    return from_columns(rows.where(F.octet_length("text") <= MOST_BYTES), F.col("path"), F.col("text"))
