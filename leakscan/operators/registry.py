"""Registries beside the scan: dictionary group files, loaded one at a time, and assistants known and installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GROUP = "name string, keywords array<string>"


def group_files(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, path) of the group files in a folder; only names are read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path")
    return rows.select(F.regexp_extract("path", r"([^/]*)\.json\z", 1).alias("slug"), "path")


def group_exists(spark: SparkSession, folder: str, slug: str) -> bool:
    return not group_files(spark, folder).where(F.col("slug") == slug).isEmpty()


def load_group(spark: SparkSession, folder: str, slug: str) -> DataFrame:
    """(keyword, group) of one group's file; empty if there is none."""
    # bounded by the paths of one slug in one folder: at most one
    paths = [r["path"] for r in group_files(spark, folder).where(F.col("slug") == slug).collect()]
    if not paths:
        return spark.createDataFrame([], "keyword string, group string")
    rows = spark.read.schema(_GROUP).option("multiLine", True).json(paths)
    return rows.select(F.explode("keywords").alias("keyword"), F.col("name").alias("group"))


def installed_assistants(known: DataFrame, extensions: DataFrame) -> DataFrame:
    """Every row of `known` (id, further columns) with installed and active: whether `extensions` (id, is_active) has its id, and
    whether one of them is active. A null state is not active; repeated ids give one row."""
    own = extensions.groupBy("id").agg(F.coalesce(F.bool_or("is_active"), F.lit(False)).alias("active"), F.lit(True).alias("installed"))
    return known.join(own, "id", "left").select(*known.columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("installed", "active")])


def active_assistants(known: DataFrame, extensions: DataFrame) -> DataFrame:
    return installed_assistants(known, extensions).where("active")
