"""Suppressions and history: what was judged before, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

COLUMNS = "suppression_key string, file_uri string, line_no int, line string, severity string, suppressed_at timestamp, rule_id string, reason string, expires_at timestamp, kind string"


def in_force(suppressions: DataFrame, now: Column | None = None) -> DataFrame:
    """Records that have not expired."""
    return suppressions.where(F.col("expires_at").isNull() | (F.col("expires_at") >= (F.current_timestamp() if now is None else now)))


def apply(findings: DataFrame, suppressions: DataFrame, now: Column | None = None) -> DataFrame:
    """Findings whose key no record in force has."""
    return findings.join(in_force(suppressions, now).select("suppression_key").distinct(), "suppression_key", "left_anti")


def suppressed(findings: DataFrame, suppressions: DataFrame, now: Column | None = None) -> DataFrame:
    """Findings that are suppressed, with the record's kind and reason; permanent records come before a session's."""
    order = F.struct(F.when(F.col("kind") == "permanent", 0).otherwise(1), -F.unix_micros("suppressed_at"))
    one = in_force(suppressions, now).groupBy("suppression_key").agg(F.min_by(F.struct("kind", "reason"), order).alias("s"))
    return findings.join(one, "suppression_key").withColumns({"kind": F.col("s.kind"), "reason": F.col("s.reason")}).drop("s")


def add(suppressions: DataFrame, records: DataFrame) -> DataFrame:
    """Both tables' records, the latest of each key and kind."""
    all_ = suppressions.unionByName(records)
    last = Window.partitionBy("suppression_key", "kind").orderBy(F.desc("suppressed_at"), F.xxhash64(*all_.columns))
    return all_.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def remove(suppressions: DataFrame, keys: DataFrame) -> DataFrame:
    return suppressions.join(keys.select("suppression_key"), "suppression_key", "left_anti")


def clear_session(suppressions: DataFrame) -> DataFrame:
    return suppressions.where("kind <> 'session'")


def counts(suppressions: DataFrame) -> DataFrame:
    return suppressions.agg(F.count_if(F.col("kind") == "permanent").alias("permanent"), F.count_if(F.col("kind") == "session").alias("session"))


def new_findings(findings: DataFrame, previous: DataFrame) -> DataFrame:
    """Findings of files whose last scan did not have their key; files without a uri are one file."""
    own = previous.select("file_uri", "suppression_key").distinct().toDF("uri", "key")
    return findings.join(own, findings["file_uri"].eqNullSafe(own["uri"]) & (findings["suppression_key"] == own["key"]), "left_anti")


def replace_files(results: DataFrame, scanned: DataFrame, fresh: DataFrame) -> DataFrame:
    """The results table after `scanned` files were scanned anew: their rows give way to `fresh`, whatever it covers.
    Files without a uri are one file."""
    return of_files(results, scanned, "left_anti").unionByName(fresh)


def of_files(rows: DataFrame, files: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of the files, or with left_anti of others; no uri equals no uri."""
    own = files.select(F.col("file_uri").alias("uri")).distinct()
    return rows.join(own, rows["file_uri"].eqNullSafe(own["uri"]), how)
