"""Ignore files: ordered rules per folder, the last that fits decides, deeper folders come later."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.functions.dialect import ignore_rule

_RULES = "dir string, depth int, ord int, pattern string, negated boolean, dir_only boolean"


def _parse(folder: str, text: str) -> list[tuple]:
    folder = folder.strip("/")
    depth = folder.count("/") + 1 if folder else 0
    found = ((i, ignore_rule(line)) for i, line in enumerate(text.replace("\r\n", "\n").split("\n")))
    return [(folder, depth, i, r["pattern"], r["negated"], r["dir_only"]) for i, r in found if r is not None]


def rules(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """(dir, depth, ord, pattern, negated, dir_only) of ignore files (dir from the root, '' for the root itself; text)."""
    return spark.createDataFrame([r for folder, text in files for r in _parse(folder, text)], _RULES)


def rules_of(files: DataFrame) -> DataFrame:
    """The same from a table of ignore files (dir, text) of any number; a null text has no rules, a null dir is the root."""

    def parse(batches):
        for b in batches:
            rows = [r for folder, text in zip(b["dir"], b["text"], strict=True) if text is not None for r in _parse(folder or "", text)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _RULES.split(", ")])

    return files.select("dir", "text").mapInPandas(parse, _RULES)


def evaluate(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """`paths` (path, from the root) with verdict: true, false, or null where no rule fits.

    Rules meet a path by folder: every folder above the path is an equi-join key, so rules are never
    paired with paths outside their folder.
    """
    own = paths.select("path").distinct().withColumn("clean", F.replace("path", F.lit("\\"), F.lit("/")))
    parts = F.split("clean", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    rows = own.select("path", "clean", F.explode(above).alias("dir")).join(rules, "dir")
    rel = F.when(F.col("dir") == "", F.col("clean")).otherwise(F.substring("clean", F.length("dir") + 2, F.length("clean")))
    bits = F.split("rel", "/")
    targets = F.when(F.col("dir_only"), F.transform(F.sequence(F.lit(1), F.size(bits)), lambda k: F.array_join(F.slice(bits, 1, k), "/"))).otherwise(F.array("rel"))
    rows = rows.withColumn("rel", rel).where(F.exists(targets, lambda t: F.call_function("rlike", t, F.col("pattern"))))
    last = rows.groupBy("path").agg(F.max_by(~F.col("negated"), F.struct("depth", "ord")).alias("verdict"))
    return paths.join(last, "path", "left")


def ignored(files: DataFrame, root: str, rules: DataFrame) -> DataFrame:
    """`files` with the column ignored: whether the rules of the folders from root down to file_uri's leave it out; false where none fits
    and outside root."""
    uri = F.regexp_replace("file_uri", r"^file:/+", "/")
    base = F.lit(root.rstrip("/") + "/")
    path = F.when(F.startswith(uri, base), F.substring(uri, F.length(base) + 1, F.length(uri)))
    seen = evaluate(files.select(path.alias("path")).where(F.col("path").isNotNull()).distinct(), rules).where("verdict").select("path")
    packed = files.select(F.struct("*").alias("row"), path.alias("path"))
    return packed.join(seen.withColumn("hit", F.lit(True)), "path", "left").select("row.*", F.coalesce("hit", F.lit(False)).alias("ignored"))
