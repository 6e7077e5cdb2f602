"""A training corpus in five stages; each is written as Parquet and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.llm import common as C
from leakscan.llm import decontam, pieces, quality, simhash, substring
from leakscan.llm.queries import PIECES, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every group of near copies."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that also start earlier; a text that loses nothing stays byte for byte."""
    return substring.clean(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no considerable part of a benchmark item."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids, their number, the scores of the best segmentations with what they change in the ids, and the text decoded from the ids."""
    out = pieces.decode(pieces.encode(docs.select("doc_id", "text"), PIECES), PIECES)
    return out.select("doc_id", "ids", "n_pieces", "scores", "changes", F.col("decoded").alias("text"))


STAGES = [("quality", keep_quality), ("near duplicates", keep_distinct), ("repeats", cut_repeats), ("contamination", keep_uncontaminated), ("pieces", to_pieces)]

#: SQL can't express the model of the first stage; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{C.scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
