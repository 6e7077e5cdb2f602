"""Named tables that outlive a run: each save writes a new version, so a reader never sees half of one."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; on one machine (tests) a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that all machines share")
        base = tempfile.mkdtemp(prefix="leakscan-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/") + "/leakscan"


def written(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder as Parquet, where several branches of a plan read what they need of it."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if owners := getattr(_local, "owners", None):
        owners[-1].append(path)
    return out


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def drop_paths(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_local = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that `written` makes inside, in this thread, are removed at the end: for work whose results are stored, such as a stream's
    batch."""
    _local.owners = [*getattr(_local, "owners", []), []]
    try:
        yield
    finally:
        drop_paths(spark, *_local.owners.pop())


class Conflict(RuntimeError):
    """Another writer was first."""


class StateStore:
    """Versioned Parquet tables under a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self, key: str) -> list[int]:
        """Complete versions, oldest first."""
        fs, p = self._fs(f"{self.folder}/{key}")
        if not fs.exists(p):
            return []
        names = [s.getPath() for s in fs.listStatus(p)]
        done = [n for n in names if n.getName().startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS"))]
        return sorted(int(n.getName()[1:]) for n in done)

    def has(self, key: str) -> bool:
        return bool(self.versions(key))

    def save(self, key: str, df: DataFrame, version: int | None = None) -> None:
        """Writes `df` as the next version, or as `version` (again, if a run repeats it)."""
        n = version if version is not None else (self.versions(key) or [-1])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/{key}/v{n}")

    def commit(self, key: str, df: DataFrame, after: int | None) -> int:
        """Writes `df` as the version that follows `after` (None: the first) and returns its number.

        The table is written aside and takes its place by one rename, which fails if another writer has taken it: of two writers that
        read the same version one gets Conflict, and has to read again. For keys that are always written so.
        """
        n = 0 if after is None else after + 1
        if (self.versions(key) or [None])[-1] != after:
            raise Conflict(f"{key}: {after} is not the latest version")
        aside = f"{self.folder}/{key}/_{uuid.uuid4().hex}"
        df.write.parquet(aside)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        source, target = jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{key}/v{n}")
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        fs = source.getFileSystem(conf)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(source).toUri(), conf).rename(source, target, options)
        except Exception as e:
            fs.delete(source, True)
            if fs.exists(target):
                raise Conflict(f"{key}: version {n} was written by another") from e
            raise
        return n

    def load(self, key: str, schema: str | T.StructType, before: int | None = None) -> DataFrame:
        """The latest version (below `before`), or an empty table."""
        own = [v for v in self.versions(key) if before is None or v < before]
        if not own:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.folder}/{key}/v{own[-1]}")

    def read(self, key: str, versions: list[int], schema: str | T.StructType) -> DataFrame:
        """Several versions together, those that exist, or an empty table."""
        own = [v for v in self.versions(key) if v in set(versions)]
        if not own:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{key}/v{v}" for v in own])

    def prune(self, key: str, below: int) -> None:
        """Removes the versions below `below`."""
        for v in self.versions(key):
            if v < below:
                fs, p = self._fs(f"{self.folder}/{key}/v{v}")
                fs.delete(p, True)

    def delete(self, key: str) -> None:
        fs, p = self._fs(f"{self.folder}/{key}")
        fs.delete(p, True)

    def clear(self) -> None:
        fs, p = self._fs(self.folder)
        fs.delete(p, True)
