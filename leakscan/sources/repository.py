"""Sources over a repository's folder, which driver and executors share: staged files out of git, and ignore files.

Both are Python data sources: the driver lists what there is (names and ids only), tasks read it.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leakscan.sources.files import MOST_BYTES, from_columns

#: Files of a task, and bytes that a batch gathers before it goes out.
FILES_A_TASK, BYTES_A_BATCH = 256, 16 << 20
#: Folders listed by the driver before tasks walk what lies below them, and tasks for those.
FOLDERS_FIRST, WALKS = 64, 256
IGNORE_FILE = ".gitignore"


def _git(root: str, *words: str) -> list[str]:
    return ["git", "-C", root, "-c", "core.fsmonitor=false", *words]


def staged_entries(root: str) -> list[tuple[str, str]]:
    """(path, blob id) of added, copied and modified files between HEAD and the index; renames count as neither."""
    out = subprocess.run(_git(root, "diff", "--cached", "--raw", "--no-abbrev", "-z", "--diff-filter=ACM", "--no-ext-diff"), check=True, capture_output=True).stdout
    fields, entries = iter(out.decode("utf-8", "surrogateescape").split("\0")), []
    for head in fields:
        if head:
            _, _, _, blob, status = head.split(" ")
            path = next(fields)
            entries.append((next(fields) if status.startswith("C") else path, blob))
    return entries


class StagedFiles(DataSource):
    """Format "staged_files", option path: (path, content) of a repository's staged files as they are in the index.

    Submodules, missing objects and files over MOST_BYTES are left out. Needs git 2.36 or later where tasks run.
    """

    @classmethod
    def name(cls) -> str:
        return "staged_files"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _StagedReader(self.options["path"])


class _StagedReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        entries = staged_entries(self.root)
        return [InputPartition(entries[i : i + FILES_A_TASK]) for i in range(0, len(entries), FILES_A_TASK)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        batch, size = [], 0
        for path, content in _blobs(self.root, partition.value):
            batch.append((path, content))
            size += len(content)
            if size >= BYTES_A_BATCH:
                yield _batch(batch)
                batch, size = [], 0
        yield _batch(batch)


def _batch(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["path", "content"])


def _blobs(root: str, entries: list[tuple[str, str]]) -> Iterator[tuple[str, bytes]]:
    """Contents by one git process, asked for one object at a time and for its size first; a lost process is an error."""
    if not entries:
        return
    with subprocess.Popen(_git(root, "cat-file", "--batch-command"), stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:

        def ask(what: str, blob: str) -> list[bytes]:
            git.stdin.write(f"{what} {blob}\n".encode())
            git.stdin.flush()
            line = git.stdout.readline()
            if not line.endswith(b"\n"):
                raise OSError(f"git ended while it read {blob}")
            return line.split()

        for path, blob in entries:
            info = ask("info", blob)
            if info[1:2] != [b"blob"] or int(info[2]) > MOST_BYTES:
                continue
            ask("contents", blob)
            content = git.stdout.read(int(info[2]))
            git.stdout.read(1)  # the line end after it
            yield path.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), content
        git.stdin.close()


class IgnoreFiles(DataSource):
    """Format "ignore_files", options path and texts (default true): (dir, mtime, length, text) of every ignore file below a folder.

    dir is from the root, '' for the root itself; mtime counts nanoseconds. Text that is no UTF-8 gets replacement characters; a
    file that can't be read has a null text. Linked folders and git's own are not entered.
    """

    @classmethod
    def name(cls) -> str:
        return "ignore_files"

    def schema(self) -> str:
        return "dir string, mtime long, length long, text string"

    def reader(self, schema) -> DataSourceReader:
        return _IgnoreReader(self.options["path"], self.options.get("texts", "true").lower() == "true")


def _folders(path: str) -> list[str]:
    try:
        with os.scandir(path) as found:
            return sorted(e.path for e in found if e.name != ".git" and e.is_dir(follow_symlinks=False))
    except OSError:  # gone, or not to be read
        return []


def read_text(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="replace", newline="") as f:
            return f.read()
    except OSError:
        return None


class _IgnoreReader(DataSourceReader):
    def __init__(self, root: str, texts: bool):
        self.root, self.texts = root, texts

    def partitions(self) -> list[InputPartition]:
        """Folders are opened level by level until there are enough; those have their own file read, those below are walked."""
        opened, below = [], [self.root]
        while below and len(below) < FOLDERS_FIRST:
            opened, below = opened + below, [f for b in below for f in _folders(b)]
        walks = [(True, below[i::WALKS]) for i in range(min(WALKS, len(below)))]
        return [InputPartition(p) for p in [(False, opened), *walks]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        deep, todo = partition.value
        todo = list(todo)
        while todo:
            folder = todo.pop()
            path = os.path.join(folder, IGNORE_FILE)
            try:
                stat = os.stat(path) if os.path.isfile(path) else None
            except OSError:
                stat = None
            if stat:
                name = os.path.relpath(folder, self.root).replace(os.sep, "/")
                yield "" if name == "." else name, stat.st_mtime_ns, stat.st_size, read_text(path) if self.texts else None
            if deep:
                todo += _folders(folder)


def register(spark: SparkSession) -> None:
    """Both formats for `spark.read.format`."""
    spark.dataSource.register(StagedFiles)
    spark.dataSource.register(IgnoreFiles)


def staged(spark: SparkSession, root: str) -> DataFrame:
    """The staged files of a repository as files to scan; bytes are read as UTF-8."""
    register(spark)
    rows = spark.read.format("staged_files").option("path", root).load()
    return from_columns(rows, F.concat(F.lit(root.rstrip("/") + "/"), "path"), F.col("content").cast("string"))


def ignore_files(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """(dir, mtime, length, text) of the ignore files below root. With `known`, an earlier result, only files whose time or
    length is another, and new ones, are read again; files that are gone leave."""
    register(spark)
    source = spark.read.format("ignore_files").option("path", root)
    if known is None:
        return source.load()
    listed = source.option("texts", "false").load().drop("text")
    old = known.dropDuplicates(["dir"]).select("dir", "mtime", "length", F.struct("text").alias("old"))

    def fill(batches):
        for b in batches:
            again = [t["text"] if t is not None else read_text(os.path.join(root, d, IGNORE_FILE)) for d, t in zip(b["dir"], b["old"], strict=True)]
            yield b[["dir", "mtime", "length"]].assign(text=again)

    return listed.join(old, ["dir", "mtime", "length"], "left").mapInPandas(fill, "dir string, mtime long, length long, text string")
