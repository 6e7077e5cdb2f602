"""A scan of many files in batches, with what it has done so far and a way to stop it.

Files come as a stream, a bounded number of them a batch. Each batch's findings are a part of one table, so what was
found before a stop is there, and a later run goes on from the checkpoint with the files that are left.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from leakscan.plans.scan import Scanner, unpacked
from leakscan.sources.state import scratch


class ScanRun:
    """A running scan. `files` is a stream of (file_uri, content, …); findings of batch n go to `path`/batch=n."""

    def __init__(self, scanner: Scanner, files: DataFrame, path: str, checkpoint: str, columns: list[str]):
        self.scanner, self.path, self.columns = scanner, path, columns
        self.spark, self.tag = files.sparkSession, f"scan-{uuid.uuid4().hex}"
        self._done = {"batches": 0, "files": 0, "lines": 0, "candidates": 0, "findings": 0}
        self._cancelled = threading.Event()
        self.query = files.writeStream.foreachBatch(self._batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _batch(self, files: DataFrame, n: int) -> None:
        if self._cancelled.is_set():
            raise RuntimeError("cancelled")
        spark = files.sparkSession
        spark.addTag(self.tag)  # of this thread's jobs
        try:
            with scratch(spark):
                read, scored = Observation(f"read-{uuid.uuid4().hex}"), Observation(f"scored-{uuid.uuid4().hex}")
                table = self.scanner.read(files)
                table.observe(read, F.count(F.lit(1)).alias("files"), F.sum("n_lines").alias("lines")).write.format("noop").mode("overwrite").save()
                found = unpacked(self.scanner._scored(table)).observe(scored, F.count(F.lit(1)).alias("candidates"), F.count("severity").alias("findings"))
                # a batch that is run again replaces its own part
                found.where("severity is not null").select(*self.columns).write.mode("overwrite").parquet(f"{self.path}/batch={n}")
        finally:
            spark.removeTag(self.tag)
        for k, v in {**read.get, **scored.get, "batches": 1}.items():
            self._done[k] += v or 0

    @property
    def progress(self) -> dict[str, int]:
        """Batches, files, lines, candidates and findings of the batches that are done."""
        return dict(self._done)

    def cancel(self) -> dict[str, int]:
        """Stops the scan, the batch that is running included, and returns what was done."""
        self._cancelled.set()
        self.spark.interruptTag(self.tag)
        self.query.stop()
        return self.progress

    def wait(self) -> dict[str, int]:
        """Until all files are scanned or the scan is cancelled."""
        try:
            self.query.awaitTermination()
        except Exception:
            if not self._cancelled.is_set():
                raise
        return self.progress
