"""What earlier scans found, as keyed state of a stream: RocksDB holds it, timers and time to live end it.

Nothing is read back from tables: a batch touches the state of its own keys only, and the stream's checkpoint
brings it back after a restart. Streams that also have to serve results of all files use `streaming.scan`.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


# --- sightings ----------------------------------------------------------------------------------

SIGHTING = "file_uri string, suppression_key string, event string, first_ms long, last_ms long, n long"


class _Sightings(StatefulProcessor):
    """Value state (first, last, number) of one key of one file, with an event-time timer for its end."""

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sighting", "first_ms long, last_ms long, n long")

    def _row(self, key, event: str, s: tuple) -> Row:
        return Row(file_uri=key[0], suppression_key=key[1], event=event, first_ms=s[0], last_ms=s[1], n=s[2])

    def handleInputRows(self, key, rows, timerValues):
        now = self.state.get()
        timed = now is not None  # a key with state has a timer, set no later than its end
        for at in sorted(r.at_ms for r in rows):
            if now is not None and at - now[1] > self.quiet:
                yield self._row(key, "expired", now)
                now = None
            if now is None:
                now = (at, at, 0)
                yield self._row(key, "new", (at, at, 1))
            now = (min(now[0], at), max(now[1], at), now[2] + 1)
        if now is not None:
            self.state.update(now)
            if not timed:  # one a key, not one for each time that it is seen anew
                self.handle.registerTimer(now[1] + self.quiet)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = self.state.get()
        if now is None:
            return
        if now[1] + self.quiet <= timerValues.getCurrentWatermarkInMs():
            self.state.clear()
            yield self._row(key, "expired", now)
        else:  # seen again since
            self.handle.registerTimer(now[1] + self.quiet)

    def close(self) -> None:
        pass


def sightings(detections: DataFrame, quiet: int, late: int) -> DataFrame:
    """(file_uri, suppression_key, event, first_ms, last_ms, n) of a stream of detections (file_uri, suppression_key, at).

    A key of a file is `new` when it is first seen, or seen again more than `quiet` milliseconds after it was last seen; it is `expired`,
    with its sightings' ends and number, when it comes back so late, or once the watermark (`late` milliseconds behind) is `quiet`
    past its last sighting, and its state goes. A batch's rows are taken in order of time; what comes in a later batch but in time
    belongs to the sightings that last. Null uris and keys are keys like others; rows without a time are left out.
    """
    own = detections.where(F.col("at").isNotNull()).select("file_uri", "suppression_key", F.col("at").cast("timestamp").alias("at"))
    own = own.withWatermark("at", f"{late} milliseconds").withColumn("at_ms", F.unix_millis("at"))
    return own.groupBy("file_uri", "suppression_key").transformWithState(_Sightings(quiet), SIGHTING, "Append", "EventTime")


# --- scans --------------------------------------------------------------------------------------

CHANGE = "file_uri string, at timestamp, suppression_key string, event string"


class _LastScan(StatefulProcessor):
    """Map state: the keys that a file's last scan found; value state: when that was."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "suppression_key string", "at_us long")
        self.scanned = handle.getValueState("scanned", "at_us long")

    def handleInputRows(self, key, rows, timerValues):
        scans, when = {}, {}
        for r in rows:
            when[r.at_us] = r.at
            scans.setdefault(r.at_us, set()).update(set() if r.suppression_key is None else {r.suppression_key})
        last = before = (self.scanned.get() or (None,))[0]
        kept = {} if last is None else {k[0]: v[0] for k, v in self.held.iterator()}
        held = dict(kept)
        for at in sorted(a for a in scans if last is None or a > last):
            for k in sorted(scans[at] - held.keys()):
                held[k] = at
                yield Row(file_uri=key[0], at=when[at], suppression_key=k, event="new")
            for k in sorted(held.keys() - scans[at]):
                del held[k]
                yield Row(file_uri=key[0], at=when[at], suppression_key=k, event="gone")
            last = at
        # the state is written once a batch, where it differs from what it was
        for k in kept.keys() - held.keys():
            self.held.removeKey((k,))
        for k, at in held.items():
            if kept.get(k) != at:
                self.held.updateValue((k,), (at,))
        if last != before:
            self.scanned.update((last,))

    def close(self) -> None:
        pass


def scan_changes(scans: DataFrame) -> DataFrame:
    """(file_uri, at, suppression_key, event) of a stream of scans (file_uri, at, suppression_key): what each scan of a file found that
    the one before had not (`new`), and what it no longer found (`gone`).

    Rows of one file and time are one scan; a scan without findings is a row with a null key. A scan comes in one batch; one that is
    not later than the file's last is passed over. Rows without a time are left out.
    """
    own = scans.where(F.col("at").isNotNull()).select("file_uri", F.col("at").cast("timestamp").alias("at"), "suppression_key").withColumn("at_us", F.unix_micros("at"))
    return own.groupBy("file_uri").transformWithState(_LastScan(), CHANGE, "Update", "None")


# --- suppressions -------------------------------------------------------------------------------

PASSED = "suppression_key string, file_uri string, at timestamp"


class _Suppressions(StatefulProcessor):
    """Value state with a time to live: whether a session suppresses a key."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.on = handle.getValueState("suppressed", "on boolean", self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        passed = []
        for r in rows:
            if r.kind == "suppress":
                self.on.update((True,))
            elif r.kind == "resume":
                self.on.clear()
            else:
                passed.append(r)
        if passed and not self.on.exists():
            for r in passed:
                yield Row(suppression_key=key[0], file_uri=r.file_uri, at=r.at)

    def close(self) -> None:
        pass


def unsuppressed(edits: DataFrame, ttl: int) -> DataFrame:
    """(suppression_key, file_uri, at) of the findings in a stream (suppression_key, file_uri, at, kind) that no suppression in force covers.

    kind is `suppress`, which holds for `ttl` milliseconds of the clock, then the state store drops it; `resume`, which ends it; or
    anything else for a finding. A batch's suppressions act on its own findings.
    """
    own = edits.select("suppression_key", "file_uri", F.col("at").cast("timestamp").alias("at"), F.coalesce("kind", F.lit("finding")).alias("kind"))
    return own.groupBy("suppression_key").transformWithState(_Suppressions(ttl), PASSED, "Append", "ProcessingTime")


# --- running ------------------------------------------------------------------------------------


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", one_batch: bool = False) -> None:
    """Takes what a stream has and appends what comes out to a Parquet table at `path`; a later run goes on from the checkpoint.

    Streams on the clock (`unsuppressed`) never run dry, as time alone may change what they hold: they take `one_batch`.
    """
    sink = stream.writeStream.option("checkpointLocation", checkpoint).trigger(**({"once": True} if one_batch else {"availableNow": True}))
    with rocksdb(stream.sparkSession):
        if mode == "append":
            query = sink.format("parquet").option("path", path).start()
        else:  # a batch that is run again replaces its own folder
            query = sink.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
    query.awaitTermination()
