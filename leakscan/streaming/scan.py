"""Scanning edits as they come: debounced, incremental, with the last result of every file kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.operators import suppress
from leakscan.plans.scan import Scanner
from leakscan.sources.state import StateStore, scratch, written

RESULT = "file_uri string, line_no int, start_pos int, end_pos int, severity string, score double, rule_id string, suppression_key string"
_SCANS = RESULT + ", batch long"
#: Batches from one base to the next.
COMPACT = 20


def debounce(edits: DataFrame, gap: str = "300 milliseconds", late: str = "10 seconds", one_timer: bool = False) -> DataFrame:
    """The last edit of every burst: edits (file_uri, ts, content, changed_lines) no further apart than `gap`.

    One timer for all files, as an editor may have, lets an edit of one file cancel another's; the default keeps a timer per file.
    """
    keys = [F.session_window("ts", gap)] + ([] if one_timer else [F.col("file_uri")])
    last = F.max_by(F.struct("file_uri", "content", "changed_lines", "ts"), "ts").alias("e")
    return edits.withWatermark("ts", late).groupBy(*keys).agg(last).select("e.*")


def guarded(edits: DataFrame) -> DataFrame:
    """Edits of files that changed something: paths and file: uris (a drive's letter is no scheme), and not an empty list of changed
    lines. Null changed_lines mean the whole file; a null uri goes."""
    scheme = F.lower(F.regexp_extract("file_uri", "^([A-Za-z][A-Za-z0-9+.-]+):", 1))
    return edits.where(scheme.isin("", "file") & (F.col("changed_lines").isNull() | (F.size("changed_lines") > 0)))


def results(state: StateStore, before: int | None = None, files: DataFrame | None = None) -> DataFrame:
    """The last result of every file (of `files` only, if given) after all batches, or those below `before`.

    Read are the latest base, which holds what was current before its batch, and the batches since then.
    """
    start = ([v for v in state.versions("base") if before is None or v <= before] or [0])[-1]
    since = [v for v in state.versions("scans") if v >= start and (before is None or v < before)]
    rows = state.read("base", [start], _SCANS).unionByName(state.read("scans", since, _SCANS))
    if files is not None:
        rows = suppress.of_files(rows, files)
    last = rows.groupBy(F.col("file_uri").alias("uri")).agg(F.max("batch").alias("newest"))
    # a scan without findings left a row without a place
    return rows.join(last, rows["file_uri"].eqNullSafe(last["uri"]) & (rows["batch"] == last["newest"]), "left_semi").where("line_no is not null")


def merge_batch(scanner: Scanner, state: StateStore, files: DataFrame, batch: int, suppressions: DataFrame | None = None) -> None:
    """Scans one batch, in which rows without a uri are one file, and writes version `batch` of scans (its files' results) and of new (what their files' last scan lacked).

    Only the batch's own files are written; every COMPACT batches a base gathers what is current, and versions that no
    batch reads any more go. A batch that is run again reads the versions before its own, so repeating it changes nothing.
    Batches are numbered from 0 by one stream; another stream needs a state of its own.
    """
    # of several edits of a file the last counts
    last = files.groupBy("file_uri").agg(F.max_by(F.struct("content", "changed_lines"), "ts").alias("e")).select("file_uri", "e.*")
    columns = [c.split()[0] for c in RESULT.split(", ")]
    with scratch(files.sparkSession):  # the scan's tables go with the batch
        fresh = written(scanner.findings(last, suppressions).select(*columns))
        state.save("new", suppress.new_findings(fresh, results(state, batch, last)), batch)
        own = last.select(F.col("file_uri").alias("uri"))
        scans = own.join(fresh, own["uri"].eqNullSafe(fresh["file_uri"]), "left").drop("file_uri").withColumnRenamed("uri", "file_uri")
        state.save("scans", scans.select(*columns, F.lit(batch).cast("long").alias("batch")), batch)
    if (batch + 1) % COMPACT == 0:
        state.save("base", results(state, batch + 1), batch + 1)
        kept = batch + 1 - COMPACT
        for key in ("base", "scans", "new"):
            state.prune(key, kept)


def start(edits: DataFrame, scanner: Scanner, state: StateStore, checkpoint: str, suppressions=None, trigger: dict | None = None, gap: str | None = None):
    """A running query that scans a stream of edits (file_uri, ts, content, changed_lines), those that `guarded` lets through.

    With `gap` edits are debounced over batches: a file's last edit is scanned once the watermark has passed its burst.
    Without it the last edit of each file in a batch is scanned.
    """

    def run(df: DataFrame, batch: int) -> None:
        merge_batch(scanner, state, df, batch, suppressions() if callable(suppressions) else suppressions)

    own = guarded(edits)
    own = debounce(own, gap) if gap else own
    return own.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of every user: begin, end and number of events. Works on a stream and on a table."""
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events"))
        .select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")
    )
