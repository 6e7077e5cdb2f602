"""What several corpus operators share: scratch tables, Arrow word splitting, n-gram hashes, components.

Rows pass to Python in Arrow batches and are handled in slices of bounded bytes, so a task's memory
follows one slice (or one very long text), not its partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 2 << 20
_LIBC = None
with contextlib.suppress(OSError):  # no such library on other systems
    _LIBC = ctypes.CDLL("libc.so.6")

# Lookup tables over UTF-8 bytes; multi-byte characters are left as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Lower-cases A-Z and turns every ASCII byte that is neither letter nor digit into a space.
ALNUM = LOWER.copy()
ALNUM[[b for b in range(128) if not chr(b).isalnum()]] = 32


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; on one machine (tests) a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that all machines share")
        base = tempfile.mkdtemp(prefix="leakscan-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/leakscan"


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{scratch_dir(self.spark)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Gives freed memory back to the system: idle workers of one stage live beside those of the next."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


# --- rows ---------------------------------------------------------------------------------------


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cuts batches so that `column` holds about SLICE_BYTES at most (one row at least); nulls read as ''."""
    for batch in batches:
        if not batch.num_rows:
            continue
        release()
        text = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
        ends = np.cumsum(np.asarray(pc.binary_length(text), dtype=np.int64))
        at = 0
        while at < len(text):
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
            yield batch.slice(at, stop - at), text.slice(at, stop - at)
            at = stop
        del batch, text, ends
    release()


def add_columns(
    df: DataFrame, text: str, fields: list[T.StructField], fn: Callable[[pa.RecordBatch, pa.Array], dict], drop: tuple[str, ...] = ()
) -> DataFrame:
    """`df` with `fields` computed by fn(slice, texts); columns of the same names (any case) give way."""
    new = {f.name.lower() for f in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in new and f.name not in drop]
    names, added = [f.name for f in keep], [f.name for f in fields]
    # what fn reads may be among the columns that give way, so the input keeps all of them
    schema = T.StructType(keep + fields)

    def run(batches):
        for batch, texts in slices(batches, text):
            out = fn(batch, texts)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [out[n] for n in added], names + added)

    return df.mapInArrow(run, schema)


def named(column: str) -> Column:
    """The column of that name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def apart(docs: DataFrame, text: str, outputs: list[str], **own: Column) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` as (rest, text, **own), rest a struct of the other columns, so that none clashes with a column the operator works with, and
    what brings them back in their order, followed by `outputs`; columns named like an output (any case) give way."""
    taken = {n.lower() for n in outputs}
    keep = [c for c in docs.columns if c.lower() not in taken]
    rest = [named(c) for c in keep if c != text] or [F.lit(0).alias("none")]
    packed = docs.select(F.struct(*rest).alias("rest"), named(text).alias("text"), *[c.alias(n) for n, c in own.items()])

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[(F.col("text") if c == text else F.col("rest").getField(c)).alias(c) for c in keep], *outputs)

    return packed, back


# --- words --------------------------------------------------------------------------------------


def translate(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Maps every byte of a large_string array by `table`."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(table[raw]))


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Runs of anything but ASCII white space: row offsets and the words of all rows."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    return offsets, flat


def joined(offsets: np.ndarray, flat: pa.Array) -> pa.Array:
    """The words of every row, joined by one space."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat.cast(pa.large_string())), pa.scalar(" ", pa.large_string()))


def coded(flat: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Word numbers and the distinct words they stand for."""
    d = flat.dictionary_encode()
    return np.asarray(d.indices).astype(np.int64), d.dictionary.cast(pa.large_binary()).to_pylist()


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word."""
    codes, distinct = coded(flat)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    return h[codes]


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row number of every word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive entries, by doubling: log2(k) passes whatever the width."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, width, power, size = None, 0, h, 1
    while True:
        if k & 1:
            if out is None:
                out, width = power, size
            else:
                n = len(power) - width
                out, width = _pair(out[:n], power[width:]), width + size
        k >>= 1
        if not k:
            return out
        power, size = _pair(power[:-size], power[size:]), size * 2


def window_starts(offsets: np.ndarray, size: int) -> np.ndarray:
    """Positions at which `size` words of one row begin."""
    pos = np.arange(offsets[-1])
    return pos[pos + size <= np.repeat(offsets[1:], np.diff(offsets))]


def leftmost_min(g: np.ndarray, w: int) -> np.ndarray:
    """For every w consecutive entries the position of the least, the leftmost of equals."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(g)), 1
    while size * 2 <= w:
        a, b = at[:-size], at[size:]
        at, size = np.where(g[b] < g[a], b, a), size * 2
    if size < w:
        a, b = at[:n], at[w - size : w - size + n]
        at = np.where(g[b] < g[a], b, a)
    return at[:n]


# --- joins --------------------------------------------------------------------------------------

#: A key is hot if it holds over one of HOT rows: there are fewer than HOT such keys, whatever the size.
HOT = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """`rows` with what `table`, whose `key` is unique, has for theirs (nulls for keys without a row and for null keys).

    One key may hold most rows: hot keys' rows of the table are broadcast, so only the rows of others are shuffled.
    `rows` and `table` are read several times and should be written tables.
    """
    own = rows.where(F.col(key).isNotNull())
    added = [f for f in table.schema.fields if f.name != key]
    total = rows.count()
    hot = Scratch(rows.sparkSession).save(own.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * HOT > total).select(key))
    held = F.broadcast(hot.join(table, key, "left"))  # fewer than HOT rows
    rest = own.join(F.broadcast(hot), key, "left_anti").join(table, key, "left")
    none = rows.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in added])
    return own.join(held, key).unionByName(rest).unionByName(none).select(*rows.columns, *[f.name for f in added])


# --- components ---------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, root the least node of its component.

    edges: columns a and b. Alternates large-star and small-star until the edges stand still; each
    round is two aggregations and two joins, written to the shared folder. Least neighbours are found
    by pre-aggregated groupBy, and the joins can be split by AQE, so a hot node is not one task's work.
    """
    scratch = Scratch(edges.sparkSession)
    cur = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(df):
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    seen = mark(cur)
    while seen[0]:
        both = cur.union(cur.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = (
            large.join(least, F.col("a") == F.col("k"))
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        nxt = scratch.save(small)
        scratch.drop(cur)
        cur, before, seen = nxt, seen, mark(nxt)
        if seen == before:
            break
    # a root has no edge to a smaller node; its own row is added
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(cur.select("b", "b")).distinct()
