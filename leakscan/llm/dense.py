"""Vectors as integers, packed into shards of bounded size, and the queries asked of them in blocks.

A shard is a row, so a task holds one at a time, however large the table. Queries go out in blocks of bounded
size, one pass over the shards each; a task merges what its shards have for a query before it answers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscan.llm import common as C

#: Components of a shard and of a block of queries: 8,192 and 16,384 vectors of 64 dimensions.
SHARD_VALUES, BLOCK_VALUES = 1 << 19, 1 << 20
#: Rows that are worth a shard of their own when there are fewer than cores.
LEAST_SHARD = 1024


def integers(vectors: DataFrame, id: str, vec: str, factor: int, more: tuple[str, ...] = ()) -> DataFrame:
    """(id, *more, dim, v): the components' floor(factor * x), x in double precision, as int32 bytes.

    Vectors that are null or hold null or non-finite components are left out. Components beyond 32 bits are an error.
    """
    names = ["id", *[f"m{i}" for i in range(len(more))]]

    def run(batches):
        for batch in batches:
            col = batch.column("vec")
            sizes = np.asarray(pc.fill_null(pc.list_value_length(col), 0), dtype=np.int64)
            flat = np.asarray(pc.fill_null(col.flatten().cast(pa.float64()), float("nan")))
            row = np.repeat(np.arange(len(sizes)), sizes)
            ok = np.asarray(col.is_valid()) & (np.bincount(row[~np.isfinite(flat)], minlength=len(sizes)) == 0)
            whole = np.floor(factor * flat[ok[row]])
            if len(whole) and np.abs(whole).max() >= 2**31:
                raise OverflowError(f"a component is too large for floor({factor} * x) to fit 32 bits")
            raw, ends = whole.astype(np.int32).tobytes(), np.cumsum(sizes[ok])
            blobs = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes[ok].tolist(), strict=True)]
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([*(batch.column(n).filter(keep) for n in names), pa.array(sizes[ok].astype(np.int32)), pa.array(blobs, pa.binary())], [*names, "dim", "v"])

    own = vectors.select(F.col(id).alias("id"), *[F.col(c).alias(n) for c, n in zip(more, names[1:], strict=True)], F.col(vec).alias("vec"))
    schema = T.StructType([*[f for f in own.schema.fields if f.name != "vec"], T.StructField("dim", T.IntegerType()), T.StructField("v", T.BinaryType())])
    out = own.mapInArrow(run, schema)
    return out.withColumnsRenamed(dict(zip(names[1:], more, strict=True)))


def numbered(table: DataFrame) -> tuple[DataFrame, int, int]:
    """`table` written with `row`, a number of each row, the number of rows and the largest dim."""
    out = C.Scratch(table.sparkSession).save(table.withColumn("row", F.monotonically_increasing_id()))
    n, dim = out.agg(F.count(F.lit(1)), F.max("dim")).first()
    return out, n, dim or 0


def shards(table: DataFrame, n: int, dim: int, more: tuple[str, ...] = (), index: Callable | None = None, extra: str = "") -> DataFrame:
    """Written rows (dim, ids, rows, *more as arrays, v) of vectors of one length each, by id, null ids last.

    With `index` what it makes of a shard's matrix follows, in the columns that `extra` declares.
    """
    spark = table.sparkSession
    size = max(1, SHARD_VALUES // max(1, dim))
    parts = max(-(-n // size), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_SHARD)), 1)
    names = ["id", "row", *more]

    def pack(batches):
        held: dict[int, list] = defaultdict(list)
        count: dict[int, int] = defaultdict(int)

        def shard(d):
            t = pa.Table.from_batches(held.pop(d))
            del count[d]
            t = t.take(pc.sort_indices(t, [("id", "ascending"), ("row", "ascending")])).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t[c].combine_chunks()) for c in names]
            x = np.frombuffer(b"".join(t["v"].to_pylist()), np.int32).reshape(len(t), d)
            added = index(x) if index else []
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *lists, pa.array([x.tobytes()], pa.binary()), *added], out_names)

        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                while part.num_rows:
                    room = size - count[d]
                    held[d].append(part.slice(0, room))
                    count[d] += min(room, part.num_rows)
                    part = part.slice(room)
                    if count[d] >= size:
                        yield shard(d)
            while sum(count.values()) > size:  # many lengths
                yield shard(max(count, key=count.get))
        for d in list(held):
            yield shard(d)

    of = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    schema = ", ".join(["dim int", *[f"{c}s array<{of[c]}>" for c in names], "v binary", *([extra] if extra else [])])
    out_names = [c.split()[0] for c in schema.split(", ")]
    # dealt out without a key: shards are of one size whatever the ids or labels
    return C.Scratch(spark).save(table.select("dim", *names, "v").repartition(parts).mapInArrow(pack, schema))


def blocks(queries: DataFrame, n: int, dim: int) -> Iterator[pa.Table]:
    """`queries` (with a column row) in blocks of about BLOCK_VALUES components, by hash of row."""
    size = max(1, BLOCK_VALUES // max(1, dim))
    parts = -(-n // size)
    for b in range(parts):
        yield queries.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == b).toArrow()


def matrix(shard: dict) -> np.ndarray:
    return np.frombuffer(shard["v"], np.int32).reshape(len(shard["rows"]), shard["dim"])


def ranks(ids: pa.Array | list) -> np.ndarray:
    """Ids as numbers to be compared with those of other shards; null is largest."""
    return np.fromiter((np.iinfo(np.int64).max if i is None else i for i in ids), np.int64, len(ids))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of x with those of q; beyond 64 bits they are an error."""
    most = int(np.abs(x.astype(np.int64)).max(initial=0)) * int(np.abs(q.astype(np.int64)).max(initial=0)) * x.shape[1]
    if most < 2**53:  # sums of whole numbers that doubles hold are exact in any order
        return (x.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("an inner product may not fit 64 bits")
    return x.astype(np.int64) @ q.astype(np.int64).T
