"""Exact top-k inner products by an impact-ordered index, score at a time.

A shard's index holds, for every dimension, segments of postings whose components fall into one of LEVELS
equal ranges. A query takes all segments in descending order of the most they can add to a score, so any
posting not yet taken adds at most what the next segment can. A vector's score is then at most what its
taken postings may add plus that much for each dimension still open. Segments are taken until few vectors
can reach the k-th best score known so far, which is the proof; those are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscan.llm import common as C
from leakscan.llm import dense

LEVELS = 32
#: Postings are taken in this many parts, with a look at the bounds after each.
PARTS = 16
#: Possible members are scored once they are at most one of so many vectors; all are, when postings end.
FEW = 16
FACTOR = 1024

_INDEX = "order binary, segments binary"


def _index(x: np.ndarray) -> list[pa.Array]:
    """Postings of a shard: positions by dimension and level, and per segment (dimension, start, size, least, most)."""
    n, dims = x.shape
    order, segments, base = [np.zeros(0, np.uint32)], [], 0
    for d in range(dims):
        col = x[:, d].astype(np.int64)
        least = col.min()
        level = (col - least) * LEVELS // (col.max() - least + 1)
        by = np.argsort(level, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(level[by]) > 0))
        low, high = np.minimum.reduceat(col[by], cuts), np.maximum.reduceat(col[by], cuts)
        segments.append(np.stack([np.full(len(cuts), d), base + cuts, np.diff(np.append(cuts, n)), low, high], axis=1))
        order.append(by.astype(np.uint32))
        base += n
    table = np.concatenate(segments) if segments else np.zeros((0, 5), np.int64)
    return [pa.array([np.concatenate(order).tobytes()], pa.binary()), pa.array([table.astype(np.int64).tobytes()], pa.binary())]


class Shard:
    """One shard's vectors with their index."""

    def __init__(self, row: dict):
        self.x, self.ids, self.rows = dense.matrix(row), dense.ranks(row["ids"]), np.array(row["rows"], np.int64)
        self.order = np.frombuffer(row["order"], np.uint32).astype(np.int64)
        self.dim, self.start, self.size, self.low, self.high = np.frombuffer(row["segments"], np.int64).reshape(-1, 5).T
        self.taken = 0

    def possible(self, q: np.ndarray, own: int, floor: int | None, k: int) -> np.ndarray:
        """Positions of all vectors other than row `own` that may be among the k best, `floor` being the k-th best score
        elsewhere if known: no other reaches the k-th best."""
        n, dims = self.x.shape
        most = np.maximum(q[self.dim] * self.low, q[self.dim] * self.high).astype(np.float64)
        seq = np.argsort(-most, kind="stable")
        done = np.cumsum(self.size[seq])
        upper, left = np.zeros(n), np.full(n, float(dims))
        slack = 1e-9 * float(np.abs(most).max(initial=0)) * dims  # rounding of the sums
        other = self.rows != own
        at, part = 0, 0
        while True:
            part += 1
            to = int(np.searchsorted(done, n * dims * part // PARTS, side="left")) + 1
            segments = seq[at:to]
            sizes = self.size[segments]
            ids = self.order[np.arange(sizes.sum()) + np.repeat(self.start[segments] - np.cumsum(sizes) + sizes, sizes)]
            upper += np.bincount(ids, weights=np.repeat(most[segments], sizes), minlength=n)
            left -= np.bincount(ids, minlength=n)
            self.taken += len(ids)
            at = min(to, len(seq))
            rest = most[seq[at]] if at < len(seq) else 0.0
            bound = upper + left * rest + slack
            found = np.flatnonzero(other if floor is None else other & (bound >= floor))
            if at == len(seq) or len(found) * FEW <= n:
                return found
            if len(found) > k:  # exact scores of the most promising raise the floor
                best = found[np.argpartition(bound[found], -k)[-k:]]
                least = int(dense.products(self.x[best], q[None]).min())
                floor = least if floor is None else max(floor, least)


def _answer(shared, k: int):
    """Arrow function over shards: the k best of a task's shards for every query of the block."""

    def run(batches):
        block = shared.value
        held: list = [None] * len(block["rows"])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard = Shard(row)
                for j, dim in enumerate(block["dims"]):
                    if dim != row["dim"]:
                        continue
                    old, q = held[j], block["v"][j].astype(np.int64)
                    floor = int(old[0][-1]) if old is not None and len(old[0]) == k else None
                    at = shard.possible(q, block["rows"][j], floor, k)
                    score = dense.products(shard.x[at], q[None])[:, 0]
                    new = (score, shard.ids[at], shard.rows[at])
                    if old is not None:
                        new = tuple(np.concatenate(p) for p in zip(old, new, strict=True))
                    best = np.lexsort((new[2], new[1], -new[0]))[:k]
                    held[j] = tuple(p[best] for p in new)
                del shard, row
            C.release()
        out = [(block["ids"][j], block["rows"][j], *h) for j, h in enumerate(held) if h is not None and len(h[0])]
        if out:
            size = [len(h[2]) for h in out]
            ids = np.concatenate([h[3] for h in out])
            cols = [pa.array(np.repeat([h[0] for h in out], size)), pa.array(np.repeat([h[1] for h in out], size)), pa.array(ids, mask=ids == np.iinfo(np.int64).max), pa.array(np.concatenate([h[4] for h in out])), pa.array(np.concatenate([h[2] for h in out]))]
            yield pa.RecordBatch.from_arrays(cols, ["query_id", "query_row", "vec_id", "row", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id: str = "vec_id", vec: str = "embedding", factor: int = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of `vectors` where `is_query` holds, the k other rows (all, if fewer) of greatest
    inner product of floor(factor * x), ties to the smaller id.

    Ids are whole numbers; a row with a null id is no query, and the last of its ties. Vectors that are null or hold null or
    non-finite components take no part; vectors of different lengths don't meet, and empty ones have products of 0. Repeated
    rows are rows: each is a candidate for the others. Products that may not fit 64 bits are an error.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id).cast("long").alias("id"), F.col(vec).alias("vec"), (F.coalesce(is_query, F.lit(False)) & F.col(id).isNotNull()).alias("query"))
    table, n, dim = dense.numbered(dense.integers(own, "id", "vec", factor, ("query",)))
    index = dense.shards(table, n, dim, index=_index, extra=_INDEX)
    queries = table.where("query").select("id", "row", "dim", "v")
    out = None
    for block in dense.blocks(queries, queries.count(), dim):
        value = {"ids": block["id"].to_pylist(), "rows": block["row"].to_pylist(), "dims": block["dim"].to_pylist(), "v": [np.frombuffer(v, np.int32) for v in block["v"].to_pylist()]}
        shared = spark.sparkContext.broadcast(value)  # at most about BLOCK_VALUES components
        part = C.Scratch(spark).save(index.mapInArrow(_answer(shared, k), "query_id long, query_row long, vec_id long, row long, score long"))
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
