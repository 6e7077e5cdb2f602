"""Exact metric range join on the unit sphere: all pairs of vectors at a cosine of at least a threshold.

Pivots, a bounded sample of the vectors, split the sphere into cells by nearest pivot. By the triangle
inequality a vector x of cell i can have a partner in cell j only if x lies within the join radius of
the plane that halves the way between pivots i and j, and within cell j's own radius plus the join
radius of pivot j; to such cells it is sent as a visitor. Of each two cells one sends to the other.
Cells join independently: homes are cut into chunks of at most CHUNK vectors, held in memory, and all
others stream past them. Equal vectors are joined once and counted by weight.

In high dimensions most cells are neighbours: on vectors without clusters the pivots save little, and
the work stays near that of comparing all chunks with one another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscan.llm import common as C

CHUNK = 4096
MAX_PIVOTS = 512
SAMPLE = 20_000
BLOCK = 2048


def _unit(values: np.ndarray) -> np.ndarray:
    return values / np.sqrt((values * values).sum(axis=1))[:, None]


def usable(vectors: DataFrame, id: str, vec: str) -> DataFrame:
    """(id, dim, data): the bytes of each vector in double precision; null where it links with nothing."""

    def run(batches):
        for batch in batches:
            col, data, dims = batch.column(vec), [], []
            flat = np.asarray(pc.fill_null(col.flatten().cast(pa.float64()), float("nan")))
            at = 0
            for n in pc.fill_null(pc.list_value_length(col), 0).to_pylist():
                v = flat[at : at + n]
                at += n
                # overflow-safe: a norm that overflows or underflows is scaled first
                ok = n > 0 and np.isfinite(v).all() and np.abs(v).max() > 0
                data.append((v / np.abs(v).max()).tobytes() if ok and not 1e-100 < np.abs(v).max() < 1e100 else v.tobytes() if ok else None)
                dims.append(n if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(id), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], ["id", "dim", "data"])

    schema = T.StructType([T.StructField("id", vectors.schema[id].dataType), T.StructField("dim", T.IntegerType()), T.StructField("data", T.BinaryType())])
    return vectors.select(id, vec).mapInArrow(run, schema)


def _pivots(reps: DataFrame, chunk: int) -> np.ndarray:
    """At most MAX_PIVOTS vectors, spread out by farthest-first choice from those of least hash, SAMPLE of them expected at most."""
    n = reps.count()
    want = min(MAX_PIVOTS, -(-n // chunk))
    # vectors are distinct, so the hash's share of its range is theirs of the vectors; no partition sends rows that aren't used
    share = min(1.0, min(SAMPLE, want * 40) / n)
    rows = sorted(reps.select("data").where(F.xxhash64("data") <= min(2**63 - 1, int(share * 2**64) - 2**63)).collect()) if want > 1 else []
    rows = rows or reps.select("data").limit(1).collect()
    pool = _unit(np.stack([np.frombuffer(r.data) for r in rows]))
    chosen, nearest = [0], pool @ pool[0]
    while len(chosen) < want and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, pool @ pool[chosen[-1]])
    return pool[chosen]


def range_links(reps: DataFrame, threshold: float, chunk: int = CHUNK) -> DataFrame:
    """(node, other, weight) rows over distinct vectors (node long, weight long, data binary, one dimension).

    Rows with other null carry part of the number of vectors linked to node; the rest are star edges
    whose components are those of all links.
    """
    scratch = C.Scratch(reps.sparkSession)
    pivots = _pivots(reps, chunk)
    k = len(pivots)
    radius = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    gaps = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-18))
    shared = reps.sparkSession.sparkContext.broadcast((pivots, gaps))

    def home(batches):
        for batch in batches:
            if batch.num_rows:
                x = _unit(np.stack([np.frombuffer(d) for d in batch.column("data").to_pylist()]))
                near = x @ shared.value[0].T
                cell = near.argmax(axis=1)
                far = np.sqrt(np.maximum(0, 2 - 2 * near[np.arange(len(x)), cell]))
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("weight"), batch.column("data"), pa.array(cell), pa.array(far)], ["node", "weight", "data", "cell", "far"])

    homes = scratch.save(reps.mapInArrow(home, "node long, weight long, data binary, cell long, far double"))
    stats = {r.cell: r for r in homes.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}  # a row per pivot
    parts = np.array([-(-stats[c].n // chunk) if c in stats else 0 for c in range(k)])
    reach = np.array([stats[c].far if c in stats else -10.0 for c in range(k)])
    base = np.concatenate([[0], np.cumsum(parts)])

    def send(batches):
        """Rows (chunk, visit, node, weight, data): each vector at home, then wherever a partner may be."""
        pivots, gaps = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                x = _unit(np.stack([np.frombuffer(d) for d in b.column("data").to_pylist()]))
                cell, node = np.asarray(b.column("cell")), np.asarray(b.column("node"))
                near = x @ pivots.T
                own = near[np.arange(len(x)), cell]
                # |x - y| >= distance to the halving plane, for any y of cell j
                close = (own[:, None] - near) / gaps[cell] <= radius
                close &= np.sqrt(np.maximum(0, 2 - 2 * near)) <= reach[None, :] + radius
                j = np.arange(k)[None, :]
                close &= np.where((cell[:, None] + j) % 2 == 1, cell[:, None] < j, cell[:, None] > j)  # one way only
                mine = (C.mix(node.astype(np.uint64)) % np.maximum(parts[cell], 1).astype(np.uint64)).astype(np.int64)
                rows, to, visit = [np.arange(len(x))], [base[cell] + mine], [np.zeros(len(x), bool)]
                r, c = np.nonzero(close)
                for part in range(int(parts.max())):
                    ok = part < parts[c]
                    rows.append(r[ok]), to.append(base[c[ok]] + part), visit.append(np.ones(ok.sum(), bool))
                    ok = (part < parts[cell]) & (part > mine)  # chunks of the own cell
                    rows.append(np.flatnonzero(ok)), to.append(base[cell[ok]] + part), visit.append(np.ones(ok.sum(), bool))
                rows = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to)), pa.array(np.concatenate(visit)), *(b.column(n).take(rows) for n in ("node", "weight", "data"))], ["chunk", "visit", "node", "weight", "data"])

    sent = homes.mapInArrow(send, "chunk long, visit boolean, node long, weight long, data binary")
    cells = sent.repartition("chunk").sortWithinPartitions("chunk", "visit")
    return cells.mapInArrow(_join(threshold), "node long, other long, weight long")


def _join(threshold: float):
    """Arrow function over rows sorted by (chunk, visit): homes are held, visitors stream by."""

    def run(batches):
        state = {"chunk": None}

        def root(i):
            p = state["parent"]
            while p[i] != i:
                p[i] = p[p[i]]
                i = p[i]
            return i

        def unite(found):
            top = root(found[0])
            for i in found[1:]:
                state["parent"][root(i)] = top
            return top

        def pairs(x, y):
            """Indices of pairs at the threshold: single precision finds them with room to spare, double decides."""
            a, b = np.nonzero(x.astype(np.float32) @ y.astype(np.float32).T >= np.float32(threshold - 1e-4))
            ok = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], y[b[i : i + 65536]]) >= threshold for i in range(0, len(a), 65536)] or [np.zeros(0, bool)])
            return a[ok], b[ok]

        def grouped(a, b):
            cuts = np.flatnonzero(np.diff(a)) + 1
            return zip(a[np.concatenate([[0], cuts])].tolist() if len(a) else [], np.split(b, cuts), strict=False)

        def settle():
            """All homes of the chunk are in."""
            s = state
            if s["chunk"] is None or s.get("ready") or not s["x"]:
                return
            s["node"], s["weight"], s["x"] = (np.concatenate(s[k]) for k in ("node", "weight", "x"))
            s["parent"], s["count"], s["ready"] = list(range(len(s["node"]))), np.zeros(len(s["node"]), np.int64), True
            for at in range(0, len(s["node"]), BLOCK):
                a, b = pairs(s["x"][at : at + BLOCK], s["x"])
                a += at
                a, b = a[a != b], b[a != b]
                np.add.at(s["count"], a, s["weight"][b])
                for i, found in grouped(a, b):
                    unite([i, *found.tolist()])

        def finish():
            settle()
            s = state
            if not s.get("ready"):
                return None  # a chunk that only visitors came to
            has = np.flatnonzero(s["count"])
            tied = [(i, root(i)) for i in range(len(s["node"])) if s["parent"][i] != i]
            return batch_of([s["node"][has], s["node"][[i for i, _ in tied]]], [None, s["node"][[j for _, j in tied]]], [s["count"][has], np.zeros(len(tied), np.int64)])

        def batch_of(node, other, weight):
            others = [pa.nulls(len(n), pa.int64()) if o is None else pa.array(o, pa.int64()) for n, o in zip(node, other, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(node), pa.int64()), pa.concat_arrays(others), pa.array(np.concatenate(weight), pa.int64())], ["node", "other", "weight"])

        for batch in batches:
            chunk, visit = np.asarray(batch.column("chunk")), np.asarray(batch.column("visit").cast(pa.int8()))
            cuts = np.flatnonzero((np.diff(chunk) != 0) | (np.diff(visit) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunk)], strict=True):
                if lo == hi:
                    continue
                if chunk[lo] != state["chunk"]:
                    if (out := finish()) is not None:
                        yield out
                    state = {"chunk": chunk[lo], "node": [np.zeros(0, np.int64)], "weight": [np.zeros(0, np.int64)], "x": []}
                part = batch.slice(lo, hi - lo)
                x = _unit(np.stack([np.frombuffer(d) for d in part.column("data").to_pylist()]))
                node, weight = np.asarray(part.column("node")), np.asarray(part.column("weight"))
                if not visit[lo]:
                    state["node"].append(node), state["weight"].append(weight), state["x"].append(x)
                    continue
                settle()
                if not state.get("ready"):
                    continue
                for at in range(0, len(x), BLOCK):
                    a, b = pairs(x[at : at + BLOCK], state["x"])
                    a += at
                    np.add.at(state["count"], b, weight[a])
                    got = np.bincount(a, weights=state["weight"][b], minlength=len(x)).astype(np.int64)
                    has = np.flatnonzero(got)
                    ties = [(i, unite(found.tolist())) for i, found in grouped(a, b)]
                    if len(has):
                        yield batch_of([node[has], node[[i for i, _ in ties]]], [None, state["node"][[j for _, j in ties]]], [got[has], np.zeros(len(ties), np.int64)])
        if (out := finish()) is not None:
            yield out

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id: str = "vec_id", vec: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """One row per vector: id, n_links (other vectors at a cosine of at least `threshold`), component_id, kept.

    component_id is the smallest id reachable by links, the own included; kept is id = component_id.
    Null, empty and zero vectors and those with null or non-finite components link with nothing, and
    vectors of different lengths don't link. Rows equal in id and vector are one vector. Rows with a null id link with
    nothing: each has no links, a null component_id and kept false.
    """
    spark = vectors.sparkSession
    scratch = C.Scratch(spark)
    key = F.when(F.col("data").isNotNull(), F.sha2("data", 256))
    rows = scratch.save(usable(vectors.where(F.col(id).isNotNull()), id, vec).withColumn("key", key).dropDuplicates(["id", "key"]))
    # one node per distinct vector, named by its smallest id
    nodes = scratch.save(rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("weight"), F.first("data").alias("data"), F.first("dim").alias("dim")))
    # an id that repeats with other vectors may name two nodes; numbers tell them apart
    nodes = scratch.save(nodes.withColumn("first", F.col("node")).withColumn("node", F.xxhash64("key")))
    none = vectors.where(F.col(id).isNull()).select(F.col(id), F.lit(0).cast("long").alias("n_links"), F.col(id).alias("component_id"), F.lit(False).alias("kept"))
    found = None
    for r in nodes.select("dim").distinct().collect():
        part = range_links(nodes.where(F.col("dim") == r.dim).select("node", "weight", "data"), threshold, chunk)
        found = part if found is None else found.unionByName(part)
    empty = spark.createDataFrame([], "node long, other long, weight long")
    found = scratch.save(empty if found is None else found)
    counts = found.where(F.col("other").isNull()).groupBy("node").agg(F.sum("weight").alias("others"))
    roots = C.components(found.where(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b")))
    of = scratch.save(nodes.select("key", "node", "first", "weight").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = scratch.save(of.groupBy("root").agg(F.min("first").alias("component_id")))
    of = scratch.save(C.lookup(of, least, "root").select("key", "component_id", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    # unusable vectors have no key, and copies of one vector share theirs
    out = C.lookup(rows.select("id", "key"), of, "key")
    return out.select(
        F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), (F.col("id") == F.coalesce("component_id", "id")).alias("kept")
    ).unionByName(none)
