"""Hard negatives: for every anchor and each of its best rows of the same label, the best rows of another label
whose scores lie between two shares of that positive's score.

Each anchor is scored against every row, and each shard's scores are sorted by score and id. A first pass takes
the positives, the best rows of the anchor's label; a second one finds every positive's upper limit in the sorted
scores by binary search and reads the rows of other labels from there on, down to the lower limit. What shards
have is merged by a task, then by anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscan.llm import common as C
from leakscan.llm import dense

FACTOR = 256
#: Anchors scored together.
STEP = 64
#: A negative's score lies between these shares (percent) of its positive's.
LEAST_SHARE, MOST_SHARE = 50, 95

_COLUMNS = "anchor_id long, anchor_row long, slot int, id long, row long, score long"


def _sorted(shard: dict, block: dict):
    """For each anchor j of the block and a shard of its dimension: j, then scores, positions by score and id, and the labels."""
    x, ids, rows, labels = dense.matrix(shard), dense.ranks(shard["ids"]), np.array(shard["rows"], np.int64), np.array(shard["labels"], np.int64)
    own = [j for j, d in enumerate(block["dims"]) if d == shard["dim"]]
    for lo in range(0, len(own), STEP):
        part = own[lo : lo + STEP]
        scores = dense.products(x, np.stack([block["v"][j] for j in part]))
        for c, j in enumerate(part):
            score = np.ascontiguousarray(scores[:, c])
            yield j, score, np.lexsort((rows, ids, -score)), ids, rows, labels


def _merge(held: dict, key, new: tuple, k: int) -> None:
    old = held.get(key)
    if old is not None:
        new = tuple(np.concatenate(p) for p in zip(old, new, strict=True))
    best = np.lexsort((new[2], new[1], -new[0]))[:k]
    held[key] = tuple(p[best] for p in new)


def _scan(shared, visit):
    """Arrow function over shards: visit(block, j, score, order, ids, rows, labels, held) fills held[(j, slot)]."""

    def run(batches):
        block, held = shared.value, {}
        for batch in batches:
            for i in range(batch.num_rows):
                for found in _sorted(batch.slice(i, 1).to_pylist()[0], block):
                    visit(block, *found, held)
            C.release()
        keys = [(key, h) for key, h in held.items() if len(h[0])]
        for lo in range(0, len(keys), 10_000):
            part = keys[lo : lo + 10_000]
            size = [len(h[0]) for _, h in part]
            ids = np.concatenate([h[1] for _, h in part])
            of = lambda values: pa.array(np.repeat(values, size))  # noqa: E731, B023
            cols = [of([block["ids"][j] for (j, _), _ in part]), of([block["rows"][j] for (j, _), _ in part]), of(np.array([s for (_, s), _ in part], np.int32)), pa.array(ids, mask=ids == np.iinfo(np.int64).max)]
            cols += [pa.array(np.concatenate([h[i] for _, h in part])) for i in (2, 0)]
            yield pa.RecordBatch.from_arrays(cols, ["anchor_id", "anchor_row", "slot", "id", "row", "score"])

    return run


def _positives(k: int):
    def visit(block, j, score, order, ids, rows, labels, held):
        like = order[(labels[order] == block["labels"][j]) & (rows[order] != block["rows"][j])][:k]
        _merge(held, (j, 0), (score[like], ids[like], rows[like]), k)

    return visit


def _negatives(k: int, least: int, most: int):
    def visit(block, j, score, order, ids, rows, labels, held):
        unlike = order[labels[order] != block["labels"][j]]
        falling = -score[unlike]  # ascending
        for slot, positive in enumerate(block["scores"][j]):
            at = int(np.searchsorted(falling, -(most * positive // 100), side="left"))
            read = unlike[at : at + k]
            read = read[100 * score[read] >= least * positive]
            if len(read):
                _merge(held, (j, slot), (score[read], ids[read], rows[read]), k)

    return visit


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each (anchor, slot) over all tasks, with rank."""
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _passes(index: DataFrame, anchors: DataFrame, dim: int, visit) -> DataFrame | None:
    spark, out = index.sparkSession, None
    for block in dense.blocks(anchors, anchors.count(), dim):
        value = {"ids": block["id"].to_pylist(), "rows": block["row"].to_pylist(), "labels": block["label"].to_pylist(), "dims": block["dim"].to_pylist(), "v": [np.frombuffer(v, np.int32) for v in block["v"].to_pylist()]}
        if "scores" in block.column_names:
            value["scores"] = block["scores"].to_pylist()
        shared = spark.sparkContext.broadcast(value)  # at most about BLOCK_VALUES components
        part = C.Scratch(spark).save(index.mapInArrow(_scan(shared, visit), _COLUMNS))
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, k: int = 3, id: str = "vec_id", vec: str = "embedding", label: str = "label", factor: int = FACTOR, least: int = LEAST_SHARE, most: int = MOST_SHARE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every row where `is_anchor` holds and each of its
    first `positives` other rows of its label, the first k rows (all, if fewer) of other labels with
    least * positive_score <= 100 * negative_score <= most * positive_score.

    Scores are inner products of floor(factor * x); higher ones come first, ties by smaller id, null ids last. Ids and labels are
    whole numbers. Rows with a null label, a null vector or null or non-finite components take no part; a row with a null id is
    no anchor; vectors of different lengths don't meet. Repeated rows are rows. A pair without negatives has no row. Products
    that may not fit 64 bits are an error.
    """
    spark = vectors.sparkSession
    own = vectors.where(F.col(label).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vec).alias("vec"), (F.coalesce(is_anchor, F.lit(False)) & F.col(id).isNotNull()).alias("anchor"))
    table, n, dim = dense.numbered(dense.integers(own, "id", "vec", factor, ("label", "anchor")))
    index = dense.shards(table, n, dim, more=("label",))
    anchors = table.where("anchor").select("id", "row", "label", "dim", "v")
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    found = _passes(index, anchors, dim, _positives(positives))
    if found is None:
        return none
    like = C.Scratch(spark).save(_best(found, positives).select("anchor_row", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = like.groupBy("anchor_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))  # at most `positives`
    asked = C.Scratch(spark).save(anchors.join(scores, anchors["row"] == scores["anchor_row"]).drop("anchor_row"))
    found = _passes(index, asked, dim, _negatives(k, least, most))
    if found is None:
        return none
    out = _best(found, k).join(like, ["anchor_row", "slot"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
