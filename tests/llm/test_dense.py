import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscan.llm import dense, negatives, topk

SCHEMA = "vec_id long, embedding array<float>, label int, query string, id double, row string"


def whole(v, factor):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(factor * float(np.float32(x))) for x in v]


def brute_top(rows, k=10, factor=1024):
    own = [(n, i, e) for n, (i, v, _) in enumerate(rows) if (e := whole(v, factor)) is not None]
    out = []
    for n, i, e in own:
        if i is None or i % 100:
            continue
        found = [(-sum(a * b for a, b in zip(e, f)), j is None, j or 0) for m, j, f in own if m != n and len(f) == len(e)]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def brute_negatives(rows, n_pos=5, k=3, factor=256):
    own = [(n, i, e, l) for n, (i, v, l) in enumerate(rows) if l is not None and (e := whole(v, factor)) is not None]
    out = []
    for n, i, e, l in own:
        if i is None or i % 50:
            continue
        found = sorted((-sum(a * b for a, b in zip(e, f)), j is None, j or 0, x == l) for m, j, f, x in own if m != n and len(f) == len(e))
        for ps, p_none, p, _ in [x for x in found if x[3]][:n_pos]:
            read = [x for x in found if not x[3] and -50 * ps <= -100 * x[0] <= -95 * ps][:k]
            out += [(i, None if p_none else p, r + 1, None if none else j, -ps, -s) for r, (s, none, j, _) in enumerate(read)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    """Clusters, repeated vectors and rows, ties, null ids and labels, odd vectors and two lengths."""
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    out = []
    for i in range(420):
        c = rng.randrange(6)
        v = [x + rng.gauss(0, 0.3) for x in centres[c]]
        n = math.sqrt(sum(x * x for x in v))
        out.append((i * 10, [x / n for x in v], c % 3))
    out += [(i * 50, [0.5, -0.5, 0.25], i % 2) for i in range(6)] + [(5, [0.5, -0.5, 0.25], 0), (5, [0.5, -0.5, 0.25], 0), (None, [0.5, -0.5, 0.25], 1), (300, None, 1), (400, [1.0, None, 2.0], 0), (500, [float("inf")] * 3, 1), (600, [float("nan")] * 8, 1)]
    out += [out[0], out[7], (100, out[30][1], None), (None, out[3][1], 2), (700, [], 0), (800, [], 1), (1000, [0.0] * 8, 1)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.0, "y") for r in rows], SCHEMA).repartition(5)


def test_top_k_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(dense, "SHARD_VALUES", 400)  # several shards a task, several blocks of queries
    monkeypatch.setattr(dense, "BLOCK_VALUES", 160)
    got = sorted(map(tuple, topk.top_k(frame(spark, rows), F.col("vec_id") % 100 == 0).collect()), key=repr)
    assert got == brute_top(rows)


def test_negatives_equal_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(dense, "SHARD_VALUES", 400)
    monkeypatch.setattr(dense, "BLOCK_VALUES", 160)
    monkeypatch.setattr(negatives, "STEP", 7)
    got = sorted(map(tuple, negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()), key=repr)
    want = brute_negatives(rows)
    assert got == want and len(want) > 50


def test_no_rows_and_no_queries(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(none, F.col("vec_id") % 100 == 0).count() == 0 and negatives.hard_negatives(none, F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(100, [1.0, 2.0], 1, "x", 1.0, "y")], SCHEMA)
    assert topk.top_k(one, F.col("vec_id") % 100 == 0).count() == 0 and negatives.hard_negatives(one, F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(one, F.col("vec_id") % 3 == 0).count() == 0


def test_possible_members_stop_on_proof():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(2000, 16)) * 20).astype(np.int32)
    x[:40] = np.round(300 + rng.normal(size=(40, 16)) * 5)  # a cluster that stands out
    order, segments = topk._index(x)
    shard = topk.Shard({"v": x.tobytes(), "dim": 16, "ids": list(range(2000)), "rows": list(range(2000)), "order": order[0].as_py(), "segments": segments[0].as_py()})
    found = shard.possible(x[0].astype(np.int64), 0, None, 10)
    best = np.lexsort((np.arange(2000), -(x.astype(np.int64) @ x[0].astype(np.int64))))[:11]
    assert set(best) - {0} <= set(found.tolist()) and 0 not in found and len(found) <= 125 and shard.taken < x.size


def test_large_components(spark):
    big = [(100, [3e5, -2e5], 1, "x", 1.0, "y"), (1, [3e5, 1e5], 1, "x", 1.0, "y"), (2, [-3e5, 1e5], 1, "x", 1.0, "y")]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(big, SCHEMA), F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert got == brute_top([r[:3] for r in big])
    with pytest.raises(Exception, match="32 bits"):
        topk.top_k(spark.createDataFrame([(100, [1e30], 1, "x", 1.0, "y")], SCHEMA), F.col("vec_id") % 100 == 0).count()
