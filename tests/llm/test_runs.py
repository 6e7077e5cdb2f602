import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscan.llm import runs as R
from leakscan.llm.queries import planted


def brute(words, least=12):
    """(start, length, smallest period) of every run, by comparing all words p apart."""
    out = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(rng.randrange(1, 7)):
        n, kinds = rng.choice([0, 1, 2, 5, 12, 30, 90]), rng.choice([1, 2, 3, 8])
        t = [rng.randrange(kinds) for _ in range(n)]
        if n > 20 and rng.random() < 0.5:
            a, p = rng.randrange(n // 2), rng.randrange(1, 9)
            t = [t[a + (i - a) % p] if i >= a else x for i, x in enumerate(t)]
        out.append(t)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_find_equals_brute_force(seed):
    own = texts(seed)
    offsets = np.cumsum([0, *map(len, own)])
    of, start, length, period = R.find(np.array(sum(own, []), np.int64), offsets, least := random.Random(seed).choice([2, 4, 12]))
    stay = R.kept(offsets, of, start, length, period)
    for i, t in enumerate(own):
        found = [(int(s), int(n), int(p)) for o, s, n, p in zip(of, start, length, period, strict=True) if o == i]
        assert found == brute(t, least)
        assert " ".join(str(w) for w, k in zip(t, stay[offsets[i] : offsets[i + 1]], strict=True) if k) == collapsed([str(w) for w in t], found)


def test_grid_in_several_blocks(monkeypatch):
    monkeypatch.setattr(R, "POINTS", 7)
    t = [1, 2, 3] * 20 + [4] * 15
    assert [tuple(map(int, x)) for x in zip(*R.find(np.array(t), np.array([0, len(t)]))[1:], strict=True)] == brute(t)


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "x " * 40), (5, "x " * 40), (None, "a b c d " * 5), (7, "É ß É ß É ß É ß É ß É ß É ß"), (8, "q " + "u v w " * 4 + "z")]
    out = R.periodic_runs(spark.createDataFrame([(*r, "n", 1.5) for r in rows], "doc_id long, text string, runs string, N_words double").repartition(3))
    got = sorted(((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in out.collect()), key=repr)
    want = []
    for i, t in rows:
        w = (t or "").split()
        want.append((i, len(w), tuple(brute(w)), collapsed(w, brute(w))))
    assert got == sorted(want, key=repr) and out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    best = out.where("doc_id = 8").select(R.longest(F.col("runs")).alias("r"), R.listed(F.col("runs")).alias("t")).first()
    assert tuple(best.r) == (1, 12, 3) and best.t == "1,12,3\n"
    assert R.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_longest_breaks_ties(spark):
    runs = spark.createDataFrame([([(9, 20, 2), (3, 20, 5), (3, 20, 4), (0, 12, 1)],), ([],)], "runs array<struct<start:long,length:long,period:long>>")
    assert [r[0] and tuple(r[0]) for r in runs.select(R.longest(F.col("runs"))).collect()] == [(3, 20, 4), None]


def test_planted_words():
    hit = [i for i in range(400) if planted(i, 50) is not None]
    assert 20 < len(hit) < 60 and planted(hit[0], 0) is None and planted(None, 50) is None
    at = planted(hit[0], 50)
    assert len(at) == 50 and (at <= np.arange(50)).all()
