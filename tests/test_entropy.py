import math
import random

from pyspark.sql import functions as F

from leakscan.functions import text


def brute(s):
    n = len(s.encode("utf-16-le")) // 2
    counts = {}
    for c in s:
        counts[c] = counts.get(c, 0) + 1
    out = 0.0
    for k in counts.values():
        out -= k / n * math.log2(k / n)
    return out


def test_entropy_of_short_and_long_values(spark):
    rng = random.Random(1)
    own = ["", "a", "aa", "a\U0001f600b", "x" * 64, "x" * 65, "ab" * 200]
    own += ["".join(rng.choice("abcXYZ019é中\U0001f600/+=") for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    own += ["".join(chr(0x4E00 + rng.randrange(6000)) for _ in range(20_000))]  # thousands of distinct characters
    rows = spark.createDataFrame([(s,) for s in own] + [(None,)], "s string").repartition(3).select("s", text.entropy(F.col("s")).alias("e")).collect()
    assert len(rows) == len(own) + 1
    for r in rows:
        assert r.e is None if r.s is None else abs(r.e - brute(r.s)) < 1e-12
