"""Points in intervals: a range join on equal keys and bins.

An interval goes to bins of its own size class, the least power of two that is no shorter than it, so it overlaps
one bin or two; a point goes to its bin of every size class that occurs, at most 64 of them. No interval is paired
with a point that is further away than a bin, long and short intervals mix freely, and no bin width has to be chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bin is hot if it holds over one of HOT of all placed points: there are fewer than HOT such bins.
HOT = 1000
#: Parts of a hot bin's points; its intervals go to each.
PARTS = 16


def _size(lo: Column, hi: Column) -> Column:
    """The size class: bins of 2**size units, no shorter than the interval."""
    return F.ceil(F.log2((hi - lo + 1).cast("double"))).cast("int")


def _bin(at: Column, size: Column) -> Column:
    return F.call_function("shiftright", at, size)


def locate(points: DataFrame, intervals: DataFrame, on: list[str], pos: str, lo: str, hi: str) -> DataFrame:
    """All columns of `points` and `intervals` (those of `on` once) of every point within an interval of its key: lo <= pos <= hi.

    pos, lo and hi are whole numbers. Null keys, positions and bounds meet nothing, nor does an interval that ends before it
    begins. Repeated rows meet each. Other columns of the two tables must differ in name. `points` is read three times.
    """
    a, b, at = F.col(lo).cast("long"), F.col(hi).cast("long"), F.col(pos).cast("long")
    keys = [F.col(c).alias(f"key{i}") for i, c in enumerate(on)]
    own = intervals.select(*keys, F.struct(*[c for c in intervals.columns if c not in on]).alias("interval"), a.alias("lo"), b.alias("hi"))
    rows = points.select(*keys, F.struct(*[c for c in points.columns if c not in on]).alias("point"), at.alias("pos"))
    keys = [f"key{i}" for i in range(len(on))]
    own, rows = own.dropna(subset=[*keys, "lo", "hi"]).where("lo <= hi"), rows.dropna(subset=[*keys, "pos"])
    # beyond 2**61 units a bin is half the line
    a, b = F.col("lo"), F.col("hi")
    own = own.withColumn("size", F.when((a < -(2**61)) | (b > 2**61), 62).otherwise(_size(a, b)))
    own = own.withColumn("bin", F.explode(F.sequence(_bin(a, F.col("size")), _bin(b, F.col("size")))))  # one or two, four of the whole line
    sizes = [r[0] for r in own.select("size").distinct().collect()]  # at most 64
    places = F.array(*[F.struct(F.lit(s).alias("size"), _bin(F.col("pos"), F.lit(s)).alias("bin")) for s in sizes]) if sizes else F.array().cast("array<struct<size:int,bin:bigint>>")
    total = rows.count() * max(1, len(sizes))
    rows = rows.select(*keys, "point", "pos", F.inline(places))
    keys += ["size", "bin"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(counts.where(F.col("n") * HOT > total).select(*keys, F.lit(True).alias("hot")))  # fewer than HOT rows
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    own = own.join(hot, keys, "left").withColumn("part", F.explode(parts)).drop("hot")
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("point"), F.lit(PARTS)).cast("int")).otherwise(0)
    rows = rows.join(hot, keys, "left").withColumn("part", part).drop("hot")
    out = rows.join(own, [*keys, "part"]).where("pos between lo and hi")
    return out.select(*[F.col(f"key{i}").alias(c) for i, c in enumerate(on)], "point.*", "interval.*")
