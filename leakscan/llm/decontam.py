"""Benchmark decontamination by winnowing.

A window is 13 consecutive item words. Every 9 consecutive 5-gram hashes elect their least, so any
shared span of 13 words elects the same 5-gram on both sides. Elected hashes of items and documents
are joined, and each hit is extended word by word against the item's words around it: the windows that
hold the elected 5-gram and agree in full are hits. Items of fewer than 13 words are one window each;
they are looked up by the hash of all their words at every document position, since winnowing
guarantees nothing that short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscan.llm import common as C

WINDOW = 13
GRAM = 5
#: Elected item hashes up to which the item side of the join is broadcast (32 bytes and up to 168 of words each).
BROADCAST_ROWS = 200_000
#: Least and most cells, as powers of two, of the bitmap that spares the join most document hashes: 512 KB to 128 MB.
BITMAP_BITS, MAX_BITMAP_BITS = 22, 30
#: Item hashes up to which the bitmap is filled on the driver; beyond, it lets all through.
LISTED_ROWS = 10_000_000
#: Contaminated rows' keys (8 bytes each) up to which they are broadcast.
BROADCAST_KEYS = 1_000_000


def _elected(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions of the 5-grams that some window of 13 words elects."""
    starts = C.window_starts(offsets, WINDOW)
    return np.unique(C.leftmost_min(C.grams(h, GRAM), WINDOW - GRAM + 1)[starts]) if len(starts) else starts


def _short(h: np.ndarray, length: int) -> np.ndarray:
    return C.mix(C.grams(h, length) ^ np.uint64(length))


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, flat = C.words(C.translate(texts, C.ALNUM))
    return offsets, C.word_hashes(flat)


def index(items: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """(fp, item, at, size, words): an elected hash, its item, its place among `words`, the hashes of the item's
    words around it, and how many of them make a window. Items without words or text have no row."""

    def run(batches):
        for batch, texts in C.slices(batches, text):
            offsets, h = _hashed(texts)
            rows, fps, ats, sizes, ctx = [], [], [], [], []
            owner = C.rows_of(offsets)
            for p in _elected(h, offsets).tolist():
                r = owner[p]
                lo, hi = max(offsets[r], p - (WINDOW - GRAM)), min(offsets[r + 1], p + WINDOW)
                rows.append(r), ats.append(p - lo), sizes.append(WINDOW), ctx.append(h[lo:hi].tobytes())
                fps.append(int(C.grams(h[p : p + GRAM], GRAM)[0].astype(np.int64)))
            for r in np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < WINDOW)).tolist():
                own = h[offsets[r] : offsets[r + 1]]
                rows.append(r), ats.append(0), sizes.append(len(own)), ctx.append(own.tobytes())
                fps.append(int(_short(own, len(own))[0].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), batch.column(id).take(pa.array(rows, pa.int64())), pa.array(ats, pa.int32()), pa.array(sizes, pa.int32()), pa.array(ctx, pa.binary())], ["fp", "item", "at", "size", "words"])

    schema = T.StructType([T.StructField("fp", T.LongType()), T.StructField("item", items.schema[id].dataType), T.StructField("at", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("words", T.BinaryType())])
    return items.select(id, text).mapInArrow(run, schema).distinct()


def _bitmap(bench: DataFrame, n: int) -> np.ndarray:
    """Which cells hold an item hash; all of them where the benchmark is too large to list."""
    bits = int(min(MAX_BITMAP_BITS, max(BITMAP_BITS, np.ceil(np.log2(64 * n + 1)))))
    if n > LISTED_ROWS:
        return np.full(1, 255, np.uint8)
    cells = np.asarray(bench.select(F.col("fp").bitwiseAND(F.lit((1 << bits) - 1)).alias("c")).distinct().toArrow()["c"], dtype=np.int64)
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    np.bitwise_or.at(out, cells >> 3, (1 << (cells & 7)).astype(np.uint8))
    return out


def _prints(shared, lengths: list[int]):
    """add_columns function: n_words, and what may be an item's hash (fp, pos, words around, words before)."""

    def fn(_, texts):
        bitmap = shared.value
        offsets, h = _hashed(texts)
        owner = C.rows_of(offsets)
        at = [_elected(h, offsets)]
        fp = [C.grams(h, GRAM)[at[0]]] if len(at[0]) else [np.zeros(0, np.uint64)]
        for size in lengths:
            own = C.window_starts(offsets, size)
            at.append(own)
            fp.append(_short(h, size)[own] if len(own) else np.zeros(0, np.uint64))
        at, fp = np.concatenate(at), np.concatenate(fp)
        cell = fp & np.uint64(8 * len(bitmap) - 1)
        ok = np.flatnonzero(bitmap[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8) & 1)
        at, fp = at[ok], fp[ok]
        row = owner[at]
        order = np.argsort(row, kind="stable")
        at, fp, row = at[order], fp[order], row[order]
        lo, hi = np.maximum(offsets[row], at - (WINDOW - GRAM)), np.minimum(offsets[row + 1], at + WINDOW)
        near = [h[i:j].tobytes() for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
        found = pa.StructArray.from_arrays([pa.array(fp.view(np.int64)), pa.array((at - offsets[row]).astype(np.int32)), pa.array((at - lo).astype(np.int32)), pa.array(near, pa.binary())], ["fp", "pos", "before", "near"])
        per = np.searchsorted(row, np.arange(len(offsets))).astype(np.int32)
        return {"n_words": pa.array(np.diff(offsets)), "prints": pa.ListArray.from_arrays(pa.array(per), found)}

    return fn


def _extend(batches):
    """Each hit's agreeing runs of at least a window: row, item, begin, end."""
    for batch in batches:
        out = []
        for row, item, pos, before, near, at, size, words in zip(*(batch.column(k).to_pylist() for k in ("row", "item", "pos", "before", "near", "at", "size", "words")), strict=True):
            doc, own = np.frombuffer(near, np.uint64), np.frombuffer(words, np.uint64)
            shift = before - at  # from the item's words to the document's
            lo, hi = max(0, -shift), min(len(own), len(doc) - shift)
            if hi - lo < size:
                continue
            same = np.zeros(len(own) + 2, np.int8)
            same[lo + 1 : hi + 1] = doc[lo + shift : hi + shift] == own[lo:hi]
            edges = np.flatnonzero(np.diff(same))
            out += [(row, item, pos - at + a, pos - at + b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= size]
        rows, items, begin, end = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(items, pa.string()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["row", "item", "begin", "end"])


def contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Per row of `docs`: id, row_key, n_words, n_hit, n_items, item_ids (sorted as strings) and contaminated
    (n_hit > 0 and 20 * n_hit >= n_words). row_key is xxhash64 of id and text.

    Words are lower-cased runs of letters, digits and non-ASCII characters; a null or wordless text has
    none and is clean. A document word inside any occurrence of a window is hit. Repeated items and
    rows change nothing; items that share an id count once, items without an id hit words but aren't listed.
    Other columns are neither read nor returned.

    Texts are read once and never shuffled: what meets the items are the elected hashes that a bitmap of
    item hashes lets through, each with the words around it.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    bench = scratch.save(index(items, item_id))
    n = bench.count()
    lengths = sorted(r[0] for r in bench.where(F.col("size") < WINDOW).select("size").distinct().collect())  # at most twelve
    shared = spark.sparkContext.broadcast(_bitmap(bench, n))
    kind = T.ArrayType(T.StructType([T.StructField("fp", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("before", T.IntegerType()), T.StructField("near", T.BinaryType())]))
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(id, text).alias("row_key"))
    own = C.add_columns(own, "text", [T.StructField("n_words", T.LongType()), T.StructField("prints", kind)], _prints(shared, lengths), drop=("text",))
    own = scratch.save(own.withColumn("row", F.monotonically_increasing_id()))
    prints = own.select("row", F.inline("prints"))
    hits = prints.join(F.broadcast(bench) if n <= BROADCAST_ROWS else bench, "fp").withColumn("item", F.col("item").cast("string"))
    runs = hits.select("row", "item", "pos", "before", "near", "at", "size", "words").mapInArrow(_extend, "row long, item string, begin int, end int").distinct()
    # words under overlapping runs count once
    step = lambda a, r: F.struct(F.greatest(a["end"], r["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(a["end"], r["begin"]))).alias("n"))
    union = F.aggregate(F.array_sort(F.collect_set(F.struct("begin", "end"))), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"]
    per = runs.groupBy(F.col("row").alias("hit_row")).agg(union.cast("long").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("item_ids"))
    out = own.select("row", "id", "row_key", "n_words").join(per, F.col("row") == F.col("hit_row"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id), "row_key", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that are not contaminated, as they are."""
    bad = C.Scratch(docs.sparkSession).save(contamination(docs.select("doc_id", "text"), items).where("contaminated").select(F.col("row_key").alias("key")).distinct())
    small = bad.count() <= BROADCAST_KEYS
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", "text").alias("key"))
    return rows.join(F.broadcast(bad) if small else bad, "key", "left_anti").select("doc.*")
