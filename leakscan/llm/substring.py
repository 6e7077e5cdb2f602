"""Substring dedup: 20-word windows that also start earlier are removed.

1. Every partition sketches its windows in a count-min sketch. A window is counted by its anchor, the
   leftmost least 6-gram hash inside it, once per anchor position: two starts of one window have two
   anchor positions, so an anchor's count never falls short of its window's count, and there are
   about eight times fewer anchors than windows. Partition sketches are merged cell range by cell
   range in a shuffle; one bit per cell ("twice or more") comes back and is broadcast. Its size is
   bounded by 2 * 2**MAX_BITS bits, whatever the input.
2. Only windows whose anchor is estimated at two or more are grouped exactly, by a 96-bit hash of
   their words; the smallest doc_id of each group keeps its first start.
3. Each document drops the words of its other candidate windows.

Beyond about 2**MAX_BITS anchors the sketch filters less and less; nothing is lost then, but more
windows are grouped exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscan.llm import common as C

WINDOW = 20
GRAM = 6
MAX_BITS = 27
#: Cells of one merged piece of the sketch, as a power of two.
PIECE_BITS = 18
ROW_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _anchored(texts: pa.Array):
    """Offsets, words, word hashes, window starts and each start's anchor hash and position."""
    offsets, flat = C.words(texts)
    h = C.word_hashes(flat)
    starts = C.window_starts(offsets, WINDOW)
    g = C.grams(h, GRAM)
    at = C.leftmost_min(g, WINDOW - GRAM + 1)[starts] if len(starts) else np.zeros(0, np.int64)
    return offsets, flat, h, starts, g[at] if len(at) else np.zeros(0, np.uint64), at


def _cells(anchor: np.ndarray, bits: int) -> list[np.ndarray]:
    """One cell per sketch row, the second row's after the first's."""
    return [((anchor * f) >> np.uint64(64 - bits)).astype(np.int64) + (r << bits) for r, f in enumerate(ROW_FACTORS)]


def sketch(docs: DataFrame, text: str) -> np.ndarray:
    """The merged sketch as packed bits: whether a cell was counted twice or more."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = int(min(MAX_BITS, max(PIECE_BITS, np.ceil(np.log2(1 + 8 * total / 48)))))
    per = 1 << PIECE_BITS

    def count(batches):
        parts = []
        for _, texts in C.slices(batches, text):
            _, _, _, _, anchor, at = _anchored(texts)
            if len(at):
                parts.append(anchor[np.concatenate([[True], at[1:] != at[:-1]])])
        if not parts:
            return
        anchors = np.concatenate(parts)
        for cells in _cells(anchors, bits):
            cell, n = np.unique(cells, return_counts=True)
            piece = cell >> PIECE_BITS
            cuts = np.flatnonzero(np.diff(piece)) + 1
            for own, many in zip(np.split(cell, cuts), np.split(n > 1, cuts), strict=True):
                local = (own & (per - 1)).astype(np.uint32)
                yield pa.RecordBatch.from_pydict(
                    {"piece": pa.array([int(own[0]) >> PIECE_BITS]), "cells": pa.array([local.tobytes()], pa.binary()), "many": pa.array([np.packbits(many).tobytes()], pa.binary())}
                )

    def merge(batches):
        now, counts = None, None

        def done():
            return pa.RecordBatch.from_pydict({"piece": pa.array([now]), "bits": pa.array([np.packbits(counts > 1).tobytes()], pa.binary())})

        for b in batches:
            for piece, cells, many in zip(*(b.column(k).to_pylist() for k in ("piece", "cells", "many")), strict=True):
                if piece != now:
                    if now is not None:
                        yield done()
                    now, counts = piece, np.zeros(per, np.uint8)
                at = np.frombuffer(cells, np.uint32)
                add = 1 + np.unpackbits(np.frombuffer(many, np.uint8), count=len(at))
                counts[at] = np.minimum(counts[at] + add, 2)
        if now is not None:
            yield done()

    pieces = docs.select(text).mapInArrow(count, "piece long, cells binary, many binary")
    merged = pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(merge, "piece long, bits binary")
    out = np.zeros((2 << bits) // 8, np.uint8)
    for r in merged.collect():  # at most 2**(MAX_BITS + 1) bits together
        out[r.piece * per // 8 : (r.piece + 1) * per // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _repeated(packed: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Which anchors the sketch estimates at two or more."""
    bits = int(len(packed) * 8).bit_length() - 2
    ok = np.ones(len(anchor), bool)
    for cell in _cells(anchor, bits):
        ok &= (packed[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return ok


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with n_words, n_removed and kept_text, the words left, joined by one space.

    Words are runs of anything but ASCII white space. A window is judged on the input: it goes if its
    words also start at a smaller id, or earlier in its own row. Null texts and texts under 20 words
    lose nothing. Rows that repeat an id count as versions of one document and don't remove each
    other's words. A null id counts as the largest. Input columns named like an output give way.
    """
    spark = docs.sparkSession
    packed = spark.sparkContext.broadcast(sketch(docs, text))

    def candidates(texts):
        offsets, flat, h, starts, anchor, _ = _anchored(texts)
        starts = starts[_repeated(packed.value, anchor)]
        return offsets, flat, h, starts, C.grams(h, WINDOW)[starts].view(np.int64) if len(starts) else np.zeros(0, np.int64)

    def windows(batches):
        for batch, texts in C.slices(batches, text):
            offsets, _, h, starts, key = candidates(texts)
            if len(starts):
                check = (C.grams(C.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), WINDOW)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(check), batch.column(id).take(pa.array(C.rows_of(offsets)[starts]))], ["w", "x", "doc"])

    kind = docs.schema[id].dataType
    fields = T.StructType([T.StructField("w", T.LongType()), T.StructField("x", T.IntegerType()), T.StructField("doc", kind)])
    first = docs.select(id, text).mapInArrow(windows, fields).groupBy("w", "x").agg(F.min("doc").alias("doc"))
    own = first.groupBy(F.col("doc").alias("owner")).agg(F.collect_list("w").alias("own"))
    rows, back = C.apart(docs, text, ["n_words", "n_removed", "kept_text"], id=C.named(id))
    joined = rows.join(own, F.col("id").eqNullSafe(F.col("owner")), "left").select("rest", "text", "own")

    def judge(batch, texts):
        offsets, flat, _, starts, key = candidates(texts)
        rows = C.rows_of(offsets)
        gone = np.zeros(len(flat), bool)
        if len(starts):
            own = batch.column("own")
            of = np.repeat(np.arange(len(own)), np.asarray(pc.fill_null(pc.list_value_length(own), 0)))
            salt = np.uint64(0x9E3779B97F4A7C15)
            kept = C.mix(np.asarray(own.flatten(), dtype=np.int64).view(np.uint64) + of.astype(np.uint64) * salt)
            mine = C.mix(key.view(np.uint64) + rows[starts].astype(np.uint64) * salt)
            distinct, at = np.unique(mine, return_index=True)
            removed = np.ones(len(starts), bool)
            removed[at[np.isin(distinct, kept)]] = False
            cover = np.zeros(len(flat) + 1, np.int64)
            np.add.at(cover, starts[removed], 1)
            np.add.at(cover, starts[removed] + WINDOW, -1)
            gone = np.cumsum(cover[:-1]) > 0
        n = np.diff(offsets)
        lost = np.bincount(rows[gone], minlength=len(n))
        left = C.joined(np.concatenate([[0], np.cumsum(n - lost)]), flat.filter(pa.array(~gone)))
        return {"n_words": pa.array(n), "n_removed": pa.array(lost), "kept_text": left.cast(pa.string())}

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    return back(C.add_columns(joined, "text", fields, judge, drop=("own",)))


def clean(docs: DataFrame) -> DataFrame:
    """`docs` without repeated passages: a text that lost words becomes its kept words, others stay as they are.

    No row goes: a document that was all repetition stays with an empty text. n_chars follows the text.
    """
    own = docs.select(F.struct(*[C.named(c) for c in docs.columns if c != "text"]).alias("doc"), "doc_id", "text")
    out, lost = remove_repeats(own), F.col("n_removed") > 0
    new = {"text": F.when(lost, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(lost, F.length("kept_text").cast("long")).otherwise(F.col("doc.n_chars"))
    return out.select(*[(new[c] if c in new else F.col("doc").getField(c)).alias(c) for c in docs.columns])
