"""Keywords in texts where the keywords are a table: an index of grams joined by equality, then verified.

A rule set's keywords are few and known to the driver, and `rules.keyword_hits` searches for them within a row. A table of
keywords may be any size: each is listed under one of its grams, the one that fewest keywords share, and a text looks up its own.
A gram is as long as the keyword allows, so that it stays rare however many keywords there are, and a bit map of bounded size that
the tasks hold spares a text's other grams the join. What a text costs follows its length and its hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscan.sources.state import written

#: A gram's length in bytes: the largest of these that the keyword has.
SIZES = (1, 2, 4, 8, 16, 32)
#: An index this large is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: The bit map: so many bits a keyword, and at most 2**MOST_BITS (32 MB).
BITS_A_KEYWORD, MOST_BITS = 32, 28
#: Bytes of text hashed together.
SLICE = 1 << 20

_PIECE = 1 << 15  # bits of one of Spark's bitmaps
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def _slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of the strings of a column, some rows at a time."""
    own = column.cast(pa.large_binary())
    ends, data = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1], own.buffers()[2]
    flat, row = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), 0
    while row < len(own):
        to = max(row + 1, int(np.searchsorted(ends, ends[row] + SLICE, "right")) - 1)
        yield row, ends[row : to + 1] - ends[row], flat[ends[row] : ends[to]]
        row = to


def _hashes(offsets: np.ndarray, flat: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all grams of q bytes within a row."""
    if len(flat) < q:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, n, k = flat.astype(np.uint64) + np.uint64(1), 1, 0
    while n < q:  # twice the length at each step
        h = h[:-n] * _ODD[k] + h[n:]
        h ^= h >> np.uint64(29)
        n, k = 2 * n, k + 1
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(h)]
    inside = np.arange(len(h)) + q <= offsets[row + 1]
    return row[inside], h[inside] * _ODD[-1] + np.uint64(q)


def _cell(h: np.ndarray, bits: int, k: int) -> np.ndarray:
    """One of the two places of a hash in the bit map."""
    h = (h ^ (h >> np.uint64(31))) * _ODD[k]
    return ((h ^ (h >> np.uint64(29))) * _ODD[k + 2] >> np.uint64(64 - bits)).view(np.int64)


def _size(text: Column) -> Column:
    """The length of a keyword's grams."""
    return F.greatest(*[F.when(F.octet_length(text) >= q, q).otherwise(0) for q in SIZES])


def index(keywords: DataFrame) -> DataFrame:
    """(keyword, size, gram) of the distinct keywords, lower-cased; null and empty ones are left out. gram is the hash of the gram of
    `size` bytes that fewest keywords share."""

    def grams(batches):
        for b in batches:
            for first, offsets, flat in _slices(b.column(0)):
                size = b.column(1).to_numpy()[first : first + len(offsets) - 1]
                for q in np.unique(size):
                    row, h = _hashes(offsets, flat, int(q))
                    row, h = row[size[row] == q], h[size[row] == q]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first + row)), b.column(1).take(pa.array(first + row)), pa.array(h.view(np.int64))], ["keyword", "size", "gram"])

    own = keywords.select(F.lower("keyword").alias("keyword")).where("keyword <> ''").distinct()
    each = own.select("keyword", _size(F.col("keyword")).alias("size")).mapInArrow(grams, "keyword string, size int, gram long")
    shared = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return each.join(shared.hint("merge"), "gram").groupBy("keyword", "size").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))


def _bitmap(listed: DataFrame, bits: int) -> np.ndarray:
    """The cells of all listed grams, at most 2**MOST_BITS bits; Spark makes it in pieces."""

    def cells(batches):
        for b in batches:
            for k in (0, 1):
                cell = _cell(b.column(0).to_numpy().view(np.uint64), bits, k)
                yield pa.RecordBatch.from_arrays([pa.array(cell + 1)], ["cell"])  # Spark counts from 1

    at = listed.select("gram").mapInArrow(cells, "cell long")
    pieces = at.groupBy(F.bitmap_bucket_number("cell").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in pieces.toLocalIterator():
        out[(r.piece - 1) * _PIECE // 8 : r.piece * _PIECE // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def hits(texts: DataFrame, keywords: DataFrame, text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`texts` without `text`, with keyword: a row for each keyword (column keyword of `keywords`, case-blind) that the text holds.

    Null texts hold none; repeated rows have their rows each; a column of `texts` named keyword gives way. The other columns pass
    through Arrow.
    """
    listed = written(index(keywords))
    n, sizes = listed.agg(F.count(F.lit(1)), F.collect_set("size")).first()  # of SIZES
    bits = min(MOST_BITS, max(15, (BITS_A_KEYWORD * n).bit_length()))
    known = texts.sparkSession.sparkContext.broadcast(_bitmap(listed, bits))
    rest = [c for c in texts.columns if c not in (text, "keyword")]
    rows = texts.where(F.col(text).isNotNull()).select(F.struct(*rest, F.lit(0).alias("none")).alias("rest"), F.lower(text).alias("low"))

    def looked_up(batches):
        """Each row once for every distinct gram of its text that may be listed."""
        bitmap = known.value
        for b in batches:
            for first, offsets, flat in _slices(b.column(1)):
                found = []
                for q in sizes:
                    row, h = _hashes(offsets, flat, q)
                    for k in (0, 1):  # few are left for the second cell
                        cell = _cell(h, bits, k)
                        ok = (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
                        row, h = row[ok], h[ok]
                    found.append((row, h.view(np.int64)))
                if not found:
                    continue
                row, h = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])[: len(row)]
                row, h = row[new], h[new]
                at = pa.array(first + row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(h)], ["rest", "low", "gram"])

    rows = rows.mapInArrow(looked_up, T.StructType([*rows.schema.fields, T.StructField("gram", T.LongType())]))
    found = rows.join(F.broadcast(listed) if n <= broadcast_rows else listed.hint("merge"), "gram").where(F.contains("low", "keyword"))
    return found.select(*[F.col("rest").getField(c).alias(c) for c in rest], "keyword")
