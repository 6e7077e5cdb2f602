"""Maximal periodic runs of words, found on a harmonic grid.

For each period p, positions jp and (j+1)p of a text are asked how far they agree forward and backward: a
run of at least two periods covers two such neighbours, and both answers give its ends. The answers are
longest common extensions: minima over ranges of the common prefixes of neighbours in a suffix array, of
the text for what lies ahead and of the reversed text for what lies behind. Over all periods the grid of n
words has about n ln n points, of which only those whose words are equal are asked.

Texts of a slice share one suffix array: symbols of different texts differ, and every text is fenced by
symbols that occur once, so nothing reaches from one text into another. Memory is bounded by a slice, or
by one very long text, at some 200 bytes a word.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscan.llm import common as C

#: The shortest run.
LEAST = 12
#: Grid points handled at a time.
POINTS = 1 << 20

RUN = T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")])


# --- longest common extensions ------------------------------------------------------------------


def _named(symbols: np.ndarray) -> list[np.ndarray]:
    """levels[k][i] names the 2**k symbols from i on, in their order, until all names differ.

    A name is the number of smaller suffixes, so the last level is the inverse of the suffix array. Only
    positions that share their name are sorted again; they hold no fence, so what follows them exists.
    """
    n = len(symbols)
    _, inverse, counts = np.unique(symbols, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[inverse].astype(np.int32)
    levels, size = [rank], 1
    while True:
        shared = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(shared):
            return levels
        key = rank[shared].astype(np.int64) * n + rank[shared + size]
        order = np.argsort(key, kind="stable")
        key, at = key[order], shared[order]
        place = np.arange(len(at))
        opens = lambda x: np.maximum.accumulate(np.where(np.append(True, x[1:] != x[:-1]), place, 0))
        fresh = rank.copy()
        fresh[at] = rank[at] + (opens(key) - opens(rank[at]))
        rank, size = fresh, size * 2
        levels.append(rank)


class Extensions:
    """Longest common extensions of positions of one text, ahead of both."""

    def __init__(self, symbols: np.ndarray, longest: int):
        levels = _named(symbols)
        self.rank, n = levels[-1], len(symbols)
        array = np.empty(n, np.int32)
        array[self.rank] = np.arange(n, dtype=np.int32)
        a, b, common = array[:-1], array[1:], np.zeros(n - 1, np.int32)
        for k in range(len(levels) - 1, -1, -1):
            common += np.where(levels[k][a + common] == levels[k][b + common], np.int32(1 << k), np.int32(0))
        del levels
        #: minima[k][i] is the least of the 2**k common prefixes from i on; suffixes of one text lie together
        self.minima, width = [common], 1
        while width * 2 <= longest:
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on are equal; i and j differ."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.minima[k][lo[own]], self.minima[k][hi[own] - (1 << k)])
        return out


# --- runs ---------------------------------------------------------------------------------------


def _grid(lengths: np.ndarray):
    """Blocks (text, p, j) of grid points: all j with (j + 1) p inside the text, for every p of at most half its length."""
    periods = lengths // 2
    text = np.repeat(np.arange(len(lengths)), periods)
    p = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = (lengths[text] - 1) // np.maximum(p, 1)
    ends, at = np.cumsum(points), 0
    while at < len(text):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + POINTS, side="right")))
        own = points[at:to]
        yield np.repeat(text[at:to], own), np.repeat(p[at:to], own), np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        at = to


def find(codes: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs of texts that lie one after another, by text, start and period.

    codes: word numbers; offsets: where texts begin, and the end.
    """
    lengths = np.diff(offsets)
    texts, words = len(lengths), int(codes.max(initial=0)) + 1
    # a fence before every text and one behind the last
    symbols = np.empty(len(codes) + texts + 1, np.int64)
    begin = offsets[:-1] + np.arange(texts) + 1
    owner = C.rows_of(offsets)
    symbols[np.arange(len(codes)) + owner + 1] = owner * words + codes
    symbols[np.append(begin - 1, len(symbols) - 1)] = texts * words + np.arange(texts + 1)
    longest, n = int(lengths.max(initial=0)), len(symbols)
    if longest < max(2, least):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    lo, hi, of, period = ([np.zeros(0, np.int64)] for _ in range(4))
    for text, p, j in _grid(lengths):
        a = begin[text] + j * p
        same = symbols[a] == symbols[a + p]
        lo.append(a[same]), hi.append((a + p)[same]), of.append(text[same]), period.append(p[same])
    lo, hi, of, period = (np.concatenate(x) for x in (lo, hi, of, period))
    ends = hi + Extensions(symbols, longest).ahead(lo, hi)
    # i - 1 is at n - i in the reversed text; nothing lies before a text's first word
    within = np.flatnonzero(lo > begin[of])
    starts = lo.copy()
    starts[within] -= Extensions(symbols[::-1], longest).ahead(n - lo[within], n - hi[within])
    ok = ends - starts >= np.maximum(2 * period, least)
    of, starts, ends, period = of[ok], starts[ok], ends[ok], period[ok]
    # a run is met once a grid point, and with multiples of its period: the smallest is its own
    order = np.lexsort((period, ends, starts))
    of, starts, ends, period = (x[order] for x in (of, starts, ends, period))
    first = np.append(True, (starts[1:] != starts[:-1]) | (ends[1:] != ends[:-1])) if len(starts) else np.zeros(0, bool)
    of, starts, ends, period = of[first], starts[first], ends[first], period[first]
    order = np.lexsort((period, starts))
    return of[order], (starts - begin[of])[order], (ends - starts)[order], period[order]


def kept(offsets: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each word stays: it goes if a run contains it after the run's first period."""
    change = np.zeros(offsets[-1] + 1, np.int64)
    np.add.at(change, offsets[text] + start + period, 1)
    np.add.at(change, offsets[text] + start + length, -1)
    return np.cumsum(change)[:-1] == 0


def periodic_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, edit: Callable | None = None) -> DataFrame:
    """Per row of `docs`: id, n_words, runs (array of start, length, period by start and period) and collapsed, the text's words
    without what its runs repeat, joined by one space.

    Words are what is between ASCII white space; n_words is their number. A run is a stretch of at least `least` words and two
    of its smallest period q, words q apart being equal, that no neighbouring word extends. `edit` maps (id, number of words) to
    the numbers of the words to be read in their places, or None. A null or blank text has no words, no runs and an empty
    collapsed text; repeated rows and null ids are rows like others.
    """

    def fn(batch, texts):
        offsets, flat = C.words(texts)
        if edit is not None:
            at, changed = np.arange(offsets[-1]), False
            for i, key in enumerate(batch.column("id").to_pylist()):
                if (own := edit(key, int(offsets[i + 1] - offsets[i]))) is not None:
                    at[offsets[i] : offsets[i + 1]], changed = offsets[i] + own, True
            flat = flat.take(pa.array(at)) if changed else flat
        codes, _ = C.coded(flat)
        of, start, length, period = find(codes, offsets, least)
        stay = kept(offsets, of, start, length, period)
        rest = np.append(0, np.cumsum(stay))[offsets]
        cuts = np.searchsorted(of, np.arange(len(offsets))).astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], RUN.names))
        return {"n_words": pa.array(np.diff(offsets)), "runs": runs, "collapsed": C.joined(rest, flat.filter(pa.array(stay))).cast(pa.string())}

    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    own = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return C.add_columns(own, "text", fields, fn, drop=("text",)).withColumnRenamed("id", id)


def longest(runs: Column) -> Column:
    """The longest of an array of runs; of equals the one that starts first, then of the smallest period; null without any."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period")))


def listed(runs: Column) -> Column:
    """One line start,length,period for every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
