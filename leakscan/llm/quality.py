"""Quality classifier: a factorisation machine over hashed words, structure statistics of the text and metadata columns.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): the pairwise part
takes time linear in the features. The model is fitted on the driver from at most SAMPLE labelled rows'
features; scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscan.llm import common as C

WORD_BITS = 14
RANK = 4
#: Labelled rows that training reads at most, in hash order.
SAMPLE = 6000
EPOCHS = 12
BINS = 12
STATS = ("words", "word length", "upper", "digit", "mark", "word ends in mark", "lone mark", "repeated word", "distinct words", "words a line", "repeated line", "non-ASCII", "length")

_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"?-()"]] = True
_HIGH = np.arange(256) >= 128
#: Metadata columns that are read where the documents have them: numbers, each lights one bin of its logarithm.
METADATA = ("n_chars",)
D = (1 << WORD_BITS) + len(STATS) * BINS + len(METADATA) * (BINS + 1)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return c[offsets[1:]] - c[offsets[:-1]]


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Structure statistics of every row (n by len(STATS), 0 to 1 each), word offsets and hashed words."""
    offsets, flat = C.words(texts)
    n = np.diff(offsets)
    many = np.maximum(n, 1)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    size = np.maximum(np.diff(at), 1)
    lower = C.translate(flat.cast(pa.large_string()), C.LOWER)
    codes, distinct = C.coded(lower)
    ends_in_mark = np.array([bool(w) and _MARK[w[-1]] for w in distinct], bool)[codes] if len(distinct) else np.zeros(0, bool)
    lone = np.array([len(w) == 1 and _MARK[w[0]] for w in distinct], bool)[codes] if len(distinct) else np.zeros(0, bool)
    rows = C.rows_of(offsets)
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])
    kinds = np.bincount(np.unique(rows * max(1, len(distinct)) + codes) // max(1, len(distinct)), minlength=len(n))
    lines = pc.split_pattern(texts, "\n")
    line_at = np.asarray(lines.offsets, dtype=np.int64)
    line_at = line_at - line_at[0]
    line_codes, line_kinds = C.coded(lines.flatten())
    line_rows = C.rows_of(line_at)
    line_distinct = np.bincount(np.unique(line_rows * max(1, len(line_kinds)) + line_codes) // max(1, len(line_kinds)), minlength=len(n))
    n_lines = np.maximum(np.diff(line_at), 1)
    lengths = np.asarray(pc.binary_length(flat), dtype=np.int64)
    x = np.stack(
        [
            np.log1p(n) / 12, np.minimum(_sums(lengths, offsets) / many / 20, 1), _sums(_UPPER[data], at) / size, _sums(_DIGIT[data], at) / size, _sums(_MARK[data], at) / size,
            _sums(ends_in_mark, offsets) / many, _sums(lone, offsets) / many, _sums(again, offsets) / many, kinds / many, np.minimum(n / n_lines / 200, 1), 1 - line_distinct / n_lines,
            _sums(_HIGH[data], at) / size, np.log1p(np.diff(at)) / 16,
        ],
        axis=1,
    )


    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    return np.clip(x, 0, 1), offsets, (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)[codes] if len(distinct) else np.zeros(0, np.int64)


def encode(texts: pa.Array, metadata: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: row, feature, value. Words weigh by the root of their share; each statistic lights one bin.

    Bins are uniform in the root of the statistic, finer where most texts lie. metadata: a column for each of METADATA;
    numbers below 0 and those that are none (NaN) share a bin of their own.
    """
    x, offsets, hashed = statistics(texts)
    pairs, count = np.unique(C.rows_of(offsets) << WORD_BITS | hashed, return_counts=True)
    row = pairs >> WORD_BITS
    share = np.sqrt(count / np.maximum(np.diff(offsets), 1)[row])
    bins = np.minimum((np.sqrt(x) * BINS).astype(np.int64), BINS - 1)
    stat = (1 << WORD_BITS) + np.arange(len(STATS)) * BINS + bins
    n = len(x)
    told = np.full((n, len(METADATA)), np.nan) if metadata is None else metadata
    known = told >= 0
    level = np.minimum(np.log1p(np.where(known, told, 0)) / 16 * BINS, BINS - 1).astype(np.int64)
    meta = (1 << WORD_BITS) + len(STATS) * BINS + np.arange(len(METADATA)) * (BINS + 1) + np.where(known, level, BINS)
    lit = np.concatenate([stat, meta], axis=1)
    rows = np.concatenate([row, np.repeat(np.arange(n), lit.shape[1])])
    order = np.argsort(rows, kind="stable")
    return rows[order], np.concatenate([pairs & ((1 << WORD_BITS) - 1), lit.ravel()])[order], np.concatenate([share, np.full(lit.size, 0.5)])[order]


def _told(docs: DataFrame) -> list[Column]:
    """The metadata columns as _meta0, _meta1, ...: null where a value is no number or the column is absent."""
    own = {c.lower(): c for c in docs.columns}
    return [(F.col(f"`{own[c]}`").try_cast("double") if c in own else F.lit(None).cast("double")).alias(f"_meta{k}") for k, c in enumerate(METADATA)]


def _encoded(batch: pa.RecordBatch, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    told = [pc.fill_null(batch.column(f"_meta{k}"), float("nan")) for k in range(len(METADATA))]
    return encode(texts, np.stack([np.asarray(c, dtype=float) for c in told], axis=1))


class Machine:
    """A factorisation machine over D features."""

    def __init__(self, rank: int = RANK, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.b, self.w, self.v = 0.0, np.zeros(D), rng.normal(0, 0.02, (D, rank))

    def parts(self, row, feature, value, n):
        """The raw score of every row and sum_i v_i x_i, by which the pairwise part is linear."""
        vx = self.v[feature] * value[:, None]
        at = np.searchsorted(row, np.arange(n))  # every row has its statistics, so none is empty
        total = np.add.reduceat(vx, at, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), at)
        linear = np.add.reduceat(self.w[feature] * value, at)
        return self.b + linear + 0.5 * ((total * total).sum(axis=1) - squares), total

    def score(self, row, feature, value, n) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(row, feature, value, n)[0], -30, 30))) if n else np.zeros(0)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 128, l2: float = 2e-4) -> None:
        """AdaGrad on the logistic loss, the classes weighted alike."""
        rng = np.random.default_rng(11)
        gw, gv, gb = np.full(D, 1e-3), np.full(self.v.shape, 1e-3), 1e-3
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 0.02), 0.5 / max(1 - labels.mean(), 0.02))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), batch):
                own = order[lo : lo + batch]
                row = np.repeat(np.arange(len(own)), [len(rows[i][0]) for i in own])
                feature, value = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
                raw, total = self.parts(row, feature, value, len(own))
                err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[own]) * weight[own] / len(own)
                used, at = np.unique(feature, return_inverse=True)
                e = err[row] * value
                dw = np.bincount(at, weights=e, minlength=len(used)) + l2 * self.w[used]
                dv = np.stack([np.bincount(at, weights=e * (total[row, f] - self.v[feature, f] * value), minlength=len(used)) for f in range(self.v.shape[1])], axis=1) + l2 * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                gb += err.sum() ** 2
                self.w[used] -= 0.1 * dw / np.sqrt(gw[used])
                self.v[used] -= 0.05 * dv / np.sqrt(gv[used])
                self.b -= 0.1 * err.sum() / np.sqrt(gb)


def held_out(id: Column) -> Column:
    """Rows that training never reads."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string")), F.lit(3)) == 1, F.lit(False))


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, out: Column, sample: int, id: str = "doc_id") -> DataFrame:
    """At most `sample` labelled rows of `docs` outside `out` in hash order, with `label` as _label; ids repeated in `labels` take the largest."""
    ids = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull() & ~out).groupBy(id).agg(F.max(label).alias("_label"))
    ids = ids.orderBy(F.xxhash64(id), id).limit(sample).withColumnRenamed(id, "_labelled")
    return docs.join(F.broadcast(ids), docs[id] == F.col("_labelled")).drop("_labelled")


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Machine:
    """The machine learned from `labels.quality`; without labelled rows it scores every text 0.5."""

    def fn(batch, texts):
        row, feature, value = _encoded(batch, texts)
        cuts = np.searchsorted(row, np.arange(1, len(texts)))
        return {"f": pa.array([x.astype(np.int32).tobytes() for x in np.split(feature, cuts)], pa.binary()), "x": pa.array([x.astype(np.float32).tobytes() for x in np.split(value, cuts)], pa.binary())}

    chosen = sample_rows(docs.select(id, text, *_told(docs)), labels, "quality", held_out(F.col(id)), sample, id)
    got = C.add_columns(chosen, text, [T.StructField("f", T.BinaryType()), T.StructField("x", T.BinaryType())], fn).select(id, "_label", "f", "x").toArrow().sort_by(id)
    m = Machine()
    if got.num_rows:
        rows = [(np.frombuffer(f, np.int32), np.frombuffer(x, np.float32)) for f, x in zip(got["f"].to_pylist(), got["x"].to_pylist(), strict=True)]
        m.fit(rows, np.asarray(got["_label"], dtype=np.float64))
    else:
        m.v[:] = 0
    return m


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with score (0 to 1, higher: good quality) and predicted (1 if score >= 0.5, else 0).

    Reads the text and the columns of METADATA. A null text reads as empty and has a score like any text; metadata that
    is null, no number or absent is a feature of its own. Repeated rows score alike. Input columns named like an
    output give way.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id, text))

    def fn(batch, texts):
        s = model.value.score(*_encoded(batch, texts), len(texts))
        return {"score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))}

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    told = {f"_meta{k}": c for k, c in enumerate(_told(docs))}
    rows, back = C.apart(docs, text, ["score", "predicted"], **told)
    return back(C.add_columns(rows, "text", fields, fn, drop=tuple(told)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the machine accepts."""
    own, back = C.apart(docs, "text", [], doc_id=F.col("doc_id"), **{c.lower(): C.named(c) for c in docs.columns if c.lower() in METADATA})
    return back(classify(own, labels).where("predicted = 1"))
