"""A hidden Markov language model over word classes, and a unigram model as its base.

Frequent words are classes of their own; others share a class with words that end alike, and a class
gives each of its words a smoothed share. Baum-Welch runs over all training texts, each one sequence from
its first word to its end: each task sums expected counts, and Spark sums the tasks'.
Texts are cut into segments for speed alone: a segment's scaled forward recursion from every state gives a
matrix, and products of a text's matrices are what its other segments pass on, so likelihoods and expected
counts are exactly those of the whole text.

Counts of words beyond the DICTIONARY most frequent are joined to the texts that hold them, so no table
that grows with the corpus is broadcast.
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

STATES = 6
ROUNDS = 4
#: Words with counts known everywhere, words that are their own class, and classes by ending. Ties at the
#: least count stay out, so the numbers are upper bounds.
DICTIONARY, HEAD, ENDINGS = 250_000, 20_000, 256
SEGMENT, LONG_SEGMENT = 64, 256  # of scoring and of training
#: The end of a text, counted as a token; no word holds a space.
END = " "
TOKENS = 250_000  # a recursion's batch


def held_out(id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id.cast("string")), F.lit(5)) == 1, F.lit(False))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Row offsets, word numbers and the distinct words; ends are left out."""
    offsets, flat = C.words(C.translate(texts, C.LOWER))
    return offsets, *C.coded(flat)


def count(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all texts, ends included."""

    def run(batches):
        for _, texts in C.slices(batches, text):
            _, codes, distinct = _tokens(texts)
            yield pa.RecordBatch.from_arrays([pa.array([*distinct, END.encode()], pa.binary()).cast(pa.string()), pa.array(np.append(np.bincount(codes, minlength=len(distinct)), len(texts)))], ["word", "n"])

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _cut(histogram: list, most: int) -> int:
    """The least count such that at most `most` words have it or more."""
    total, cut = 0, 1 << 62
    for n, words in sorted(histogram, reverse=True):
        total += words
        if total > most:
            break
        cut = n
    return cut


def _ending(word: str) -> int:
    h = xxhash.xxh64_intdigest(word[-2:], 42)
    return (h - (1 << 64) if h >> 63 else h) % ENDINGS


def _pad(classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Segments as rows of `size` classes, -1 where a segment has ended."""
    at = starts[:, None] + np.arange(size)
    ok = np.arange(size) < lengths[:, None]
    return np.where(ok, classes[np.where(ok, at, 0)], -1)


def _segments(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, whether the text begins here) of the segments of texts that lie one after another."""
    n = -(-lengths // size)
    text = np.repeat(np.arange(len(n)), n)
    within = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * size
    return text, np.repeat(np.cumsum(lengths) - lengths, n) + within, np.minimum(size, lengths[text] - within), within == 0


class Model:
    """start (K), move (K, K) and emit (classes, K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, frequency: np.ndarray, states: int = STATES) -> Model:
        """Unigram shares, shaken so that the states can part."""
        rng = np.random.default_rng(5)
        emit = (frequency + 0.1)[:, None] * np.exp(1.2 * rng.normal(size=(len(frequency), states)))
        return cls(np.full(states, 1 / states), np.full((states, states), 0.04 / states) + 0.96 * np.eye(states), emit / emit.sum(axis=0))

    def expected(self, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of starts, moves and emissions, and the log likelihood, of the whole texts."""
        k, size = len(self.start), len(self.emit)
        start, move, emit, like = np.zeros(k), np.zeros((k, k)), np.zeros((size, k)), 0.0
        text, begin, length, first = _segments(lengths, LONG_SEGMENT)
        before, after = self._passed(classes, text, begin, length, first)
        order = np.argsort(-length, kind="stable")  # long ones first: step t works on a prefix
        begin, length, first, before, after = (v[order] for v in (begin, length, first, before, after))
        for lo in range(0, len(begin), TOKENS // LONG_SEGMENT):
            own = slice(lo, lo + TOKENS // LONG_SEGMENT)
            x = _pad(classes, begin[own], length[own], LONG_SEGMENT)
            opens, arrive = first[own], before[own]
            live = (x >= 0).sum(axis=0)
            steps = int((live > 0).sum())
            alpha, scale, b = [], [], []
            for t in range(steps):
                n = live[t]
                b.append(self.emit[x[:n, t]])
                a = (np.where(opens[:, None], self.start, arrive @ self.move) if t == 0 else alpha[-1][:n] @ self.move) * b[-1]
                s = a.sum(axis=1, keepdims=True)
                alpha.append(a / s)
                scale.append(s)
                like += np.log(s).sum()
            # what follows a segment, so scaled that the shares of its last states sum to 1
            last = np.concatenate([alpha[t][(live[t + 1] if t + 1 < steps else 0) :] for t in range(steps - 1, -1, -1)])
            follow = after[own] / (last * after[own]).sum(axis=1, keepdims=True)
            beta, gammas = follow[: live[steps - 1]], [None] * steps
            for t in range(steps - 1, -1, -1):
                gammas[t] = alpha[t] * beta
                back = beta * b[t] / scale[t]
                if t:
                    move += self.move * (alpha[t - 1][: live[t]].T @ back)
                    beta = np.concatenate([back @ self.move.T, follow[live[t] : live[t - 1]]])
                else:
                    move += self.move * (arrive[~opens].T @ back[~opens])
            start += gammas[0][opens].sum(axis=0)
            g, c = np.concatenate(gammas), np.concatenate([x[: live[t], t] for t in range(steps)])
            for j in range(k):
                emit[:, j] += np.bincount(c, weights=g[:, j], minlength=size)
        return start, move, emit, like

    def _passed(self, classes: np.ndarray, text: np.ndarray, begin: np.ndarray, length: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a text's earlier segments pass on (shares of the state before each segment) and what its later ones
        make of each last state, up to a factor. Texts of one segment have neither."""
        before, after = np.zeros((len(text), len(self.start))), np.ones((len(text), len(self.start)))
        many = np.flatnonzero(~first | np.append(~first[1:], False)) if len(text) else np.zeros(0, np.int64)
        if not len(many):
            return before, after
        mats, _ = self._matrices(classes, begin[many], length[many], first[many], LONG_SEGMENT)
        at = np.flatnonzero(first[many])
        n = np.diff(np.append(at, len(many)))
        v, u = np.tile(self.start, (len(at), 1)), np.ones((len(at), len(self.start)))
        for j in range(int(n.max()) - 1):
            rows = np.flatnonzero(n > j + 1)
            v[rows] = np.einsum("ni,nij->nj", v[rows], mats[at[rows] + j])
            v[rows] /= v[rows].sum(axis=1, keepdims=True)
            before[many[at[rows] + j + 1]] = v[rows]
        for j in range(int(n.max()) - 1, 0, -1):
            rows = np.flatnonzero(n > j)
            u[rows] = np.einsum("nij,nj->ni", mats[at[rows] + j], u[rows])
            u[rows] /= u[rows].sum(axis=1, keepdims=True)
            after[many[at[rows] + j - 1]] = u[rows]
        return before, after

    def _matrices(self, classes: np.ndarray, begin: np.ndarray, length: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Every segment's scaled forward recursion from every state, and the log10 of its scale."""
        k, eye = len(self.start), np.eye(len(self.start))
        mats, logs = np.empty((len(begin), k, k)), np.zeros(len(begin))
        for lo in range(0, len(begin), TOKENS // size):
            own = slice(lo, lo + TOKENS // size)
            x = _pad(classes, begin[own], length[own], size)
            m = np.where(first[own, None, None], eye, self.move) if len(x) else np.zeros((0, k, k))
            for t in range(size):
                on = np.flatnonzero(x[:, t] >= 0)
                if not len(on):
                    break
                cur = m[on]
                if t:
                    cur = (cur.reshape(-1, k) @ self.move).reshape(-1, k, k)
                cur = cur * self.emit[x[on, t]][:, None, :]
                s = cur.sum(axis=(1, 2), keepdims=True)
                m[on] = cur / s
                logs[lo + on] += np.log10(s[:, 0, 0])
            mats[own] = m
        return mats, logs

    def log10(self, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 likelihood of every text (one token at least each), by scaled forward recursion."""
        text, begin, length, first = _segments(lengths, SEGMENT)
        mats, logs = self._matrices(classes, begin, length, first, SEGMENT)
        out, v = np.zeros(len(lengths)), np.tile(self.start, (len(lengths), 1))
        at = np.flatnonzero(first)
        n = np.diff(np.append(at, len(text)))
        np.add.at(out, text, logs)
        for j in range(int(n.max()) if len(n) else 0):  # segment j of every text that has one
            rows = np.flatnonzero(n > j)
            w = np.einsum("ni,nij->nj", v[rows], mats[at[rows] + j])
            s = w.sum(axis=1, keepdims=True)
            v[rows] = w / s
            out[rows] += np.log10(s[:, 0])
        return out


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    blobs = batch.column("classes").to_pylist()
    return np.frombuffer(b"".join(blobs), np.int32), np.array([len(b) // 4 for b in blobs], np.int64)


def train(encoded: DataFrame, frequency: np.ndarray, rounds: int = ROUNDS, states: int = STATES) -> Model:
    """Baum-Welch over the rows' classes (binary, int32)."""
    model = Model.initial(frequency, states)
    names = [f"s{j}" for j in range(states)]
    size = len(frequency)
    for _ in range(rounds):
        shared = encoded.sparkSession.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            start, move, emit, like, any_ = np.zeros(states), np.zeros((states, states)), np.zeros((size, states)), 0.0, False
            for batch in batches:
                step = max(1, batch.num_rows // 8)
                for lo in range(0, batch.num_rows, step):
                    a, b, c, d = shared.value.expected(*_unpacked(batch.slice(lo, step)))
                    start, move, emit, like, any_ = start + a, move + b, emit + c, like + d, True
            if any_:
                used = np.flatnonzero(emit.sum(axis=1))
                # emissions by class, then moves, starts and the likelihood under keys of their own
                key = np.concatenate([used, size + np.arange(states), [size + states, size + states + 1]])
                rows = np.concatenate([emit[used], move, start[None], np.full((1, states), like)])
                yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, rows.T)], ["key", *names])

        sums = encoded.select("classes").mapInArrow(run, "key long, " + ", ".join(f"{n} double" for n in names)).groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        if not sums.num_rows:
            return model
        key, rows = np.asarray(sums["key"]), np.stack([np.asarray(sums[n]) for n in names], axis=1)
        table = np.zeros((size + states + 2, states))
        table[key] = rows
        emit, move, start = table[:size] + 0.05 * (frequency + 0.1)[:, None] / frequency.sum() * len(frequency) * 0.01, table[size : size + states] + 1, table[size + states] + 1
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
        shared.destroy()
    return model


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", dictionary: int = DICTIONARY, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """Per row of `docs`: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Both models give a probability to every token sequence: a word unknown to training takes the place
    that is set aside for one. A null or empty text is its end alone. Held-out rows are never counted.
    Repeated rows are scored, and counted, each.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    docs = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), held_out(F.col(id)).alias("held_out"))
    counts = scratch.save(count(docs.where(~F.col("held_out")), "text"))
    histogram = [tuple(r) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect()]  # a row per distinct count
    total, distinct = sum(n * w for n, w in histogram), sum(w for _, w in histogram)
    known_from, head_from = _cut(histogram, dictionary), _cut(histogram, head)
    top = counts.where(F.col("n") >= known_from).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    ending = F.pmod(F.xxhash64(F.substring("word", -2, 2)), F.lit(ENDINGS))
    shared_classes = counts.where(F.col("n") < head_from).groupBy(ending.alias("e")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    mass, kinds = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in shared_classes:
        mass[r.e], kinds[r.e] = r.n, r.words
    n_head = int(pc.sum(pc.greater_equal(top["n"], head_from)).as_py() or 0)
    frequency = np.concatenate([mass, np.asarray(top["n"])[:n_head].astype(float)])
    class_mass = mass + 0.5 * (kinds + 1)
    z = total + 0.5 * (distinct + 1)
    shared = spark.sparkContext.broadcast((top["word"].to_pylist(), np.asarray(top["n"])))  # at most `dictionary` words
    state: dict = {}

    def own():
        if not state:
            names, n = shared.value
            state.update(number={w: i for i, w in enumerate(names)}, n=n)
        return state["number"], state["n"]

    def encode(_, texts):
        number, n_top = own()
        offsets, codes, distinct_here = _tokens(texts)
        names = [w.decode() for w in distinct_here] + [END]
        at = np.fromiter((number.get(w, -1) for w in names), np.int64, len(names))
        seen = at >= 0
        c = np.where(seen, n_top[at] if len(n_top) else 0, 0)
        own_class = np.where((at >= 0) & (at < n_head), at + ENDINGS, -1)
        shared_ = own_class < 0
        own_class[shared_] = [_ending(w) for w, s in zip(names, shared_, strict=True) if s]
        # log10 terms that don't wait for the tail's counts
        log_c = np.where(seen, np.log10(c + 0.5), 0.0)
        minus = np.where(shared_, -np.log10(class_mass[np.minimum(own_class, ENDINGS - 1)]), 0.0) + np.where(shared_ & seen, log_c, 0.0)
        n = np.diff(offsets)
        row = C.rows_of(offsets)
        size = n + 1
        tokens = np.full(size.sum(), len(names) - 1)
        tokens[np.arange(len(codes)) + row] = codes  # an end after every text
        owner = np.repeat(np.arange(len(n)), size)
        sums = lambda per: np.bincount(owner, weights=per[tokens], minlength=len(n))
        cls = own_class[tokens].astype(np.int32)
        ends = np.cumsum(size)
        raw = cls.tobytes()
        blobs = [raw[4 * (e - s) : 4 * e] for e, s in zip(ends.tolist(), size.tolist(), strict=True)]
        rare = np.flatnonzero(~seen[tokens])
        pairs, tf = np.unique(owner[rare] * len(names) + tokens[rare], return_counts=True)
        per_row = np.searchsorted(pairs // len(names), np.arange(len(n) + 1)).astype(np.int32)
        tail = pa.array(names, pa.string()).take(pa.array(pairs % len(names)))
        return {
            "n_tokens": pa.array(size), "sure": pa.array(sums(seen.astype(float)).astype(np.int64)), "base": pa.array(sums(log_c)), "inner": pa.array(sums(minus)), "classes": pa.array(blobs, pa.binary()),
            "tail": pa.ListArray.from_arrays(pa.array(per_row), tail), "tf": pa.ListArray.from_arrays(pa.array(per_row), pa.array(tf)),
        }

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("sure", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("inner", T.DoubleType()), T.StructField("classes", T.BinaryType()), T.StructField("tail", T.ArrayType(T.StringType())), T.StructField("tf", T.ArrayType(T.LongType()))]
    encoded = C.add_columns(docs, "text", fields, encode, drop=("text",)).withColumn("row", F.monotonically_increasing_id())
    encoded = scratch.save(encoded)
    model = spark.sparkContext.broadcast(train(encoded.where(~F.col("held_out")), frequency, rounds))

    def likelihood(batches):
        for batch in batches:
            step = max(1, batch.num_rows // 8)
            for lo in range(0, batch.num_rows, step):
                b = batch.slice(lo, step)
                values = model.value.log10(*_unpacked(b))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("row", "id", "held_out", "n_tokens", "sure", "base", "inner")), pa.array(values)], ["row", "id", "held_out", "n_tokens", "sure", "base", "inner", "hmm"])

    kept = encoded.select("row", "id", "held_out", "n_tokens", "sure", "base", "inner", "classes")
    schema = T.StructType([f for f in kept.schema.fields if f.name != "classes"] + [T.StructField("hmm", T.DoubleType())])
    scored = kept.mapInArrow(likelihood, schema)
    rare = encoded.select(F.col("row").alias("of"), F.explode(F.arrays_zip("tail", "tf")).alias("e")).select("of", F.col("e.tail").alias("word"), F.col("e.tf").alias("tf"))
    rare = rare.join(counts.where(F.col("n") < known_from), "word", "left").groupBy("of").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"), F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("more")
    )
    logs = F.coalesce("logs", F.lit(0.0))
    out = scored.join(rare, F.col("row") == F.col("of"), "left")
    return out.select(
        F.col("id").alias(id), "held_out", "n_tokens", (F.col("sure") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * float(np.log10(z))).alias("base_score"), (F.col("hmm") + F.col("inner") + logs).alias("score"),
    )
