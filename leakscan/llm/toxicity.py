"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of the words around each hit.

The lexicon is learned from labelled rows: words, and stems where many words share a beginning, that
toxic documents hold and others don't. The product of the trie and the Levenshtein automata of its
terms is made deterministic as words need it, so a word costs a step a letter, and most end within three.
Each hit is weighed by its window: quoted and reported words count less, words aimed at a reader more.
A logistic model over the weighed hits gives the score.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscan.llm import common as C
from leakscan.llm.quality import sample_rows

#: Labelled rows that training reads at most, in hash order.
SAMPLE = 12_000
#: Likelihood ratio, share of toxic documents and number of them that a term needs.
LEAST_RATIO, LEAST_SHARE, LEAST_DOCS = 24.0, 0.95, 4
STEM_LENGTHS = range(4, 9)
#: Terms this long may be misspelled by one letter.
FUZZY_LENGTH = 5
WINDOW = 6

# Letters written as other characters, reporting words, and words that address a reader.
LOOKALIKES = str.maketrans("013457@$", "oieastas")
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes word words term phrase dit disait mot sagte sagt wort dijo dice palabra".split())
ADDRESS = frozenset("you your you're du dein deine ihr tu toi vous votre usted tus".split())

_TABLE = C.ALNUM.copy()
_TABLE[[ord("@"), ord("$")]] = [ord("@"), ord("$")]
# Signs of Latin-1 and general punctuation end a word as those of ASCII do.
_PART = re.compile(r"[0-9a-z@$\u00c0-\u1fff\u2070-\U0010ffff]+")
_TOKEN = re.compile(_PART.pattern + r"|[\"\n]")
_QUOTES = str.maketrans({c: '"' for c in "«»“”„‟"} | {chr(c): chr(c + 32) for c in range(65, 91)})


class FuzzyTrie:
    """Words within one edit of a term, or that begin with a stem: 2 exact, 1 misspelled, 0 neither."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: set[int] = set()
        self.stem: set[int] = set()
        self.loose: set[int] = set()  # nodes above or at a term that may be misspelled
        self.long: set[int] = set()  # such terms' ends
        for word, kind in [(t, self.term) for t in terms] + [(s, self.stem) for s in stems]:
            path = [0]
            for c in word:
                nxt = self.children[path[-1]].get(c)
                if nxt is None:
                    nxt = self.children[path[-1]][c] = len(self.children)
                    self.children.append({})
                path.append(nxt)
            kind.add(path[-1])
            if kind is self.term and len(word) >= FUZZY_LENGTH:
                self.loose.update(path)
                self.long.add(path[-1])
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accept: list[int] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With the letters of a term that the word leaves out."""
        return frozenset(pairs | {(c, 1) for n, e in pairs if e == 0 for c in self.children[n].values() if c in self.loose})

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.states:
            self.states[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.steps.append({})
            exact = any(e == 0 and n in self.term or n in self.stem for n, e in pairs)
            self.accept.append(2 if exact else 1 if any(n in self.long for n, _ in pairs) else 0)
        return self.states[pairs]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for n, e in self.sets[state]:
            if n in self.stem and e == 0:
                out.add((n, 0))  # a stem takes any ending
            nxt = self.children[n].get(c)
            if nxt is not None and (e == 0 or nxt in self.loose):
                out.add((nxt, e))
            if e == 0 and n in self.loose:
                out.add((n, 1))
                out.update((k, 1) for k in self.children[n].values() if k in self.loose)
        to = self.steps[state][c] = self._state(self._closed(out))
        return to

    def match(self, word: str) -> int:
        at, steps, dead = self.start, self.steps, self.dead
        for c in word:
            nxt = steps[at].get(c)
            at = self._step(at, c) if nxt is None else nxt
            if at == dead:
                return 0
        return self.accept[at]


def normal(word: str) -> str:
    """Marks at the ends go; look-alike characters become the letters they stand for."""
    word = word.strip("@$")
    return word.translate(LOOKALIKES) if any(c.isalpha() for c in word) else ""


# --- learning -----------------------------------------------------------------------------------


def held_out(id: Column) -> Column:
    """Rows that training never reads."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string")), F.lit(5)) == 0, F.lit(False))


def lexicon(rows: DataFrame, text: str = "text") -> tuple[list[str], list[str]]:
    """Terms and stems from rows with _label 0 or 1. Each needs several of the sample's toxic documents, which bounds their number."""

    def run(batches):
        for batch, texts in C.slices(batches, text):
            offsets, flat = C.words(C.translate(texts, C.ALNUM))
            codes, distinct = C.coded(flat)
            pairs = np.unique(C.rows_of(offsets) * max(1, len(distinct)) + codes)
            row, code = pairs // max(1, len(distinct)), pairs % max(1, len(distinct))
            label = np.asarray(batch.column("_label"), dtype=np.int64)[row]
            parts = [_PART.findall(w.decode()) for w in distinct]
            # a document counts once for a word and once for a beginning
            seen = {(r, n) for r, c in zip(row.tolist(), code.tolist(), strict=True) for p in parts[c] for n in {p[:k] + "*" for k in STEM_LENGTHS if len(p) >= k} | {p}}
            of = dict(zip(row.tolist(), label.tolist(), strict=True))
            count = defaultdict(lambda: [0, 0])
            for r, n in seen:
                count[n][of[r]] += 1
            yield pa.RecordBatch.from_pydict({"term": list(count), "neg": [v[0] for v in count.values()], "pos": [v[1] for v in count.values()]})

    total = {r._label: r.n for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    if not pos or not neg:
        return [], []
    base = pos / (pos + neg)
    found = rows.select(text, "_label").mapInArrow(run, "term string, neg long, pos long").groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    n = F.col("pos") + F.col("neg")
    ratio = 2 * (F.col("pos") * F.log(F.col("pos") / n / base) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / n / (1 - base))).otherwise(0.0))
    found = found.where((F.col("pos") >= LEAST_DOCS) & (F.col("pos") >= LEAST_SHARE * n)).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    best = {r.term: r.pos for r in found.select("term", "pos").collect()}
    terms = sorted(t for t in best if t[-1] != "*" and len(t) >= 4 and not t.isdigit())
    begins = sorted(t[:-1] for t in best if t[-1] == "*")
    under = lambda names, s: names[bisect_left(names, s) : bisect_left(names, s + "\U0010ffff")]
    covered = lambda t: any(t[:k] in stems for k in STEM_LENGTHS)
    stems: dict[str, None] = {}
    for s in sorted(begins, key=lambda t: (len(t), t)):
        if covered(s):
            continue
        # the longest beginning that keeps nearly all documents is the safest
        longest = max((x for x in under(begins, s) if best[x + "*"] >= 0.9 * best[s + "*"]), key=lambda x: (len(x), x))
        if max((best[t] for t in under(terms, s)), default=0) < 0.6 * best[s + "*"]:
            stems[longest] = None
    return [t for t in sorted(terms, key=lambda t: (-best[t], t)) if not covered(t)], list(stems)


# --- scoring ------------------------------------------------------------------------------------


def context(tokens: list[str], kinds: list[int]) -> tuple[float, float]:
    """The weighed exact and misspelled hits of one text's tokens (kinds: 2, 1 or 0; quotes and line ends are tokens)."""
    exact = fuzzy = 0.0
    open_, quoted = False, [False] * len(tokens)
    last = None
    for i, t in enumerate(tokens):
        if t == "\n":
            open_ = False  # an unclosed mark quotes nothing
        elif t == '"':
            if open_:
                quoted[last:i] = [True] * (i - last)
            open_, last = not open_, i
    for i, k in enumerate(kinds):
        if k:
            near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
            weight = 0.35 if quoted[i] else 1.0
            if any(t in REPORTING for t in near):
                weight *= 0.6
            if not quoted[i] and any(t in ADDRESS for t in near):
                weight *= 1.3
            exact, fuzzy = (exact + weight, fuzzy) if k == 2 else (exact, fuzzy + weight)
    return exact, fuzzy


def hits(texts: pa.Array, trie: FuzzyTrie, known: dict[bytes, int]) -> np.ndarray:
    """The weighed exact and misspelled hits of every text. known: results for words seen before."""
    offsets, flat = C.words(C.translate(texts, _TABLE))
    codes, distinct = C.coded(flat)
    if len(known) > 500_000:
        known.clear()
    kinds = np.zeros(len(distinct), np.int8)
    for i, w in enumerate(distinct):
        k = known.get(w)
        if k is None:
            k = known[w] = max((trie.match(normal(p)) for p in _PART.findall(w.decode())), default=0)
        kinds[i] = k
    out = np.zeros((len(texts), 2))
    if kinds.any():
        found = {p: trie.match(normal(p)) for w, k in zip(distinct, kinds, strict=True) if k for p in _PART.findall(w.decode())}
        for r in np.unique(C.rows_of(offsets)[kinds[codes] > 0]).tolist():
            tokens = _TOKEN.findall(texts[r].as_py().translate(_QUOTES))
            out[r] = context(tokens, [found.get(t, 0) for t in tokens])
    return out


def _inputs(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.minimum(x, 1), np.log1p(x)])


#: What the model believes before it has seen rows: bias, an exact and a misspelled hit, their numbers.
PRIOR = np.array([-3.0, 5.0, 3.5, 1.0, 1.0])


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 300) -> np.ndarray:
    """Logistic regression drawn towards PRIOR."""
    w, f = PRIOR.copy(), _inputs(x)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        w -= 0.5 * (f.T @ (p - y) / max(1, len(y)) + 2e-3 * (w - PRIOR))
    return w


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """`docs` with score (0 to 1, higher: toxic) and predicted (1 if score >= 0.5, else 0).

    Reads the text alone; null reads as empty, and a text without hits gets the model's base score, below
    0.5. Without labelled rows of both kinds the lexicon is empty. Repeated rows score alike; input
    columns named like an output give way.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    rows = scratch.save(sample_rows(docs.select(id, text), labels, "toxic", held_out(F.col(id)), sample, id))
    words = spark.sparkContext.broadcast(lexicon(rows, text))
    state: dict = {}

    def own():
        if not state:
            state.update(trie=FuzzyTrie(*words.value), known={})
        return state["trie"], state["known"]

    def count(_, texts):
        return dict(zip(("_exact", "_fuzzy"), map(pa.array, hits(texts, *own()).T), strict=True))

    got = C.add_columns(rows, text, [T.StructField(k, T.DoubleType()) for k in ("_exact", "_fuzzy")], count).select("_label", "_exact", "_fuzzy").toArrow()
    x = np.column_stack([np.asarray(got["_exact"]), np.asarray(got["_fuzzy"])]).reshape(-1, 2)
    weights = _fit(x, np.asarray(got["_label"], dtype=float)) if got.num_rows else PRIOR

    def score(_, texts):
        p = 1 / (1 + np.exp(-np.clip(_inputs(hits(texts, *own())) @ weights, -30, 30)))
        return {"score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))}

    return C.add_columns(docs, text, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], score)
