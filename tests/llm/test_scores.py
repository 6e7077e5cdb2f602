"""Scores of the three classifiers against plain Python: every feature, hit and pair is counted anew, a text at a time."""

import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leakscan.llm import quality, toxicity, urlfilter
from leakscan.llm.queries import QUERIES
from tests.oracle import DATA

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tables(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def close(got, want):
    assert got.keys() == want.keys()
    worst = max(got, key=lambda i: abs(got[i] - want[i]))
    assert got[worst] == pytest.approx(want[worst], abs=1e-6), worst


# --- urls ---------------------------------------------------------------------------------------


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOWER), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def url_score(url, weights):
    grams = set()
    for tag, s in zip("hp", url_parts(url), strict=True):
        s = f"^{s}$"
        for n in urlfilter.GRAMS:
            grams |= {f"{tag}{n}{s[i:i + n]}" for i in range(len(s) - n + 1)} or {f"{tag}{n}{s}"}
    own = {xxhash.xxh64_intdigest(g.encode(), seed=42) % (1 << urlfilter.BITS) for g in grams}
    return 1 / (1 + math.exp(-(weights[-1] + sum(weights[g] for g in own) / math.sqrt(len(own)))))


def url_rule(host, path):
    fits = [r for r in urlfilter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: len(r[0] + r[1]), default=None)


def test_url_query(spark):
    labelled = urlfilter.built_in_labels(spark).select(urlfilter.host_of(F.col("url")).alias("host"), urlfilter.path_of(F.col("url")).alias("path"), "label")
    weights = urlfilter.fit(labelled)
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = {r.page_id: r for r in QUERIES["op2_urls"](spark, DATA).collect()}
    close({i: r.score for i, r in rows.items()}, {i: url_score(u, weights) for i, u in urls.items()})
    for i, u in urls.items():
        rule = url_rule(*url_parts(u))
        assert (rows[i].host, rows[i].path) == url_parts(u) and rows[i].rule == (rule and rule[0] + rule[1])
        assert rows[i].verdict == (rule[2] if rule else "allow" if rows[i].score >= 0.5 else "block")


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "a://", "http://É.ORG/ü?x", "http://b.net", "x://" + "long/" * 3000, "http://a.net/b#c?d"]
    weights = np.random.default_rng(5).normal(size=(1 << urlfilter.BITS) + 1).round(4)
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    parts = df.select("i", urlfilter.host_of(F.col("url")).alias("h"), urlfilter.path_of(F.col("url")).alias("p"))
    got = parts.select("i", urlfilter.probability(urlfilter.features(F.col("h"), F.col("p")), weights).alias("score")).collect()
    close({r.i: r.score for r in got}, {i: url_score(u, weights) for i, u in enumerate(urls)})


# --- quality ------------------------------------------------------------------------------------

MARKS = {c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in ".,;:'\"?-()"}


def quality_features(text, n_chars):
    """{feature: value} of one document."""
    data, words, lines = text.encode(), [w.translate(LOWER) for w in WORD.findall(text)], text.split("\n")
    size, many = max(1, len(data)), max(1, len(words))
    share = lambda bad: sum(map(bad, data)) / size
    stats = [
        math.log1p(len(words)) / 12, sum(len(w.encode()) for w in words) / many / 20, share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(lambda b: chr(b) in MARKS),
        sum(w[-1] in MARKS for w in words) / many, sum(w in MARKS for w in words) / many, sum(a == b for a, b in zip(words, words[1:], strict=False)) / many, len(set(words)) / many,
        len(words) / len(lines) / 200, 1 - len(set(lines)) / len(lines), share(lambda b: b >= 128), math.log1p(len(data)) / 16,
    ]
    out, counts = {}, {}
    for w in words:
        h = xxhash.xxh3_64_intdigest(w.encode()) >> (64 - quality.WORD_BITS)
        counts[h] = counts.get(h, 0) + 1
    out.update({h: math.sqrt(n / many) for h, n in counts.items()})
    at = 1 << quality.WORD_BITS
    for k, x in enumerate(stats):
        out[at + k * quality.BINS + min(int(math.sqrt(min(1, max(0, x))) * quality.BINS), quality.BINS - 1)] = 0.5
    known = n_chars is not None and n_chars >= 0
    out[at + len(stats) * quality.BINS + (int(min(math.log1p(n_chars) / 16 * quality.BINS, quality.BINS - 1)) if known else quality.BINS)] = 0.5
    return out


def quality_score(m, text, n_chars):
    """The model's formula with every pair of features, without the sum-of-squares identity."""
    x = quality_features(text or "", n_chars)
    own, value = np.array(list(x)), np.array(list(x.values()))
    v = m.v[own] * value[:, None]
    pairs = np.triu(v @ v.T, 1).sum()
    return 1 / (1 + math.exp(-max(-30, min(30, m.b + m.w[own] @ value + pairs))))


def test_quality_scores(spark):
    docs, labels = tables(spark)
    m = quality.train(docs, labels)
    some = docs.unionByName(spark.createDataFrame([(10**7 + i, t, n) for i, (t, n) in enumerate([(None, None), ("", 0), ("!! !! a\n\na\n", -3), ("É 中文 \U0001f600 UPPER", 17), ("x " * 50_000, 10**9)])], "doc_id long, text string, n_chars long"), allowMissingColumns=True)
    rows = quality.classify(some, labels).select("doc_id", "text", "n_chars", "score", "predicted").collect()
    close({r.doc_id: r.score for r in rows}, {r.doc_id: quality_score(m, r.text, r.n_chars) for r in rows})
    assert all(r.predicted == (r.score >= 0.5) for r in rows) and len({r.predicted for r in rows}) == 2


# --- toxicity -----------------------------------------------------------------------------------


def one_edit(a, b):
    """At most one letter inserted, left out or changed: what common ends leave of both is one letter at most."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return max(len(a), len(b)) <= 1


def word_kind(word, terms, stems):
    word = toxicity.normal(word)
    if word in terms or any(word.startswith(s) for s in stems):
        return 2
    return int(any(one_edit(word, t) for t in terms if len(t) >= toxicity.FUZZY_LENGTH)) if word else 0


def toxic_hits(text, terms, stems, known):
    """Weighed exact and misspelled hits: quoted x 0.35, reported x 0.6, aimed at a reader x 1.3 unless quoted."""
    plain = re.sub("[«»“”„‟]", '"', text.translate(LOWER))
    tokens = re.findall(r'[^\x00-\x23\x25-\x2f\x3a-\x3f\x41-\x60\x7b-\xbf\u2000-\u206f]+|["\n]', plain)
    quoted, line = set(), []
    for i, t in enumerate(tokens + ["\n"]):
        if t == "\n":
            for a, b in zip(line[::2], line[1::2], strict=False):
                quoted |= set(range(a, b))
            line = []
        elif t == '"':
            line.append(i)
    out = [0.0, 0.0]
    for i, t in enumerate(tokens):
        if t not in known:
            known[t] = word_kind(t, terms, stems) if t not in '"\n' else 0
        if known[t]:
            near = set(tokens[max(0, i - toxicity.WINDOW) : i + toxicity.WINDOW + 1])
            weight = (0.35 if i in quoted else 1.3 if near & toxicity.ADDRESS else 1) * (0.6 if near & toxicity.REPORTING else 1)
            out[2 - known[t]] += weight
    return out


def test_toxicity_scores(spark):
    docs, labels = tables(spark)
    sample = quality.sample_rows(docs.select("doc_id", "text"), labels, "toxic", toxicity.held_out(F.col("doc_id")), toxicity.SAMPLE).collect()
    terms, stems = toxicity.lexicon(spark.createDataFrame([(r.text, r._label) for r in sample], "text string, _label int"))
    terms, known = set(terms), {}
    assert terms or stems
    word = sorted(terms or stems)[-1]
    inputs = lambda h: np.array([1, min(h[0], 1), min(h[1], 1), math.log1p(h[0]), math.log1p(h[1])])
    hits = lambda t: toxic_hits(t or "", terms, stems, known)
    weights = toxicity._fit(np.array([hits(r.text) for r in sample]), np.array([float(r._label) for r in sample]))
    odd = [None, "", word, f"{word.upper()}!", f'he said "{word}" to us', f"you {word}", f"«{word}»", f"“{word}” {word}", f"¡{word}! oh—{word}… ‘{word}’", f'" {word}\n{word} "', f"{word[:2]}x{word[2:]} {word[1:]} {word}$", "a " * 50_000 + word]
    more = spark.createDataFrame([(10**7 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    rows = toxicity.classify(docs.unionByName(more, allowMissingColumns=True), labels).select("doc_id", "text", "score", "predicted").collect()
    close({r.doc_id: r.score for r in rows}, {r.doc_id: 1 / (1 + math.exp(-inputs(hits(r.text)) @ weights)) for r in rows})
    assert all(r.predicted == (r.score >= 0.5) for r in rows) and len({r.predicted for r in rows}) == 2
