"""URL filters: host and path rules, and logistic regression on hashed character n-grams for the rest.

DataFrame expressions only. The model is fitted on the driver from the n-grams of at most SAMPLE labelled urls;
judging is one pass over the urls without a shuffle.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path prefix, verdict); the longest that fits a url decides.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Words of the small labelled table that stands in where none is given: of hosts that filters block, and of plain ones. Every
#: word is paired with words that come with either.
BLOCKED_WORDS = """
casino poker slots jackpot bets betting lottery roulette spam linkfarm seospam adserver adtrack trackclicks popup banner
pills viagra pharmacy cams xxx dating payday loans richquick warez crack keygen torrent prizes winbig freemoney
""".split()
PLAIN_WORDS = """
blog news library museum docs help support mail wiki forum school university health travel weather recipes garden history
music sports science research journal press events city council bank post media photo art books learning data community people
""".split()
PARTNERS = "online best free my the new top world city club".split()
BLOCKED_PATHS = ["/casino/bonus", "/free-bets", "/ads/click", "/track?id=1", "/pills/buy-now", "/win-prizes.html"]
PLAIN_PATHS = ["/", "/en/12", "/fr/article/7", "/de/34.html", "/es/5/", "/about", "/news/2024/a.html", "/index.html"]
BITS = 12
GRAMS = (3, 4)
#: Labelled urls that training reads at most.
SAMPLE = 3000
STEPS = 200


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; '' without :// or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; '' without :// or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1)


def _name(rule: tuple[str, str, str]) -> str:
    return rule[0] + rule[1]


def rule_of(host: Column, path: Column, rules=RULES, what=_name) -> Column:
    """The longest rule that fits (its host or a subdomain, its path as prefix), or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(_name(r)), _name(r))):  # a longer one overrides
        fits = ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1])
        out = F.when(fits, F.lit(what(r))).otherwise(out)
    return out


def features(host: Column, path: Column, bits: int = BITS) -> Column:
    """Distinct hashed character n-grams, the host's and the path's kept apart by a prefix."""

    def of(s: Column, tag: str) -> Column:
        marked = F.concat(F.lit("^"), s, F.lit("$"))
        letters = F.filter(F.split(marked, ""), lambda c: c != "")

        def runs(n: int) -> Column:
            """Every n consecutive characters, a letter joined to all runs at a time: substring would walk the text for each."""
            if n == 1:
                return letters
            longer = F.zip_with(runs(n - 1), F.slice(letters, F.lit(n), F.size(letters)), lambda a, b: F.concat(a, b))
            return F.filter(longer, lambda x: x.isNotNull())

        def grams(n: int) -> Column:
            own = runs(n)
            return F.transform(F.when(F.size(own) > 0, own).otherwise(F.array(marked)), lambda x: F.concat(F.lit(f"{tag}{n}"), x))

        return F.concat(*[grams(n) for n in GRAMS])

    both = F.concat(of(host, "h"), of(path, "p"))
    return F.array_distinct(F.transform(both, lambda g: F.pmod(F.xxhash64(g), F.lit(1 << bits)).cast("int")))


def _literal(weights: np.ndarray) -> Column:
    """The weights as one constant array, folded by the optimizer."""
    return F.from_json(F.lit(json.dumps([float(f"{w:.9g}") for w in weights])), "array<double>")


def probability(grams: Column, weights: np.ndarray) -> Column:
    """1 / (1 + exp(-(bias + mean of the n-grams' weights * sqrt(their number))))."""
    own = _literal(weights[:-1])
    total = F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.element_at(own, g + 1))
    return 1 / (1 + F.exp(-(F.lit(float(weights[-1])) + total / F.sqrt(F.size(grams)))))


def fit(labelled: DataFrame, bits: int = BITS, steps: int = STEPS, sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from (host, path, label 0/1), at most `sample` distinct rows in hash order, by full-batch gradient
    steps on the logistic loss with the labels weighted alike; zeros without rows."""
    rows = labelled.where(F.col("label").isNotNull()).groupBy("host", "path").agg(F.max("label").cast("int").alias("label"))
    rows = rows.orderBy(F.xxhash64("host", "path"), "host", "path").limit(sample)
    rows = rows.select("label", features(F.col("host"), F.col("path"), bits).alias("grams")).collect()  # at most `sample`
    weights = np.zeros((1 << bits) + 1)
    if not rows:
        return weights
    label, size = np.array([r.label for r in rows], float), np.array([len(r.grams) for r in rows])
    gram, row = np.concatenate([r.grams for r in rows]).astype(np.int64), np.repeat(np.arange(len(rows)), size)
    unit = 1 / np.sqrt(size)  # features have length 1, so steps this long are stable
    balance = np.where(label == 1, 0.5 / max(label.mean(), 0.02), 0.5 / max(1 - label.mean(), 0.02)) / len(rows)
    speed = np.zeros_like(weights)
    for _ in range(steps):
        raw = weights[-1] + np.bincount(row, weights[gram], len(rows)) * unit
        err = (1 / (1 + np.exp(-raw)) - label) * balance
        grad = np.append(np.bincount(gram, (err * unit)[row], 1 << bits) + 1e-4 * weights[:-1], err.sum())
        speed = 0.9 * speed - 2.0 * grad
        weights = weights + speed
    return weights


def built_in_rows() -> list[tuple[str, int]]:
    """(url, label): 1 for plain urls, 0 for those of kinds that filters block. Endings, subdomains and partner words are the same on both sides."""
    tails, rows = [".example.com", ".example.org", ".example.net", ".com", ".net"], []
    for label, names in ((0, BLOCKED_WORDS), (1, PLAIN_WORDS)):
        for i, w in enumerate(names):
            for j, p in enumerate(PARTNERS):
                if (i + j) % 2 == 0:
                    host = [f"{p}-{w}", f"{w}-{p}", f"{p}{w}", w][(i + j // 2) % 4]
                    rows.append((f"http://{'www.' * (j % 2)}{host}{tails[(i + j) % 5]}{PLAIN_PATHS[(i + 3 * j) % len(PLAIN_PATHS)]}", label))
    rows += [(f"http://www.{a}{tails[i % 5]}{p}", 0) for i, p in enumerate(BLOCKED_PATHS) for a in PLAIN_WORDS[4:8]]
    rows += [(f"http://www.{a}{tails[i % 5]}{p}", 1) for i, p in enumerate(PLAIN_PATHS) for a in PLAIN_WORDS[4:8]]
    return rows


def built_in_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(built_in_rows(), "url string, label int")


def judge(pages: DataFrame, url: str = "url", rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """`pages` with host, path, rule, score and verdict.

    A rule's verdict stands; other urls are allowed if the model gives 0.5 or more. The model learns
    from `labelled` (url, label 0 or 1), or from a built-in table. Null and malformed urls have an empty
    host and path and are judged by the model. Rows that repeat are judged alike; input columns named
    like an output give way.
    """
    said = rule_of(F.col("host"), F.col("path"), rules, lambda r: r[2])
    known = built_in_labels(pages.sparkSession) if labelled is None else labelled
    weights = fit(known.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label"))
    new = {"host", "path", "rule", "score", "verdict"}
    keep = [c for c in pages.columns if c.lower() not in new]
    own_url = F.col(url)
    out = pages.select(*keep, host_of(own_url).alias("host"), path_of(own_url).alias("path"))
    score = probability(features(F.col("host"), F.col("path")), weights)
    return out.select(
        *keep, "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), score.alias("score"),
        F.coalesce(said, F.when(score >= 0.5, "allow").otherwise("block")).alias("verdict"),
    )
