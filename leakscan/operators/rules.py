"""Detection rules: loading, compiling, keyword index, and matching triggered rules to candidates."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscan.functions import fixed
from leakscan.functions.dialect import groups, rule_regex

BUILT_IN = Path(__file__).parent.parent / "data" / "rules.toml"
#: Rules are a driver-side dimension; a larger set is refused rather than broadcast.
MOST_RULES = 20_000

SCHEMA = T.StructType(
    [
        T.StructField("rule_id", T.StringType()), T.StructField("description", T.StringType()), T.StructField("java_regex", T.StringType()), T.StructField("n_groups", T.IntegerType()),
        T.StructField("rule_entropy", T.DoubleType()), T.StructField("secret_group", T.IntegerType()), T.StructField("path_regex", T.StringType()), T.StructField("generic", T.BooleanType()),
    ]
)


class BadRules(ValueError):
    """A rule file that holds no usable rules."""


@dataclass
class RuleSet:
    """Compiled rules, the keyword multimap (keyword, rule_id) and the rules' allowlists, in file order."""

    rules: list[dict]
    keywords: list[tuple[str, str]]
    allowlists: list[dict] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)

    @property
    def keyword_set(self) -> list[str]:
        return list(dict.fromkeys(k for k, _ in self.keywords))

    def rules_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([[r[f.name] for f in SCHEMA.fields] for r in self.rules], SCHEMA)

    def keywords_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.keywords, "keyword string, rule_id string")

    def allowlists_df(self, spark: SparkSession) -> DataFrame:
        rows = [(a["rule_id"], a["ord"], a["regexes"], a["paths"], a["target"], a["stopwords"], a["condition"]) for a in self.allowlists]
        return spark.createDataFrame(rows, "rule_id string, ord int, regexes array<string>, paths array<string>, target string, stopwords array<string>, condition string")


def load(path: str | Path | None = None) -> dict:
    """A rule file, TOML or JSON by its extension; without a path the built-in rules."""
    path = Path(path or BUILT_IN)
    text = path.read_text(encoding="utf-8")
    return json.loads(text) if path.suffix == ".json" else tomllib.loads(text)


def _usable(jvm, pattern: str) -> bool:
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # Py4J wraps PatternSyntaxException
        return False
    return True


def derived_keywords(rule_id: Column) -> Column:
    """For rules without keywords: the id's telling parts and, if there are several, both ways to write them as one; sorted."""
    words = F.filter(F.split(F.lower(rule_id), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(fixed.COMMON_PARTS))
    joins = F.when(F.size(words) > 1, F.array(F.array_join(words, "-"), F.array_join(words, ""))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(words, joins), lambda k: F.length(k) > 1)))


def derive_keywords(spark: SparkSession, rule_ids: list[str]) -> dict[str, list[str]]:
    """The derived keywords of some rules, at most MOST_RULES."""
    if not rule_ids:
        return {}
    rows = spark.createDataFrame([(i,) for i in rule_ids], "rule_id string")
    return {r.rule_id: r.k for r in rows.select("rule_id", derived_keywords(F.col("rule_id")).alias("k")).collect()}


def compile_rules(spark: SparkSession, data: dict, derive: bool = True) -> RuleSet:
    """Patterns in Java's dialect; rules and allowlist patterns that don't compile are dropped. Keywords are lower-cased,
    and derived from the id for rules without any: a rule without keywords is never tried."""
    if not isinstance(data, dict) or not isinstance(data.get("rules"), list):
        raise BadRules("no list of rules")
    if not data["rules"]:
        raise BadRules("no rules")
    if len(data["rules"]) > MOST_RULES:
        raise BadRules(f"more than {MOST_RULES} rules")
    jvm, out = spark._jvm, RuleSet([], [])
    derived = derive_keywords(spark, [r["id"] for r in data["rules"] if r.get("id") and not r.get("keywords")] if derive else [])
    for r in data["rules"]:
        source = r.get("regex")
        java = rule_regex(source) if source else None
        if not r.get("id") or not java or not _usable(jvm, java):
            out.dropped.append(r.get("id") or "")
            continue
        out.rules.append(
            {"rule_id": r["id"], "description": r.get("description") or "", "java_regex": java, "n_groups": groups(source), "rule_entropy": float(r.get("entropy") or 0), "secret_group": int(r.get("secretGroup") or 0), "path_regex": r.get("path"), "generic": r["id"].lower().startswith("generic-")}
        )
        out.keywords += [(k.lower(), r["id"]) for k in r.get("keywords") or derived.get(r["id"], [])]
        for i, a in enumerate(r.get("allowlists") or ([r["allowlist"]] if r.get("allowlist") else [])):
            regexes = [p for p in ("(?iu)" + rule_regex(x) for x in a.get("regexes") or [] if "(?s:" not in x) if _usable(jvm, p)]
            paths = [p for p in ("(?iu)" + rule_regex(x) for x in a.get("paths") or []) if _usable(jvm, p)]
            out.allowlists.append({"rule_id": r["id"], "ord": i, "regexes": regexes, "paths": paths, "target": a.get("regexTarget") or "match", "stopwords": [s.lower() for s in a.get("stopwords") or []], "condition": (a.get("condition") or "OR").upper()})
    return out


# --- keywords -----------------------------------------------------------------------------------


#: So many characters of a place are looked at, each by a class of its own, before the words are tried there.
AHEAD = 3


def keyword_pattern(keywords: list[str], between: str = "") -> str:
    """An alternation shaped as a trie behind a look at the first characters, so that most places in a text are left after one or two
    of them, however many words there are. `between`: a pattern of what may stand between a keyword's characters."""

    def escaped(c: str) -> str:
        return re.sub(r"([.^$*+?()\[\]{}|\\&~#\s-])", r"\\\1", c)

    def branch(words: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for w in words:
            heads.setdefault(w[0], []).append(w[1:])
        # a word that ends here makes what follows it needless
        one = [escaped(c) + ("" if "" in rest else between + branch(rest)) for c, rest in heads.items()]
        return one[0] if len(one) == 1 else "(?:" + "|".join(one) + ")"

    own = sorted({k for k in keywords if k})
    if not own:
        return r"(?!)"
    shared = min(AHEAD, *(len(k) for k in own))
    ahead = between.join("[" + "".join(map(escaped, sorted({k[i] for k in own}))) + "]" for i in range(shared))
    return branch(own) if len({k[0] for k in own}) == 1 else f"(?={ahead})" + branch(own)


def may_hold(text: Column, words: list[str]) -> Column:
    """True for every text whose lower case holds one of the words. Nothing is lower-cased: besides capitals only two signs have a lower
    case with ASCII letters, and texts with those may hold any."""
    if not all(w.isascii() for w in words):
        return F.lower(text).rlike(keyword_pattern(words))
    return text.rlike("(?i)" + keyword_pattern(words)) | text.contains("\u0130") | text.contains("\u212a")


def _layers(keywords: list[str]) -> list[list[str]]:
    """The keywords in layers, in none of which one begins with another: as many layers as the longest chain of such."""
    depth: dict[str, int] = {}
    for k in sorted({k for k in keywords if k}):  # what a keyword begins with comes before it
        depth[k] = 1 + max((depth[k[:n]] for n in range(1, len(k)) if k[:n] in depth), default=-1)
    out: list[list[str]] = [[] for _ in range(1 + max(depth.values(), default=-1))]
    for k, d in depth.items():
        out[d].append(k)
    return out


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """The distinct keywords that `text` holds, case-blind.

    One alternation spares most texts the search. The search reads the text once a layer, looking ahead from every place into a trie:
    in a layer at most one keyword begins at a place, so none is missed, and the cost does not grow with the keywords' number.
    """
    low = F.lower(text)
    found = [F.regexp_extract_all(low, F.lit(f"(?=({keyword_pattern(own)}))"), F.lit(1)) for own in _layers(keywords)]
    if not found:
        return F.array().cast("array<string>")
    return F.when(low.rlike(keyword_pattern(keywords)), F.array_distinct(F.concat(*found))).otherwise(F.array().cast("array<string>"))


def collisions(keywords: DataFrame) -> DataFrame:
    """Keywords of several rules: keyword, n_rules, rule_ids (sorted)."""
    return keywords.groupBy("keyword").agg(F.countDistinct("rule_id").alias("n_rules"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids")).where("n_rules > 1")


# --- matching -----------------------------------------------------------------------------------


def match_rules(candidates: DataFrame, ruleset: RuleSet, by_path: bool = False) -> DataFrame:
    """For every candidate (cand_id, value, line, db1_hits, path) with a match its best rule and all that matched.

    Triggered are the rules of keywords in the line or the value. A rule is tried on the line, then on the
    value; a match on the line that doesn't overlap the value's first place there rejects the rule.
    """
    spark = candidates.sparkSession
    keywords = F.broadcast(ruleset.keywords_df(spark))  # bounded by MOST_RULES
    rules = F.broadcast(ruleset.rules_df(spark))
    hit = F.array_union("db1_hits", keyword_hits(F.col("value"), ruleset.keyword_set))
    rows = candidates.select("cand_id", "value", "line", "path", F.explode(hit).alias("keyword")).join(keywords, "keyword").join(rules, "rule_id")
    if by_path:
        rows = rows.where(F.col("path_regex").isNull() | F.expr("path rlike path_regex"))
    where = F.expr("regexp_instr(line, java_regex)")
    whole = F.expr("regexp_extract(line, java_regex, 0)")
    first = F.expr("instr(line, value)")
    overlaps = (first == 0) | ((first + F.length("value") > where) & (first < where + F.length(whole)))
    on_line, on_value = F.expr("line rlike java_regex"), F.expr("value rlike java_regex")
    score = F.when(on_line, F.when(overlaps, F.when(F.col("generic"), 0.8).otherwise(0.92))).when(on_value, F.when(F.col("generic"), 0.6).otherwise(0.85))
    group = F.expr("if(secret_group <= n_groups, secret_group, 0)")
    rows = rows.select("cand_id", "rule_id", "description", "generic", "rule_entropy", score.alias("l1_score"), F.when(on_line, F.col("line")).otherwise(F.col("value")).alias("subject"), "java_regex", group.alias("g")).where("l1_score is not null")
    inside = F.expr("regexp_extract(subject, java_regex, g)")
    matched = F.when(inside == "", F.expr("regexp_extract(subject, java_regex, 0)")).otherwise(inside)
    order = F.struct((-F.col("l1_score")).alias("s"), F.col("generic").alias("g"), F.col("rule_id").alias("r"))
    best = F.struct("rule_id", "description", matched.alias("matched_value"), "l1_score", "generic", "rule_entropy")
    return (
        rows.groupBy("cand_id")
        .agg(F.min_by(best, order).alias("b"), F.array_sort(F.collect_set(F.struct((-F.col("l1_score")).alias("neg"), "generic", "rule_id"))).alias("m"))
        .select("cand_id", "b.*", F.transform("m", lambda x: F.struct(x["rule_id"].alias("rule_id"), (-x["neg"]).alias("score"))).alias("all_matched"))
        .withColumn("known_provider", ~F.col("generic"))
    )


def allowlisted(matched: DataFrame, ruleset: RuleSet) -> DataFrame:
    """`matched` (cand_id, rule_id, value, line, path) that one of its rule's allowlists covers: cand_id, rule_reason."""
    if not ruleset.allowlists:
        return matched.select("cand_id", F.lit(None).cast("string").alias("rule_reason")).limit(0)
    lists = F.broadcast(ruleset.allowlists_df(matched.sparkSession))  # bounded by MOST_RULES
    rows = matched.join(lists, "rule_id").withColumn("t", F.when(F.col("target") == "line", F.col("line")).otherwise(F.col("value")))
    low = F.lower("t")
    stop = F.filter("stopwords", lambda w: F.contains(low, w))
    regex = F.exists("regexes", lambda p: F.call_function("rlike", F.col("t"), p))
    path = F.exists("paths", lambda p: F.call_function("rlike", F.col("path"), p))
    some = F.size("paths") > 0
    both = (F.col("condition") == "AND") & regex & (path | ~some)
    either = (F.col("condition") != "AND") & (regex | (some & path))
    reason = F.when(F.size(stop) > 0, F.concat(F.lit('stopword match: "'), F.get(stop, 0), F.lit('"'))).when(both, "AND condition met (regex + path)").when(either, "OR condition met")
    rows = rows.select("cand_id", "ord", reason.alias("reason")).where("reason is not null")
    return rows.groupBy("cand_id").agg(F.min_by("reason", "ord").alias("rule_reason"))
