"""The five scores of a candidate, as columns, and the context signals they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan.functions import fixed
from leakscan.functions.text import charset, diverse_score, entropy, let
from leakscan.operators import identifiers as I
from leakscan.operators import lines as L
from leakscan.operators import literals as S
from leakscan.operators.paths import risk_factor

_SIGNAL = "array<struct<ord:int,identifier:string,group:string,distance:int,weight:double>>"


def entropy_layer(value: Column, rule_entropy: Column) -> dict[str, Column]:
    """l2_entropy, l2_threshold and l2_score; the rule's threshold, or 3 bits without one."""
    e = entropy(value)
    threshold = F.when(rule_entropy > 0, rule_entropy).otherwise(3.0)
    size = charset(value)["charset_size"]

    def score(e):
        adjusted = diverse_score(value, e)
        full = F.least(F.lit(1.0), adjusted + F.when(size >= 94, 0.05).when(size >= 62, 0.03).otherwise(0.0))
        return F.when(e < 2, 0.0).when(e < threshold, F.least(F.lit(0.3), adjusted * (e / threshold))).otherwise(full)

    return {"l2_entropy": e, "l2_threshold": threshold, "l2_score": let(e, score)}


def context_lines(line: Column, line_no: Column, surrounding: Column) -> Column:
    """The own line, then the neighbours top down, each with its distance."""
    before = F.least(F.lit(5), line_no)
    near = F.transform(surrounding, lambda s, i: F.struct(s.alias("line"), F.abs(F.when(i < before, i - before).otherwise(i - before + 1)).alias("distance")))
    return F.concat(F.array(F.struct(line.alias("line"), F.lit(0).alias("distance"))), near)


def names(line: Column, line_no: Column, surrounding: Column, plain: list[str] | None = None) -> Column:
    """(ord, name, distance) of the names on a line and its neighbours, own line first, in order of appearance. Names that cannot be
    among the `plain` keywords are left out."""

    def of(c, k):
        own = lambda code: F.transform(S.names(code), lambda name, j: F.struct((k * 100_000 + j).alias("ord"), name.alias("name"), c["distance"].alias("distance")))
        return let(S.code(c["line"]), lambda code: F.when(I.may_name(code, plain), F.filter(own(code), lambda x: I.may_name(x["name"], plain))))

    return F.flatten(F.filter(F.transform(context_lines(line, line_no, surrounding), of), lambda own: own.isNotNull()))


def signals(lines: DataFrame, dictionary: DataFrame, broadcast: bool = True) -> DataFrame:
    """(line_id, signals, db2_hits) of lines (line_id, names): the names that the dictionary knows, in order of appearance."""
    named = lines.select("line_id", F.explode("names").alias("n")).select("line_id", "n.*")
    known = I.resolve(named, dictionary, broadcast)
    weight = F.get(F.lit(fixed.DISTANCE_WEIGHTS), F.col("distance"))
    hit = named.join(known, "name").select("line_id", F.struct("ord", F.col("name").alias("identifier"), "group", "distance", weight.alias("weight")).alias("s"))
    out = hit.groupBy("line_id").agg(F.array_sort(F.collect_list("s")).alias("signals"))
    own = F.transform(F.filter("signals", lambda s: s["distance"] == 0), lambda s: s["identifier"])
    return out.select("line_id", "signals", own.alias("db2_hits"))


def no_signals() -> Column:
    return F.array().cast(_SIGNAL)


def context_score(signals: Column) -> Column:
    """Weighted mean of the signals' group values, with bonuses for several groups and for the own line; 0 without signals."""
    known = [*fixed.BROAD_GROUPS, *fixed.SPECIFIC_GROUPS]
    value = lambda s: F.when(s["group"].isin(known), 1.0).otherwise(0.7)
    top = F.aggregate(signals, F.lit(0.0), lambda a, s: a + s["weight"] * value(s))
    all_ = F.aggregate(signals, F.lit(0.0), lambda a, s: a + s["weight"])
    kinds = F.size(F.array_distinct(F.transform(signals, lambda s: s["group"])))
    bonus = F.least(F.lit(0.2), (kinds - 1) * F.lit(0.05))
    own = F.when(F.exists(signals, lambda s: s["distance"] == 0), 0.1).otherwise(0.0)
    return F.when(F.size(signals) == 0, 0.0).otherwise(F.least(F.lit(1.0), top / all_ + bonus + own))


def matched_groups(signals: Column) -> Column:
    """Groups by their nearest signal, ties by first appearance."""
    firsts = F.transform(F.array_distinct(F.transform(signals, lambda s: s["group"])), lambda g: F.struct(
        F.array_min(F.transform(F.filter(signals, lambda s: s["group"] == g), lambda s: s["distance"])).alias("d"),
        F.array_min(F.transform(F.filter(signals, lambda s: s["group"] == g), lambda s: s["ord"])).alias("o"), g.alias("g")))
    return F.transform(F.array_sort(firsts), lambda x: x["g"])


def string_score(value: Column, line: Column, surrounding: Column) -> Column:
    """What other literals around say: authentication words, providers, HTTP."""
    others = F.filter(F.flatten(F.transform(F.concat(F.array(line), surrounding), S.literal_values)), lambda x: x != value)
    low = F.array_distinct(F.transform(others, F.lower))
    number = lambda own, names: F.size(F.filter(own, lambda x: x.rlike("|".join(n.replace(".", r"\.") for n in names))))

    def score(n):
        auth, provider, http = n["auth"], n["provider"], n["http"]
        return F.least(F.lit(0.55), auth * F.lit(0.2)) + F.least(F.lit(0.25), provider * F.lit(0.2)) + F.when(http > 0, 0.1).otherwise(0.0) + F.when((auth > 0) & (provider > 0), 0.1).otherwise(0.0)

    numbers = let(low, lambda own: F.struct(number(own, fixed.AUTH_STRINGS).alias("auth"), number(own, fixed.PROVIDER_STRINGS).alias("provider"), number(own, fixed.HTTP_STRINGS).alias("http")))
    return F.least(F.lit(1.0), let(numbers, score))


def file_score(line: Column, in_comment: Column, risk: Column) -> dict[str, Column]:
    """l5_score and what it rests on."""
    kind = L.line_type(line)
    comment = lambda kind: in_comment | (kind == "COMMENT")
    string = L.string_assignment(line)
    base = lambda kind, comment: (
        F.lit(0.5)
        + F.when(comment, -0.35).when(kind.isin("ASSIGNMENT", "OBJECT_PROPERTY"), 0.25).when(kind == "IMPORT", -0.2).when(kind == "RETURN_STATEMENT", 0.05).when((kind == "ARRAY_ELEMENT") | L.array_context(line), -0.1).otherwise(0.0)
        + F.when(string & ~comment, 0.1).otherwise(0.0)
    )
    factor = risk_factor(risk)
    row = lambda k, c: F.struct(k.alias("line_type"), c.alias("in_comment"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), base(k, c) * factor)).alias("l5_score"))
    own = let(kind, lambda k: let(comment(k), lambda c: row(k, c)))  # one row, so that the line's type is worked out once
    return {k: own[k] for k in ("line_type", "in_comment", "l5_score")} | {"file_factor": factor}
