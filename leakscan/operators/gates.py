"""Reductions, allowlists, the aggregate score and severities, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscan.functions import fixed
from leakscan.functions.dialect import BOUNDARY, ascii_words
from leakscan.functions.text import any_of, either, let, trim_unicode


def _least(value: Column, table: list[tuple[str, str, float]]) -> tuple[Column, Column]:
    """The names of the patterns that fit, in order, and the least of their factors (1 without any)."""
    rows = [F.when(value.rlike(ascii_words(p)), F.struct(F.lit(n).alias("name"), F.lit(f).alias("factor"))) for n, p, f in table]
    found = F.filter(F.array(*rows), lambda x: x.isNotNull())
    return F.transform(found, lambda x: x["name"]), F.coalesce(F.array_min(F.transform(found, lambda x: x["factor"])), F.lit(1.0))


def placeholder(value: Column, line: Column | None = None, adjacent: Column | None = None) -> dict[str, Column]:
    """placeholder_names and placeholder_factor; phrases on the line or beside it lower the factor."""
    names, factor = _least(value, fixed.PLACEHOLDERS)
    if line is not None:
        around = F.lower(F.concat_ws(" ", F.array(line), adjacent))
        phrase = let(around, lambda a: F.exists(F.lit(list(fixed.PLACEHOLDER_PHRASES)), lambda p: F.contains(a, p)))

        def lowered(x):
            lower = (x["factor"] > fixed.PLACEHOLDER_PHRASE_FACTOR) & phrase
            more = F.when(lower, F.array_append(x["names"], F.lit("placeholder-context"))).otherwise(x["names"])
            return F.struct(more.alias("names"), F.when(lower, fixed.PLACEHOLDER_PHRASE_FACTOR).otherwise(x["factor"]).alias("factor"))

        both = let(F.struct(names.alias("names"), factor.alias("factor")), lowered)
        names, factor = both["names"], both["factor"]
    return {"placeholder_names": names, "placeholder_factor": factor}


def non_secret_format(value: Column) -> dict[str, Column]:
    """format_names and format_factor of the trimmed value."""
    both = let(trim_unicode(value), lambda v: F.struct(*[c.alias(n) for n, c in zip(("names", "factor"), _least(v, fixed.FORMATS), strict=True)]))
    names, factor = both["names"], both["factor"]
    return {"format_names": names, "format_factor": factor}


def _stopword(value: Column, words: list[str], label: str) -> Column:
    escaped = [w.replace("-", r"\-") for w in words]
    out = None
    some = value.rlike(f"(?i){BOUNDARY}(?:{'|'.join(escaped)}){BOUNDARY}")
    for w, e in zip(words, escaped, strict=True):
        hit, said = value.rlike(f"(?i){BOUNDARY}{e}{BOUNDARY}"), F.lit(f'{label} stopword: "{w}"')
        out = F.when(hit, said) if out is None else out.when(hit, said)
    return F.when(some, out) if words else F.lit(None).cast("string")


def allow_reason(value: Column, line: Column, rule_reason: Column, stopwords: list[str], patterns: list[str], marks: list[str]) -> Column:
    """Why a candidate is allowed, the first reason of the cascade; null if it isn't."""
    return F.coalesce(
        F.when(any_of(line, [either(fixed.INLINE_MARKS), *marks]), "Inline suppression comment"),
        F.when(rule_reason.isNotNull(), F.concat(F.lit("Rule allowlist: "), rule_reason)),
        F.when(any_of(value, [either(fixed.GLOBAL_PATTERNS)]) | any_of(line, [either(fixed.GLOBAL_PATTERNS)]), "Global allowlist pattern"),
        _stopword(value, fixed.GLOBAL_STOPWORDS, "Global"),
        _stopword(value, stopwords, "Developer"),
        *[F.when(any_of(value, ["(?i)" + p]) | any_of(line, ["(?i)" + p]), F.lit(f"Developer pattern: {p}")) for p in patterns],
    )


def normal_weights(weights: dict[str, float]) -> dict[str, float]:
    """Weights that sum to 1; the defaults if their sum is no positive number."""
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total > 0 and math.isfinite(total) else dict(fixed.WEIGHTS)


def confidence(c: dict[str, Column], weights: dict[str, float]) -> dict[str, Column]:
    """base_score and score from the layers' columns, in a fixed order of operations.

    c: l1_score, l2_score, l2_entropy, l3_score, l4_score, l5_score, matched, known_provider, generic,
    specific_context, file_factor, placeholder_factor, format_factor, allowed, value.
    """
    w = normal_weights(weights)
    synergy = F.when(~c["matched"] & (c["l3_score"] >= 0.4) & (c["l2_score"] >= 0.6), 0.28).otherwise(0.0)
    base = c["l1_score"] * w["regex"] + c["l2_score"] * w["entropy"] + c["l3_score"] * w["context"] + c["l4_score"] * w["string_group"] + c["l5_score"] * w["file_context"] + synergy
    allow = F.when(c["allowed"], 0.02).otherwise(1.0)
    scaled = base * c["file_factor"] * allow * c["placeholder_factor"] * c["format_factor"]
    pem = c["value"].rlike("-----BEGIN[A-Z0-9 _-]*PRIVATE KEY-----")
    floor = c["known_provider"] | (c["matched"] & c["generic"] & c["specific_context"]) | pem
    score = F.when(c["allowed"], 0.0).when(floor, F.greatest(scaled, F.lit(0.9))).otherwise(scaled)
    name_like = c["value"].rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*\z") & (c["l2_entropy"] < 3.0)
    return {"base_score": base, "score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(name_like, 0.0).otherwise(score)))}


def may_reach(c: dict[str, Column], weights: dict[str, float], least: float) -> Column:
    """Whether a candidate passes `least` unless it is allowed or reduced: no allowlist and no factor, all at most 1, raises a score.
    c: `confidence`'s columns but for placeholder_factor, format_factor and allowed."""
    none = {"allowed": F.lit(False), "placeholder_factor": F.lit(1.0), "format_factor": F.lit(1.0)}
    own = F.struct(*[x.alias(k) for k, x in c.items()])
    return F.coalesce(let(own, lambda s: passes(confidence({k: s[k] for k in c} | none, weights)["score"], least)), F.lit(True))


def explanation(c: dict[str, Column]) -> Column:
    """How a score came about: the layers, what reduced or raised it, and the result. c: `confidence`'s columns and its results."""
    two = lambda x: F.format_string("%.2f", x)
    base = F.concat(F.lit("Base score: "), F.format_string("%.3f", c["base_score"]), F.lit(" (regex="), two(c["l1_score"]), F.lit(", entropy="), two(c["l2_score"]), F.lit(", context="), two(c["l3_score"]), F.lit(", strings="), two(c["l4_score"]), F.lit(", file="), two(c["l5_score"]), F.lit(")"))
    factor = lambda label, x, when: F.when(when, F.concat(F.lit(label + ": ×"), two(x)))
    return F.concat_ws(
        " | ", base, factor("File risk multiplier", c["file_factor"], c["file_factor"] != 1.0), factor("Allowlist reduction", F.lit(0.02), c["allowed"]),
        factor("Placeholder reduction", c["placeholder_factor"], c["placeholder_factor"] < 1.0), factor("Format disambiguation", c["format_factor"], c["format_factor"] < 1.0),
        F.when(c["known_provider"], F.lit("Known provider override: floor=0.90")), F.concat(F.lit("Final confidence: "), F.format_string("%.1f", c["score"] * 100), F.lit("%")),
    )


def severity(score: Column) -> Column:
    """Null below the least severity's score."""
    out = F.lit(None).cast("string")
    for name, _, least in reversed(fixed.SEVERITIES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def severity_rank(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for n, rank, _ in fixed.SEVERITIES:
        out = F.when(name == n, rank).otherwise(out)
    return out


def _named(name: Column, words: dict[str, str]) -> Column:
    return F.get(F.lit(list(words.values())), F.array_position(F.lit(list(words)), name).cast("int") - 1)


def severity_label(name: Column) -> Column:
    """The severity in words; a name that is none stays."""
    return F.coalesce(F.when(name.isin([n for n, _, _ in fixed.SEVERITIES]), F.initcap(name)), name)


def marker_level(name: Column) -> Column:
    """error, warning, information or hint; warning for a name that is no severity."""
    return F.coalesce(_named(name, fixed.MARKER_LEVELS), F.lit("warning"))


def marker_color(name: Column) -> Column:
    """A theme's colour; null for a name that is no severity."""
    return _named(name, fixed.MARKER_COLORS)


def passes(score: Column, least: float) -> Column:
    """At or above the configured score, which counts from the least severity's up."""
    return score >= max(least, fixed.SEVERITIES[-1][2])


def blocks(name: Column, blocking: dict[str, bool] | None = None) -> Column:
    """Whether a finding of this severity blocks a commit."""
    return F.coalesce(name.isin([k for k, v in (blocking or fixed.BLOCKING).items() if v] or [""]), F.lit(False))
