"""String literals, unquoted assignments and identifiers of a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscan.functions import fixed
from leakscan.functions.dialect import SPACE
from leakscan.functions.text import let, trim_unicode, utf16_length

# possessive, so that long literals don't nest the matcher's calls
QUOTED = {'"': r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"', "'": r"'([^'\\]*+(?:\\.[^'\\]*+)*+)'", "`": r"`([^`$\\]*+(?:\\.[^`$\\]*+)*+)`"}
_LITERAL = "array<struct<value:string,start_pos:int,end_pos:int,quote:string>>"


def _located(line: Column, quote: str) -> Column:
    """Literals of one kind with the positions of their text, from 0. Matches are leftmost and don't overlap."""
    found = F.regexp_extract_all(line, F.lit(QUOTED[quote]), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.array().cast(_LITERAL).alias("out"))

    def step(a, m):
        pos = F.call_function("locate", m, line, a["at"])
        lit = F.struct(F.substring(m, F.lit(2), F.length(m) - 2).alias("value"), pos.cast("int").alias("start_pos"), (pos + F.length(m) - 2).cast("int").alias("end_pos"), F.lit(quote).alias("quote"))
        return F.struct((pos + F.length(m)).cast("int").alias("at"), F.array_append(a["out"], lit).alias("out"))

    return F.aggregate(found, start, step)["out"]


def literals(line: Column, least: int = fixed.SHORTEST) -> Column:
    """Double, then single, then back-quoted literals of at least `least` UTF-16 units, with positions."""
    parts = [F.when(line.contains(q), _located(line, q)).otherwise(F.array().cast(_LITERAL)) for q in QUOTED]
    return F.filter(F.concat(*parts), lambda x: utf16_length(x["value"]) >= least)


def literal_values(line: Column) -> Column:
    """All literals' texts, empty ones left out."""
    found = F.concat(*[F.regexp_extract_all(line, F.lit(p), F.lit(1)) for p in QUOTED.values()])
    return F.filter(found, lambda x: x != "")


def env_value(line: Column) -> Column:
    """The value of an unquoted KEY=value line as an array of at most one literal; a trailing ` # comment` goes."""
    ok = line.rlike(rf"^[{SPACE}]*[A-Za-z_][A-Za-z0-9_.-]*[{SPACE}]*=[{SPACE}]*([^\n\r  ]+)\z")
    eq = F.instr(line, "=")
    rest = F.substring(line, eq + 1, F.length(line))
    value = trim_unicode(F.regexp_replace(rest, rf"[{SPACE}]+#[^\n\r  ]*\z", ""))
    start = (eq + F.call_function("locate", value, rest) - 1).cast("int")
    one = F.array(F.struct(value.alias("value"), start.alias("start_pos"), (start + F.length(value)).cast("int").alias("end_pos"), F.lit("").alias("quote")))
    return F.when(ok & (value != ""), one).otherwise(F.array().cast(_LITERAL))


#: A line without this offers nothing: a literal holds three characters or escapes at least, an unquoted value has a name before it.
OFFERS = "|".join(rf"{q}(?:[^{q}{more}\\]|\\.){{3,}}+{q}" for q, more in (('"', ""), ("'", ""), ("`", "$"))) + rf"|^[{SPACE}]*+[A-Za-z_][A-Za-z0-9_.-]*+[{SPACE}]*+="


def candidate_values(line: Column) -> Column:
    """What a line offers for scoring: its literals, or else its unquoted value, of 8 to 512 UTF-16 units."""
    found = let(literals(line), lambda own: F.when(F.size(own) > 0, own).otherwise(env_value(line)))
    return F.filter(found, lambda x: (utf16_length(x["value"]) >= fixed.SHORTEST) & (utf16_length(x["value"]) <= fixed.LONGEST))


def _without(line: Column, mark: str, pattern: str) -> Column:
    return let(line, lambda x: F.when(x.contains(mark), F.regexp_replace(x, pattern, "")).otherwise(x))


def code(line: Column) -> Column:
    """The line without its literals and comments."""
    s = line
    for mark, p in (('"', r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'), ("'", r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"), ("`", r"`[^`\\]*+(?:\\.[^`\\]*+)*+`"), ("//", r"//.*\z"), ("/*", r"/\*.*?\*/"), ("#", r"#.*\z")):
        s = _without(s, mark, p)
    return s


def identifiers(line: Column) -> Column:
    """Names outside literals and comments, repeats included, without language keywords and single letters."""
    return names(code(line))


def names(code: Column) -> Column:
    """`identifiers` of a line's `code`."""
    # a name starts at a word boundary and ends at one; $ is no word character
    name = r"(?<![A-Za-z0-9_])([a-zA-Z_](?:[a-zA-Z0-9_$]*[a-zA-Z0-9_])?)(?![A-Za-z0-9_])|(?<=[A-Za-z0-9_])(\$[a-zA-Z0-9_$]*[a-zA-Z0-9_])(?![A-Za-z0-9_])"
    found = F.regexp_extract_all(code, F.lit(name), F.lit(0))
    return F.filter(found, lambda x: (F.length(x) >= 2) & ~F.lower(x).isin(fixed.LANGUAGE_KEYWORDS))
