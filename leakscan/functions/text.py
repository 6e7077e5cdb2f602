"""Column functions over strings. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscan.functions.dialect import SPACE, ascii_words


def any_of(col: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is found."""
    return reduce(lambda a, b: a | b, [col.rlike(ascii_words(p)) for p in patterns], F.lit(False))


def either(patterns: list[str]) -> str:
    r"""One pattern for all, which a text is read through once for. They refer to no groups. What begins with ^\s* shares that."""
    head = r"^\s*"
    rest = "|".join(f"(?:{p.removeprefix(head)})" for p in patterns if p.startswith(head))
    return "|".join([*([f"{head}(?:{rest})"] if rest else []), *(f"(?:{p})" for p in patterns if not p.startswith(head))])


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body reads it, inside lambdas too: the optimiser can't copy a lambda's
    variable to where it is read, as it does with a column."""
    return F.get(F.transform(F.array(value), body), 0)


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice. Such take four bytes, so most strings need no search."""
    return F.when(F.octet_length(s) < F.length(s) + 3, F.length(s)).otherwise(F.length(s) + F.length(F.regexp_replace(s, r"[^\x{10000}-\x{10FFFF}]+", "")))


def trim_unicode(s: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(s, f"^[{SPACE}]+", ""), f"[{SPACE}]+\\z", "")


def blank(s: Column) -> Column:
    """Whether `trim_unicode` leaves nothing; a text is read up to its first other character only."""
    return ~s.rlike(f"[^{SPACE}]")


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


#: Up to so many characters, counting each distinct one by a pass of its own is quicker than sorting them.
FEW = 64


def _counts(own: Column) -> Column:
    """How often each distinct character occurs, in order of first occurrence: by sorting characters with their places once."""
    placed = F.array_sort(F.transform(own, lambda c, i: F.struct(c.alias("c"), i.alias("i"))))

    def runs(all_):
        first = F.filter(F.transform(all_, lambda x, k: F.when((k == 0) | (x["c"] != F.get(all_, k - 1)["c"]), F.struct(x["i"].alias("i"), k.alias("k")))), lambda x: x.isNotNull())
        sized = let(first, lambda f: F.transform(f, lambda x, j: F.struct(x["i"].alias("i"), (F.coalesce(F.get(f, j + 1)["k"], F.size(all_)) - x["k"]).alias("n"))))
        return F.transform(F.array_sort(sized), lambda x: x["n"].cast("double"))

    return let(placed, runs)


def entropy(s: Column) -> Column:
    """Shannon entropy in bits of the characters, over the UTF-16 length; 0 for the empty string.

    Terms are summed in order of first occurrence. Time is near linear in the length, whatever the number of distinct characters.
    """
    own, n = chars(s), utf16_length(s).cast("double")
    count = lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("double")
    counts = F.when(F.length(s) <= FEW, F.transform(F.array_distinct(own), count)).otherwise(_counts(own))
    total = let(n, lambda m: F.aggregate(counts, F.lit(0.0), lambda a, k: a - k / m * F.log2(k / m)))
    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(total)


def entropy_score(e: Column) -> Column:
    """0, .2, .4, .6, .8 or 1 at 2, 3, 3.5, 4 and 4.5 bits."""
    return F.when(e < 2, 0.0).when(e < 3, 0.2).when(e < 3.5, 0.4).when(e < 4, 0.6).when(e < 4.5, 0.8).otherwise(1.0)


def charset(s: Column) -> dict[str, Column]:
    """Which classes of characters occur, and the size of their union."""
    flags = {"has_upper": s.rlike("[A-Z]"), "has_lower": s.rlike("[a-z]"), "has_digit": s.rlike("[0-9]"), "has_special": s.rlike("[^A-Za-z0-9]")}
    sizes = zip(flags.values(), (26, 26, 10, 32), strict=True)
    return flags | {"charset_size": reduce(lambda a, b: a + b, [F.when(f, n).otherwise(0) for f, n in sizes])}


def diverse_score(s: Column, e: Column) -> Column:
    """entropy_score with a bonus for three or four classes of characters, at most 1."""
    c = charset(s)
    kinds = reduce(lambda a, b: a + b, [c[k].cast("int") for k in ("has_upper", "has_lower", "has_digit", "has_special")])
    return F.least(F.lit(1.0), entropy_score(e) + F.when(kinds >= 4, 0.1).when(kinds == 3, 0.05).otherwise(0.0))


def snake(s: Column) -> Column:
    """An underscore before every capital, then lower case, without a leading one."""
    return F.regexp_replace(F.lower(F.regexp_replace(s, "([A-Z])", "_$1")), "^_", "")


def camel(s: Column) -> Column:
    """snake_case as camelCase: only a letter right after an underscore is raised and takes its place."""
    parts = F.split(F.lower(s), "_(?=[a-z])")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))))), "")


def case_variants(s: Column) -> Column:
    """The distinct spellings of an identifier, itself first."""
    own, has = snake(s), s.contains("_")
    c = camel(s)
    pascal = F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))
    more = F.when(has, F.array(c, pascal)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(s, F.lower(s), F.upper(s), own, F.upper(own)), more, F.array(F.replace(own, F.lit("_"), F.lit("-")))))


def slug(s: Column) -> Column:
    """Lower case, other runs as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+\\z", "")


def camel_to_snake(s: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2"))


def env_segment(s: Column) -> Column:
    """An upper-case name of letters, digits and single underscores."""
    return F.regexp_replace(F.regexp_replace(F.upper(s), "[^A-Z0-9]+", "_"), "^_+|_+\\z", "")


def mean_entropy(values: Column) -> Column:
    """The mean entropy of an array of strings; 0 without any."""
    return F.when(F.size(values) > 0, F.aggregate(F.transform(values, entropy), F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(0.0)


def finding_id(uri: Column, line_no: Column, start: Column, value: Column) -> Column:
    """SHA-256 of where a finding is and of its value's hash: the same in every run."""
    return F.sha2(F.concat_ws(":", F.coalesce(uri, F.lit("")), line_no.cast("string"), start.cast("string"), F.sha2(value, 256)), 256)


def suppression_key(uri: Column, line_no: Column, line: Column, rule: Column) -> Column:
    """SHA-256 of uri:line number:trimmed line:rule, 'unknown' without a rule, an empty uri without one."""
    return F.sha2(F.concat(F.coalesce(uri, F.lit("")), F.lit(":"), line_no.cast("string"), F.lit(":"), trim_unicode(line), F.lit(":"), F.coalesce(rule, F.lit("unknown"))), 256)
