"""Files cut into lines, each with its neighbours and whether it is in a comment.

All of it is computed within a file's row, so no shuffle gathers a file's lines and no window sorts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan.functions import fixed, text
from leakscan.functions.dialect import SPACE
from leakscan.functions.text import any_of

NEAR = 5
CHANGED_NEAR = 2


def _single(line: Column) -> Column:
    """A comment up to the line's end, after blanks."""
    return line.rlike(f"^[{SPACE}]*(?://|#|--|<!--)")


def _events(lines: Column) -> Column:
    """One letter a line: c ends a block comment, o opens one, x does neither."""

    def event(line):
        return F.when(line.contains("*/"), "c").when(line.contains("/*") & ~_single(line), "o").otherwise("x")

    return F.array_join(F.transform(lines, event), "")


def _inside(events: Column) -> Column:
    """One letter a line: i inside a block comment (after the line that opens it, up to the one that closes it), else the event."""
    # a line is inside if the one before opens, or is inside itself (the last match ends here) and doesn't close
    return F.regexp_replace(events, r"(?<=o).|(?!^)\G(?<!c).", "i")


def in_comment(line: Column, inside: Column) -> Column:
    return inside | line.contains("/*") | _single(line)


def _near_changed(changed: Column, n: Column) -> Column:
    """One letter a line: x within CHANGED_NEAR lines of a changed one."""
    own = F.array_sort(F.array_distinct(F.filter(changed, lambda c: (c >= -CHANGED_NEAR) & (c < n + CHANGED_NEAR))))
    own = F.transform(own, lambda c: c + CHANGED_NEAR)  # from 0, so that lines beyond both ends count too
    gaps = lambda a: F.transform(a, lambda c, i: c - F.when(i == 0, F.lit(0)).otherwise(F.get(a, i - 1) + 1))
    marks = text.let(own, lambda a: F.concat(F.array_join(F.transform(gaps(a), lambda g: F.concat(F.repeat(F.lit("."), g), F.lit("x"))), ""), F.repeat(F.lit("."), n + 2 * CHANGED_NEAR)))
    # what follows or precedes an x by that much
    spread = F.regexp_replace(marks, f"(?<=x.{{0,{CHANGED_NEAR - 1}}}).|.(?=.{{0,{CHANGED_NEAR - 1}}}x)", "x")
    return F.substring(spread, F.lit(CHANGED_NEAR + 1), n)


def with_lines(files: DataFrame, keep=None, surrounding: bool = True, keep_near=None, keep_text=None, counted: bool = True) -> DataFrame:
    """`files` (content, optional changed_lines), a row each, with content replaced by n_lines and lines (line_no from 0, line,
    in_comment, surrounding).

    Lines end at \\n only. surrounding holds up to five lines before, then five after. Lines go out if
    changed_lines is not empty and none of it is within two lines, or if `keep` (of the line) or `keep_near` (of the
    line and its surrounding) is false. Files whose content `keep_text` refuses have no lines. A null content has
    null lines and n_lines. Time is linear in a file's lines. Without `counted` n_lines is a field of the lines instead, which spares
    files without lines the count.
    """
    content, incremental = F.col("content"), "changed_lines" in files.columns
    some = F.array().cast("array<string>")

    def neighbours(all_, n, i):
        before = F.slice(all_, F.greatest(F.lit(1), i - NEAR + 1), F.least(i, F.lit(NEAR)))
        after = F.slice(all_, F.least(i + 2, n + 1), F.least(F.lit(NEAR), n - i - 1))
        return F.concat(F.when(i > 0, before).otherwise(some), F.when(i < n - 1, after).otherwise(some))

    def lines(all_, inside, near):
        n = F.size(all_)
        at = F.transform(all_, lambda line, i: F.struct(i.alias("line_no"), line.alias("line")))
        if incremental:
            at = F.filter(at, lambda r: F.coalesce(F.size("changed_lines") <= 0, F.lit(True)) | (F.get(near, r["line_no"]) == "x"))
        if keep is not None:
            at = F.filter(at, lambda r: keep(r["line"]))

        def row(r):
            own = [r["line_no"].alias("line_no"), r["line"].alias("line"), in_comment(r["line"], F.get(inside, r["line_no"]) == "i").alias("in_comment")]
            return F.struct(*own, *([neighbours(all_, n, r["line_no"]).alias("surrounding")] if surrounding else []), *([] if counted else [n.alias("n_lines")]))

        rows = F.transform(at, row)
        return rows if keep_near is None else F.filter(rows, lambda r: keep_near(r["line"], r["surrounding"]))

    near_of = lambda all_: F.split(_near_changed(F.col("changed_lines"), F.size(all_)), "") if incremental else some
    all_lines = F.split(content, "\n")
    all_lines = all_lines if keep_text is None else F.when(keep_text(content), all_lines).otherwise(some)
    own = text.let(all_lines, lambda all_: text.let(F.split(_inside(_events(all_)), ""), lambda inside: text.let(near_of(all_), lambda near: lines(all_, inside, near))))
    n = F.octet_length(content) - F.octet_length(F.replace(content, F.lit("\n"), F.lit(""))) + 1  # in bytes, which needs no counting of characters
    columns = [c for c in files.columns if c not in ("content", "changed_lines")]
    return files.select(*columns, *([n.alias("n_lines")] if counted else []), F.when(content.isNotNull(), own).alias("lines"))


def split_lines(files: DataFrame, keep: Column | None = None, surrounding: bool = True) -> DataFrame:
    """The lines of `with_lines`, a row each."""
    own = with_lines(files.where(F.col("content").isNotNull()), keep, surrounding)
    # for an outer generator no filter is inferred, which would compute the lines again; files without lines go by theirs
    return own.select(*[c for c in own.columns if c != "lines"], F.inline_outer("lines")).where("line_no is not null")


def adjacent(surrounding: Column) -> Column:
    """The two lines around the middle of `surrounding`: not always the true neighbours near a file's ends."""
    half = F.floor(F.size(surrounding) / 2).cast("int")
    pick = lambda k: F.when((k >= 1) & (k <= F.size(surrounding)), F.array(F.get(surrounding, k - 1))).otherwise(F.array().cast("array<string>"))
    return F.concat(pick(half), pick(half + 1))


def line_type(line: Column) -> Column:
    """The first type that fits; blank lines and others are UNKNOWN."""
    out = F.when(text.blank(line), "UNKNOWN")
    for name, patterns in fixed.LINE_TYPES:
        out = out.when(any_of(line, [text.either(patterns)]), name)
    return out.otherwise("UNKNOWN")


def string_assignment(line: Column) -> Column:
    return line.rlike("[:=]\\s*[\"'`]")


def array_context(line: Column) -> Column:
    return line.rlike(f"^[{SPACE}]*[\\[,]")
