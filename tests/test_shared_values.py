"""Globs are searched for without .* at their ends; lengths need no search in most strings."""

import time

from pyspark.sql import functions as F

from leakscan.functions import fixed, text
from leakscan.functions.dialect import glob_regex
from leakscan.operators import literals, paths


def test_globs_without_their_ends_find_the_same(spark):
    assert not any(paths._found(g).startswith(".*") or paths._found(g).endswith(".*") for g in fixed.EXCLUDED_GLOBS)
    uris = [g.replace("**", x).replace("*", "y") for g in fixed.EXCLUDED_GLOBS for x in ("", "a", "a/b", "\n", "B/")] + ["src/a.js", "/DIST/x", "distx/", "/x.min.jss"]
    df = spark.createDataFrame([(u,) for u in uris], "u string")
    whole, short = ("|".join(f"(?:{f(g)})" for g in fixed.EXCLUDED_GLOBS) for f in (glob_regex, paths._found))
    assert df.where(F.col("u").rlike(whole) != F.col("u").rlike("(?i)" + short)).count() == 0
    assert df.where(F.col("u").rlike(whole)).count() > 60


def test_long_paths_cost_little(spark):
    df = spark.range(20).select(F.concat(F.repeat(F.lit("/abc"), 5_000), F.col("id").cast("string")).alias("u"))
    began = time.time()
    assert df.where(paths.risk(F.col("u")) == "NORMAL").count() == 20
    assert time.time() - began < 20


def test_lines_that_offer_values_pass_the_first_search(spark):
    quoted = [q + x + q for q in "\"'`" for x in ("abcdefgh", r"\"\"\"\"\"", "\\\\\\😀\\😀\\😀", "😀😀😀😀", "don't say it", "it\\'s \\'here", "$abcdefgh", "ab")]
    rows = [*quoted, "KEY=abcdefghij", " a.b-c = 12345678 # x", "x = 'short' \"longer value\"", "it's one", "=abcdefghij", ""]
    df = spark.createDataFrame([(x,) for x in rows], "line string")
    some = df.where(F.size(literals.candidate_values(F.col("line"))) > 0)
    assert some.count() > 12 and some.where(~F.col("line").rlike(literals.OFFERS)).count() == 0
    n = spark.createDataFrame([(x,) for x in ("", "abc", "äöü", "日", "😀", "a😀é", "😀😀😀")], "s string").select("s", text.utf16_length(F.col("s")).alias("n"))
    assert all(r.n == len(r.s.encode("utf-16-le")) // 2 for r in n.collect())
