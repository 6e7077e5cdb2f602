"""Findings come from the candidates that can have a severity, and from nothing that a line was read for twice."""

from pyspark.sql import functions as F

from leakscan.functions import fixed, text
from leakscan.operators import gates as G
from leakscan.operators import lines as L
from leakscan.plans.scan import Scanner

VALUES = ["Zk9#vQ2!mX7@pL4$wR8", "example-value-1", "aaaaaaaaaaaa", "deadbeef12", "${SOME_VALUE}", "ghp_" + "aB3dE5fG7hJ9" * 3, "-----BEGIN RSA PRIVATE KEY-----", "someName", "not a secret at all"]
SHAPES = ['const password = "{}"', '// token: "{}"', 'login(tkn, "{}") // nosec', 'colour = "{}"\na token beside', 'import "{}" # key', '"{}", "oauth stripe https key"']


def _files(spark):
    rows = [(f"/{folder}/{i}-{j}.js", shape.format(v)) for folder in ("src", "tests") for i, shape in enumerate(SHAPES) for j, v in enumerate(VALUES)]
    return spark.createDataFrame(rows, "file_uri string, content string")


def test_findings_are_the_scored_with_a_severity(spark):
    s, files = Scanner.default(spark), _files(spark)
    told = lambda df: sorted((r.file_uri, r.start_pos, r.score, r.severity, r.explanation, r.n_lines) for r in df.collect())
    scored = told(s.scored(files))
    found = [r for r in scored if r[3]]
    assert told(s.findings(files)) == found and found
    judged = told(s._scored(s.read(files), found=True))
    assert set(found) < set(judged) < set(scored)  # some stay below whatever the reductions do, and go before those


def test_no_reduction_raises_a_score(spark):
    names = ["l1_score", "l2_score", "l3_score", "l4_score", "l5_score", "l2_entropy", "file_factor"]
    rows = [(a, b, c, 0.3, 0.5, e, f, m, k, g, v) for a in (0.0, 0.92) for b in (0.2, 1.0) for c in (0.0, 0.9) for e in (2.0, 4.0) for f in (0.0, 0.5, 1.4) for m, k, g in ((False, False, False), (True, True, False), (True, False, True)) for v in ("name", "-----BEGIN PRIVATE KEY-----", "a b")]
    df = spark.createDataFrame([*rows, (None,) * 11], ", ".join(f"{n} double" for n in names) + ", matched boolean, known_provider boolean, generic boolean, value string")
    c = {k: F.col(k) for k in df.columns} | {"specific_context": F.col("matched")}
    reduced = [G.confidence(c | {"allowed": F.lit(a), "placeholder_factor": F.lit(p), "format_factor": F.lit(q)}, fixed.WEIGHTS)["score"] for a in (False, True) for p in (0.01, 1.0) for q in (0.3, 1.0)]
    for least in (0.1, 0.4, 0.9):
        out = df.select(G.may_reach(c, fixed.WEIGHTS, least).alias("may"), F.exists(F.array(*reduced), lambda x: G.passes(x, least)).alias("does"), "value").collect()
        assert all(r.may == bool(r.does) for r in out if r.value) and [r.may for r in out if r.value is None] == [True]


def test_a_line_is_read_through_once_for_patterns_of_a_kind(spark):
    assert str(L.line_type(F.col("x"))).upper().count("RLIKE") == len(fixed.LINE_TYPES) + 1
    texts = ["", " ", "　﻿", "\xa0x", "  # c", " return x", "x = 1", "a := 2", "let y: 3", "from a import b", "  const z = require ('q')", "private int", "'k' : 1", "f (x)", "=> {", "x [ ", ", y", "import", "/* c", "use it", "é = 1", "xé (", "<AB>", "LOCALHOST", "mylocalhost", "${x}", "x ${}", "NoSec", "pragma:allowlist  secret", "noqaX"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for patterns in [*(p for _, p in fixed.LINE_TYPES), fixed.GLOBAL_PATTERNS, fixed.INLINE_MARKS]:
        assert df.where(text.any_of(F.col("t"), [text.either(patterns)]) != text.any_of(F.col("t"), patterns)).count() == 0, patterns
    assert df.where(text.blank(F.col("t")) != (text.trim_unicode(F.col("t")) == "")).count() == 0 and df.where(text.blank(F.col("t"))).count() == 3


def test_lines_are_counted_where_asked(spark):
    s = Scanner.default(spark)
    files = spark.createDataFrame([("/a", 'x\nkey = "abcdefgh12"\n'), ("/b", "plain\n"), ("/c", None)], "file_uri string, content string")
    assert "n_lines" not in s.read(files, counted=False).columns
    assert {r.file_uri: r.n_lines for r in s.candidates(files).collect()} == {"/a": 3}
    assert {r.file_uri: r.lines_scanned for r in s.funnel(files).collect()} == {"/a": 3, "/b": 2, "/c": 1}
