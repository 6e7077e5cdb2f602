"""The line model against plain Python, and its time in a file's lines."""

import random
import time

import pytest
from pyspark.sql import functions as F

from leakscan.operators import lines as L
from leakscan.plans.scan import Scanner

SECRET = 'const githubToken = "ghp_' + "aB3dE5fG7hJ9kL1mN2pQ4rS6tU8vW0xY1zA2" + '";'
PARTS = ["/*", "*/", "x", "// /*", "/* a */", "*/ /*", "y = 1", "", "  # z", "\t-- q", "<!-- r"]


def comments(lines):
    inside, out = False, []
    for x in lines:
        single = x.lstrip().startswith(("//", "#", "--", "<!--"))
        out.append(inside or single or "/*" in x)
        inside = False if "*/" in x else inside or ("/*" in x and not single)
    return out


@pytest.fixture(scope="module")
def files():
    rng = random.Random(2)
    out = [(f"/{k}", "\n".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 25))), [rng.randrange(-4, 26) for _ in range(rng.randrange(0, 5))] if k % 6 else None) for k in range(200)]
    return [*out, ("/empty", "", None), ("/blank", "\n", []), ("/far", "a\nb\nc", [2**31 - 1, -(2**31), 5])]


def test_lines_equal_brute_force(spark, files):
    df = spark.createDataFrame([(u, c) for u, c, _ in files], "file_uri string, content string").repartition(3)
    got = {}
    for r in L.split_lines(df).collect():
        got.setdefault(r.file_uri, []).append((r.line_no, r.line, r.in_comment, r.surrounding, r.n_lines))
    for uri, content, _ in files:
        own = content.split("\n")
        want = [(i, x, c, own[max(0, i - 5) : i] + own[i + 1 : i + 6], len(own)) for i, (x, c) in enumerate(zip(own, comments(own), strict=True))]
        assert sorted(got[uri]) == want


def test_changed_lines_equal_brute_force(spark, files):
    df = spark.createDataFrame(files, "file_uri string, content string, changed_lines array<int>").repartition(3)
    got = {}
    for r in L.split_lines(df, surrounding=False).collect():
        got.setdefault(r.file_uri, set()).add(r.line_no)
    for uri, content, changed in files:
        assert got.get(uri, set()) == {i for i in range(content.count("\n") + 1) if not changed or any(abs(i - c) <= 2 for c in changed)}


def test_null_content(spark):
    df = spark.createDataFrame([("/a", None), ("/b", "x")], "file_uri string, content string")
    assert [(r.file_uri, r.n_lines, r.lines is None) for r in L.with_lines(df).orderBy("file_uri").collect()] == [("/a", None, True), ("/b", 1, False)]
    assert [r.file_uri for r in L.split_lines(df).collect()] == ["/b"]


def _seconds(spark, n, run):
    text = "\n".join(SECRET if i % 50 == 0 else f"value_{i} = compute({i}) /* note */" for i in range(n))
    df = spark.createDataFrame([("/a.js", text, list(range(0, n, 3)))], "file_uri string, content string, changed_lines array<int>")
    best = 1e9
    for _ in range(3):
        began = time.perf_counter()
        run(df)
        best = min(best, time.perf_counter() - began)
    return best


@pytest.mark.parametrize("what", ["lines", "changed", "read"])
def test_time_is_linear_in_a_files_lines(spark, what):
    run = {
        "lines": lambda df: L.split_lines(df.drop("changed_lines")).agg(F.sum(F.size("surrounding")), F.count_if("in_comment")).collect(),
        "changed": lambda df: L.split_lines(df).agg(F.sum(F.size("surrounding"))).collect(),
        "read": Scanner.default(spark).read,
    }[what]
    run(spark.createDataFrame([("/a", "x", [1])], "file_uri string, content string, changed_lines array<int>"))
    small, middle, large = (_seconds(spark, n, run) for n in (5_000, 20_000, 80_000))
    # a quadratic plan takes 16 times as long for 4 times the lines, and minutes for the last
    assert large < 15 and large < 6 * middle + 1 and middle < 6 * small + 1


def test_no_file_wide_expression_is_repeated(spark):
    df = spark.createDataFrame([("/a", "x")], "file_uri string, content string")
    plan = L.split_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(content") == 1


NAMES = ["lines", "line", "n_lines", "line_no", "rule_id", "value", "extra", "off", "_off", "_lines", "_blocks", "signals", "c", "cand_id", "row_id", "risk", "severity", "score", "surrounding", "adjacent", "b.c", "LINE_ID"]


def test_scan_with_clashing_names(spark):
    quoted = ", ".join(f"`{n}` string" for n in NAMES)
    rows = [("/src/a.js", SECRET, *[f"{n} of a" for n in NAMES]), ("/src/b.js", "x = 1", *[f"{n} of b" for n in NAMES])]
    files = spark.createDataFrame(rows, f"file_uri string, content string, {quoted}")
    scanner = Scanner.default(spark)
    plain = scanner.findings(files.select("file_uri", "content"))
    own = {c.lower() for c in plain.columns}
    out = scanner.findings(files)
    assert [c for c in out.columns if c in plain.columns] == plain.columns
    got, want = out.first(), plain.first()
    assert all(got[c] == want[c] for c in ("line_no", "line", "rule_id", "value", "severity", "score", "finding_id"))
    kept = [n for n in NAMES if n.lower() not in own]
    assert {"lines", "extra", "off", "b.c"} <= set(kept) and all(got[n] == f"{n} of a" for n in kept)
    assert scanner.candidates(files).count() == 1 and scanner.funnel(files).count() == 2
