"""The console report and the dashboard's rows."""

import datetime as dt
import json

from pyspark.sql import functions as F

from leakscan.operators import gates as G
from leakscan.operators import report, suppress
from leakscan.plans.scan import Scanner

VALUE = "acme_aB3dE5fG7hJ9kL1mN2pQ"


def _findings(spark, *rows):
    return spark.createDataFrame([(f"id{i}", u, n, s, 0.9, "acme-token", VALUE, "Base score: 1") for i, (u, n, s) in enumerate(rows)], "finding_id string, file_uri string, line_no int, severity string, score double, rule_id string, value string, explanation string")


def test_console(spark):
    got = report.console(_findings(spark, ("/b.py", 2, "critical"), ("/a.py", 0, "low"), ("/a.py", 4, "high")), 5).orderBy("part", "file_uri").collect()
    assert [r.text.split("\n")[0] for r in got] == ["Commit blocked: credentials in staged files", "/a.py", "/b.py", "How to go on:"]
    assert got[1].text == "/a.py\n  [HIGH] line 5: acme-token\n  [LOW] line 1: acme-token" and got[3].text.endswith("Scanned 5 file(s)")
    for none in (_findings(spark, ("/a.py", 0, "low")), _findings(spark, ("/a.py", 0, "low")).limit(0)):
        assert [r.text for r in report.console(none, 3).collect()] == ["No blocking credentials in 3 staged file(s). Commit allowed."]


def test_dashboard(spark):
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
    history = spark.createDataFrame([(at(i), "high", "a.py", "acme-token", False, f"k{i}") for i in range(130)], "detected_at timestamp, severity string, file_name string, rule_id string, is_fixed boolean, suppression_key string")
    ignored = spark.createDataFrame([("k", "/x/a.py", None, f't = "{VALUE}"', "low", at(i), None, "r", None, "session") for i in range(2)], suppress.COLUMNS)
    one = spark.range(1).select(F.lit(3).alias("n"))
    rows = report.dashboard(_findings(spark, ("/a.py", 0, "high")), history, one, one, ignored).collect()
    by = {s: [r for r in rows if r.section == s] for s in ("findings", "history", "statistics", "health", "ignored")}
    assert [len(v) for v in by.values()] == [1, 100, 1, 1, 2] and min(r.at for r in by["history"]) == at(30)
    assert json.loads(by["findings"][0].payload)["value"] == "acme****" and not any(VALUE in r.payload for r in rows)
    assert json.loads(by["ignored"][0].payload)["file_name"] == "a.py" and json.loads(by["ignored"][0].payload)["line_no"] == 0


def test_severity_markers(spark):
    names = ["critical", "high", "medium", "low", "informational", "other", None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, s string")
    got = rows.orderBy("i").select(G.severity_label(F.col("s")), G.marker_level(F.col("s")), G.marker_color(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [
        ("Critical", "error", "errorForeground"), ("High", "error", "charts.orange"), ("Medium", "warning", "charts.yellow"), ("Low", "information", "charts.green"),
        ("Informational", "hint", "charts.blue"), ("other", "warning", None), (None, "warning", None),
    ]


def test_details(spark):
    scanner = Scanner.default(spark)
    files = spark.createDataFrame([("/src/a.py", 'github_token = "ghp_aZ3kQ9xW7vB2nM5cL8rT1yU4oP6sD0fG3hJk"\n', "python")], "file_uri string, content string, language_id string")
    found = scanner.findings(files)
    d = report.details(found).first()
    assert (d.file_uri, d.line_no, d.label, d.level, d.color) == ("/src/a.py", 0, d.severity.capitalize(), "error", "errorForeground" if d.severity == "critical" else "charts.orange")
    assert d.summary.startswith("github-token (") and d.summary.endswith('line 1: os.environ.get("GITHUB_TOKEN")')
    assert "**Type:** github-token" in d.text and "\n| Rules | 92% |\n" in d.text and d.text.endswith("3. See that .env is ignored") and "ghp_" not in d.text + d.summary
    bare = report.details(found.withColumns({"rule_id": F.lit(None).cast("string"), "matched_groups": F.array().cast("array<string>"), "language_id": F.lit(None).cast("string")})).first()
    assert bare.summary.startswith("Possible secret (") and "process.env." in bare.summary and "**Type" not in bare.text and "**Category" not in bare.text
