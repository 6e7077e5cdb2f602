"""Reports over findings and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscan.functions import fixed
from leakscan.operators import gates as G
from leakscan.operators import remediate
from leakscan.operators.intervals import locate
from leakscan.operators.paths import base_name


def masked(value: Column) -> Column:
    """The first four characters at most, and stars: reports never carry a value."""
    return F.concat(F.substring(value, 1, 4), F.lit("****"))


def severities(spark) -> DataFrame:
    return spark.createDataFrame([(n, r) for n, r, _ in fixed.SEVERITIES], "severity string, rank int")


def by_severity(findings: DataFrame) -> DataFrame:
    """Every severity with its number of findings, zero included."""
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return severities(findings.sparkSession).join(counts, "severity", "left").select("severity", "rank", F.coalesce("n", F.lit(0)).alias("n"))


def max_severity(findings: DataFrame) -> DataFrame:
    """Each file's gravest severity."""
    return findings.groupBy("file_uri").agg(F.max_by("severity", G.severity_rank(F.col("severity"))).alias("severity"), F.count(F.lit(1)).alias("n"))


def finding_type(matched_groups: Column | None = None) -> Column:
    group = F.col("matched_group") if matched_groups is None else matched_groups
    return F.coalesce("rule_id", group, F.lit("unknown"))


def top_types(history: DataFrame, k: int = 8) -> DataFrame:
    """The k most frequent types; equal counts in order of name."""
    return history.groupBy(finding_type().alias("type")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(k)


def daily(history: DataFrame, today: Column, days: int = 14) -> DataFrame:
    """Detections a day over the last `days` days, zeros included."""
    spark = history.sparkSession
    span = spark.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    counts = history.groupBy(F.to_date("detected_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return span.join(F.broadcast(counts.where((F.col("day") >= F.date_sub(today, days - 1)) & (F.col("day") <= today))), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def peak(days: DataFrame) -> DataFrame:
    """The first day with most detections, the days with any, and the last day's number."""
    return days.agg(F.max_by("day", F.struct("n", -F.unix_date("day"))).alias("peak_day"), F.max("n").alias("peak"), F.count_if(F.col("n") > 0).alias("active_days"), F.max_by("n", "day").alias("today"))


def counters(history: DataFrame, active: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Lifetime and current numbers, one row. Blocked commits are not recorded by any scan and count 0."""
    h = history.agg(F.count(F.lit(1)).alias("detected"), F.count_if(F.col("is_fixed")).alias("fixed"))
    a = active.agg(F.count(F.lit(1)).alias("active"))
    s = suppressions.agg(F.count(F.lit(1)).alias("suppressed"))
    return h.join(a, F.lit(True)).join(s, F.lit(True)).withColumn("blocked", F.lit(0).cast("long"))


def confusion(scored: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1; a ratio without cases is 0."""
    n = {k: F.count_if(c) for k, c in {"tp": predicted & actual, "fp": predicted & ~actual, "fn": ~predicted & actual, "tn": ~predicted & ~actual}.items()}
    one = scored.agg(*[c.alias(k) for k, c in n.items()])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return one.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def blocked(findings: DataFrame, blocking: dict[str, bool] | None = None) -> DataFrame:
    """One row: whether any finding blocks the commit."""
    return findings.agg(F.coalesce(F.bool_or(G.blocks(F.col("severity"), blocking)), F.lit(False)).alias("blocked"), F.count(F.lit(1)).alias("findings"))


def exit_code(findings_of, blocking: dict[str, bool] | None = None) -> int:
    """1 if a finding blocks; 0 if none does and on any error, so a broken scan never stops a commit."""
    try:
        return int(blocked(findings_of(), blocking).first()["blocked"])
    except Exception:  # the contract is to fail open
        return 0


def by_file(findings: DataFrame) -> DataFrame:
    """Each file's findings as text lines (1-based), worst first."""
    row = F.struct((-G.severity_rank(F.col("severity"))).alias("r"), (F.col("line_no") + 1).alias("line"), "severity", F.coalesce("rule_id", F.lit("unknown")).alias("rule"))
    lines = F.transform(F.array_sort(F.collect_list(row)), lambda x: F.format_string("  [%s] line %d: %s", F.upper(x["severity"]), x["line"], x["rule"]))
    return findings.groupBy("file_uri").agg(F.array_join(lines, "\n").alias("text"))


def console(findings: DataFrame, scanned: int, blocking: dict[str, bool] | None = None) -> DataFrame:
    """(part, file_uri, text) of a commit's report, to be shown in order of part and file_uri: a head, a text per file and advice,
    or one line that the commit is allowed if no finding blocks it."""
    spark = findings.sparkSession
    stop = F.broadcast(blocked(findings, blocking).select("blocked"))  # one row
    advice = f"How to go on:\n  1. Move the values to an ignored file or a secret store.\n  2. Stage the change and commit again.\n  Scanned {scanned} file(s)"
    fixed_rows = [(True, 0, "Commit blocked: credentials in staged files"), (True, 2, advice), (False, 0, f"No blocking credentials in {scanned} staged file(s). Commit allowed.")]
    said = spark.createDataFrame(fixed_rows, "blocked boolean, part int, text string").join(stop, "blocked").select("part", F.lit(None).cast("string").alias("file_uri"), "text")
    files = by_file(findings).join(stop, F.col("blocked")).select(F.lit(1).alias("part"), "file_uri", F.concat(F.coalesce("file_uri", F.lit("")), F.lit("\n"), F.col("text")).alias("text"))
    return said.unionByName(files)


def dashboard(findings: DataFrame, history: DataFrame, statistics: DataFrame, health: DataFrame, ignored: DataFrame, k: int = 100) -> DataFrame:
    """(section, at, payload) rows of a dashboard, payload in JSON: findings with masked values, the k latest detections, statistics, health,
    and ignored records without the text of their lines. Each section is shown by `at`, newest first. A row an item: nothing is gathered."""

    def rows(section: str, df: DataFrame, at: Column | None, *columns) -> DataFrame:
        when = F.lit(None).cast("timestamp") if at is None else at
        return df.select(F.lit(section).alias("section"), when.alias("at"), F.to_json(F.struct(*columns)).alias("payload"))

    latest = history.orderBy(F.desc("detected_at"), "suppression_key").limit(k)
    out = rows("findings", findings, None, "finding_id", "file_uri", "line_no", "severity", "score", "rule_id", masked(F.col("value")).alias("value"), "explanation")
    out = out.unionByName(rows("history", latest, F.col("detected_at"), "detected_at", "severity", "file_name", "rule_id", "is_fixed"))
    out = out.unionByName(rows("statistics", statistics, None, "*")).unionByName(rows("health", health, None, "*"))
    name = base_name(F.col("file_uri")).alias("file_name")
    return out.unionByName(rows("ignored", ignored, F.col("suppressed_at"), "file_uri", name, F.coalesce("line_no", F.lit(0)).alias("line_no"), "severity", "rule_id", "reason", "suppressed_at", "kind"))


def diagnostics(findings: DataFrame) -> DataFrame:
    """Messages with edit ranges, for a sink that overwrites a file's rows."""
    percent = F.round(F.col("score") * 100).cast("int")
    text = F.concat_ws(" ", F.concat(F.lit("["), F.upper("severity"), F.lit("]")), F.coalesce("rule_id", F.get("matched_groups", 0), F.lit("Possible secret")), F.concat(F.lit("("), percent, F.lit("%)")))
    return findings.select("file_uri", "line_no", F.greatest(F.lit(0), F.col("start_pos") - 1).alias("from_pos"), (F.col("end_pos") + 1).alias("to_pos"), "severity", text.alias("message"))


def details(findings: DataFrame) -> DataFrame:
    """What is shown for a finding on demand: severity in words, marker level and colour, a line for lists, and a text in Markdown with
    confidence, kind, entropy, the layers' scores and the steps of a fix. No value is part of it."""
    key, name = remediate.env_key(), F.coalesce("rule_id", F.get("matched_groups", 0), F.lit("Possible secret"))
    percent = lambda c: F.format_string("%.0f%%", F.col(c) * 100)
    kind = F.when(F.col("rule_id").isNotNull(), F.concat(F.lit("**Type:** "), "rule_id")).when(F.size("matched_groups") > 0, F.concat(F.lit("**Category:** "), F.get("matched_groups", 0)))
    layers = {"Rules": "l1_score", "Entropy": "l2_score", "Context": "l3_score", "Strings": "l4_score", "File": "l5_score"}
    table = F.concat_ws("\n", F.lit("| Layer | Score |"), F.lit("|-|-|"), *[F.concat(F.lit(f"| {k} | "), percent(c), F.lit(" |")) for k, c in layers.items()])
    expr = remediate.replacement(F.col("key"), F.coalesce("language_id", F.lit("plaintext")))
    steps = F.concat_ws("\n", F.concat(F.lit("1. Add "), "key", F.lit(" to .env")), F.concat(F.lit("2. Write "), expr, F.lit(" instead of the value")), F.lit("3. See that .env is ignored"))
    head = F.concat(F.lit("### "), G.severity_label(F.col("severity")), F.lit(" risk"))
    text = F.concat_ws("\n\n", head, F.format_string("**Confidence:** %.1f%%", F.col("score") * 100), kind, F.format_string("**Entropy:** %.2f", "l2_entropy"), table, steps)
    line = F.concat(name, F.lit(" ("), percent("score"), F.lit("), line "), (F.col("line_no") + 1).cast("string"), F.lit(": "), expr)
    shown = {"label": G.severity_label(F.col("severity")), "level": G.marker_level(F.col("severity")), "color": G.marker_color(F.col("severity")), "summary": line, "text": text}
    return findings.withColumn("key", key).select("file_uri", "line_no", "start_pos", "severity", *[c.alias(k) for k, c in shown.items()])


def at_position(findings: DataFrame, places: DataFrame) -> DataFrame:
    """Findings under places (file_uri, line_no, pos): the literal with its quotes."""
    ranged = findings.withColumns({"from_pos": F.col("start_pos") - 1, "to_pos": F.col("end_pos") + 1})
    return locate(places, ranged, ["file_uri", "line_no"], "pos", "from_pos", "to_pos").drop("from_pos", "to_pos")


def filter_findings(findings: DataFrame, severity: str | None = None, query: str = "") -> DataFrame:
    """By severity, and by text in the file's name or the type."""
    q = query.lower()
    text = F.lower(base_name(F.col("file_uri"))).contains(q) | F.lower(F.coalesce("rule_id", F.lit("unknown"))).contains(q)
    return findings.where(text & ((F.col("severity") == severity) if severity else F.lit(True)))


def export(history: DataFrame, suppressions: DataFrame, statistics: DataFrame, at: Column, k: int = 100) -> DataFrame:
    """(section, ord, payload) of a report, a JSON text a row: the time with the statistics, the k latest detections numbered from the
    newest, and every suppression's key, whose rows have no number. Nothing is gathered, and no row carries a value."""
    newest = Window.orderBy(F.desc("detected_at"), "suppression_key")
    latest = history.orderBy(F.desc("detected_at"), "suppression_key").limit(k).withColumn("ord", F.row_number().over(newest))  # k rows
    row = lambda section, df, ord_, *columns: df.select(F.lit(section).alias("section"), ord_.cast("int").alias("ord"), F.to_json(F.struct(*columns)).alias("payload"))
    out = row("report", statistics, F.lit(0), at.alias("generatedAt"), F.struct("*").alias("statistics"))
    out = out.unionByName(row("history", latest, F.col("ord"), "detected_at", "severity", "file_name", "rule_id", "is_fixed"))
    return out.unionByName(row("suppressions", suppressions, F.lit(None), "suppression_key", "file_uri", "line_no", "reason"))


def health(rules: DataFrame, keywords: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Sizes of the dimensions, one row."""
    a = rules.agg(F.count(F.lit(1)).alias("rules"))
    b = keywords.agg(F.countDistinct("keyword").alias("rule_keywords"))
    c = dictionary.agg(F.count(F.lit(1)).alias("names"), F.countDistinct("group").alias("groups"))
    return a.join(b, F.lit(True)).join(c, F.lit(True))
