"""What to do about findings: names, replacements and file rows, as projections. No file is edited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan.functions import fixed
from leakscan.functions.text import camel_to_snake, env_segment

KEY = "^[A-Z_][A-Z0-9_]*\\z"


def env_key() -> Column:
    """A name for a finding's value: from its rule, the name it is assigned to, a dictionary name, a near group, or SECRET_KEY."""
    rule = F.regexp_replace(F.replace(F.upper("rule_id"), F.lit("-"), F.lit("_")), "[^A-Z0-9_]", "")
    name = F.regexp_extract("line", r"(?:const|let|var|export|private|public|protected|static|final)?\s*([A-Za-z_$][A-Za-z0-9_$]*)\s*[:=]", 1)
    named = (name != "") & ~F.lower(name).isin(fixed.LANGUAGE_KEYWORDS) & name.rlike("(?i)(key|token|secret|pass|pwd|cred|auth|api|jwt|salt|hash|sid)")
    near = F.array_sort(F.transform(F.filter("signals", lambda s: (s["distance"] <= 1) & ~s["group"].isin(fixed.BROAD_GROUPS)), lambda s: F.struct(s["distance"].alias("d"), s["ord"].alias("o"), s["group"].alias("g"))))
    return F.coalesce(
        F.when(F.col("rule_id").isNotNull() & ~F.lower("rule_id").startswith("generic-"), rule), F.when(named, env_segment(camel_to_snake(name))),
        F.when(F.size("db2_hits") > 0, env_segment(camel_to_snake(F.get("db2_hits", 0)))), F.when(F.size(near) > 0, F.concat(env_segment(F.get(near, 0)["g"]), F.lit("_KEY"))), F.lit("SECRET_KEY"),
    )


def replacement(key: Column, language: Column) -> Column:
    """Reading the variable in a language; JavaScript where it is unknown."""
    forms = {"python": 'os.environ.get("%s")', "go": 'os.Getenv("%s")', "ruby": 'ENV["%s"]', "php": 'getenv("%s")', "rust": 'std::env::var("%s").unwrap()', "java": 'System.getenv("%s")', "csharp": 'Environment.GetEnvironmentVariable("%s")'}
    out = F.format_string("process.env.%s", key)
    for k, form in forms.items():
        out = F.when(F.lower(language) == k, F.format_string(form, key)).otherwise(out)
    return out


def placeholder(key: Column) -> Column:
    return F.concat(F.lit("your-"), F.lower(F.replace(key, F.lit("_"), F.lit("-"))), F.lit("-here"))


def parse_env(text: Column) -> Column:
    """(key, value) of an env file's lines; blank lines, comments and lines without = are left out."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#") & x.contains("="))
    return F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("value")))


def upsert_env(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, value, action) of an env table after `wanted` (key, value): kept, unchanged, replaced or appended; bad names are rejected."""
    e, w = existing.select("key", F.col("value").alias("old")), wanted.groupBy("key").agg(F.max("value").alias("new"))
    action = F.when(F.col("new").isNull(), "kept").when(~F.col("key").rlike(KEY), "rejected").when(F.col("old").isNull(), "appended").when(F.col("old") == F.col("new"), "unchanged").otherwise("replaced")
    return e.join(w, "key", "full_outer").select("key", F.when(action == "rejected", F.col("old")).otherwise(F.coalesce("new", "old")).alias("value"), action.alias("action"))


_END = "\\r?\\n|\\r"


def upsert_text(files: DataFrame, wanted: DataFrame, date: Column) -> DataFrame:
    """(file_uri, text, replaced, appended, unchanged, rejected) of env files (file_uri, text) after `wanted` (file_uri, ord, key, value).

    A key keeps the place of its first line and that line's ending, whatever it is; other lines stay byte for byte. A key that the file
    lacks is appended under a comment with `date`, in order of ord, behind an empty line but in an empty file. Of several values for a key
    the last by ord counts, in the place of the first. Names other than capitals, digits and underscores are rejected. A file that only
    `wanted` names, or whose text is null, is made; null uris are left out.

    Lines meet their edits by (file, key); a file's lines are gathered again as the one row that it came in.
    """
    # a line with its ending is a piece; lookbehinds cut without taking anything
    pieces = F.posexplode(F.split("text", r"(?<=\n)|(?<=\r)(?!\n)"))
    own = files.where(F.col("file_uri").isNotNull()).select("file_uri", F.coalesce("text", F.lit("")).alias("text"))
    lines = own.select("file_uri", pieces.alias("pos", "piece")).withColumn("key", F.regexp_extract("piece", r"^([A-Z_][A-Z0-9_]*)=", 1))
    order = F.struct("ord", "value")
    edits = wanted.where(F.col("file_uri").isNotNull()).groupBy("file_uri", "key").agg(F.max_by("value", order).alias("value"), F.min(order).alias("first"))
    valid = F.coalesce(F.col("key").rlike(KEY), F.lit(False))
    first = lines.where("key <> ''").groupBy("file_uri", "key").agg(F.min("pos").alias("pos"))
    edits = edits.join(first, ["file_uri", "key"], "left").withColumn("valid", valid)
    # in place
    place = edits.where("valid and pos is not null").select("file_uri", "pos", F.col("value").alias("new"))
    rows = lines.join(place, ["file_uri", "pos"], "left")
    ending = F.regexp_extract("piece", rf"({_END})?\z", 0)
    old = F.regexp_replace(F.substring("piece", F.instr("piece", "=") + 1, F.length("piece")), rf"(?:{_END})\z", "")
    edited = F.col("new").isNotNull()
    piece = F.when(edited, F.concat("key", F.lit("="), "new", ending)).otherwise(F.col("piece"))
    body = rows.groupBy("file_uri").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))), lambda p: p["piece"]), "").alias("body"),
        F.count_if(edited & (old != F.col("new"))).alias("replaced"), F.count_if(edited & (old == F.col("new"))).alias("unchanged"),
    )
    # at the end
    entry = F.struct("first", F.concat(F.lit("# Added on "), date, F.lit("\n"), F.col("key"), F.lit("="), F.coalesce("value", F.lit("")), F.lit("\n")).alias("entry"))
    new = F.col("valid") & F.col("pos").isNull()
    added = edits.groupBy("file_uri").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(new, entry))), lambda e: e["entry"]), "\n").alias("tail"), F.count_if(new).alias("appended"), F.count_if(~F.col("valid")).alias("rejected"))
    out = body.join(added, "file_uri", "full_outer")
    head, tail, zero = F.coalesce("body", F.lit("")), F.coalesce("tail", F.lit("")), F.lit(0)
    text = F.concat(head, F.when((head != "") & (tail != ""), "\n").otherwise(""), tail)
    return out.select("file_uri", text.alias("text"), *[F.coalesce(c, zero).alias(c) for c in ("replaced", "appended", "unchanged", "rejected")])


def missing_entries(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Ignore entries that no line (column line) holds yet."""
    have = lines.select(F.trim("line").alias("entry")).where("entry <> '' and not startswith(entry, '#')").distinct()
    return entries.join(have, "entry", "left_anti")


def sync_example(env: DataFrame, example: DataFrame) -> DataFrame:
    """Rows an example file lacks: each key with a placeholder."""
    return env.select("key").distinct().join(example.select("key"), "key", "left_anti").withColumn("value", placeholder(F.col("key")))


def plan(findings: DataFrame) -> DataFrame:
    """Steps per finding in order; the finding counts as fixed at the end whatever became of the steps between."""
    f = findings.withColumn("key", env_key()).withColumn("expr", replacement(F.col("key"), F.coalesce("language_id", F.lit("plaintext"))))
    steps = F.array(
        F.struct(F.lit("migrate").alias("step"), F.col("key").alias("detail")), F.struct(F.lit("replace").alias("step"), F.col("expr").alias("detail")), F.struct(F.lit("ignore").alias("step"), F.lit(".env").alias("detail")),
        F.struct(F.lit("example").alias("step"), F.concat("key", F.lit("="), placeholder(F.col("key"))).alias("detail")), F.struct(F.lit("mark fixed").alias("step"), F.col("suppression_key").alias("detail")),
    )
    return f.select("file_uri", "line_no", "start_pos", "suppression_key", F.posexplode(steps).alias("ord", "s")).select("file_uri", "line_no", "start_pos", "suppression_key", "ord", "s.step", "s.detail")
