"""Registered queries of the credential scanner over whole tables, and the SQL that checks them.

A query's name begins with the operators it exercises. SQL is built from the same fixed values and runs
in another engine with another regex library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.functions import fixed, text
from leakscan.functions import sql as sql_functions
from leakscan.operators import assets, ignores, intervals, keywords, layers, lines, literals, paths, registry, remediate, report, suppress
from leakscan.operators import gates as G
from leakscan.operators import identifiers as I
from leakscan.operators import rules as R
from leakscan.plans.scan import Scanner
from leakscan.sources import files as S
from leakscan.sources.state import drop_paths, scratch_path, written
from leakscan.streaming import memory

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case(subject: str, rows: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    """CASE over patterns; the other engine's \\z and (?i) are the same."""
    return "CASE " + " ".join(f"WHEN regexp_matches({subject}, {lit(p)}) THEN {v}" for p, v in rows) + f" ELSE {otherwise} END"


def in_list(names: list[str]) -> str:
    return ", ".join(map(lit, names))


# --- shared SQL ---------------------------------------------------------------------------------

_DOCS = "SELECT '/corpus/' || source || '/' || CAST(doc_id AS VARCHAR) AS file_uri, text AS content FROM documents"
_PAGES = "SELECT url AS file_uri, html AS content FROM pages"


def _lines(files: str) -> str:
    return f"""f AS ({files}), a AS (SELECT file_uri, string_split(content, chr(10)) AS ls FROM f WHERE content IS NOT NULL),
l AS (SELECT file_uri, CAST(i - 1 AS INTEGER) AS line_no, ls[i] AS line, ls FROM (SELECT file_uri, ls, unnest(range(1, len(ls) + 1)) AS i FROM a))"""


_VALUES = r"v AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS value FROM documents)"
_HISTORY = """h AS (SELECT event_id, ts AS detected_at, CAST(user_id AS VARCHAR) AS file_name, event_type AS rule_id, ((event_id * 7919) % 1000) / 1000.0 AS score, event_id % 7 = 0 AS is_fixed FROM events),
hs AS (SELECT *, CASE """ + " ".join(f"WHEN score >= {x} THEN '{n}'" for n, _, x in fixed.SEVERITIES) + " END AS severity FROM h)"
_RANK = "CASE severity " + " ".join(f"WHEN '{n}' THEN {r}" for n, r, _ in fixed.SEVERITIES) + " END"


def values(spark, sf_dir) -> DataFrame:
    """Every distinct word of the documents, as a value to be judged."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select(F.explode(words).alias("value")).distinct()


def history(spark, sf_dir) -> DataFrame:
    """Detections drawn from the events: each has a time, a file, a rule and a score."""
    e = table(spark, sf_dir, "events")
    score = (F.col("event_id") * 7919 % 1000) / 1000.0
    out = e.select("event_id", F.col("ts").alias("detected_at"), F.col("user_id").cast("string").alias("file_name"), F.col("event_type").alias("rule_id"), score.alias("score"), (F.col("event_id") % 7 == 0).alias("is_fixed"))
    return out.withColumn("severity", G.severity(F.col("score")))


# --- sources and lines --------------------------------------------------------------------------


@query(f"SELECT source, count(*) AS n_files, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes FROM (SELECT 'documents' AS source, content FROM ({_DOCS}) UNION ALL SELECT 'pages', content FROM ({_PAGES}) UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY source")
def s1_s2_sources(spark, sf_dir):
    parts = [f(spark, sf_dir).select(F.lit(f.__name__).alias("source"), "content") for f in (S.documents, S.pages, S.conversations)]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("source").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.octet_length("content")).alias("bytes"))


@query(f"WITH {_lines(_DOCS)} SELECT file_uri, line_no, sha256(line) AS line_sha256 FROM l")
def p1_lines(spark, sf_dir):
    out = lines.split_lines(S.documents(spark, sf_dir), surrounding=False)
    return out.select("file_uri", "line_no", F.sha2("line", 256).alias("line_sha256"))


@query(f"WITH {_lines(_DOCS)} SELECT file_uri, line_no, sha256(array_to_string(list_concat(ls[greatest(1, line_no - 4):line_no], ls[line_no + 2:line_no + 6]), chr(10))) AS near_sha256, CAST(len(list_concat(ls[greatest(1, line_no - 4):line_no], ls[line_no + 2:line_no + 6])) AS INTEGER) AS n_near FROM l")
def w1_j6_surrounding(spark, sf_dir):
    out = lines.split_lines(S.documents(spark, sf_dir))
    return out.select("file_uri", "line_no", F.sha2(F.array_join("surrounding", "\n"), 256).alias("near_sha256"), F.size("surrounding").alias("n_near"))


_TRIM = r"regexp_replace(regexp_replace({}, '^[\s\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+', ''), '[\s\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+$', '')"
_SINGLE = "(starts_with(t, '//') OR starts_with(t, '#') OR starts_with(t, '--') OR starts_with(t, '<!--'))"


@query(f"""WITH {_lines(_PAGES)}, e AS (SELECT file_uri, line_no, line, {_TRIM.format('line')} AS t FROM l),
g AS (SELECT *, CASE WHEN contains(line, '*/') THEN 0 WHEN NOT {_SINGLE} AND contains(t, '/*') THEN 1 END AS ev FROM e),
s AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY file_uri ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM g)
SELECT file_uri, line_no, st = 1 OR {_SINGLE} OR contains(t, '/*') AS in_comment FROM s""")
def p7_w3_comment_map(spark, sf_dir):
    return lines.split_lines(S.pages(spark, sf_dir), surrounding=False).select("file_uri", "line_no", "in_comment")


def _line_case(subject: str) -> str:
    rows = [("|".join(f"(?:{p})" for p in ps), lit(n)) for n, ps in fixed.LINE_TYPES]
    return f"CASE WHEN trim({subject}, chr(32) || chr(9) || chr(13)) = '' THEN 'UNKNOWN' ELSE " + case(subject, rows, "'UNKNOWN'") + " END"


@query(f"WITH {_lines(_DOCS)} SELECT file_uri, line_no, {_line_case('line')} AS line_type, regexp_matches(line, '[:=]\\s*[\"''`]') AS string_assignment FROM l")
def p8_p9_line_types(spark, sf_dir):
    out = lines.split_lines(S.documents(spark, sf_dir), surrounding=False)
    return out.select("file_uri", "line_no", lines.line_type(F.col("line")).alias("line_type"), lines.string_assignment(F.col("line")).alias("string_assignment"))


@query(rf"""WITH {_lines(_PAGES)} SELECT file_uri, line_no, CAST(len(x) AS INTEGER) AS n, sha256(array_to_string(x, chr(1))) AS values_sha256 FROM (
SELECT file_uri, line_no, list_filter(list_concat(list_concat(regexp_extract_all(line, '(?s)"((?:[^"\\]|\\[^\n])*)"', 1), regexp_extract_all(line, '(?s)''((?:[^''\\]|\\[^\n])*)''', 1)), regexp_extract_all(line, '(?s)`((?:[^`$\\]|\\[^\n])*)`', 1)), lambda v: v <> '') AS x FROM l)""")
def p4_literal_values(spark, sf_dir):
    out = lines.split_lines(S.pages(spark, sf_dir), surrounding=False).withColumn("x", literals.literal_values(F.col("line")))
    return out.select("file_uri", "line_no", F.size("x").alias("n"), F.sha2(F.array_join("x", "\x01"), 256).alias("values_sha256"))


@query()
def p3_p22_literals(spark, sf_dir):
    """Literals of pages and documents with positions."""
    both = S.pages(spark, sf_dir).unionByName(S.documents(spark, sf_dir))
    out = lines.split_lines(both, keep=lambda x: x.rlike("[\"'`]"), surrounding=False)
    return out.select("file_uri", "line_no", F.inline(literals.literals(F.col("line"))))


@query(rf"""WITH {_lines(_DOCS)}, m AS (SELECT file_uri, line_no, line, instr(line, '=') AS eq FROM l WHERE regexp_matches(line, '^\s*[A-Za-z_][A-Za-z0-9_.-]*\s*=\s*([^\n\r]+)$'))
SELECT file_uri, line_no, trim(regexp_replace(substr(line, eq + 1), '\s+#[^\n\r]*$', '')) AS value FROM m WHERE trim(regexp_replace(substr(line, eq + 1), '\s+#[^\n\r]*$', '')) <> ''""")
def p5_env_values(spark, sf_dir):
    out = lines.split_lines(S.documents(spark, sf_dir), keep=lambda x: x.contains("="), surrounding=False)
    return out.select("file_uri", "line_no", F.inline(literals.env_value(F.col("line")))).select("file_uri", "line_no", "value")


@query()
def p6_identifiers(spark, sf_dir):
    """How often each name occurs in pages' lines."""
    out = lines.split_lines(S.pages(spark, sf_dir), surrounding=False)
    return out.select(F.explode(literals.identifiers(F.col("line"))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


# --- paths --------------------------------------------------------------------------------------

_URIS = f"SELECT file_uri FROM ({_DOCS}) UNION ALL SELECT url FROM pages UNION ALL SELECT '/src/' || p_name || CASE p_partkey % 9 WHEN 0 THEN '/.env.local' WHEN 1 THEN '/tests/a.py' WHEN 2 THEN '/node_modules/x.js' WHEN 3 THEN '/README.md' WHEN 4 THEN '/config.json' WHEN 5 THEN '/a.png' WHEN 6 THEN '/x_test.go' WHEN 7 THEN '/secrets.json' ELSE '/main.rs' END FROM part"


def _uris(spark, sf_dir):
    tails = ["/.env.local", "/tests/a.py", "/node_modules/x.js", "/README.md", "/config.json", "/a.png", "/x_test.go", "/secrets.json", "/main.rs"]
    k = F.pmod("p_partkey", F.lit(9)).cast("int")
    made = table(spark, sf_dir, "part").select(F.concat(F.lit("/src/"), "p_name", F.get(F.lit(tails), k)).alias("file_uri"))
    return S.documents(spark, sf_dir).select("file_uri").union(S.pages(spark, sf_dir).select("file_uri")).union(made)


_BASE = r"regexp_extract(file_uri, '[^/]*$', 0)"
_EXT = rf"lower(regexp_extract({_BASE}, '^.+(\.[^.]*)$', 1))"


def _glob_sql(g: str) -> str:
    return paths.glob_regex(g)


@query(f"""WITH u AS ({_URIS}), x AS (SELECT file_uri, {_EXT} AS ext, lower({_BASE}) AS b FROM u)
SELECT file_uri, CASE WHEN ext IN ({in_list(fixed.BINARY_EXTENSIONS)}) OR regexp_matches(file_uri, {lit("|".join("(?:" + _glob_sql(g) + ")" for g in fixed.EXCLUDED_GLOBS))}) THEN 'EXCLUDED'
WHEN b IN ({in_list(fixed.HIGH_NAMES)}) OR starts_with(b, '.env.') THEN 'HIGH' WHEN b IN ({in_list(fixed.ELEVATED_NAMES)}) THEN 'ELEVATED'
WHEN regexp_matches(file_uri, '(?i)/(?:{"|".join(fixed.REDUCED_FOLDERS)})/') OR ext IN ({in_list(fixed.REDUCED_EXTENSIONS)}) OR {" OR ".join(f"ends_with(b, {lit(s)})" for s in fixed.REDUCED_SUFFIXES)} THEN 'REDUCED' ELSE 'NORMAL' END AS risk FROM x""")
def f1_f2_file_risk(spark, sf_dir):
    return _uris(spark, sf_dir).select("file_uri", paths.risk(F.col("file_uri")).alias("risk"))


@query(f"WITH u AS ({_URIS}) SELECT file_uri, {_BASE} AS base, {_EXT} AS ext, CASE {_EXT} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fixed.LANGUAGES.items()) + " ELSE 'plaintext' END AS language FROM u")
def p2_p23_names(spark, sf_dir):
    u = F.col("file_uri")
    return _uris(spark, sf_dir).select("file_uri", paths.base_name(u).alias("base"), paths.extension(u).alias("ext"), paths.language(u).alias("language"))


# --- values -------------------------------------------------------------------------------------


@query(f"""WITH {_VALUES}, n AS (SELECT value, length(value) + length(regexp_replace(value, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS n FROM v),
c AS (SELECT value, n, count(*) AS k FROM (SELECT value, n, unnest(string_split(value, '')) AS ch FROM n) WHERE ch <> '' GROUP BY value, n, ch),
e AS (SELECT value, -sum(k / CAST(n AS DOUBLE) * log2(k / CAST(n AS DOUBLE))) AS e FROM c GROUP BY value)
SELECT value, round(e, 6) + 0.0 AS entropy FROM e""")
def p10_a8_entropy(spark, sf_dir):
    return values(spark, sf_dir).select("value", (F.round(text.entropy(F.col("value")), 6) + 0.0).alias("entropy"))


@query(f"""WITH {_VALUES} SELECT value, regexp_matches(value, '[A-Z]') AS has_upper, regexp_matches(value, '[a-z]') AS has_lower, regexp_matches(value, '[0-9]') AS has_digit, regexp_matches(value, '[^A-Za-z0-9]') AS has_special,
CAST(CASE WHEN regexp_matches(value, '[A-Z]') THEN 26 ELSE 0 END + CASE WHEN regexp_matches(value, '[a-z]') THEN 26 ELSE 0 END + CASE WHEN regexp_matches(value, '[0-9]') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(value, '[^A-Za-z0-9]') THEN 32 ELSE 0 END AS INTEGER) AS charset_size FROM v""")
def p12_charset(spark, sf_dir):
    return values(spark, sf_dir).select("value", *[c.alias(k) for k, c in text.charset(F.col("value")).items()])


def _entropy_sql(table_: str) -> str:
    """CTEs that end in es (value, e): entropy over UTF-16 lengths of the distinct values of a table."""
    return f"""en AS (SELECT value, length(value) + length(regexp_replace(value, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS n FROM (SELECT DISTINCT value FROM {table_})),
ec AS (SELECT value, n, count(*) AS k FROM (SELECT value, n, unnest(string_split(value, '')) AS ch FROM en) WHERE ch <> '' GROUP BY value, n, ch),
es AS (SELECT value, -sum(k / CAST(n AS DOUBLE) * log2(k / CAST(n AS DOUBLE))) AS e FROM ec GROUP BY value)"""


def _entropy_score_sql(threshold: str) -> str:
    """The entropy layer's score from value and e."""
    has = [f"CAST(regexp_matches(value, '{p}') AS INTEGER)" for p in ("[A-Z]", "[a-z]", "[0-9]", "[^A-Za-z0-9]")]
    kinds, size = " + ".join(has), " + ".join(f"{n} * {h}" for n, h in zip((26, 26, 10, 32), has, strict=True))
    adjusted = f"least(1.0, CASE WHEN e < 2 THEN 0.0 WHEN e < 3 THEN 0.2 WHEN e < 3.5 THEN 0.4 WHEN e < 4 THEN 0.6 WHEN e < 4.5 THEN 0.8 ELSE 1.0 END + CASE {kinds} WHEN 4 THEN 0.1 WHEN 3 THEN 0.05 ELSE 0.0 END)"
    return f"CAST(CASE WHEN e < 2 THEN 0.0 WHEN e < {threshold} THEN least(0.3, {adjusted} * (e / {threshold})) ELSE least(1.0, {adjusted} + CASE WHEN {size} >= 94 THEN 0.05 WHEN {size} >= 62 THEN 0.03 ELSE 0.0 END) END AS DOUBLE)"


@query(f"WITH {_VALUES}, {_entropy_sql('v')} SELECT value, round(e, 6) + 0.0 AS l2_entropy, CAST(3.5 AS DOUBLE) AS l2_threshold, round({_entropy_score_sql('3.5')}, 6) AS l2_score FROM es")
def l2_p11_p13_entropy_layer(spark, sf_dir):
    cols = layers.entropy_layer(F.col("value"), F.lit(3.5))
    return values(spark, sf_dir).select("value", *[(F.round(c, 6) + 0.0).alias(k) for k, c in cols.items()])


_DOC_WORDS = r"w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS value FROM documents)"


@query(f"WITH {_DOC_WORDS}, {_entropy_sql('w')}, m AS (SELECT doc_id, count(*) AS n, avg(e) AS m FROM w JOIN es USING (value) GROUP BY doc_id) SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_words, round(coalesce(m, 0.0), 6) + 0.0 AS mean_entropy FROM documents LEFT JOIN m USING (doc_id)")
def l2b_mean_entropy(spark, sf_dir):
    """The mean entropy of the distinct words of each document, within its row."""
    words = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    docs = S.spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("words", words)
    return docs.select("doc_id", F.size("words").alias("n_words"), (F.round(text.mean_entropy(F.col("words")), 6) + 0.0).alias("mean_entropy"))


@query("""WITH k AS (SELECT n_nationkey AS id, n_name AS name FROM nation), x AS (SELECT c_nationkey AS id, bool_or(c_acctbal > 9000) AS active FROM customer WHERE c_nationkey % 3 > 0 GROUP BY 1)
SELECT id, name, active IS NOT NULL AS installed, coalesce(active, false) AS active FROM k LEFT JOIN x USING (id)""")
def f18_j11_left_outer_flags(spark, sf_dir):
    """Known rows with flags of what is installed and active, over nations and their customers."""
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    have = table(spark, sf_dir, "customer").where("c_nationkey % 3 > 0").select(F.col("c_nationkey").alias("id"), (F.col("c_acctbal") > 9000).alias("is_active"))
    return registry.installed_assistants(known, have)


def _reduce(table_: list, subject: str) -> str:
    # RE2 has no back-references
    one = lambda p: f"(length({subject}) >= 8 AND {subject} = repeat({subject}[1], length({subject})))" if "\\1" in p else f"regexp_matches({subject}, {lit(p)})"
    return "least(" + ", ".join(f"CASE WHEN {one(p)} THEN {f} ELSE 1.0 END" for _, p, f in table_) + ")"


@query(f"WITH {_VALUES} SELECT value, CAST({_reduce(fixed.PLACEHOLDERS, 'value')} AS DOUBLE) AS factor FROM v WHERE regexp_full_match(value, '[\\x00-\\x7F]*')")
def f5_a11_placeholders(spark, sf_dir):
    v = values(spark, sf_dir).where(F.col("value").rlike(r"^[\x00-\x7F]*\z"))
    return v.select("value", G.placeholder(F.col("value"))["placeholder_factor"].alias("factor"))


@query()
def f5_a11_placeholders_every_word(spark, sf_dir):
    """Also the words with characters beyond ASCII, which the SQL above leaves out."""
    return values(spark, sf_dir).select("value", G.placeholder(F.col("value"))["placeholder_factor"].alias("factor"))


@query(f"WITH {_VALUES} SELECT value, CAST({_reduce(fixed.FORMATS, 'value')} AS DOUBLE) AS factor FROM v")
def f6_formats(spark, sf_dir):
    return values(spark, sf_dir).select("value", G.non_secret_format(F.col("value"))["format_factor"].alias("factor"))


@query(f"WITH {_VALUES} SELECT value, trim(regexp_replace(lower(value), '[^a-z0-9]+', '-', 'g'), '-') AS slug, trim(regexp_replace(upper(value), '[^A-Z0-9]+', '_', 'g'), '_') AS segment FROM v WHERE regexp_full_match(value, '[\\x00-\\x7F]*')")
def p18_p19_names(spark, sf_dir):
    v = values(spark, sf_dir).where(F.col("value").rlike(r"^[\x00-\x7F]*\z"))
    return v.select("value", text.slug(F.col("value")).alias("slug"), text.env_segment(F.col("value")).alias("segment"))


@query()
def p18_p19_names_every_word(spark, sf_dir):
    """Also the words with characters beyond ASCII, which the SQL above leaves out."""
    return values(spark, sf_dir).select("value", text.slug(F.col("value")).alias("slug"), text.env_segment(F.col("value")).alias("segment"))


@query()
def p16_p17_variants(spark, sf_dir):
    v = values(spark, sf_dir).where(F.col("value").rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z"))
    return v.select("value", text.case_variants(F.col("value")).alias("variants"), I.builder_variants(F.col("value")).alias("listed"))


@query(f"WITH {_lines(_DOCS)} SELECT file_uri, line_no, sha256(file_uri || ':' || line_no || ':' || {_TRIM.format('line')} || ':unknown') AS suppression_key FROM l")
def p14_suppression_keys(spark, sf_dir):
    out = lines.split_lines(S.documents(spark, sf_dir), surrounding=False)
    return out.select("file_uri", "line_no", text.suppression_key(F.col("file_uri"), F.col("line_no"), F.col("line"), F.lit(None).cast("string")).alias("suppression_key"))


@query(f"""WITH {_lines(_DOCS)} SELECT file_uri, line_no, CASE
WHEN {" OR ".join(f"regexp_matches(line, {lit(p)})" for p in fixed.INLINE_MARKS)} THEN 'inline' WHEN {" OR ".join(f"regexp_matches(line, {lit(p)})" for p in fixed.GLOBAL_PATTERNS)} THEN 'global' ELSE 'none' END AS reason FROM l""")
def f7_line_allowlist(spark, sf_dir):
    out = lines.split_lines(S.documents(spark, sf_dir), surrounding=False)
    line = F.col("line")
    return out.select("file_uri", "line_no", F.when(text.any_of(line, fixed.INLINE_MARKS), "inline").when(text.any_of(line, fixed.GLOBAL_PATTERNS), "global").otherwise("none").alias("reason"))


# --- rules and dictionary -----------------------------------------------------------------------

_KEYWORDS = list(dict.fromkeys(k.lower() for r in R.load()["rules"] for k in r["keywords"]))
_PAIRS = [(k.lower(), r["id"]) for r in R.load()["rules"] for k in r["keywords"]]
_DIM = "k AS (SELECT * FROM (VALUES " + ", ".join(f"({lit(k)}, {lit(r)})" for k, r in _PAIRS) + ") t(keyword, rule_id))"


@query(f"WITH {_DIM}, {_lines(_DOCS)} SELECT keyword, count(*) AS n_lines FROM l JOIN (SELECT DISTINCT keyword FROM k) ON contains(lower(line), keyword) GROUP BY keyword")
def j2_keyword_hits(spark, sf_dir):
    out = lines.split_lines(S.documents(spark, sf_dir), surrounding=False)
    return out.select(F.explode(R.keyword_hits(F.col("line"), _KEYWORDS)).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"WITH {_DIM}, {_lines(_DOCS)}, h AS (SELECT DISTINCT file_uri, line_no, rule_id FROM l JOIN k ON contains(lower(line), keyword)) SELECT rule_id, count(*) AS n_lines FROM h GROUP BY rule_id")
def j1_j4_triggered_rules(spark, sf_dir):
    sc = R.compile_rules(spark, R.load())
    out = lines.split_lines(S.documents(spark, sf_dir), surrounding=False).select("file_uri", "line_no", F.explode(R.keyword_hits(F.col("line"), sc.keyword_set)).alias("keyword"))
    # the multimap has a few rows a rule, at most R.MOST_RULES rules
    return out.join(F.broadcast(sc.keywords_df(spark)), "keyword").select("file_uri", "line_no", "rule_id").distinct().groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_lines"))


#: Keywords that the parts claim: each word of a part's name, for the part's brand.
_CLAIMS = "cl AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS keyword, p_brand AS rule_id FROM part)"


def _claims(spark, sf_dir):
    words = F.explode(F.split(F.lower("p_name"), " ")).alias("keyword")
    return table(spark, sf_dir, "part").select(words, F.col("p_brand").alias("rule_id")).distinct()


@query(f"WITH {_CLAIMS} SELECT keyword, count(*) AS n_rules, array_to_string(list_sort(list(rule_id)), ',') AS rule_ids FROM cl GROUP BY keyword HAVING count(*) > 1")
def a14_s10_collisions(spark, sf_dir):
    """Words of the parts' names that several brands claim."""
    return R.collisions(_claims(spark, sf_dir)).select("keyword", "n_rules", F.array_join("rule_ids", ",").alias("rule_ids"))


_PART_TEXTS = "t AS (SELECT l_orderkey, l_linenumber, 'order ' || l_orderkey || ': ' || upper(p_name) || ' ' || p_partkey || ' x' || CAST(l_quantity AS INTEGER) AS line FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"WITH {_PART_TEXTS}, k AS (SELECT DISTINCT lower(p_name) || ' ' || p_partkey AS keyword FROM part UNION SELECT DISTINCT lower(p_brand) FROM part) SELECT keyword, count(*) AS n_lines FROM t JOIN k ON contains(lower(line), keyword) GROUP BY keyword")
def j2_part_keywords(spark, sf_dir):
    """A keyword for every part, in a line for every order line: the keywords grow with the table."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    own = p.select(F.concat_ws(" ", "p_name", "p_partkey").alias("keyword")).union(p.select("p_brand"))
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_quantity").join(p.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    line = F.concat(F.lit("order "), F.col("l_orderkey").cast("string"), F.lit(": "), F.upper("p_name"), F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" x"), F.col("l_quantity").cast("int").cast("string"))
    return keywords.hits(rows.select(line.alias("text")), own).groupBy("keyword").agg(F.count(F.lit(1)).alias("n_lines"))


# Rules of unlike shape, a JSON text for every event.
def _rule_texts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    names = F.transform(F.sequence(F.lit(1), k % 4 + 1), lambda n: F.concat(F.upper("event_type"), F.lit("_"), (n + i % 50).cast("string")))
    lists = F.array(F.struct(F.when(i % 2 == 0, F.array(F.lit("^x"))).alias("regexes"), F.when(i % 3 == 0, F.lit("line")).alias("regexTarget"), F.when(i % 4 == 0, F.array(F.lit("test"))).alias("stopwords")))
    entropy = F.when(i % 5 < 3, k.cast("string"))
    made = F.to_json(F.struct(F.concat(F.lit("r"), i.cast("string")).alias("id"), F.when(i % 7 > 0, names).alias("keywords"), F.when(i % 5 == 3, k).alias("entropy"), entropy.alias("level"), F.when(i % 11 == 0, lists).alias("allowlists")))
    # some write the entropy as text, and some texts are cut
    made = F.when(i % 5 == 4, F.concat(F.substring(made, F.lit(1), F.length(made) - 1), F.lit(',"entropy":"high"}'))).otherwise(made)
    return e.select(F.when(i % 97 == 0, F.substring(made, F.lit(1), F.length(made) - 2)).otherwise(made).alias("json"))


_RULE_ROWS = "e AS (SELECT event_id AS i, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), o AS (SELECT * FROM e WHERE i % 97 <> 0)"


@query(f"""WITH {_RULE_ROWS}, f AS (SELECT 'id' AS field, 'STRING' AS type, count(*) AS n FROM o UNION ALL SELECT 'keywords', 'ARRAY', count(*) FROM o WHERE i % 7 > 0 UNION ALL SELECT 'entropy', 'BIGINT', count(*) FROM o WHERE i % 5 = 3
UNION ALL SELECT 'entropy', 'STRING', count(*) FROM o WHERE i % 5 = 4 UNION ALL SELECT 'level', 'STRING', count(*) FROM o WHERE i % 5 < 3 UNION ALL SELECT 'allowlists', 'ARRAY', count(*) FROM o WHERE i % 11 = 0
UNION ALL SELECT 'allowlists[].regexes', 'ARRAY', count(*) FROM o WHERE i % 11 = 0 AND i % 2 = 0 UNION ALL SELECT 'allowlists[].regexTarget', 'STRING', count(*) FROM o WHERE i % 11 = 0 AND i % 3 = 0
UNION ALL SELECT 'allowlists[].stopwords', 'ARRAY', count(*) FROM o WHERE i % 11 = 0 AND i % 4 = 0)
SELECT field, CAST(sum(n) AS BIGINT) AS n_rules, string_agg(type, ',' ORDER BY type) AS types FROM f WHERE n > 0 GROUP BY field""")
def a14_field_usage(spark, sf_dir):
    """Which fields rules use, and of what types, where no two rules need to agree."""
    return assets.field_usage(assets.parsed(_rule_texts(spark, sf_dir), "json")).select("field", "n_rules", F.array_join("types", ",").alias("types"))


@query(f"""WITH {_RULE_ROWS}, s AS (SELECT array_to_string(list_sort(list_filter([CASE WHEN i % 11 = 0 THEN 'allowlists' END, CASE WHEN i % 5 > 2 THEN 'entropy' END, 'id', CASE WHEN i % 7 > 0 THEN 'keywords' END, CASE WHEN i % 5 < 3 THEN 'level' END], lambda x: x IS NOT NULL)), ',') AS fields FROM o UNION ALL SELECT NULL FROM e WHERE i % 97 = 0)
SELECT fields, count(*) AS n_rules FROM s GROUP BY fields""")
def a14_shapes(spark, sf_dir):
    return assets.shapes(assets.parsed(_rule_texts(spark, sf_dir), "json"))


@query(f"WITH {_RULE_ROWS} SELECT CAST(CASE WHEN i % 97 > 0 AND i % 7 > 0 THEN k % 4 + 1 ELSE 0 END AS INTEGER) AS n_keywords, count(*) AS n_rules FROM e GROUP BY 1")
def a14_keyword_counts(spark, sf_dir):
    return assets.keyword_histogram(assets.parsed(_rule_texts(spark, sf_dir), "json"))


@query(f"""WITH {_RULE_ROWS}, c AS (SELECT DISTINCT lower(event_type) || '_' || (unnest(range(1, k % 4 + 2)) + i % 50) AS keyword, 'r' || i AS rule_id FROM o WHERE i % 7 > 0)
SELECT keyword, count(*) AS n_rules, sha256(array_to_string(list_sort(list(rule_id)), ',')) AS rules_sha256 FROM c GROUP BY keyword HAVING count(*) > 1""")
def s10_claimed_keywords(spark, sf_dir):
    """Keywords that rules of unlike shape share."""
    out = R.collisions(assets.claimed(assets.parsed(_rule_texts(spark, sf_dir), "json")))
    return out.select("keyword", "n_rules", F.sha2(F.array_join("rule_ids", ","), 256).alias("rules_sha256"))


_TITLE = "list_transform({}, lambda x: upper(x[1]) || x[2:])"
_FRAGMENTS = "fr AS (SELECT p_brand AS grp, CAST(substr(p_brand, 7) AS INTEGER) AS group_ord, replace(lower(p_name), ' ', '_') || '_' || p_partkey % 400 AS keyword, p_partkey AS keyword_ord FROM part)"


def _fragments(spark, sf_dir):
    """Keywords of the parts, with their brands as groups; many are claimed by several."""
    name = F.concat(F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), (F.col("p_partkey") % 400).cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("group"), F.substring("p_brand", 7, 9).cast("int").alias("group_ord"), name.alias("keyword"), F.col("p_partkey").alias("keyword_ord"), F.lit("part").alias("source"))


_DICTIONARY = f"""{_FRAGMENTS}, s AS (SELECT *, string_split(keyword, '_') AS w FROM fr),
n AS (SELECT grp, group_ord, keyword_ord, unnest([keyword, upper(keyword), w[1] || array_to_string({_TITLE.format('w[2:]')}, ''), array_to_string({_TITLE.format('w')}, ''), array_to_string(w, '-'), array_to_string(w, ''), upper(array_to_string(w, ''))]) AS name FROM s),
f AS (SELECT name AS keyword, arg_min(grp, CAST(group_ord AS BIGINT) * 100000000 + keyword_ord) AS grp FROM n GROUP BY name)"""


@query(f"""WITH {_DICTIONARY} SELECT keyword, grp AS "group", 'part' AS source, trim(regexp_replace(lower(grp), '[^a-z0-9]+', '-', 'g'), '-') || '.json' AS file FROM f""")
def s9_w5_dictionary(spark, sf_dir):
    """A dictionary built from the parts: every spelling goes to the first that claims it."""
    return I.build(_fragments(spark, sf_dir)).withColumn("file", I.file_name(F.col("group")))


@query(f"""WITH {_DICTIONARY}, g AS (SELECT keyword, CASE WHEN crc % 211 = 0 THEN 'other' ELSE grp END AS grp FROM (SELECT *, length(keyword) * 31 + ascii(keyword[-1:]) * 17 + ascii(keyword[1:1]) AS crc FROM f) WHERE crc % 307 <> 0)
SELECT keyword, f.grp AS in_index, g.grp AS in_groups FROM f FULL JOIN g USING (keyword) WHERE f.grp IS DISTINCT FROM g.grp""")
def s7_j12_consistency(spark, sf_dir):
    """The dictionary of the parts against a copy with rows moved and rows missing."""
    index = written(I.build(_fragments(spark, sf_dir)))
    k = F.col("keyword")
    mark = F.length(k) * 31 + F.ascii(F.substring(k, -1, 1)) * 17 + F.ascii(k)
    copy = index.where(mark % 307 != 0).select("keyword", F.when(mark % 211 == 0, "other").otherwise(F.col("group")).alias("group"))
    return assets.consistency(index, copy)


@query()
def j3_groups(spark, sf_dir):
    """Dictionary groups of the names in all texts."""
    out = lines.split_lines(S.documents(spark, sf_dir).unionByName(S.pages(spark, sf_dir)), surrounding=False)
    return I.resolve(out.select(F.explode(literals.identifiers(F.col("line"))).alias("name")), I.seed(spark))


@query(f"""WITH {_CLAIMS}, d AS (SELECT DISTINCT lower(c_name) AS keyword, c_mktsegment AS grp FROM customer)
SELECT (SELECT count(*) FROM part) AS rules, (SELECT count(DISTINCT keyword) FROM cl) AS rule_keywords, (SELECT count(*) FROM d) AS names, (SELECT count(DISTINCT grp) FROM d) AS groups""")
def a15_health(spark, sf_dir):
    """Sizes of dimensions made from parts and customers."""
    names = table(spark, sf_dir, "customer").select(F.lower("c_name").alias("keyword"), F.col("c_mktsegment").alias("group")).distinct()
    return report.health(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id")), _claims(spark, sf_dir), names)


# --- scan ---------------------------------------------------------------------------------------


def _all_files(spark, sf_dir):
    return S.documents(spark, sf_dir).unionByName(S.pages(spark, sf_dir)).unionByName(S.conversations(spark, sf_dir))


_SCORES = ["l1_score", "l2_score", "l3_score", "l4_score", "l5_score", "base_score", "score"]


@query()
def f3_f4_candidates(spark, sf_dir):
    return Scanner.default(spark).candidates(_all_files(spark, sf_dir)).select("file_uri", "line_no", "start_pos", "end_pos", "value", F.size("db1_hits").alias("n_keywords"), F.size("db2_hits").alias("n_names"))


@query()
def l1_l5_g4_g6_scored(spark, sf_dir):
    return Scanner.default(spark).scored(_all_files(spark, sf_dir)).select("file_uri", "line_no", "start_pos", "rule_id", "line_type", "allow_reason", "placeholder_names", "format_names", *[F.round(c, 6).alias(c) for c in _SCORES], "severity")


@query()
def f8_f10_f11_findings(spark, sf_dir):
    return Scanner.default(spark).findings(_all_files(spark, sf_dir)).select("file_uri", "line_no", "start_pos", "rule_id", F.round("score", 6).alias("score"), "severity")


@query()
def a7_funnel(spark, sf_dir):
    return Scanner.default(spark).funnel(_all_files(spark, sf_dir))


@query()
def k1_k3_k4_reports(spark, sf_dir):
    """Diagnostics, the console report and the dashboard's rows of all files' findings and the events' history."""
    files = _all_files(spark, sf_dir)
    scanner = Scanner.default(spark)
    found = written(scanner.findings(files))
    past, ignored = _keyed(spark, sf_dir), spark.createDataFrame([], suppress.COLUMNS)
    sizes = report.health(scanner.ruleset.rules_df(spark), scanner.ruleset.keywords_df(spark), scanner.dictionary)
    rows = report.dashboard(found, past, report.counters(past, found, ignored), sizes, ignored)
    parts = [report.diagnostics(found).select(F.lit("diagnostic").alias("kind"), "file_uri", F.col("message").alias("text")), report.console(found, files.count()).select(F.lit("console"), "file_uri", "text")]
    return parts[0].union(parts[1]).union(rows.select("section", F.lit(None).cast("string"), "payload"))


@query()
def p20_p21_remediation_plan(spark, sf_dir):
    return remediate.plan(Scanner.default(spark).findings(_all_files(spark, sf_dir)))


# Files made from the customers, a line each, so that there are findings of all severities. The SQL knows what each line is
# (a provider's token, assignments to dictionary names, an argument, a comment) and adds the layers up on its own.
_MADE_LINES = ['const githubToken = "ghp_{}"', 'const pwd = "{}"', 'const password = "{}"', 'login(pwd, "{}")', '# password = "{}"']
_MADE_TAILS = ["/main.js", "/config.json", "/secrets.json", "/tests/a.js"]


def _made_files(spark, sf_dir):
    h, k = F.sha2("c_name", 256), F.col("c_custkey")
    kind, tail = (k % 5).cast("int"), F.get(F.lit(_MADE_TAILS), (F.floor(k / 5) % 4).cast("int"))
    value = F.when(kind == 0, F.substring(h, 1, 36)).otherwise(F.concat(F.upper(F.substring(h, 1, 14)), F.lit("-"), F.substring(h, 15, 14)))
    content = F.concat(F.replace(F.get(F.lit(_MADE_LINES), kind), F.lit("{}"), value), F.when(k % 7 == 0, " // nosec").otherwise(""))
    return S.from_columns(table(spark, sf_dir, "customer"), F.concat(F.lit("/made/"), k.cast("string"), tail), content)


_MADE = f"""h AS (SELECT c_custkey % 5 AS kind, CAST(floor(c_custkey / 5) AS BIGINT) % 4 AS place, c_custkey % 7 = 0 AS allowed, '/made/' || c_custkey || CASE CAST(floor(c_custkey / 5) AS BIGINT) % 4 {" ".join(f"WHEN {i} THEN {lit(t)}" for i, t in enumerate(_MADE_TAILS))} END AS file_uri, sha256(c_name) AS h FROM customer),
m AS (SELECT *, CASE kind WHEN 0 THEN 'ghp_' || h[1:36] ELSE upper(h[1:14]) || '-' || h[15:28] END AS value FROM h),
t AS (SELECT *, CASE kind {" ".join(f"WHEN {i} THEN {lit(x.split('{}')[0].replace('ghp_', ''))} || value || {lit(x.split('{}')[1])}" for i, x in enumerate(_MADE_LINES))} END || CASE WHEN allowed THEN ' // nosec' ELSE '' END AS line,
CASE place WHEN 0 THEN 1.0 WHEN 1 THEN 1.2 WHEN 2 THEN 1.4 ELSE 0.5 END AS factor, CASE kind WHEN 0 THEN 'github-token' WHEN 2 THEN 'generic-secret' WHEN 4 THEN 'generic-secret' END AS rule_id FROM m),
{_entropy_sql("m")},
x AS (SELECT t.*, {_entropy_score_sql("(CASE WHEN kind IN (2, 4) THEN 3.5 ELSE 3.0 END)").replace("value", "t.value")} AS l2, CAST(CASE kind WHEN 0 THEN 0.92 WHEN 2 THEN 0.8 WHEN 4 THEN 0.8 ELSE 0.0 END AS DOUBLE) AS l1,
CASE kind WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 2 THEN 1 WHEN 4 THEN 0 ELSE CAST(0.7 AS DOUBLE) + CAST(0.1 AS DOUBLE) END AS l3, least(1.0, CAST(CASE kind WHEN 3 THEN 0.5 WHEN 4 THEN 0.15 ELSE 0.85 END AS DOUBLE) * CAST(factor AS DOUBLE)) AS l5 FROM t JOIN es ON es.value = t.value),
b AS (SELECT *, CAST(l1 * 0.35 + l2 * 0.2 + l3 * 0.2 + l5 * 0.1 + CASE WHEN kind IN (1, 3) AND l2 >= 0.6 THEN 0.28 ELSE 0.0 END AS DOUBLE) AS base FROM x),
r AS (SELECT *, CAST(CASE WHEN allowed THEN 0.0 ELSE least(1.0, CASE WHEN kind = 0 THEN greatest(base * factor, 0.9) ELSE base * factor END) END AS DOUBLE) AS score FROM b),
found AS (SELECT *, CAST(instr(line, '"') AS INTEGER) AS start_pos, CASE {" ".join(f"WHEN score >= {least} THEN '{n}'" for n, _, least in fixed.SEVERITIES)} END AS severity,
sha256(file_uri || ':0:' || line || ':' || coalesce(rule_id, 'unknown')) AS suppression_key, CASE kind WHEN 0 THEN 'GITHUB_TOKEN' WHEN 2 THEN 'PASSWORD' WHEN 4 THEN 'PASSWORD' ELSE 'PWD' END AS key FROM r)"""


@query(f"WITH {_MADE} SELECT file_uri, 0 AS line_no, start_pos, rule_id, round(l1, 6) AS l1_score, round(l2, 6) AS l2_score, round(l3, 6) AS l3_score, round(l5, 6) AS l5_score, round(score, 6) AS score, severity FROM found")
def l1_l5_g6_made_scores(spark, sf_dir):
    out = Scanner.default(spark).scored(_made_files(spark, sf_dir))
    return out.select("file_uri", "line_no", "start_pos", "rule_id", *[F.round(c, 6).alias(c) for c in ("l1_score", "l2_score", "l3_score", "l5_score", "score")], "severity")


@query(f"WITH {_MADE} SELECT file_uri, 0 AS line_no, start_pos, rule_id, round(score, 6) AS score, severity, suppression_key FROM found WHERE severity IS NOT NULL AND suppression_key[1:1] <> '0'")
def f10_f11_j5_made_findings(spark, sf_dir):
    """Findings of made files; those whose key begins with 0 are suppressed."""
    scored = written(Scanner.default(spark).findings(_made_files(spark, sf_dir)))
    ignored = scored.where(F.col("suppression_key").startswith("0")).select("suppression_key", F.lit(None).cast("timestamp").alias("expires_at"))
    return suppress.apply(scored, ignored).select("file_uri", "line_no", "start_pos", "rule_id", F.round("score", 6).alias("score"), "severity", "suppression_key")


@query(f"""WITH {_MADE} SELECT file_uri, CAST(1 AS BIGINT) AS lines_scanned, CAST(1 AS BIGINT) AS candidates, CAST(severity IS NOT NULL AS BIGINT) AS findings, CAST(0 AS BIGINT) AS skipped_gate0,
CAST(allowed AND kind <> 0 AS BIGINT) AS skipped_gate5, CAST(severity IS NULL AS BIGINT) AS skipped_gate7 FROM found""")
def a7_made_funnel(spark, sf_dir):
    return Scanner.default(spark).funnel(_made_files(spark, sf_dir))


@query(f"""WITH {_MADE} SELECT file_uri, 0 AS line_no, start_pos - 1 AS from_pos, CAST(start_pos + length(value) + 1 AS INTEGER) AS to_pos, severity,
'[' || upper(severity) || '] ' || coalesce(rule_id, 'Key & Token Abbreviations') || ' (' || CAST(round(score * 100) AS INTEGER) || '%)' AS message FROM found WHERE severity IS NOT NULL""")
def k1_p22_p26_made_diagnostics(spark, sf_dir):
    return report.diagnostics(Scanner.default(spark).findings(_made_files(spark, sf_dir)))


@query(f"""WITH {_MADE}, d AS (SELECT *, CASE WHEN rule_id IS NULL THEN 'Key & Token Abbreviations' ELSE rule_id END AS name, 'process.env.' || key AS expr,
upper(severity[1:1]) || severity[2:] AS label FROM found JOIN es USING (value) WHERE severity IS NOT NULL)
SELECT file_uri, 0 AS line_no, start_pos, severity, label, CASE severity WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'information' WHEN 'informational' THEN 'hint' ELSE 'error' END AS level,
CASE severity WHEN 'critical' THEN 'errorForeground' ELSE 'charts.' || CASE severity WHEN 'high' THEN 'orange' WHEN 'medium' THEN 'yellow' WHEN 'low' THEN 'green' ELSE 'blue' END END AS color,
name || ' (' || CAST(round(score * 100) AS INTEGER) || '%), line 1: ' || expr AS summary,
'### ' || label || ' risk\n\n**Confidence:** ' || format('{{:.1f}}', round(score * 100, 1)) || '%\n\n**' || CASE WHEN rule_id IS NULL THEN 'Category' ELSE 'Type' END || ':** ' || name || '\n\n**Entropy:** ' || format('{{:.2f}}', round(e, 2))
|| '\n\n| Layer | Score |\n|-|-|' || list_aggregate(list_transform([('Rules', l1), ('Entropy', l2), ('Context', l3), ('Strings', 0.0), ('File', l5)], lambda x: '\n| ' || x[1] || ' | ' || CAST(round(x[2] * 100) AS INTEGER) || '% |'), 'string_agg', '')
|| '\n\n1. Add ' || key || ' to .env\n2. Write ' || expr || ' instead of the value\n3. See that .env is ignored' AS text FROM d""")
def p25_p26_made_details(spark, sf_dir):
    return report.details(Scanner.default(spark).findings(_made_files(spark, sf_dir)))


@query(f"""WITH {_MADE}, s AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS ord FROM found WHERE severity IS NOT NULL)
SELECT file_uri, 0 AS line_no, start_pos, suppression_key, CAST(ord AS INTEGER) AS ord, ['migrate', 'replace', 'ignore', 'example', 'mark fixed'][ord + 1] AS step,
[key, 'process.env.' || key, '.env', key || '=your-' || lower(replace(key, '_', '-')) || '-here', suppression_key][ord + 1] AS detail FROM s""")
def p20_p21_made_plan(spark, sf_dir):
    return remediate.plan(Scanner.default(spark).findings(_made_files(spark, sf_dir)))


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS l1, l_tax * 12 AS l2, l_quantity / 50.0 AS l3, (l_partkey % 10) / 10.0 AS l4, (l_suppkey % 10) / 10.0 AS l5 FROM lineitem),
b AS (SELECT *, CAST(l1 AS DOUBLE) * 0.35 + CAST(l2 AS DOUBLE) * 0.2 + CAST(l3 AS DOUBLE) * 0.2 + CAST(l4 AS DOUBLE) * 0.15 + CAST(l5 AS DOUBLE) * 0.1 + CASE WHEN l1 = 0 AND l3 >= 0.4 AND l2 >= 0.6 THEN 0.28 ELSE 0.0 END AS base FROM i)
SELECT l_orderkey, l_linenumber, round(base, 6) AS base_score, round(greatest(0.0, least(1.0, CASE WHEN l_linenumber = 7 THEN 0.0 WHEN l_linenumber = 6 THEN greatest(base * 1.2 * CASE WHEN l_linenumber = 5 THEN 0.05 ELSE 1.0 END, 0.9) ELSE base * 1.2 * CASE WHEN l_linenumber = 5 THEN 0.05 ELSE 1.0 END END)), 6) AS score FROM b""")
def g6_confidence(spark, sf_dir):
    """The aggregate over scores made from the order lines' numbers."""
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[c.cast("double").alias(k) for k, c in {"l1": F.col("l_discount") * 10, "l2": F.col("l_tax") * 12, "l3": F.col("l_quantity") / 50.0, "l4": F.col("l_partkey") % 10 / 10.0, "l5": F.col("l_suppkey") % 10 / 10.0}.items()])
    n = F.col("l_linenumber")
    c = {"l1_score": F.col("l1"), "l2_score": F.col("l2"), "l2_entropy": F.lit(4.0), "l3_score": F.col("l3"), "l4_score": F.col("l4"), "l5_score": F.col("l5"), "matched": F.col("l1") != 0, "known_provider": n == 6, "generic": F.lit(False),
         "specific_context": F.lit(False), "file_factor": F.lit(1.2), "placeholder_factor": F.when(n == 5, 0.05).otherwise(1.0), "format_factor": F.lit(1.0), "allowed": n == 7, "value": F.lit("x y")}
    out = G.confidence(c, fixed.WEIGHTS)
    return i.select("l_orderkey", "l_linenumber", *[F.round(v, 6).alias(k) for k, v in out.items()])


# --- reports ------------------------------------------------------------------------------------


@query(f"WITH {_HISTORY} SELECT event_id, severity, CAST({_RANK} AS INTEGER) AS rank, coalesce(severity IN ('critical', 'high'), false) AS blocks FROM hs")
def f11_f12_severities(spark, sf_dir):
    s = F.col("severity")
    return history(spark, sf_dir).select("event_id", "severity", G.severity_rank(s).alias("rank"), G.blocks(s).alias("blocks"))


@query(f"WITH {_HISTORY} SELECT d.severity, CAST(d.rank AS INTEGER) AS rank, count(hs.severity) AS n FROM (VALUES " + ", ".join(f"('{n}', {r})" for n, r, _ in fixed.SEVERITIES) + ") d(severity, rank) LEFT JOIN hs ON hs.severity = d.severity GROUP BY d.severity, d.rank")
def a2_by_severity(spark, sf_dir):
    return report.by_severity(history(spark, sf_dir))


@query(f"WITH {_HISTORY} SELECT file_name AS file_uri, CASE max({_RANK}) " + " ".join(f"WHEN {r} THEN '{n}'" for n, r, _ in fixed.SEVERITIES) + " END AS severity, count(*) AS n FROM hs WHERE severity IS NOT NULL GROUP BY file_name")
def a1_max_severity(spark, sf_dir):
    return report.max_severity(history(spark, sf_dir).where("severity is not null").withColumnRenamed("file_name", "file_uri"))


@query(f"WITH {_HISTORY} SELECT coalesce(rule_id, 'unknown') AS type, count(*) AS n FROM hs GROUP BY 1 ORDER BY n DESC, type LIMIT 8")
def a3_top_types(spark, sf_dir):
    return report.top_types(history(spark, sf_dir).withColumn("matched_group", F.lit(None).cast("string")))


_TODAY = "(SELECT max(CAST(ts AS DATE)) FROM events)"
_DAYS = f"d AS (SELECT CAST({_TODAY} - CAST(i AS INTEGER) AS DATE) AS day FROM range(14) t(i)), c AS (SELECT d.day, count(hs.event_id) AS n FROM d LEFT JOIN hs ON CAST(hs.detected_at AS DATE) = d.day GROUP BY d.day)"


def _days(spark, sf_dir):
    h = history(spark, sf_dir)
    today = h.agg(F.max(F.to_date("detected_at"))).first()[0]
    return report.daily(h, F.lit(today))


@query(f"WITH {_HISTORY}, {_DAYS} SELECT day, n FROM c")
def a4_daily(spark, sf_dir):
    return _days(spark, sf_dir)


@query(f"WITH {_HISTORY}, {_DAYS} SELECT (SELECT day FROM c ORDER BY n DESC, day LIMIT 1) AS peak_day, max(n) AS peak, count(*) FILTER (n > 0) AS active_days, (SELECT n FROM c ORDER BY day DESC LIMIT 1) AS today FROM c")
def a5_peak(spark, sf_dir):
    return report.peak(_days(spark, sf_dir))


@query(f"WITH {_HISTORY} SELECT count(*) AS detected, count(*) FILTER (is_fixed) AS fixed, count(*) FILTER (severity IS NOT NULL) AS active, count(*) FILTER (severity = 'low') AS suppressed, CAST(0 AS BIGINT) AS blocked FROM hs")
def a6_a17_counters(spark, sf_dir):
    h = history(spark, sf_dir)
    return report.counters(h, h.where("severity is not null"), h.where("severity = 'low'"))


@query(f"WITH {_HISTORY} SELECT bool_or(coalesce(severity IN ('critical', 'high'), false)) AS blocked, count(*) AS findings FROM hs")
def f12_a13_k5_blocked(spark, sf_dir):
    return report.blocked(history(spark, sf_dir))


@query("""WITH x AS (SELECT quality = 1 AS a, length(text) > 900 AS p FROM labels JOIN documents USING (doc_id)),
n AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM x),
r AS (SELECT *, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(tp + fn AS DOUBLE) AS recall FROM n)
SELECT tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(2 * precision * recall / (precision + recall), 9) AS f1 FROM r""")
def a16_confusion(spark, sf_dir):
    """Long documents taken as a prediction of quality."""
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    out = report.confusion(x, F.length("text") > 900, F.col("quality") == 1)
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_HISTORY} SELECT event_id, severity FROM hs WHERE severity = 'high' AND (contains(lower(file_name), '1') OR contains(lower(rule_id), '1'))")
def f17_filter(spark, sf_dir):
    return report.filter_findings(history(spark, sf_dir).withColumnRenamed("file_name", "file_uri"), "high", "1").select("event_id", "severity")


# --- state --------------------------------------------------------------------------------------

_KEYS = "k AS (SELECT *, sha256(file_name || ':' || rule_id || ':' || CAST(event_id % 500 AS VARCHAR)) AS suppression_key FROM hs)"
_SUPPRESSED = "s AS (SELECT suppression_key, max(detected_at) + INTERVAL 3 DAY AS expires_at FROM k WHERE event_id % 5 = 0 GROUP BY suppression_key)"


def _keyed(spark, sf_dir):
    h = history(spark, sf_dir)
    return h.withColumn("suppression_key", F.sha2(F.concat_ws(":", "file_name", "rule_id", (F.col("event_id") % 500).cast("string")), 256))


@query(f"WITH {_HISTORY}, {_KEYS}, {_SUPPRESSED} SELECT event_id, suppression_key FROM k WHERE suppression_key NOT IN (SELECT suppression_key FROM s WHERE expires_at >= (SELECT max(ts) FROM events))")
def j5_st6_suppressed(spark, sf_dir):
    k = _keyed(spark, sf_dir)
    s = k.where("event_id % 5 = 0").groupBy("suppression_key").agg((F.max("detected_at") + F.expr("interval 3 days")).alias("expires_at"))
    now = k.agg(F.max("detected_at")).first()[0]
    return suppress.apply(k, s, F.lit(now)).select("event_id", "suppression_key")


@query(f"WITH {_HISTORY}, {_KEYS} SELECT event_id FROM k a WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM k b WHERE b.event_id % 2 = 0 AND b.file_name = a.file_name AND b.suppression_key = a.suppression_key)")
def j7_st5_new_findings(spark, sf_dir):
    k = _keyed(spark, sf_dir).withColumnRenamed("file_name", "file_uri")
    return suppress.new_findings(k.where("event_id % 2 = 1"), k.where("event_id % 2 = 0")).select("event_id")


@query(f"WITH {_HISTORY} SELECT file_name AS file_uri, event_id FROM hs WHERE event_id % 2 = 1 OR file_name NOT IN (SELECT file_name FROM hs WHERE event_id % 2 = 1)")
def st4_replace_files(spark, sf_dir):
    k = history(spark, sf_dir).withColumnRenamed("file_name", "file_uri").select("file_uri", "event_id")
    fresh = k.where("event_id % 2 = 1")
    return suppress.replace_files(k.where("event_id % 2 = 0"), fresh, fresh)


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut, event_id FROM events),
s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n_events FROM s GROUP BY user_id, s""")
def st2_sessions(spark, sf_dir):
    from leakscan.streaming.scan import event_sessions

    return event_sessions(table(spark, sf_dir, "events"))


# --- ignore files and remediation ---------------------------------------------------------------

_IGNORES = [("", "*.png\n/src/**/main.rs\nnode_modules/\n"), ("src", "!*.png\n# kept\n*.md\n")]


@query("""WITH u AS (""" + _URIS + r"""), r AS (SELECT DISTINCT ltrim(file_uri, '/') AS path FROM u WHERE starts_with(file_uri, '/'))
SELECT path, CASE WHEN starts_with(path, 'src/') AND ends_with(path, '.md') THEN true WHEN starts_with(path, 'src/') AND ends_with(path, '.png') THEN false WHEN regexp_matches(path, '(^|/)node_modules(/|$)') THEN true
WHEN regexp_matches(path, '^src/(.*/)?main\.rs$') THEN true WHEN ends_with(path, '.png') THEN true END AS verdict FROM r""")
def f15_f16_j9_ignored(spark, sf_dir):
    u = _uris(spark, sf_dir).where(F.col("file_uri").startswith("/")).select(F.regexp_replace("file_uri", "^/+", "").alias("path")).distinct()
    return ignores.evaluate(u, ignores.rules(spark, _IGNORES))


@query("""WITH p AS (SELECT *, replace(p_brand, '#', '-') AS dir FROM part), d AS (SELECT DISTINCT p_size FROM p WHERE starts_with(p_name, 'cold') AND p_type = 'PROMO'), k AS (SELECT DISTINCT dir, p_type, p_size FROM p WHERE starts_with(p_name, 'small'))
SELECT '/parts/' || dir || '/' || p_partkey || '.' || p_type || '.' || p_size AS file_uri, p_size IN (SELECT p_size FROM d) AND (dir, p_type, p_size) NOT IN (SELECT (dir, p_type, p_size) FROM k) AS ignored FROM p""")
def f15_f16_s13_made_ignores(spark, sf_dir):
    """A file a part, ignored by size, which ignore files of the brands' folders take back by type and size; the files are a table."""
    p, text = table(spark, sf_dir, "part").withColumn("dir", F.replace("p_brand", F.lit("#"), F.lit("-"))), lambda c: F.array_join(F.collect_set(c), "\n")
    size = F.col("p_size").cast("string")
    root = p.where("startswith(p_name, 'cold') AND p_type = 'PROMO'").agg(text(F.concat(F.lit("*."), size)).alias("text")).select(F.lit("").alias("dir"), "text")  # a line a size
    own = p.where("startswith(p_name, 'small')").groupBy("dir").agg(text(F.concat_ws(".", F.lit("!*"), "p_type", size)).alias("text"))  # a line a type and size
    files = p.select(F.concat(F.lit("/parts/"), "dir", F.lit("/"), F.concat_ws(".", F.col("p_partkey").cast("string"), "p_type", size)).alias("file_uri"))
    return ignores.ignored(files, "/parts", ignores.rules_of(root.unionByName(own)))


@query("""WITH e AS (SELECT upper(replace(c_name, '#', '_')) AS key, CAST(c_acctbal AS VARCHAR) AS old FROM customer WHERE c_custkey % 3 > 0), w AS (SELECT upper(replace(c_name, '#', '_')) AS key, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_acctbal AS VARCHAR) ELSE 'x' END AS new FROM customer WHERE c_custkey % 5 > 1)
SELECT key, coalesce(new, old) AS value, CASE WHEN new IS NULL THEN 'kept' WHEN old IS NULL THEN 'appended' WHEN old = new THEN 'unchanged' ELSE 'replaced' END AS action FROM e FULL JOIN w USING (key)""")
def k6_k7_env_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("key", F.upper(F.replace("c_name", F.lit("#"), F.lit("_"))))
    value = F.col("c_acctbal").cast("string")
    own = c.where("c_custkey % 3 > 0").select("key", value.alias("value"))
    want = c.where("c_custkey % 5 > 1").select("key", F.when(F.col("c_custkey") % 2 == 0, value).otherwise("x").alias("value"))
    out = remediate.upsert_env(own, want)
    return out.select("key", "value", "action")


@query("SELECT 'your-' || lower(replace(upper(replace(s_name, '#', '_')), '_', '-')) || '-here' AS value, upper(replace(s_name, '#', '_')) AS key FROM supplier WHERE s_suppkey % 4 > 0")
def k9_example_sync(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("key", F.upper(F.replace("s_name", F.lit("#"), F.lit("_"))))
    return remediate.sync_example(s, s.where("s_suppkey % 4 = 0")).select("key", "value")


@query("""WITH h AS (SELECT CASE c_custkey % 5 WHEN 0 THEN '# /out/' ELSE '  /out/' END || c_nationkey || '/' || c_custkey % 50 || CASE c_custkey % 3 WHEN 0 THEN ' ' ELSE '' END AS line FROM customer),
e AS (SELECT DISTINCT '/out/' || s_nationkey || '/' || s_suppkey % 60 AS entry FROM supplier)
SELECT entry FROM e WHERE entry NOT IN (SELECT trim(line) FROM h WHERE NOT starts_with(trim(line), '#'))""")
def k8_j10_missing_ignores(spark, sf_dir):
    """Ignore entries for the suppliers that the lines of the customers lack."""
    k = F.col("c_custkey")
    tail = lambda a, b: F.concat(F.col(a).cast("string"), F.lit("/"), b.cast("string"))
    line = F.concat(F.when(k % 5 == 0, "# /out/").otherwise("  /out/"), tail("c_nationkey", k % 50), F.when(k % 3 == 0, " ").otherwise(""))
    entries = table(spark, sf_dir, "supplier").select(F.concat(F.lit("/out/"), tail("s_nationkey", F.col("s_suppkey") % 60)).alias("entry")).distinct()
    return remediate.missing_entries(table(spark, sf_dir, "customer").select(line.alias("line")), entries)


_ENV_FILES = """c AS (SELECT c_custkey AS i, c_nationkey AS f, 'C' || c_custkey % 800 AS key, CAST(c_acctbal AS VARCHAR) AS v, CASE WHEN c_nationkey % 2 = 0 THEN chr(13) || chr(10) ELSE chr(10) END AS nl FROM customer),
own AS (SELECT *, CASE WHEN i % 10 = 4 THEN '# ' || key || '=' || v ELSE key || '=' || v END AS line, i % 10 <> 4 AS live FROM c WHERE i % 3 > 0),
w AS (SELECT f, key, min(i) AS first, arg_max(CASE WHEN i % 2 = 0 THEN v ELSE 'x' END, i) AS new FROM c WHERE i % 5 > 1 GROUP BY f, key)"""


@query(f"""WITH {_ENV_FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY f, key, live ORDER BY i) AS n FROM own),
m AS (SELECT r.f, r.i, r.nl, r.line, r.v, CASE WHEN live AND n = 1 THEN w.new END AS new, r.key FROM r LEFT JOIN w ON w.f = r.f AND w.key = r.key),
b AS (SELECT f, string_agg(CASE WHEN new IS NULL THEN line ELSE key || '=' || new END || nl, '' ORDER BY i) AS body, count(*) FILTER (new IS NOT NULL AND new <> v) AS replaced, count(*) FILTER (new = v) AS unchanged FROM m GROUP BY f),
a AS (SELECT f, string_agg('# Added on 2024-01-01' || chr(10) || key || '=' || new || chr(10), chr(10) ORDER BY first) AS tail, count(*) AS appended FROM w WHERE NOT EXISTS (SELECT 1 FROM own WHERE live AND own.f = w.f AND own.key = w.key) GROUP BY f)
SELECT '/env/' || coalesce(b.f, a.f) AS file_uri, sha256(coalesce(body, '') || CASE WHEN body IS NOT NULL AND tail IS NOT NULL THEN chr(10) ELSE '' END || coalesce(tail, '')) AS text_sha256,
coalesce(replaced, 0) AS replaced, coalesce(appended, 0) AS appended, coalesce(unchanged, 0) AS unchanged, CAST(0 AS BIGINT) AS rejected FROM b FULL JOIN a ON a.f = b.f""")
def k6_env_text(spark, sf_dir):
    """Env files, one for every nation's customers, edited in place: order, comments and line endings stay."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.concat(F.lit("/env/"), F.col("c_nationkey").cast("string")).alias("file_uri"), F.concat(F.lit("C"), (F.col("c_custkey") % 800).cast("string")).alias("key"),
                                                F.col("c_acctbal").cast("string").alias("v"), F.when(F.col("c_nationkey") % 2 == 0, "\r\n").otherwise("\n").alias("nl"))
    line = F.concat(F.when(F.col("i") % 10 == 4, "# ").otherwise(""), "key", F.lit("="), "v", "nl")
    files = c.where("i % 3 > 0").groupBy("file_uri").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "").alias("text"))
    want = c.where("i % 5 > 1").select("file_uri", F.col("i").alias("ord"), "key", F.when(F.col("i") % 2 == 0, F.col("v")).otherwise("x").alias("value"))
    out = remediate.upsert_text(files, want, F.lit("2024-01-01"))
    return out.select("file_uri", F.sha2("text", 256).alias("text_sha256"), "replaced", "appended", "unchanged", F.col("rejected").cast("long").alias("rejected"))


# --- intervals, streams, SQL functions ----------------------------------------------------------

_SPANS = "sp AS (SELECT event_id AS span_id, event_type, epoch_us(ts) // 1000 AS from_ms, epoch_us(ts) // 1000 + (CASE WHEN event_id % 50 = 0 THEN 720 ELSE event_id % 40 END) * 60000 AS to_ms FROM events WHERE event_type = 'purchase' OR event_id % 10 = 0)"


@query(f"WITH {_SPANS} SELECT span_id, count(*) AS n_events, min(event_id) AS first_event FROM sp JOIN events e ON e.event_type = sp.event_type AND epoch_us(e.ts) // 1000 BETWEEN from_ms AND to_ms GROUP BY span_id")
def j8_events_in_spans(spark, sf_dir):
    """Events within spans of very unlike lengths that begin at other events of their type."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    i = F.col("event_id")
    minutes = F.when(i % 50 == 0, 720).otherwise(i % 40)
    spans = e.where((F.col("event_type") == "purchase") | (i % 10 == 0)).select("event_type", i.alias("span_id"), F.col("at").alias("from_ms"), (F.col("at") + minutes * 60_000).alias("to_ms"))
    return intervals.locate(e, spans, ["event_type"], "at", "from_ms", "to_ms").groupBy("span_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"))


def _event_stream(spark, sf_dir):
    """The events as a stream; the pattern lets a single file be one."""
    path = f"{sf_dir}/events.parque[t]"
    e = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(path)
    return e.select(F.col("user_id").cast("string").alias("file_uri"), F.col("event_type").alias("suppression_key"), F.col("ts").cast("timestamp").alias("at"))


def _ran(spark, stream: DataFrame, schema: str, mode: str = "append") -> DataFrame:
    """What a stream gives, in a table of the shared folder; the checkpoint goes with the run."""
    out, checkpoint = scratch_path(spark), scratch_path(spark)
    memory.run_once(stream, out, checkpoint, mode)
    drop_paths(spark, checkpoint)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS u, event_type AS k, epoch_us(ts) // 1000 AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY u, k ORDER BY t) <= 86400000 THEN 0 ELSE 1 END AS cut FROM e),
s AS (SELECT *, sum(cut) OVER (PARTITION BY u, k ORDER BY t ROWS UNBOUNDED PRECEDING) AS z FROM g), a AS (SELECT u, k, z, min(t) AS f, max(t) AS l, count(*) AS n, max(z) OVER (PARTITION BY u, k) AS last FROM s GROUP BY u, k, z)
SELECT u AS file_uri, k AS suppression_key, 'new' AS event, f AS first_ms, f AS last_ms, CAST(1 AS BIGINT) AS n FROM a
UNION ALL SELECT u, k, 'expired', f, l, n FROM a WHERE z < last OR l + 86400000 <= (SELECT max(t) - 3600000 FROM e)""")
def st5_st6_sightings(spark, sf_dir):
    """New and expired detections of the event stream, kept in keyed state until a day has passed without one."""
    return _ran(spark, memory.sightings(_event_stream(spark, sf_dir), quiet=24 * 3600_000, late=3600_000), memory.SIGHTING)


@query("""WITH s AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS u, date_trunc('day', ts) AS d, event_type AS k FROM events), d AS (SELECT u, d, lag(d) OVER (PARTITION BY u ORDER BY d) AS before, lead(d) OVER (PARTITION BY u ORDER BY d) AS after FROM (SELECT DISTINCT u, d FROM s))
SELECT s.u AS file_uri, CAST(s.d AS TIMESTAMP) AS at, s.k AS suppression_key, 'new' AS event FROM s JOIN d USING (u, d) WHERE NOT EXISTS (SELECT 1 FROM s p WHERE p.u = s.u AND p.d = d.before AND p.k = s.k)
UNION ALL SELECT s.u, CAST(d.after AS TIMESTAMP), s.k, 'gone' FROM s JOIN d USING (u, d) WHERE d.after IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s p WHERE p.u = s.u AND p.d = d.after AND p.k = s.k)""")
def st4_st5_scan_changes(spark, sf_dir):
    """Each user's day of events as a scan: what it found that the day before had not, and what was gone."""
    scans = _event_stream(spark, sf_dir).withColumn("at", F.date_trunc("day", "at"))
    return _ran(spark, memory.scan_changes(scans), memory.CHANGE, "update")


@query(f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
w AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS value FROM l), {_entropy_sql('w')}, m AS (SELECT doc_id, count(DISTINCT line_no) AS lines_with_words, count(*) AS n_words, max(e) AS top FROM w JOIN es USING (value) GROUP BY doc_id)
SELECT doc_id, lines_with_words, n_words, round(top, 6) + 0.0 AS top_entropy, CASE {" ".join(f"WHEN round(top, 6) / 5 >= {x} THEN '{n}'" for n, _, x in fixed.SEVERITIES)} END AS severity FROM m""")
def p10_f11_sql_functions(spark, sf_dir):
    """The session's SQL functions and table functions in a SQL text: a text's lines, their words, the highest entropy and its severity."""
    sql_functions.register(spark)
    docs = S.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spark.sql(
        """WITH words AS (SELECT doc_id, l.line_no, w.word FROM {docs} d, LATERAL lines_of(d.text) l, LATERAL words_of(l.line) w),
        top AS (SELECT doc_id, count(DISTINCT line_no) AS lines_with_words, count(*) AS n_words, max(shannon_entropy(word)) AS e FROM words GROUP BY doc_id)
        SELECT doc_id, lines_with_words, n_words, round(e, 6) + 0D AS top_entropy, severity_of(round(e, 6) / 5) AS severity FROM top""", docs=docs,
    )


@query(f"""WITH {_HISTORY}, k AS (SELECT *, sha256(file_name || ':' || rule_id || ':' || CAST(event_id % 500 AS VARCHAR)) AS suppression_key FROM hs),
t AS (SELECT *, row_number() OVER (ORDER BY detected_at DESC, suppression_key) AS n FROM k)
SELECT 'report' AS section, 0 AS ord, (SELECT CAST(count(*) AS VARCHAR) FROM k) AS a, NULL AS b UNION ALL SELECT 'history', CAST(n AS INTEGER), file_name, severity FROM t WHERE n <= 100
UNION ALL SELECT 'suppressions', NULL, suppression_key, file_name FROM k WHERE event_id % 5 = 0""")
def k2_export(spark, sf_dir):
    """The report's rows, with what their JSON texts hold."""
    k = _keyed(spark, sf_dir)
    ignored = k.where("event_id % 5 = 0").select("suppression_key", F.col("file_name").alias("file_uri"), F.lit(1).alias("line_no"), F.lit("test").alias("reason"))
    out = report.export(k, ignored, k.agg(F.count(F.lit(1)).alias("detected")), F.lit("2024-01-01"))
    j = lambda path: F.get_json_object("payload", path)
    return out.select("section", "ord", F.coalesce(j("$.statistics.detected"), j("$.file_name"), j("$.suppression_key")).alias("a"), F.coalesce(j("$.severity"), j("$.file_uri")).alias("b"))


_CHANGED = "ch AS (SELECT '/corpus/' || source || '/' || CAST(doc_id AS VARCHAR) AS file_uri, CASE WHEN doc_id % 4 > 0 THEN [doc_id % 7, doc_id % 7 + doc_id % 23, doc_id % 50] END AS changed FROM documents)"


@query(f"WITH {_lines(_DOCS)}, {_CHANGED} SELECT file_uri, line_no, sha256(line) AS line_sha256 FROM l JOIN ch USING (file_uri) WHERE changed IS NULL OR len(list_filter(changed, lambda c: abs(c - line_no) <= 2)) > 0")
def f3_changed_lines(spark, sf_dir):
    """Lines within two of a changed one, where a file says which changed."""
    d = F.col("doc_id")
    uri = F.concat(F.lit("/corpus/"), "source", F.lit("/"), d.cast("string"))
    changed = F.when(d % 4 > 0, F.array(d % 7, d % 7 + d % 23, d % 50).cast("array<int>"))
    files = S.spread(table(spark, sf_dir, "documents").select("source", "doc_id", "text")).select(uri.alias("file_uri"), F.col("text").alias("content"), changed.alias("changed_lines"))
    return lines.split_lines(files, surrounding=False).select("file_uri", "line_no", F.sha2("line", 256).alias("line_sha256"))


# --- operators over candidates made from customers -----------------------------------------------
# The SQL knows what each kind of row is, so it needs none of the engine's patterns.


@query(f"WITH {_MADE} SELECT file_uri, start_pos, rule_id, sha256(file_uri || ':0:' || start_pos || ':' || sha256(value)) AS finding_id FROM found")
def p15_made_finding_ids(spark, sf_dir):
    return Scanner.default(spark).scored(_made_files(spark, sf_dir)).select("file_uri", "start_pos", "rule_id", "finding_id")


_RIVALS = {"rules": [
    {"id": "acme-b", "regex": "acme_[0-9a-f]+", "keywords": ["acme"], "entropy": 2.5}, {"id": "acme-a", "regex": "acme_[0-9a-f]{20}", "keywords": ["ACME"]},
    {"id": "generic-token", "regex": 'token\\s*=\\s*"([^"]{8,})"', "keywords": ["token"], "secretGroup": 1},
]}


@query("""WITH c AS (SELECT c_custkey AS cand_id, c_custkey % 6 AS kind, sha256(c_name)[1:20] AS h FROM customer)
SELECT cand_id, CASE kind WHEN 2 THEN 'generic-token' ELSE 'acme-a' END AS rule_id, CASE kind WHEN 2 THEN h ELSE 'acme_' || h END AS matched_value, CAST(CASE kind WHEN 2 THEN 0.8 WHEN 5 THEN 0.85 ELSE 0.92 END AS DOUBLE) AS l1_score, kind <> 2 AS known_provider,
CASE kind WHEN 0 THEN 'acme-a:0.92,acme-b:0.92' WHEN 1 THEN 'acme-a:0.92,acme-b:0.92,generic-token:0.8' WHEN 2 THEN 'generic-token:0.8' ELSE 'acme-a:0.85,acme-b:0.85' END AS matched FROM c WHERE kind IN (0, 1, 2, 5)""")
def l1b_l1c_f14_w4_rivals(spark, sf_dir):
    """Of several rules that match the best counts, provider rules before generic ones; a match beside the value rejects a rule."""
    k, h = F.col("c_custkey"), F.substring(F.sha2("c_name", 256), 1, 20)
    own, near = F.concat(F.lit("acme_"), h), F.concat(F.lit("val-"), F.substring(h, 1, 8))
    line = F.concat(F.lit('x = "'), own, F.lit('"'))
    kind = (k % 6).cast("int")
    line = F.when(kind == 0, line).when(kind == 1, F.concat(F.lit('token = "'), own, F.lit('"'))).when(kind == 2, F.concat(F.lit('token = "'), h, F.lit('"'))).when(kind == 3, "see acme here").when(kind == 4, F.concat(own, F.lit(' and "'), near, F.lit('"'))).otherwise("the acme value is elsewhere")
    value = F.when(kind == 2, h).when(kind == 3, "nothing").when(kind == 4, near).otherwise(own)
    rules = R.compile_rules(spark, _RIVALS)
    rows = table(spark, sf_dir, "customer").select(k.alias("cand_id"), value.alias("value"), line.alias("line"), F.lit("/a").alias("path"), R.keyword_hits(line, rules.keyword_set).alias("db1_hits"))
    shown = F.array_join(F.transform("all_matched", lambda m: F.concat_ws(":", m["rule_id"], m["score"].cast("string"))), ",")
    return R.match_rules(rows, rules).select("cand_id", "rule_id", "matched_value", "l1_score", "known_provider", shown.alias("matched"))


_ALLOWED = {"rules": [
    {"id": "r0", "regex": "x", "keywords": ["x"], "allowlists": [{"stopwords": ["R#0", "007"]}]}, {"id": "r1", "regex": "x", "keywords": ["x"], "allowlists": [{"regexes": ["#0+[1-9]*5$"]}]},
    {"id": "r2", "regex": "x", "keywords": ["x"], "allowlists": [{"condition": "AND", "regexes": ["[02468]$"], "paths": ["/EVEN/"]}]},
    {"id": "r3", "regex": "x", "keywords": ["x"], "allowlists": [{"stopwords": ["none"], "regexTarget": "line", "regexes": ["note$"]}, {"regexes": ["[37]$"]}]},
]}


@query("""WITH c AS (SELECT c_custkey AS cand_id, c_custkey % 4 AS r, c_name AS v, c_nationkey % 2 = 0 AS even, c_custkey % 3 = 0 AS note FROM customer), x AS (SELECT cand_id, CASE
WHEN r = 0 THEN 'stopword match: "r#0"' WHEN r = 1 AND regexp_matches(v, '#0+[1-9]*5$') THEN 'OR condition met' WHEN r = 2 AND even AND v[-1:] IN ('0', '2', '4', '6', '8') THEN 'AND condition met (regex + path)'
WHEN r = 3 AND (note OR v[-1:] IN ('3', '7')) THEN 'OR condition met' END AS rule_reason FROM c) SELECT * FROM x WHERE rule_reason IS NOT NULL""")
def f8_rule_allowlists(spark, sf_dir):
    """Stop words, patterns on value or line, and conditions with paths."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("cand_id"), F.concat(F.lit("r"), (k % 4).cast("string")).alias("rule_id"), F.col("c_name").alias("value"), F.concat("c_name", F.when(k % 3 == 0, " note").otherwise(" x")).alias("line"),
        F.when(F.col("c_nationkey") % 2 == 0, "/a/even/b").otherwise("/a/odd/b").alias("path"),
    )
    return R.allowlisted(rows, R.compile_rules(spark, _ALLOWED))


@query("""WITH c AS (SELECT c_custkey AS id, c_custkey % 8 AS kind FROM customer) SELECT id, CASE kind WHEN 0 THEN 'Inline suppression comment' WHEN 1 THEN 'Rule allowlist: x' WHEN 2 THEN 'Global allowlist pattern' WHEN 3 THEN 'Global stopword: "demo"'
WHEN 4 THEN 'Developer stopword: "mine"' WHEN 5 THEN 'Developer pattern: ^keep-' WHEN 6 THEN 'Inline suppression comment' END AS reason FROM c""")
def f7_f9_allow_cascade(spark, sf_dir):
    """All steps of the cascade, of which the first counts; a stop word inside a longer word is none."""
    k = F.col("c_custkey")
    kind, n = (k % 8).cast("int"), k.cast("string")
    value = F.when(kind == 2, F.concat(F.lit("http://localhost:"), n)).when(kind == 3, F.concat(F.lit("Demo-Q"), n)).when(kind == 4, F.concat(F.lit("q"), n, F.lit("-mine"))).when(kind == 5, F.concat(F.lit("KEEP-"), n)).when(kind == 7, F.concat(F.lit("xdemox"), n)).otherwise(F.concat(F.lit("keep-demo-"), n))
    line = F.concat(F.lit("v = "), value, F.when(kind == 0, " # nosec").when(kind == 6, " // own-mark").otherwise(""))
    rows = written(table(spark, sf_dir, "customer").select(k.alias("id"), value.alias("value"), line.alias("line"), F.when(kind == 1, "x").alias("rule_reason")))
    return rows.select("id", G.allow_reason(F.col("value"), F.col("line"), F.col("rule_reason"), fixed.DEVELOPER_STOPWORDS, ["^keep-"], ["own-mark"]).alias("reason"))


@query("""WITH c AS (SELECT c_custkey AS id, c_custkey % 5 AS a, c_custkey // 5 % 3 AS p, c_custkey // 15 % 2 AS h FROM customer)
SELECT id, round(least(1.0, least(0.55, a * 0.2) + least(0.25, p * 0.2) + h * 0.1 + CASE WHEN a > 0 AND p > 0 THEN 0.1 ELSE 0.0 END) + 0.0::DOUBLE, 6) AS l4_score FROM c""")
def l4_a9_other_literals(spark, sf_dir):
    """What literals beside the value say: distinct ones count once, the value itself not at all."""
    k = F.col("c_custkey")
    some = lambda n, word: F.transform(F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: i < n), lambda i: F.concat(F.lit(f'f("{word} '), i.cast("string"), F.lit(f'", "plain", "{word.upper()} '), i.cast("string"), F.lit('")')))
    around = F.concat(some(k % 5, "bearer"), some(F.floor(k / 5) % 3, "stripe"), F.when(F.floor(k / 15) % 2 == 1, F.array(F.lit("go('endpoint q', `endpoint q`)"))).otherwise(F.array().cast("array<string>")), F.array(F.lit('"a bearer value"')))
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.round(layers.string_score(F.lit("a bearer value"), F.lit('x = "a bearer value"'), around), 6).alias("l4_score"))


_KINDS = ["AWS", "Misc", "Generic Secrets", "Stripe", "Other"]


@query(f"""WITH c AS (SELECT c_custkey AS id, unnest(range(c_custkey % 7)) AS i, c_custkey AS k FROM customer), s AS (SELECT id, i, [{in_list(_KINDS)}][(k + i * i) % 5 + 1] AS g, (k // 7 + i * 5) % 6 AS d FROM c),
w AS (SELECT *, CAST([{", ".join(map(str, fixed.DISTANCE_WEIGHTS))}][d + 1] AS DOUBLE) AS w, CASE WHEN g IN ('Misc', 'Other') THEN CAST(0.7 AS DOUBLE) ELSE 1 END AS v FROM s),
t AS (SELECT id, least(1.0, sum(w * v) / sum(w) + least(0.2, (count(DISTINCT g) - 1) * 0.05) + CASE WHEN min(d) = 0 THEN 0.1 ELSE 0.0 END) AS score FROM w GROUP BY id),
f AS (SELECT id, string_agg(g, ',' ORDER BY d, i) AS groups FROM (SELECT id, g, min(d) AS d, min(i) AS i FROM s GROUP BY id, g) GROUP BY id)
SELECT c_custkey AS id, round(coalesce(CAST(score AS DOUBLE), 0.0), 6) AS l3_score, coalesce(groups, '') AS groups FROM customer LEFT JOIN t ON t.id = c_custkey LEFT JOIN f ON f.id = c_custkey""")
def l3_l3b_made_signals(spark, sf_dir):
    """The context score and the groups, over signals of every distance."""
    k = F.col("c_custkey")
    at = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: i < k % 7)
    distance = lambda i: ((F.floor(k / 7) + i * 5) % 6).cast("int")
    signals = F.transform(at, lambda i: F.struct(i.alias("ord"), F.lit("x").alias("identifier"), F.get(F.lit(_KINDS), ((k + i * i) % 5).cast("int")).alias("group"), distance(i).alias("distance"), F.get(F.lit(fixed.DISTANCE_WEIGHTS), distance(i)).alias("weight")))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), signals.alias("signals"))
    return rows.select("id", F.round(layers.context_score(F.col("signals")), 6).alias("l3_score"), F.array_join(layers.matched_groups(F.col("signals")), ",").alias("groups"))


@query(f"""WITH {_HISTORY}, f AS (SELECT *, {_RANK} AS rank, event_id % 100 + 1 AS line FROM hs WHERE severity IS NOT NULL)
SELECT file_name AS file_uri, sha256(string_agg('  [' || upper(severity) || '] line ' || line || ': ' || coalesce(rule_id, 'unknown'), chr(10) ORDER BY rank DESC, line, severity, rule_id)) AS text_sha256 FROM f GROUP BY file_name""")
def a12_by_file(spark, sf_dir):
    """Each file's findings as a text, worst first."""
    found = history(spark, sf_dir).where("severity is not null").select(F.col("file_name").alias("file_uri"), "severity", (F.col("event_id") % 100).cast("int").alias("line_no"), "rule_id")
    return report.by_file(found).select("file_uri", F.sha2("text", 256).alias("text_sha256"))


@query(f"""WITH {_lines(_PAGES)}, n AS (SELECT file_uri, line_no, list_concat(ls[greatest(1, line_no - 4):line_no], ls[line_no + 2:line_no + 6]) AS s FROM l)
SELECT file_uri, line_no, sha256(array_to_string(s[greatest(1, len(s) // 2):len(s) // 2 + 1], chr(10))) AS adjacent_sha256 FROM n""")
def w2_adjacent(spark, sf_dir):
    """The two lines about the middle of a line's neighbours."""
    out = lines.split_lines(S.pages(spark, sf_dir))
    return out.select("file_uri", "line_no", F.sha2(F.array_join(lines.adjacent(F.col("surrounding")), "\n"), 256).alias("adjacent_sha256"))


@query(f"""WITH i AS (SELECT DISTINCT p_type || '-Access_' || p_brand || CASE p_partkey % 3 WHEN 0 THEN '--file' WHEN 1 THEN ' ' || p_name ELSE '' END AS rule_id FROM part),
w AS (SELECT rule_id, list_filter(string_split_regex(lower(rule_id), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ({in_list(fixed.COMMON_PARTS)})) AS w FROM i)
SELECT rule_id, array_to_string(list_sort(list_distinct(list_filter(CASE WHEN len(w) > 1 THEN list_concat(w, [array_to_string(w, '-'), array_to_string(w, '')]) ELSE w END, lambda x: length(x) > 1))), ',') AS keywords FROM w""")
def p27_derived_keywords(spark, sf_dir):
    """Keywords for rules that list none, from ids made of the parts."""
    k = F.col("p_partkey") % 3
    ids = F.concat("p_type", F.lit("-Access_"), "p_brand", F.when(k == 0, "--file").when(k == 1, F.concat(F.lit(" "), "p_name")).otherwise(""))
    return table(spark, sf_dir, "part").select(ids.alias("rule_id")).distinct().select("rule_id", F.array_join(R.derived_keywords(F.col("rule_id")), ",").alias("keywords"))


@query("""WITH c AS (SELECT c_custkey AS id, c_custkey % 6 AS kind, CAST(c_acctbal AS VARCHAR) AS v FROM customer)
SELECT id, CASE kind WHEN 1 THEN v || ' ' || v ELSE v END AS value, CAST(CASE kind WHEN 1 THEN 12 ELSE 4 END AS INTEGER) AS start_pos FROM c WHERE kind < 4""")
def p5_made_env_values(spark, sf_dir):
    """Unquoted values: blanks and a comment around them go, lines that are no assignment have none."""
    k, v = F.col("c_custkey"), F.col("c_acctbal").cast("string")
    forms = {0: ("KEY=", ""), 1: ("  key.name= ", "\t"), 2: ("K = ", "  # note"), 3: ("K-1=", " #= x")}
    line = F.concat(F.lit("9K="), v)
    for kind, (head, tail) in forms.items():
        line = F.when(k % 6 == kind, F.concat(F.lit(head), v, F.concat(F.lit(" "), v) if kind == 1 else F.lit(""), F.lit(tail))).otherwise(line)
    line = F.when(k % 6 == 5, "K =   ").otherwise(line)
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.inline(literals.env_value(line))).select("id", "value", "start_pos")


_NAMES = f"""pn AS (SELECT DISTINCT replace(lower(p_name), ' ', '_') AS snake, string_split(lower(p_name), ' ') AS w FROM part),
nm AS (SELECT snake, upper(snake) AS up, w[1] || array_to_string({_TITLE.format('w[2:]')}, '') AS camel, array_to_string({_TITLE.format('w')}, '') AS pascal, replace(snake, '_', '-') AS dash, replace(snake, '_', '') AS flat FROM pn)"""


def _part_names(spark, sf_dir):
    """The parts' names as identifiers, each in the spellings that code uses."""
    words = F.split(F.lower("p_name"), " ")
    pascal = F.array_join(F.transform(words, lambda w: F.initcap(w)), "")
    own = table(spark, sf_dir, "part").select(F.array_join(words, "_").alias("snake"), pascal.alias("pascal")).distinct()
    return own.select("snake", "pascal", F.concat(F.lower(F.substring("pascal", 1, 1)), F.substring("pascal", F.lit(2), F.length("pascal"))).alias("camel"), F.upper("snake").alias("up"))


@query(f"""WITH {_NAMES}, d AS (SELECT replace(lower(p_name), ' ', '_') AS snake, min(p_brand) AS grp FROM part GROUP BY 1), n AS (SELECT snake, unnest([snake, up, camel, 'get' || pascal, 'set' || pascal, 'is' || pascal]) AS name FROM nm)
SELECT DISTINCT name, grp AS "group", snake AS matched_variant FROM n JOIN d USING (snake)""")
def j3_part_names(spark, sf_dir):
    """Names in several spellings, found through their forms in a dictionary that lists one; others are not found."""
    own = _part_names(spark, sf_dir)
    listed = table(spark, sf_dir, "part").groupBy(F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")).alias("keyword")).agg(F.min("p_brand").alias("group"))
    names = F.array("snake", "up", "camel", *[F.concat(F.lit(p), "pascal") for p in ("get", "set", "is", "xx")], F.replace("snake", F.lit("_"), F.lit("-")))
    return I.resolve(own.select(F.explode(names).alias("name")), listed)


@query(f"""WITH {_NAMES} SELECT snake AS name, array_to_string([snake, up, camel, pascal, dash], ',') AS variants, array_to_string([snake, up, camel, pascal, dash, flat, upper(flat)], ',') AS listed FROM nm
UNION ALL SELECT camel, array_to_string([camel, flat, upper(flat), snake, up, dash], ','), array_to_string([camel, snake, up, pascal, dash, flat, upper(flat)], ',') FROM nm""")
def p16_p17_part_variants(spark, sf_dir):
    """Spellings of snake_case and camelCase names, for lookups and for a dictionary's builder."""
    own = _part_names(spark, sf_dir).select(F.explode(F.array("snake", "camel")).alias("name"))
    return own.select("name", F.array_join(text.case_variants(F.col("name")), ",").alias("variants"), F.array_join(I.builder_variants(F.col("name")), ",").alias("listed"))


@query(f"""WITH {_NAMES}, l AS (SELECT unnest([camel, pascal, snake, up, snake]) AS name FROM nm) SELECT name, count(*) AS n FROM l GROUP BY name""")
def p6_made_identifiers(spark, sf_dir):
    """Names in lines of code: not those in literals and comments, not keywords and single letters."""
    line = lambda form: F.format_string(form, "camel", "pascal", "snake", "up")
    code = F.array(line("const %1$s = %2$s(\"lit %3$s\", 'x%4$s'); // %1$s"), line("if (%3$s > a) return %4$s /* %1$s */ # %2$s"), line("`%1$s` + %3$s - 12"))
    lines_ = _part_names(spark, sf_dir).select(F.explode(code).alias("line"))
    return lines_.select(F.explode(literals.identifiers(F.col("line"))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT c_custkey AS id, c_name AS v, sha256(c_name)[1:c_custkey % 6 + 5] AS h, repeat(' ', c_custkey % 4) AS pad FROM customer), l AS (SELECT id, v AS value, length(pad) + 3 AS s, '"' AS quote FROM c
UNION ALL SELECT id, v, length(pad) + 3 + length(v) + 4, '"' FROM c UNION ALL SELECT id, h, length(pad) + 3 + 2 * length(v) + 8, chr(39) FROM c UNION ALL SELECT id, 'b' || v, length(pad) + 3 + 2 * length(v) + length(h) + 12, '`' FROM c)
SELECT id, value, CAST(s AS INTEGER) AS start_pos, CAST(s + length(value) AS INTEGER) AS end_pos, quote FROM l WHERE length(value) >= 8""")
def p3_made_literals(spark, sf_dir):
    """Literals of three kinds with positions; one occurs twice, short ones are left out."""
    k, v = F.col("c_custkey"), F.col("c_name")
    h = F.substring(F.sha2(v, 256), F.lit(1), (k % 6 + 5).cast("int"))
    line = F.concat(F.repeat(F.lit(" "), (k % 4).cast("int")), F.lit('f("'), v, F.lit('", "'), v, F.lit("\", '"), h, F.lit("', `b"), v, F.lit("`)"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.inline(literals.literals(line))).select("id", "value", "start_pos", "end_pos", "quote")


@query(f"""WITH {_ENV_FILES} SELECT '/env/' || f AS file_uri, count(*) AS n_keys, sha256(string_agg(key || '=' || v, chr(10) ORDER BY i)) AS pairs_sha256 FROM own WHERE live GROUP BY f""")
def k7_env_keys(spark, sf_dir):
    """Keys and values of env files, one for every nation's customers."""
    i = F.col("c_custkey")
    nl = F.when(F.col("c_nationkey") % 2 == 0, "\r\n").otherwise("\n")
    line = F.concat(F.when(i % 10 == 4, "# ").otherwise(""), F.lit("C"), (i % 800).cast("string"), F.lit("="), F.col("c_acctbal").cast("string"), nl)
    files = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").groupBy(F.concat(F.lit("/env/"), F.col("c_nationkey").cast("string")).alias("file_uri")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("x")))), lambda r: r["x"]), "").alias("text"))
    pairs = remediate.parse_env(F.col("text"))
    return files.select("file_uri", F.size(pairs).cast("long").alias("n_keys"), F.sha2(F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), "\n"), 256).alias("pairs_sha256"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: what became of every file's lines and candidates."""
    return Scanner.default(spark).funnel(_all_files(spark, sf_dir))
