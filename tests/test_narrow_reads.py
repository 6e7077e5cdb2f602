"""The read pass keeps the lines that a keyword or a dictionary name may make candidates, and loses none of those."""

from pyspark.sql import functions as F

from leakscan.operators import identifiers as I
from leakscan.operators import layers as Y
from leakscan.operators import lines as L
from leakscan.operators import rules as R
from leakscan.plans.scan import Scanner

TEXTS = {
    "plain": 'colour = "abcdefgh12"', "keyword": 'myToken = "abcdefgh12"', "kelvin": '\u212aey: "abcdefgh12"', "dotted": 'ey İ = "abcdefgh12"', "beside": 'colour = "abcdefgh12"\na token',
    "name": 'tkn = "abcdefgh12"', "spread": 'T_K__N = "abcdefgh12"', "getter": 'getPwd("abcdefgh12")', "joined": 'p"x"w/* y */d("abcdefgh12")', "no value": "token", "empty": "", "none": None,
}


def test_lines_that_nothing_tells_stay_behind(spark):
    s = Scanner.default(spark)
    files = spark.createDataFrame([(k, v) for k, v in TEXTS.items()], "file_uri string, content string")
    kept = {r.file_uri for r in s.read(files).where(F.size("lines") > 0).collect()}
    assert kept == {"keyword", "kelvin", "dotted", "beside", "name", "spread", "getter", "joined"}
    every = Scanner(s.ruleset, s.dictionary, s.config)  # looks every name up
    names = lambda one: sorted((r.file_uri, r.value, tuple(r.db2_hits), r.signals) for r in one.candidates(files).collect())
    assert names(s) == names(every) and {r[0] for r in names(s)} == kept - {"dotted", "spread"}


def test_no_known_name_is_left_out(spark):
    names = ["apiKey", "API_KEY", "a_p_i_Key", "getApiKey", "isPwd", "setpwd", "_api_key_", "api$key", "colour", "ap", "__"]
    for listed in (["api-key", "pwd"], ["api$key"], ["__"], ["x" * 3000, "apikey"], ["äpi"]):
        df = spark.createDataFrame([(n,) for n in names], "name string")
        known = {r.name for r in I.resolve(df, spark.createDataFrame([(k, "g") for k in listed], "keyword string, group string")).collect()}
        assert known <= {r.name for r in df.where(I.may_name(F.col("name"), I.plain_keywords(listed))).collect()}


def test_texts_may_hold_what_their_lower_case_holds(spark):
    df = spark.createDataFrame([(t,) for t in ("KEY", "KEY", "İd", "k", "Äkey", "Ä")], "t string")
    for words in (["key"], ["id", "x"], ["ä"]):
        assert df.where(F.lower("t").rlike(R.keyword_pattern(words)) & ~R.may_hold(F.col("t"), words)).count() == 0


def test_places_are_left_after_a_look(spark):
    """Whatever the number of words, most places are left by the classes of their first characters; what is found stays the same."""
    assert R.keyword_pattern(["key", "token"]).startswith("(?=[kt][eo][ky])") and R.keyword_pattern(["ab", "token"]).startswith("(?=[at][bo])")
    assert R.keyword_pattern(["pwd", "tkn"], "_*+").startswith("(?=[pt]_*+[kw]_*+[dn])")
    odd = ["^a-", "]b", "-c]", "\\d", "a&&b", "[x", " #", "~\t", "\U0001f511k", "ä.", "k"]
    texts = [*odd, *["x" + w + "y" for w in odd], *[w[:1] for w in odd], *[w[1:] for w in odd], "&", "a&b", "-", "^", "]", "ab", "\U0001f511"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for words in (odd, odd[:-1], odd[:3], odd[4:9], ["]b", "^a-"]):
        got = {r.t: r.hit for r in df.select("t", F.col("t").rlike(R.keyword_pattern(words)).alias("hit")).collect()}
        assert got == {t: any(w in t for w in words) for t in texts}, words


def test_lines_are_counted_in_bytes(spark):
    """A file that is no UTF-8 has as many lines as it is cut into."""
    raw = [b"a\xc3\nb", b"\xc3\n", b"\xe2\x82\n\n", b"", b"\n", "ä\n€\n".encode()]
    df = spark.createDataFrame([(bytearray(b),) for b in raw], "b binary").select(F.col("b").cast("string").alias("content"))
    assert all(r.n_lines == len(r.lines) for r in L.with_lines(df).collect()) and L.with_lines(df).agg(F.sum("n_lines")).first()[0] == sum(b.count(b"\n") + 1 for b in raw)


def test_a_line_has_its_type_worked_out_once(spark):
    own = Y.file_score(F.col("line"), F.col("in_comment"), F.col("risk"))
    df = spark.createDataFrame([('x = "a"', False, "NORMAL"), ("// x", False, "HIGH"), ("import x", True, None)], "line string, in_comment boolean, risk string").select(*[c.alias(k) for k, c in own.items()])
    assert [tuple(r[k] for k in ("line_type", "in_comment")) for r in df.collect()] == [("ASSIGNMENT", False), ("COMMENT", True), ("IMPORT", True)]
    assert len({str(own[k]).split("[")[0] for k in ("line_type", "in_comment", "l5_score")}) == 1
