"""Interval, keyword and consistency joins against brute force, env files in place, rule files by shape."""

import random
import time

from pyspark.sql import functions as F

from leakscan.functions import sql
from leakscan.operators import assets as A
from leakscan.operators import intervals as I
from leakscan.operators import keywords as K
from leakscan.operators import remediate as M
from leakscan.operators import rules as R


def test_points_in_intervals(spark, monkeypatch):
    rng = random.Random(1)
    pts = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-50, 200)]), i) for i in range(400)] + [("a", 7, 1)] * 60
    spans = [(rng.choice(["a", "b", None]), lo := rng.randrange(-60, 200), lo + rng.choice([-1, 0, 1, 3, 7, 8, 9, 100, 1000, 2**62]), i) for i in range(150)] + [("a", None, 3, 500), ("a", -(2**63), 2**63 - 1, 501)]
    want = sorted((k, p, i, lo, hi, j) for k, p, i in pts if k and p is not None for k2, lo, hi, j in spans if k2 == k and lo is not None and lo <= p <= hi)
    points, own = spark.createDataFrame(pts, "k string, size long, n int").repartition(3), spark.createDataFrame(spans, "k string, lo long, bin long, j int")
    for hot in (1000, 40):  # with the second, bins of many points are split
        monkeypatch.setattr(I, "HOT", hot)
        got = I.locate(points, own, ["k"], "size", "lo", "bin")
        assert got.columns == ["k", "size", "n", "lo", "bin", "j"] and sorted(map(tuple, got.collect())) == want
    assert I.locate(points, own.limit(0), ["k"], "size", "lo", "bin").count() == 0 and I.locate(points.limit(0), own, ["k"], "size", "lo", "bin").count() == 0


def test_no_bin_is_wider_than_twice_its_interval(spark):
    """Long and short intervals on one key: candidate pairs stay near the results, where one width for all would not."""
    points = spark.range(20_000).select(F.lit("a").alias("k"), F.col("id").alias("pos"))
    spans = spark.createDataFrame([("a", i * 20, i * 20 + 1) for i in range(1000)] + [("a", 0, 19_999)], "k string, lo long, hi long")
    assert I.locate(points, spans, ["k"], "pos", "lo", "hi").count() == 2 * 1000 + 20_000


def test_keyword_layers():
    layers = R._layers(["ab", "abc", "abcd", "b", "bx", "q", "", "abc"])
    assert [sorted(x) for x in layers] == [["ab", "b", "q"], ["abc", "bx"], ["abcd"]] and R._layers([]) == []


def test_keyword_hits_equal_contains(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab_.+*\\[") for _ in range(rng.randrange(1, 5))) for _ in range(60)})
    texts = ["".join(rng.choice("ab_.+*\\[xAB\n") for _ in range(rng.randrange(0, 30))) for _ in range(120)] + [None, ""]
    df = spark.createDataFrame([(i, t, "z", "g") for i, t in enumerate(texts)], "id int, text string, keyword string, gram string").repartition(3)
    want = {(i, k) for i, t in enumerate(texts) if t for k in words if k in t.lower()}
    assert {(r.id, k) for r in df.select("id", R.keyword_hits(F.col("text"), words).alias("h")).collect() for k in r.h or []} == want
    listed = spark.createDataFrame([(w.upper(),) for w in [*words, *words]] + [(None,), ("",)], "keyword string")
    for rows in (K.BROADCAST_ROWS, 0):
        got = K.hits(df, listed, broadcast_rows=rows)
        assert got.columns == ["id", "gram", "keyword"] and sorted((r.id, r.keyword) for r in got.collect()) == sorted(want) and got.where("gram = 'g'").count() == len(want)
    assert K.hits(df, listed.limit(0)).count() == 0


def test_cost_does_not_grow_with_the_keywords(spark):
    """20,000 keywords cost about what 2,000 cost, in the row search and in the join; searching one by one costs ten times as much."""
    rng = random.Random(5)
    names = ["key_" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) + str(i) for i in range(20_000)]
    texts = spark.createDataFrame([(i, f"x = {names[i * 7 % 2000]} and {'some more text of a line ' * 3}{names[i * 3 % 2000]}") for i in range(4000)], "id int, text string").repartition(4).cache()
    texts.count()

    def seconds(run):
        run()
        began = time.perf_counter()
        n = run()
        return n, time.perf_counter() - began

    few = lambda n: texts.agg(F.sum(F.size(R.keyword_hits(F.col("text"), names[:n])))).first()[0]
    listed = {n: spark.createDataFrame([(k,) for k in names[:n]], "keyword string").cache() for n in (2_000, 20_000)}
    joined = lambda n: K.hits(texts, listed[n]).count()
    (a, small), (b, large) = seconds(lambda: few(2_000)), seconds(lambda: few(20_000))
    (c, small_join), (d, large_join) = seconds(lambda: joined(2_000)), seconds(lambda: joined(20_000))
    assert a == c and b == d and b >= a and large < 5 * small + 2 and large_join < 5 * small_join + 2
    texts.unpersist()


def test_rules_by_shape(spark):
    rows = ['{"id":"A","keywords":["x","Y"],"entropy":3}', '{"id":"B","entropy":"no","keywords":["y"],"allowlists":[{"regexes":["a"]},{"paths":[]},3]}', "bad", None, "[1]", "{}"]
    rules = A.parsed(spark.createDataFrame([(r,) for r in rows], "json string"), "json")
    assert sorted(map(tuple, A.field_usage(rules).collect())) == [("allowlists", 1, ["ARRAY"]), ("allowlists[].paths", 1, ["ARRAY"]), ("allowlists[].regexes", 1, ["ARRAY"]), ("entropy", 2, ["BIGINT", "STRING"]), ("id", 2, ["STRING"]), ("keywords", 2, ["ARRAY"])]
    assert sorted(map(tuple, A.shapes(rules).collect()), key=repr) == sorted([("allowlists,entropy,id,keywords", 1), ("entropy,id,keywords", 1), ("", 1), (None, 3)], key=repr)
    assert sorted(map(tuple, A.keyword_histogram(rules).collect())) == [(0, 4), (1, 1), (2, 1)]
    assert [tuple(r) for r in R.collisions(A.claimed(rules)).collect()] == [("y", 2, ["A", "B"])]
    assert A.field_usage(rules.limit(0)).count() == 0


def test_consistency_finds_planted_faults(spark, monkeypatch):
    monkeypatch.setattr(A, "BUCKET_ROWS", 50)
    index = [(f"k{i}", f"g{i % 7}") for i in range(1000)] + [(None, "g")]
    groups = [(k, "moved" if k == "k3" else g) for k, g in index if k != "k5"] + [("extra", "g1")]
    a, b = (spark.createDataFrame(x, "keyword string, group string").repartition(3) for x in (index, groups))
    bad = A.consistency(a, b)
    assert sorted(map(tuple, bad.where("keyword is not null").collect())) == [("extra", None, "g1"), ("k3", "g3", "moved"), ("k5", "g5", None)]
    assert A.consistency(a.where("keyword is not null"), a.where("keyword is not null")).count() == 0 and A.consistency(a.limit(0), a.limit(0)).count() == 0


def brute_env(text, edits, date):
    """One edit after another, as an editor makes them."""
    import re

    for _, key, value in edits:
        if not key or not re.fullmatch("[A-Z_][A-Z0-9_]*", key):
            continue
        found = re.search(f"(?:^|(?<=[\r\n])){key}=([^\r\n]*)", text)
        if found is None:
            text += ("\n" if text else "") + f"# Added on {date}\n{key}={value}\n"
        elif found[1] != value:
            at = found.start()
            text = text[:at] + f"{key}={value}" + text[found.end() :]
    return text


def test_env_text_equals_edits_one_by_one(spark):
    rng = random.Random(6)
    line = lambda: rng.choice(["", "# note", " A=1", "A=1", "B=two words", "C=", "D==x=", "A=other", "export E=1", "BAD-KEY=2", "É=1"])
    files = {f"/{i}": "".join(line() + rng.choice(["\n", "\r\n", "\r"]) for _ in range(rng.randrange(0, 8))) + rng.choice(["", "A=9", "Z=8"]) for i in range(60)} | {"/empty": "", "/same": "A=1\r\n"}
    edits = [(f, i, rng.choice(["A", "B", "C", "D", "F", "G_1", "bad", "1X"]), rng.choice(["1", "two words", "", "new", "$1"])) for i, f in enumerate(list(files) * 4) if rng.random() < 0.7 and f != "/same"]
    edits += [("/same", 900, "A", "1"), ("/made", 901, "A", "1"), ("/made", 902, "B", "2"), ("/null", 903, "A", "1"), ("/made", 904, None, "3"), (None, 905, "A", "1")]
    df = spark.createDataFrame([*files.items(), ("/null", None), (None, "A=1")], "file_uri string, text string").repartition(3)
    out = M.upsert_text(df, spark.createDataFrame(edits, "file_uri string, ord int, key string, value string").repartition(3), F.lit("2024-05-06"))
    got = {r.file_uri: r for r in out.collect()}
    assert set(got) == {*files, "/made", "/null"}
    for uri, r in got.items():
        assert r.text == brute_env(files.get(uri, ""), [e[1:] for e in edits if e[0] == uri], "2024-05-06"), uri
    assert (got["/same"].unchanged, got["/same"].replaced, got["/same"].text) == (1, 0, "A=1\r\n") and (got["/made"].appended, got["/made"].rejected) == (2, 1)


def test_sql_functions(spark):
    assert "shannon_entropy" in sql.register(spark) and sql.register(spark)
    one = spark.sql(r"SELECT shannon_entropy('aab\U0001F600'), utf16_length('a\U0001F600'), severity_of(0.97D), severity_rank('high'), env_segment('--a b-'), masked('abcdefgh'), shannon_entropy(NULL), shannon_entropy('')").first()
    assert abs(one[0] - 1.4575424759) < 1e-9 and tuple(one[1:]) == (3, "critical", 4, "A_B", "abcd****", None, 0.0)
    d = spark.createDataFrame([(1, "a b\nc"), (2, None), (3, "")], "id int, t string")
    rows = spark.sql("SELECT id, l.line_no, w.word_no, w.word FROM {d} d, LATERAL lines_of(d.t) l, LATERAL words_of(l.line) w", d=d).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "c")]
