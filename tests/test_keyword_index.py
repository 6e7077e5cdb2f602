"""The index of a table of keywords: rare grams, and no broadcast of a large one."""

from pyspark.sql import functions as F

from leakscan.operators import keywords as K


def test_grams_stay_rare_and_a_large_index_is_not_broadcast(spark):
    listed = spark.range(100_000, 105_000).select(F.concat(F.lit("Old bolt "), "id").alias("keyword"))
    assert K.index(listed).groupBy("gram").count().agg(F.max("count")).first()[0] == 1
    texts = listed.select(F.concat(F.lit("order 17: "), "keyword", F.lit(" x3")).alias("text"))
    out = K.hits(texts, listed, broadcast_rows=0)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.groupBy("keyword").count().where("count = 1").count() == 5_000


def test_keywords_of_all_lengths_and_alphabets(spark):
    words = ["a", "é", "ключ", "ключи", "straße", "x" * 40, "x" * 33 + "y", "日本", "😀😀", "ab", "abcdefgh", "bcdefghi", "a b c d e f g h i"]
    texts = ["", None, "a", "É", "Ключи ключ", "x" * 41 + "y", "日本語", "a😀😀😀", "zabcdefghi", "A B C D E F G H I", "abcdefg h", "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    listed = spark.createDataFrame([(w,) for w in words], "keyword string")
    want = sorted((i, w) for i, t in enumerate(texts) for w in words if t is not None and w in t.lower())
    for rows in (0, 100):
        assert sorted(map(tuple, K.hits(df, listed, broadcast_rows=rows).collect())) == want
