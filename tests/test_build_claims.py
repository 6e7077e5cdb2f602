"""Rows that repeat a keyword are reduced before their spellings are listed and sorted."""

from leakscan.operators import identifiers as I

SCHEMA = "group string, group_ord int, keyword string, keyword_ord long, source string"


def test_repeated_keywords_are_reduced_first(spark):
    rows = [(f"g{i % 3}", i % 3, f"my_key{i % 4}", 100 - i, "s") for i in range(60)] + [("g0", 0, "my-key1", 999, "s"), ("g9", 9, "MY_KEY7", 1, "s")]
    out = I.build(spark.createDataFrame(rows, SCHEMA).repartition(3))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Generate") < plan.index("Aggregate")
    got = {r.keyword: r.group for r in out.collect()}
    assert got["my_key1"] == got["MY_KEY1"] == got["my-key1"] == "g0" and got["MY_KEY7"] == got["myKey7"] == "g9"
    assert len(got) == out.count()
