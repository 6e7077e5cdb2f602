"""Spellings of very long names are whole."""

from pyspark.sql import functions as F

from leakscan.functions import text
from leakscan.operators import identifiers as I


def test_spellings_of_long_names(spark):
    many = "_".join(["ab"] * 1500)
    row = spark.createDataFrame([(many,)], "v string").select(I.builder_variants(F.col("v")).alias("x")).first()
    assert "ab" + "Ab" * 1499 in row.x and "Ab" * 1500 in row.x
    n = 1_000_100
    long = spark.createDataFrame([("x_" + "a" * n,)], "v string")
    v = F.col("v")
    r = long.select(
        F.transform(I.builder_variants(v), F.length).alias("listed"), F.length(text.camel(v)).alias("camel"), F.transform(text.case_variants(v), F.length).alias("variants"),
        F.array_max(F.transform(I.lookup_forms(F.concat(F.lit("getX"), v)), F.length)).alias("most"), F.exists(I.lookup_forms(F.concat(F.lit("getX"), v)), lambda x: x == F.concat(F.lit("X"), v)).alias("rest"),
    ).first()
    assert min(r.listed) == n + 1 and r.camel == n + 1 and min(r.variants) == n + 1 and r.rest
