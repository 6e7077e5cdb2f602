"""What rule files and dictionaries are made of: fields, shapes, keywords, and where two copies of an index disagree.

Rules come as JSON, a text a row, and needn't agree in shape: they are read as VARIANT, so a field that only some
rows have, or that has another type in some, is found without a schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of an index that are digested together, about.
BUCKET_ROWS = 1000


def parsed(rows: DataFrame, json: str) -> DataFrame:
    """One column, rule, of VARIANT; a text that is no JSON, or none at all, is null."""
    return rows.select(F.try_parse_json(F.col(json)).alias("rule"))


def field_usage(rules: DataFrame) -> DataFrame:
    """(field, n_rules, types) of `parsed` rules: every top-level field, how many rules have it, and its types, sorted.

    Fields of objects in an array field come as field[].name, with the number of such objects that have it.
    """
    spark = rules.sparkSession
    top = rules.lateralJoin(spark.tvf.variant_explode(F.col("rule").outer())).where("key is not null").select("key", "value")
    # one level down: objects listed in a field
    listed = top.where(F.schema_of_variant("value").startswith("ARRAY")).select(F.col("key").alias("of"), F.col("value").alias("list"))
    each = listed.lateralJoin(spark.tvf.variant_explode(F.col("list").outer())).select("of", F.col("value").alias("item")).where(F.schema_of_variant("item").startswith("OBJECT"))
    inner = each.lateralJoin(spark.tvf.variant_explode(F.col("item").outer())).where("key is not null").select(F.concat("of", F.lit("[]."), "key").alias("key"), "value")
    kinds = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    both = top.unionByName(inner).select(F.col("key").alias("field"), kinds.alias("type"))
    return both.groupBy("field").agg(F.count(F.lit(1)).alias("n_rules"), F.array_sort(F.collect_set("type")).alias("types"))


def shapes(rules: DataFrame) -> DataFrame:
    """(fields, n_rules): which fields occur together, sorted and comma-joined, and in how many rules; null for what is no object."""
    schema = F.schema_of_variant("rule")
    names = F.when(schema.startswith("OBJECT"), F.array_join(F.array_sort(F.json_object_keys(F.to_json("rule"))), ","))
    return rules.select(names.alias("fields")).groupBy("fields").agg(F.count(F.lit(1)).alias("n_rules"))


def _keywords(rule: Column) -> Column:
    return F.coalesce(F.try_variant_get(rule, "$.keywords", "array<string>"), F.array().cast("array<string>"))


def keyword_histogram(rules: DataFrame) -> DataFrame:
    """(n_keywords, n_rules): how many rules list so many keywords; a rule without a list has none."""
    return rules.select(F.size(_keywords(F.col("rule"))).alias("n_keywords")).groupBy("n_keywords").agg(F.count(F.lit(1)).alias("n_rules"))


def claimed(rules: DataFrame) -> DataFrame:
    """(keyword, rule_id) of `parsed` rules, lower-cased: what `rules.collisions` reads."""
    return rules.select(F.explode(_keywords(F.col("rule"))).alias("keyword"), F.try_variant_get("rule", "$.id", "string").alias("rule_id")).select(F.lower("keyword").alias("keyword"), "rule_id")


# --- two copies of an index ---------------------------------------------------------------------


def _digests(index: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n, digest) of (keyword, group): a sum of hashes, so the order of rows does not matter."""
    h = F.xxhash64("keyword", "group").cast("decimal(38,0)")
    return index.groupBy(_bucket(buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("digest"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("keyword"), F.lit(buckets))


def consistency(index: DataFrame, groups: DataFrame) -> DataFrame:
    """(keyword, in_index, in_groups) where an index and the groups it was built from, both (keyword, group), disagree.

    Both are digested in buckets by keyword first; only rows of unequal buckets are joined, so equal copies cost two
    aggregations and no join of rows. A keyword that one side lists several times has a row for each pair that differs.
    """
    a, b = index.select("keyword", "group"), groups.select("keyword", "group")
    buckets = max(1, -(-a.count() // BUCKET_ROWS))
    x, y = _digests(a, buckets), _digests(b, buckets).withColumnsRenamed({"n": "n2", "digest": "digest2"})
    bad = x.join(y, "bucket", "full_outer").where(~(F.col("n").eqNullSafe(F.col("n2")) & F.col("digest").eqNullSafe(F.col("digest2")))).select("bucket")

    def suspects(side: DataFrame, name: str) -> DataFrame:
        return side.withColumn("bucket", _bucket(buckets)).join(bad, "bucket", "left_semi").select("keyword", F.col("group").alias(name))

    both = suspects(a, "in_index").join(suspects(b, "in_groups"), "keyword", "full_outer")
    return both.where(~F.col("in_index").eqNullSafe(F.col("in_groups")))
