"""The identifier dictionary: building it, and looking names up through spelling variants."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakscan.functions.text import camel, slug, snake
from leakscan.operators.rules import keyword_pattern

#: Stands in where no dictionary is given.
SEED = {
    "Generic Secrets": "api_key password token secret auth_token access_token secret_key client_secret jwt_secret passwd".split(),
    "OpenAI": ["openai_api_key"],
    "Anthropic": ["anthropic_api_key"],
    "AWS": ["aws_access_key_id", "aws_secret_access_key", "aws_session_token"],
    "Azure": ["azure_storage_key", "azure_client_secret"],
    "Google Cloud Platform": ["google_api_key", "gcp_api_key"],
    "GitHub": ["github_token"],
    "GitLab": ["gitlab_token"],
    "Stripe": ["stripe_secret_key"],
    "Certificates": ["private_key"],
    "Databases": ["db_password", "database_url"],
    "Key & Token Abbreviations": ["tkn", "pwd"],
}
#: A dictionary this large is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: So many names are also looked for in lines before names are cut out of them.
FEW_ROWS = 30_000


def words(keyword: Column) -> Column:
    """A keyword's lower-case words: cut at other characters than letters and digits, and at capitals."""
    cut = F.regexp_replace(F.regexp_replace(keyword, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(cut, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")


def builder_variants(keyword: Column) -> Column:
    """Spellings under which a keyword is listed, itself first."""
    w = words(keyword)
    title = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))
    pascal = F.array_join(F.transform(w, title), "")
    own_camel = F.concat(F.get(w, 0), F.array_join(F.transform(F.slice(w, F.lit(2), F.size(w)), title), ""))
    low = F.array_join(w, "_")
    all_ = F.array(keyword, low, F.upper(low), own_camel, pascal, F.array_join(w, "-"), F.array_join(w, ""), F.upper(F.array_join(w, "")))
    return F.when(F.size(w) > 0, F.array_distinct(all_)).otherwise(F.array(keyword))


def build(fragments: DataFrame) -> DataFrame:
    """(keyword, group, source) from fragments (group, group_ord, keyword, keyword_ord, source): every spelling goes to the first that claims it.

    Rows that repeat a keyword claim the same spellings, so the first of them stands for all before they are spelled out. What is
    sorted follows the number of distinct keywords and groups, not of rows.
    """
    own = fragments.groupBy("keyword", "group", "group_ord", "source").agg(F.min("keyword_ord").alias("keyword_ord"))  # by hash, unsorted
    order = F.struct("group_ord", "keyword_ord")
    own = own.groupBy("keyword").agg(F.min_by(F.struct("group", "source", "group_ord", "keyword_ord"), order).alias("f")).select("keyword", "f.*")
    rows = own.select("group", "group_ord", "keyword_ord", "source", F.posexplode(builder_variants(F.col("keyword"))).alias("variant_ord", "name"))
    first = Window.partitionBy("name").orderBy("group_ord", "keyword_ord", "variant_ord")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select(F.col("name").alias("keyword"), "group", "source")


def load(spark: SparkSession, path: str) -> DataFrame:
    """(keyword, group, source) of group files {name, keywords}; a keyword listed twice keeps the group first by name."""
    rows = spark.read.schema("name string, keywords array<string>").option("multiLine", True).json(path).select(F.col("name").alias("group"), F.explode("keywords").alias("keyword"))
    return rows.groupBy("keyword").agg(F.min("group").alias("group")).select("keyword", "group", F.lit("file").alias("source"))


def seed(spark: SparkSession) -> DataFrame:
    rows = [(g, i, k, j, "seed") for i, (g, ks) in enumerate(SEED.items()) for j, k in enumerate(ks)]
    return build(spark.createDataFrame(rows, "group string, group_ord int, keyword string, keyword_ord int, source string"))


def file_name(group: Column) -> Column:
    return F.concat(slug(group), F.lit(".json"))


def lookup_forms(name: Column) -> Column:
    """What is looked up, in order of preference: the name's spellings, then those without get, set or is."""

    def forms(x):
        own = snake(x)
        more = F.when(x.contains("_"), F.array(camel(x))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(x, F.lower(x), F.upper(x), own, F.upper(own)), more, F.array(F.replace(own, F.lit("_"), F.lit("-"))))

    out = [forms(name)]
    for prefix in ("get", "set", "is"):
        rest = F.substring(name, F.lit(len(prefix) + 1), F.length(name))
        ok = F.lower(name).startswith(prefix) & rest.rlike("^[A-Z].")
        out.append(F.when(ok, forms(rest)).otherwise(F.array().cast("array<string>")))
    return F.concat(*out)


def plain_keywords(keywords: list[str]) -> list[str]:
    """The keywords that a name can equal, without case, underscores and dashes. The forms of a name differ from it, or from what
    follows its get, set or is, in these only, so a name that `resolve` finds holds one of them. Of long ones the beginning will do."""
    return sorted({re.sub("[_-]", "", k.lower())[:64] for k in keywords if k and re.fullmatch("[A-Za-z0-9_$-]+", k)})


def may_name(code: Column, plain: list[str] | None) -> Column:
    """Whether a text, or a name, may hold a name that `resolve` finds among the `plain` keywords; None stands for any keywords."""
    return F.lit(True) if plain is None or "" in plain else code.rlike("(?i)" + keyword_pattern(plain, "_*+"))


def resolve(names: DataFrame, dictionary: DataFrame, broadcast: bool = True) -> DataFrame:
    """(name, group, matched_variant) of the names (column name) that the dictionary knows, by the first form that hits."""
    rows = names.select("name").distinct().select("name", F.posexplode(lookup_forms(F.col("name"))).alias("rank", "form"))
    dim = dictionary.select(F.col("keyword").alias("form"), "group")
    hit = rows.join(F.broadcast(dim) if broadcast else dim, "form")
    return hit.groupBy("name").agg(F.min_by(F.struct("group", F.col("form").alias("matched_variant")), "rank").alias("x")).select("name", "x.*")
