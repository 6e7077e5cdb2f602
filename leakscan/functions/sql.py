"""The scan's functions for SQL texts, as functions of the session that Spark inlines: no worker, no registration of code."""

from __future__ import annotations

from pyspark.sql import SparkSession

from leakscan.functions import fixed

_SEVERITY = "CASE " + " ".join(f"WHEN score >= {least} THEN '{name}'" for name, _, least in fixed.SEVERITIES) + " END"
_RANK = "CASE severity " + " ".join(f"WHEN '{name}' THEN {rank}" for name, rank, _ in fixed.SEVERITIES) + " END"

#: name(parameters) -> what it returns: scalars in terms of their parameters, tables as a query.
SCALARS = {
    # each is worked out once a string, outside the lambda over its characters
    "utf16_length(s STRING) RETURNS INT": r"CASE WHEN octet_length(s) < length(s) + 3 THEN length(s) ELSE length(s) + length(regexp_replace(s, '[^\\x{10000}-\\x{10FFFF}]+', '')) END",
    "shannon_entropy(s STRING) RETURNS DOUBLE": """CASE WHEN length(s) = 0 THEN 0D ELSE transform(array(CAST(utf16_length(s) AS DOUBLE)), n -> aggregate(
        transform(array_distinct(filter(split(s, ''), c -> c <> '')), c -> CAST(length(s) - length(replace(s, c, '')) AS DOUBLE) / n), 0D, (a, p) -> a - p * log2(p)))[0] END""",
    "severity_of(score DOUBLE) RETURNS STRING": _SEVERITY,
    "severity_rank(severity STRING) RETURNS INT": _RANK,
    "env_segment(s STRING) RETURNS STRING": r"regexp_replace(regexp_replace(upper(s), '[^A-Z0-9]+', '_'), '^_+|_+\\z', '')",
    "masked(s STRING) RETURNS STRING": "concat(substring(s, 1, 4), '****')",
}
TABLES = {
    "lines_of(content STRING) RETURNS TABLE(line_no INT, line STRING)": r"SELECT pos, col FROM posexplode(split(content, '\n'))",
    "words_of(content STRING) RETURNS TABLE(word_no INT, word STRING)": r"SELECT pos, col FROM posexplode(regexp_extract_all(content, '[^\\x20\\x09-\\x0D]+', 0))",
}


def register(spark: SparkSession) -> list[str]:
    """Creates (or replaces) the functions in the session and returns their names. A null argument gives null, or no rows."""
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for head, body in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in (*SCALARS, *TABLES)]
