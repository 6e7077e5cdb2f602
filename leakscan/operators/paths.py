"""What a path says about its file: name, extension, language, risk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscan.functions import fixed
from leakscan.functions.dialect import glob_regex


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """With its dot, in lower case; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    ext = extension(path)
    out = F.lit("plaintext")
    for k, v in fixed.LANGUAGES.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def _found(glob: str) -> str:
    """A glob's pattern where it is only searched for: .* at its ends would try every end from every place and changes nothing."""
    return glob_regex(glob).removeprefix("(?i)").removeprefix(".*").removesuffix(".*")


def risk(path: Column, extra_globs: tuple[str, ...] = (), defaults: bool = True) -> Column:
    """EXCLUDED, HIGH, ELEVATED, REDUCED or NORMAL, the first that applies."""
    own = F.replace(path, F.lit("\\"), F.lit("/"))
    ext, name = extension(own), F.lower(base_name(own))
    globs = [*(fixed.EXCLUDED_GLOBS if defaults else []), *extra_globs]
    excluded = own.rlike("(?i)" + "|".join(f"(?:{_found(g)})" for g in globs)) if globs else F.lit(False)
    folders = own.rlike(f"(?i)/(?:{'|'.join(fixed.REDUCED_FOLDERS)})/")
    suffixes = name.rlike("(?:" + "|".join(s.replace(".", r"\.") for s in fixed.REDUCED_SUFFIXES) + ")\\z")
    return (
        F.when(ext.isin(fixed.BINARY_EXTENSIONS) | excluded, "EXCLUDED")
        .when(name.isin(fixed.HIGH_NAMES) | name.startswith(fixed.HIGH_PREFIX), "HIGH")
        .when(name.isin(fixed.ELEVATED_NAMES), "ELEVATED")
        .when(folders | ext.isin(fixed.REDUCED_EXTENSIONS) | suffixes, "REDUCED")
        .otherwise("NORMAL")
    )


def risk_factor(level: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, (_, factor) in fixed.RISKS.items():
        out = F.when(level == k, factor).otherwise(out)
    return out
