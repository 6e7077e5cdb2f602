"""Runs a query's SQL in DuckDB over the same tables and compares rows, whatever their order."""

import os
from pathlib import Path

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir=DATA):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(r)) for r in rows)


def compare(df, sql, sf_dir=DATA):
    names = sorted(df.columns)
    got = plain(df.select(*names).collect())
    rel = connect(sf_dir).sql(sql)
    assert sorted(rel.columns) == names
    want = plain(rel.select(*[f'"{n}"' for n in names]).fetchall())
    if got != want:
        g, w = set(got), set(want)
        raise AssertionError(f"{len(got)} rows, SQL has {len(want)}; only here: {sorted(g - w)[:4]}; only there: {sorted(w - g)[:4]}")
