import pytest

from leakscan.queries import QUERIES, SQL, entry
from tests.oracle import DATA, compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(QUERIES[name](spark, DATA), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    rows = entry(spark, DATA)
    assert rows.count() > 0 and rows.columns[0] == "file_uri"
