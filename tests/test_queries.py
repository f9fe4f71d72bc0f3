"""Every registered query against its DuckDB check on the smallest tables."""

import pytest
from checking import compare, connect

from rasterweave.plans import load

FOLDER = "/root/testdata/sf0.001"
QUERIES = load()


@pytest.fixture(scope="module")
def duck():
    with connect(FOLDER) as con:
        yield con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    query = QUERIES[name]
    if query.check:
        assert compare(query, spark, FOLDER, duck) is None
    else:
        assert query(spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
