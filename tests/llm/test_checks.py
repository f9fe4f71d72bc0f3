"""The queries that SQL can express, against DuckDB on two folders."""

import pytest
from checking import connect, duck_table, spark_table

from rasterweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(name, folder, spark):
    with connect(folder) as con:
        expected = duck_table(con, queries.CHECKS[name])
    assert spark_table(queries.QUERIES[name](spark, folder)) == expected
    assert expected[1]
