"""Every query with SQL gives the rows that DuckDB gives."""

import os

import pytest

import __spark_entry__ as entry
from chronoloom import queries as core
from chronoloom import series_queries as series
from tests.conftest import DATA
from tests.oracle import assert_same

SQL = series.ORACLE_SQL | core.ORACLE_SQL
DIRECTORY = f"{DATA}/sf0.001"
#: In the smallest tables too many faulty readings break the relation for it to be verified.
LARGER = {"p5_by_rule": f"{DATA}/sf0.01"}


@pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert_same(spark, LARGER.get(name, DIRECTORY), (series.QUERIES | core.QUERIES)[name], SQL[name])


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
