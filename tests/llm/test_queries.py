import os

import pytest

from leadloom.llm import queries

from ..compare import connection, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    expected, columns = duck_rows(con, queries.ORACLE[name])
    assert sorted(df.columns) == columns
    assert spark_rows(df) == expected
