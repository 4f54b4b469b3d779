import pytest
from sphaera.llm import queries

from tests.compare import connection, differences


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_as_the_sql(spark, sf_dir, name):
    assert differences(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], connection(sf_dir)) == ""
