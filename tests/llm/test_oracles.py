"""The queries that SQL can express, held against DuckDB on the smallest tables."""

import pytest

from termloom.llm import queries
from tests.llm.conftest import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, oracle, name):
    same(queries.queries()[name](spark, SF), *oracle(queries.oracle_sql()[name], SF))
