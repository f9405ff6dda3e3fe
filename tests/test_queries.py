"""Every query with SQL gives the same rows as DuckDB."""

import pytest
from conftest import as_rows

from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, oracle, name):
    assert as_rows(QUERIES[name](spark, FOLDER)) == as_rows(oracle(ORACLES[name], FOLDER))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
