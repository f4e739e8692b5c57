"""Every registered query that SQL can express, against DuckDB; the others for their shape."""

import pytest

from strandwise.plans.oracle import ORACLE_SQL
from strandwise.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE_SQL)))
def test_against_sql(name, spark, sf_dir, duck, same):
    same(QUERIES[name](spark, sf_dir), duck.execute(ORACLE_SQL[name]).df())


def test_all_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 9
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
