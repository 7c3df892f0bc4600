"""Every query of the library against its SQL, and stability where there is none."""

import pytest

from lectern.plans.registry import ORACLES, QUERIES
from oracle import check, rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    check(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_twice_alike(spark, sf_dir, name):
    a, b = (rows(QUERIES[name](spark, sf_dir).toPandas()) for _ in range(2))
    assert a == b


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
