"""Every core query against its SQL, on the smallest tables."""

import pytest

from sekvant.plans import oracles, queries
from tests.compare import DATA, same


@pytest.mark.parametrize("name", sorted(oracles()))
def test_same_as_sql(spark, name):
    same(spark, queries()[name], oracles()[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracles())))
def test_runs_without_sql(spark, name):
    df = queries()[name](spark, f"{DATA}/sf0.001")
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
