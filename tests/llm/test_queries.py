"""The package's queries against their SQL, and all of them over the smallest tables."""

import pytest

from sekvant.llm.plans import ORACLES, QUERIES
from tests.compare import DATA, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_only_the_entry_point_imports_the_package():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for p in (root / "sekvant").rglob("*.py"):
        if "llm" not in p.parts:
            assert "sekvant.llm" not in p.read_text()
