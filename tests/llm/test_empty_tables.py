"""Queries over tables without rows: no failure, and no rows beyond totals."""

import pytest

from sekvant.llm.plans import QUERIES
from tests.empty import tables


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("empty"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, folder, name):
    assert QUERIES[name](spark, folder).count() == (name == "p8_check")
