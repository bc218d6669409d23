"""Nulls in every column and extra columns with clashing names: no failure, same as SQL where there is some."""

from pathlib import Path

import duckdb
import pytest

from sekvant.llm.plans import ORACLES, QUERIES
from tests.compare import rows
from tests.empty import dirty

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return dirty(tmp_path_factory.mktemp("dirty"))


@pytest.mark.parametrize("name", NAMES)
def test_dirty(spark, folder, name):
    df = QUERIES[name](spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES and name != "p1_found":
        con = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        cur = con.execute(ORACLES[name])
        assert got == rows([x[0] for x in cur.description], cur.fetchall())
