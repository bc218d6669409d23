"""A data directory whose tables have the real columns and no rows."""

from pathlib import Path

import pyarrow.parquet as pq

from tests.compare import DATA


def tables(folder) -> str:
    for p in Path(DATA, "sf0.001").glob("*.parquet"):
        pq.write_table(pq.read_table(p).slice(0, 0), Path(folder, p.name))
    return str(folder)


def dirty(folder) -> str:
    """The smallest tables with a sixth of all values null and with columns of clashing names."""
    import random

    import pyarrow as pa

    rng = random.Random(1)
    clashes = ("k", "v", "n", "i", "item", "label", "chunk", "part", "pos", "val", "row_id", "score_", "g0", "s", "c", "skeleton", "marks", "size", "kind", "size_", "w", "cuts", "votes", "container")
    for p in Path(DATA, "sf0.001").glob("*.parquet"):
        t = pq.read_table(p)
        cols = {}
        for name in t.column_names:
            values = t[name].to_pylist()
            cols[name] = pa.array([None if rng.random() < 1 / 6 else x for x in values], type=t.schema.field(name).type)
        for name in clashes:
            if name not in cols:
                cols[name] = pa.array(["clash"] * t.num_rows)
        pq.write_table(pa.table(cols), Path(folder, p.name))
    return str(folder)
