import random

import pytest
from pyspark.sql import functions as F

from sekvant.llm.top_n import code_score, score_code, top_n

SCHEMA = "grp string, kind string, score double, id long, hi string, g0 int, n int"


def run(spark, rows, n=3, **kw):
    # The extra columns carry the operator's own names.
    df = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], SCHEMA)
    return sorted((r["g0"], r["g1"], r["score"], r["row_id"]) for r in top_n(df, [F.col("grp"), F.col("kind")], F.col("score"), F.col("id"), n, **kw).collect())


def brute(rows, n=3):
    groups = {}
    for g, k, s, i in set(rows):
        if None not in (g, k, s, i) and s == s:
            groups.setdefault((g, k), set()).add((s + 0.0, i))
    return sorted((*g, s, i) for g, x in groups.items() for s, i in sorted(x, key=lambda y: (-y[0], y[1]))[:n])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [("hot", "a", rng.choice([1.5, 2.0, 2.5, -3.0, rng.random() * 100]), i) for i in range(500)]
    out += [(rng.choice("xyz"), rng.choice("ab"), round(rng.gauss(0, 3), 1), 1000 + i) for i in range(400)]
    out += [("tied", "a", 7.25, 5000 - i) for i in range(60)] + [("few", "a", 1.0, 1), ("few", "b", float("inf"), 2), ("few", "b", float("-inf"), 3)]
    out += [("zero", "a", z, i) for i, z in enumerate([0.0, -0.0, 0.0, -0.0, 0.0, 5e-324, -5e-324])]
    out += [("ids", "a", 1.0, i) for i in (2**63 - 1, -(2**63), -1, 0, 7)]
    out += [(None, "a", 9.0, 1), ("x", None, 9.0, 1), ("x", "a", None, 1), ("x", "a", float("nan"), 1), ("x", "a", 99.0, None)] + out[:30]
    return out


@pytest.mark.parametrize("n,kw", [(3, {}), (1, {"bits": 2}), (3, {"broadcast_bytes": 0, "bits": 3})])
def test_like_brute_force(spark, rows, n, kw):
    assert run(spark, rows, n, **kw) == brute(rows, n)


def test_empty_and_small(spark):
    assert run(spark, []) == []
    assert run(spark, [("a", "b", 1.0, 1)] * 4) == [("a", "b", 1.0, 1)]


def test_code_sorts_as_the_score(spark):
    values = sorted([0.0, 1.0, -1.0, 1e308, -1e308, 5e-324, -5e-324, float("inf"), float("-inf"), 22.9, 23.0])
    df = spark.createDataFrame([(v,) for v in values], "s double")
    got = df.select("s", score_code(F.col("s")).alias("c")).withColumn("back", code_score(F.col("c"))).orderBy("c").collect()
    assert [r["s"] for r in got] == values and all(r["s"] == r["back"] for r in got)
