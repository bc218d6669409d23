import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sekvant.operators.heavy_keys import change_counts, numbered, usual_values


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [("hot", rng.choice([5, 5, 7, None])) for _ in range(700)] + [(rng.choice("abc"), rng.choice([1, 2])) for _ in range(200)] + [(None, 1)] * 20 + [("nulls", None)] * 3
    rng.shuffle(out)
    return out


def frame(spark, rows, parts=5):
    # Extra columns carry the operator's own names.
    return spark.createDataFrame([(k, v, 9, 9, "x") for k, v in rows], "key string, value int, k int, part int, chunk string").repartitionByRange(parts, "value") if parts == 0 else spark.sparkContext.parallelize([(k, v, 9, 9, "x") for k, v in rows], parts).toDF("key string, value int, k int, part int, chunk string")


@pytest.mark.parametrize("chunk_rows", [1, 7, 100, 10_000])
def test_usual_values(spark, rows, chunk_rows):
    got = {r["k"]: tuple(r)[1:] for r in usual_values(frame(spark, rows), "key", "value", chunk_rows=chunk_rows).collect()}
    for key in {k for k, _ in rows if k}:
        values = [v for k, v in rows if k == key]
        votes = Counter(v for v in values if v is not None)
        best = min(votes.items(), key=lambda x: (-x[1], x[0]), default=(None, 0))
        assert got.pop(key) == (len(values), *best, len(votes))
    assert not got


def test_numbers_are_exact_and_chunks_equal(spark, rows):
    df = numbered(frame(spark, rows), "key", "value", chunk_rows=64).where("k = 'hot'")
    assert sorted(r["row_no"] for r in df.collect()) == list(range(1, 701))
    assert sorted(r["count"] for r in df.groupBy("chunk").count().collect()) == sorted([64] * 10 + [60])


@pytest.mark.parametrize("chunk_rows", [1, 3, 50])
def test_changes_across_chunks(spark, rows, chunk_rows):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "key string, value int, n int").repartition(5)
    got = {r["k"]: (r["n_rows"], r["n_changes"]) for r in change_counts(df, "key", "value", order=["n"], chunk_rows=chunk_rows).collect()}
    for key in {k for k, _ in rows if k}:
        values = [v for k, v in rows if k == key]
        assert got[key] == (len(values), sum(x != y for x, y in zip(values, values[1:])))


def test_empty(spark):
    assert usual_values(frame(spark, []), "key", "value").count() == 0
    assert change_counts(frame(spark, [(None, 1)]), "key", "value", order=["part"]).count() == 0


def test_ties_take_the_smaller(spark):
    df = frame(spark, [("a", 9), ("a", 2), ("a", 9), ("a", 2), ("a", None), ("a", None), ("a", None)])
    r = usual_values(df, F.col("key"), F.col("value")).first()
    assert (r["usual"], r["n_usual"], r["n_rows"], r["n_values"]) == (2, 2, 7, 2)
