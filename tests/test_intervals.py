import random

import pytest

from sekvant.operators.intervals import merged, stretches

SCHEMA = "k string, a int, b int, kind string, chunk int"


def brute(rows):
    out, by = [], {}
    for k, a, b in rows:
        if None not in (k, a, b):
            by.setdefault(k, []).append((min(a, b), max(a, b)))
    for k, spans in by.items():
        joined = []
        for a, b in sorted(spans):
            if joined and a <= joined[-1][1] + 1:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        out += [(k, "covered", a, b) for a, b in joined]
        out += [(k, "gap", x[1] + 1, y[0] - 1) for x, y in zip(joined, joined[1:])]
    return sorted(out)


def run(spark, rows, bits=16):
    # The extra columns clash with the operator's own.
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in stretches(df, "k", "a", "b", chunk_bits=bits).collect())


@pytest.mark.parametrize("bits", [2, 4, 16])
def test_like_brute_force(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice("ABC"), x := rng.randint(-60, 400), x + rng.randint(-6, 12)) for _ in range(120)]
    # One key with a third of all rows, all on few positions.
    rows += [("H", 5, 9)] * 40 + [("H", 10, 11), ("H", 13, 13)] + rows[:10]
    assert run(spark, rows, bits) == brute(rows)


def test_defined_cases(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, 2), ("A", None, 2), ("A", 1, None)]) == []
    assert run(spark, [("A", 7, 3), ("A", 8, 8), ("A", 8, 8)]) == [("A", "covered", 3, 8)]
    assert run(spark, [("A", 2147483647, 2147483647), ("A", -5, 0)]) == [("A", "covered", -5, 0), ("A", "covered", 2147483647, 2147483647), ("A", "gap", 1, 2147483646)]


def test_merged(spark):
    df = spark.createDataFrame([("A", 1, 4), ("A", 3, 9), ("A", 20, 30)], "k string, a int, b int")
    assert sorted(map(tuple, merged(df, "k", "a", "b").collect())) == [("A", 1, 9), ("A", 20, 30)]
