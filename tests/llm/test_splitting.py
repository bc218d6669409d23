import random

import pytest

from sekvant.llm.splitting import agglomerate, atoms, split_oversized

ITEMS = "name string, size long, pos_to int, cuts string"
GAPS = "name string, gap_from long, gap_to long, w int"


def run(spark, items, gaps, **kw):
    a = spark.createDataFrame([(*i, 1, "x") for i in items], ITEMS)
    b = spark.createDataFrame([(*g, 1) for g in gaps], GAPS)
    out = {}
    for r in split_oversized(a, b, **kw).orderBy("name", "piece").collect():
        out.setdefault(r["name"], []).append((r["piece"], r["pos_from"], r["pos_to"]))
    return out


def check(pieces, size, limit, overlap, gaps):
    assert [p for p, _, _ in pieces] == list(range(1, len(pieces) + 1))
    assert pieces[0][1] == 1 and pieces[-1][2] == size
    inside = lambda x: any(a <= x <= b for a, b in gaps)
    for _, a, b in pieces:
        assert 0 < b - a + 1 <= limit
    for (_, _, end), (_, start, _) in zip(pieces, pieces[1:]):
        assert start == end - overlap + 1
    for _, start, end in pieces[:-1]:
        if not inside(end):
            # Outside gaps only where no other gap than the one before lies in reach.
            x = start + overlap
            while start > 1 and inside(x):
                x += 1
            assert not any(map(inside, range(x, min(start + limit, size))))


@pytest.mark.parametrize("block_pieces", [2, 64])
def test_cover_limit_overlap_and_gaps(spark, block_pieces):
    rng = random.Random(9)
    items, gaps = [], []
    for i in range(25):
        size = rng.randint(101, 3000)
        items.append((f"s{i}", size))
        for _ in range(rng.choice([0, 1, 5, 40])):
            a = rng.randint(1, size)
            gaps.append((f"s{i}", a, a + rng.choice([0, 3, 20, 150])))
    gaps += gaps[:9] + [("s1", None, 5), (None, 1, 2), ("other", 4, 9)]
    items += [("small", 100), ("none", None), ("zero", 0), (None, 500)]
    got = run(spark, items, gaps, limit=100, overlap=10, block_pieces=block_pieces)
    assert set(got) == {f"s{i}" for i in range(25)}
    for name, size in items[:25]:
        check(got[name], size, 100, 10, [(a, b) for n, a, b in gaps if n == name and a is not None])


def test_empty(spark):
    assert run(spark, [], [], limit=10, overlap=2) == {}
    assert run(spark, [("a", 25)], [], limit=10, overlap=2) == {"a": [(1, 1, 10), (2, 9, 18), (3, 17, 25)]}
    with pytest.raises(ValueError):
        run(spark, [], [], limit=10, overlap=10)


def test_weakest_boundary_goes_first():
    # The boundary of strength 1 is merged over, the one of strength 9 stays.
    assert agglomerate(0, [(4, 9), (8, 1), (12, 0)], 9, 0) == [4, 12]
    assert agglomerate(0, [(4, 1), (8, 9), (12, 0)], 9, 0) == [8, 12]
    assert atoms(0, 25, [(5, 3)], 10, 2) == [(5, 3), (13, 0), (21, 0), (25, 0)]
