import random

import pytest

from sekvant.llm.splitting import agglomerate, atoms
from tests.llm.test_splitting import run


def whole(size, gaps, limit, overlap):
    """All cuts of an item merged at once, from gaps marked position by position."""
    free = sorted({x for a, b in gaps for x in range(max(min(a, b), 1), min(max(a, b), size) + 1)})
    spans = []
    for x in free:
        if spans and spans[-1][1] == x - 1:
            spans[-1][1] = x
        else:
            spans.append([x, x])
    cuts = {}
    for a, b in spans:
        at = {*range(a, b + 1, limit - overlap), b} if b - a > limit - overlap else {a, max((a + b) // 2, min(b, max(overlap, 1))), b}
        cuts |= {p: b - a + 1 for p in at if max(overlap, 1) <= p < size}
    ends = agglomerate(0, atoms(0, size, sorted(cuts.items()), limit, overlap), limit, overlap)
    return [(i + 1, ends[i - 1] - overlap + 1 if i else 1, e) for i, e in enumerate(ends)]


@pytest.mark.parametrize("block_pieces", [1, 3, 64])
def test_parts_change_nothing(spark, block_pieces):
    rng = random.Random(21)
    items, gaps = [], []
    for i in range(40):
        size = rng.randint(101, 4000)
        items.append((f"s{i}", size))
        for _ in range(rng.choice([0, 2, 10, 120])):
            a = rng.randint(1, size)
            gaps.append((f"s{i}", a, a + rng.choice([0, 1, 3, 20, 260])))
    got = run(spark, items, gaps, limit=100, overlap=10, block_pieces=block_pieces)
    for name, size in items:
        assert got[name] == whole(size, [g[1:] for g in gaps if g[0] == name], 100, 10), name
