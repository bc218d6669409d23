import random
from collections import Counter

import numpy as np
import pytest

from sekvant.llm.consensus import annotations, consensus, learn

GROUPS = {"A": ["a1", "a2", "a3"], "B": ["b1", "b2"], "C": ["c1", "c2", "c3", "c4"], "D": ["d1", "d2"]}
SCHEMA = "item long, annotator string, grp string, part string, label int, v0 string"


def world(n=4000, seed=2):
    """Six annotators of known accuracy; the last copies the fifth more often than not."""
    rng = random.Random(seed)
    right, parts = [0.97, 0.93, 0.9, 0.8, 0.72, 0.7], [0.95, 0.9, 0.85, 0.7, 0.6, 0.6]
    truth, votes = {}, []
    for item in range(n):
        g = rng.choice("ABCD")
        p = rng.choice(GROUPS[g])
        truth[item] = (g, p)
        said = {}
        for k in range(6):
            if rng.random() > 0.7:
                continue
            if k == 5 and 4 in said and rng.random() < 0.7:
                said[5] = said[4]
                continue
            vg = g if rng.random() < right[k] else rng.choice([x for x in "ABCD" if x != g])
            vp = (p if rng.random() < parts[k] else rng.choice([x for x in GROUPS[g] if x != p])) if vg == g else rng.choice(GROUPS[vg])
            said[k] = (vg, None if rng.random() < 0.08 else vp)
        votes += [(item, f"w{k}", *v, 1, "x") for k, v in said.items()]
    return truth, votes, right


@pytest.fixture(scope="module")
def solved(spark):
    truth, votes, right = world()
    a = annotations(spark.createDataFrame(votes, SCHEMA))
    return truth, votes, right, learn(a), {r["item"]: r for r in consensus(a, learn(a)).collect()}


def test_accuracies_and_copier(solved):
    _, _, right, model, _ = solved
    assert np.abs(model.group_accuracy[:5] - right[:5]).max() < 0.04
    assert [{model.annotators[b], model.annotators[a]} for b, a, _ in model.copies] == [{"w4", "w5"}]
    assert abs(model.copies[0][2] - 0.7) < 0.2


def test_better_than_majority(solved):
    truth, votes, _, _, got = solved
    by = {}
    for item, _, g, p, *_ in votes:
        by.setdefault(item, []).append((g, p))
    assert set(got) == set(by)
    mine = sum((r["grp"], r["part"]) == truth[i] for i, r in got.items())
    majority = sum(Counter(v).most_common(1)[0][0] == truth[i] for i, v in by.items())
    assert mine > majority + 0.04 * len(by) and mine / len(by) > 0.88


def test_agreement_and_contradiction(solved):
    _, votes, _, _, got = solved
    by = {}
    for item, _, g, p, *_ in votes:
        by.setdefault(item, []).append((g, p))
    for item, vs in by.items():
        pairs = [(x, y) for i, x in enumerate(vs) for y in vs[:i]]
        r = got[item]
        assert r["n_votes"] == len(vs)
        assert r["contradicts"] == any(x[0] != y[0] or (x[1] and y[1] and x[1] != y[1]) for x, y in pairs)
        assert (r["agreement"] is None) if not pairs else abs(r["agreement"] - sum(x[0] == y[0] for x, y in pairs) / len(pairs)) < 1e-9


def test_defined_cases(spark):
    def run(rows):
        a = annotations(spark.createDataFrame(rows, "item string, annotator string, grp string, part string"))
        return {r["item"]: (r["grp"], r["part"]) for r in consensus(a, learn(a)).collect()}

    assert run([]) == {}
    assert run([(None, "x", "A", None), ("i", None, "A", None), ("i", "x", None, None)]) == {}
    assert run([("i", "x", "A", None), ("j", "x", "B", "b")]) == {"i": ("A", None), "j": ("B", "b")}
    # A group alone yields to a part of the same group.
    assert run([("i", "x", "A", None), ("i", "y", "A", "a"), ("j", "y", "A", "a")])["i"] == ("A", "a")
