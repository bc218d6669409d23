import random

import numpy as np
from pyspark.sql import functions as F

from sekvant.operators import models, screening


def slow_windows(s, size, overlap=0.0, least_mean=0.0, least_cover=0.0, most=None):
    """Greedy choice written out position by position."""
    if len(s) < size:
        return [(0, len(s), sum(s))]
    used, out = set(), []
    while most is None or len(out) < most:
        best = None
        for i in range(len(s) - size + 1):
            if len(used & set(range(i, i + size))) <= int(size * overlap):
                t = sum(s[i : i + size])
                if best is None or t > best[1] + 1e-9:
                    best = (i, t)
        if best is None or (best[1] / size < least_mean and len(used) / len(s) >= least_cover):
            break
        out.append((best[0], best[0] + size, best[1]))
        used |= set(range(best[0], best[0] + size))
    return sorted(out)


def test_greedy_windows():
    rng = random.Random(2)
    for _ in range(60):
        s = [rng.randint(0, 9) for _ in range(rng.randint(3, 50))]
        kw = {"overlap": rng.choice([0.0, 0.3, 0.5]), "least_mean": rng.choice([0.0, 5.0]), "least_cover": rng.choice([0.0, 0.4])}
        got = models.greedy_windows(np.array(s, dtype=float), 6, **kw)
        assert [(a, b, round(t)) for a, b, t in got] == slow_windows(s, 6, **kw)


def test_decompose_tiers(spark):
    df = spark.createDataFrame([(m, p, float(p % 5)) for m, n in (("tiny", 10), ("small", 33), ("big", 130)) for p in range(1, n + 1)], "model string, pos int, score double")
    got = {}
    for r in models.decompose(df).collect():
        got.setdefault(r["model"], []).append((r["part_from"], r["part_to"]))
    assert got["tiny"] == [(0, 10)] and all(b - a == 32 for a, b in got["small"]) and all(b - a == 96 for a, b in got["big"])


def test_splice_and_scores(spark):
    m = spark.createDataFrame([("x", [[1.0], [2.0], [3.0]], [[0.0], [0.1], [0.2], [0.3]], [[9.0]] * 4)], "name string, match array<array<double>>, insert array<array<double>>, trans array<array<double>>")
    r = models.spliced(m, spark.createDataFrame([("x", 1, 3)], "model string, part_from int, part_to int")).first()
    assert (r["sub_name"], r["m"], r["match"]) == ("x__sub_1-3", 2, [[2.0], [3.0]])
    r = spark.range(1).select(models.log_odds(F.array(F.lit(0.5), F.lit(0.0)), F.array(F.lit(0.25), F.lit(0.25))).alias("l"), models.ungapped_score(F.array(*map(F.lit, (1.0, -3.0, 2.0, 2.0, -1.0, 2.0)))).alias("u")).first()
    assert r["l"] == [1.0, -100.0] and r["u"] == 5.0


def test_traversal_and_neighbours(spark):
    edges = spark.createDataFrame([("a", "b", 5.0), ("a", "c", 9.0), ("c", "d", 7.0), ("b", "d", 8.0), ("d", "a", 1.0), ("a", "a", 99.0)], "query string, target string, score double")
    for most in (1, 100):
        walk = lambda **kw: [m for m, _ in models.traversal(edges, "a", most_edges=most, **kw)]  # noqa: B023, E731
        assert walk() == ["a", "c", "d", "b"] and walk(breadth=1) == ["a", "c", "d"]
    assert models.neighbours(edges, 1).count() == 4 and models.neighbours(edges).count() == 5 and models.neighbours(edges, 0).count() == 5


def test_a_later_and_better_edge_counts(spark):
    edges = spark.createDataFrame([("a", "b", 5.0), ("a", "c", 9.0), ("a", "d", 7.0), ("c", "b", 100.0)], "query string, target string, score double")
    for most in (1, 100):
        assert [*models.traversal(edges, "a", most_edges=most)] == [("a", float("inf")), ("c", 9.0), ("b", 100.0), ("d", 7.0)]
    assert [*models.traversal(edges, "lone")] == [("lone", float("inf"))]


def test_graph_of_consensuses(spark):
    rng = random.Random(5)
    texts = {f"m{i}": "".join(rng.choice("ACGT") for _ in range(rng.randint(3, 12))) for i in range(9)} | {"odd": "AXG"}
    rows = [(n, "dna", t, [[0.85 if c == x else 0.05 for x in "ACGT"] for c in t]) for n, t in texts.items()] + [("none", "dna", None, None)]
    df = spark.createDataFrame(rows, "name string, alphabet string, consensus string, match array<array<double>>")
    want = {}
    for q, a in texts.items():
        for t, b in texts.items():
            one = lambda x, y: 0.0 if y not in "ACGT" else np.log2((0.85 if x == y else 0.05) * 4)
            best = max(sum(one(a[i + k] if a[i + k] in "ACGT" else "?", b[j + k]) for k in range(n)) for i in range(len(a)) for j in range(len(b)) for n in range(min(len(a) - i, len(b) - j) + 1))
            if best > 2.0:
                want[q, t] = best
    for block in (2, 256):
        got = {(r["query"], r["target"]): r["score"] for r in models.consensus_edges(df, block=block, least=2.0).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_size_outliers(spark):
    rng = random.Random(4)
    for n in (0, 3, 4, 5, 9, 40):
        sizes = [rng.randint(50, 90) for _ in range(n)] + ([900] if n > 4 else [])
        df = spark.createDataFrame([(f"m{i}", s) for i, s in enumerate(sizes)], "name string, m int")
        sq = sorted(s * s for s in sizes)
        h = len(sq) // 2
        q1, q3 = (np.median(sq[:h]), np.median(sq[len(sq) - h :])) if len(sq) > 3 else (0, float("inf"))
        want = sorted(s for s in sizes if len(sizes) > 3 and s * s > q3 + 2 * (q3 - q1))
        assert sorted(r["m"] for r in models.size_outliers(df).where("outlier").collect()) == want


def test_iterative_confirmation(spark):
    cand = spark.createDataFrame([("f", "a", 30.0), ("f", "b", 20.0), ("g", "a", 9.0), ("h", "a", 50.0), ("h", "b", 40.0)], "target_name string, parent string, score double")
    hits = spark.createDataFrame([("f", "a", 10.0, 1e-3), ("f", "c", 12.0, 1e-4), ("h", "a", 99.0, 1e-50)], "target_name string, query_name string, dom_score double, i_evalue double")
    edges = spark.createDataFrame([("a", "c", 3.0), ("a", "b", 2.0)], "query string, target string, score double")
    fam = spark.createDataFrame([(m, "X") for m in "abc"], "parent string, family string")
    frames = spark.createDataFrame([(x,) for x in "fghzz"], "target_name string")
    got = {}
    for r in screening.confirm_iteratively(frames, cand, hits, edges, fam).orderBy("round").collect():
        got.setdefault(r["target_name"], []).append((r["query_name"], r["confirmed"], r["status"]))
    # f tries a (confirmed, neighbours join), b, then c; g has no hit; h ends after a strong hit; z has no candidate.
    assert got["f"] == [("a", True, "resolved"), ("b", False, "resolved"), ("c", True, "resolved")]
    assert got["g"] == [("a", False, "resolved")] and got["h"] == [("a", True, "resolved")] and got["z"] == [(None, False, "unresolved")]


def test_unknown_models_get_their_family_from_the_name(spark):
    cand = spark.createDataFrame([("f", "RT_x", 30.0), ("f", "RT_y", 20.0)], "target_name string, parent string, score double")
    hits = spark.createDataFrame([("f", "RT_x", 10.0, 1e-30)], "target_name string, query_name string, dom_score double, i_evalue double")
    edges = spark.createDataFrame([("RT_x", "RT_y", 3.0)], "query string, target string, score double")
    fam = spark.createDataFrame([], "parent string, family string")
    rows = screening.confirm_iteratively(cand.select("target_name"), cand, hits, edges, fam).collect()
    # The strong hit ends the search in its family, to which the other model belongs by name.
    assert [(r["query_name"], r["status"]) for r in rows] == [("RT_x", "resolved")]
    staged = screening.iterative_stages(screening.confirm_iteratively(cand.select("target_name"), cand, hits, edges, fam), hits)
    assert [(r["query_name"], r["stage"]) for r in staged.collect()] == [("RT_x", "confirmed")]


def test_stages_of_the_two_step_search(spark):
    schema = "target_name string, query_name string, dom_score double, query_len int, i_evalue double"
    full = spark.createDataFrame([("f", "A1", 50.0, 90, 1e-20), ("f", "B1", 30.0, 90, 1e-9), ("n", "B1", 9.0, 90, 1e-4)], schema)
    screen = spark.createDataFrame([("f", "A1", 40.0, 96, 1.0), ("f", "A2", 20.0, 96, 1.0)], schema)
    fam = spark.createDataFrame([("A1", "A"), ("A2", "A"), ("B1", "B")], "parent string, family string")
    frames = spark.createDataFrame([("f",), ("n",)], "target_name string")
    ranked, hits = screening.facet_stages(frames, screening.best_submodel(screen), fam, full)
    assert sorted((r["model"], r["verified"], r["is_secondary"], r["full_score"]) for r in ranked.collect()) == [("A1", True, False, 50.0), ("A2", True, True, 0.0)]
    assert sorted((r["target_name"], r["query_name"], r["stage"]) for r in hits.collect()) == [("f", "A1", "verified"), ("f", "B1", "cross_family"), ("n", "B1", "fallback")]
