import random

from sekvant.operators.overlap import class_summary, resolve_overlaps, summary_lines
from sekvant.plans import oracles, queries
from tests.compare import same

SCHEMA = "chrom string, type string, f_start int, f_end int, score double, gid string, i int"


def brute(features, limit=20.0):
    """The sweep over one list at a time, on plain tuples."""
    kept = []
    for key in sorted({f[:2] for f in features}):
        group = sorted((f for f in features if f[:2] == key), key=lambda f: (f[2], f[3], -f[4], f[5]))
        last, gone = None, set()
        for f in group:
            if last is None:
                last = f
                continue
            shared = max(0, min(f[3], last[3]) - max(f[2], last[2]))
            if f == last:
                gone.add(f)
            elif 100.0 * shared / min(f[3] - f[2] + 1, last[3] - last[2] + 1) > limit:
                if f[4] > last[4]:
                    gone.add(last)
                    last = f
                else:
                    gone.add(f)
            else:
                last = f
        kept += [f for f in group if f not in gone]
    return sorted(kept)


def test_like_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        a = rng.randint(1, 60_000 if i % 2 else 140_000)
        rows.append((rng.choice(["c1", "c2"]), rng.choice(["CDS", "SINE"]), a, a + rng.randint(0, 900), rng.choice([0.5, 1.0, 1.5]), f"g{i}", 1))
    # One place with a third of all rows, and exact copies.
    rows += [("hot", "CDS", a := rng.randint(1, 3_000), a + rng.randint(5, 60), round(rng.random(), 3), f"h{i}", 1) for i in range(200)]
    rows += rows[:5]
    got = sorted(tuple(r) for r in resolve_overlaps(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows)


def test_defined_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert resolve_overlaps(empty).count() == 0 and class_summary(empty.withColumnRenamed("gid", "classification")).count() == 0
    df = spark.createDataFrame([("c", "t", None, 5, 1.0, "a", 1), ("c", "t", 9, 3, None, None, 1), ("c", "t", 100, 200, 1.0, "b", 1), ("c", "t", 200, 300, 1.0, "c", 1)], SCHEMA)
    assert [(r["f_start"], r["f_end"]) for r in resolve_overlaps(df).orderBy("f_start").collect()] == [(3, 9), (100, 200), (200, 300)]


def test_summary_of_ragged_paths(spark):
    df = spark.createDataFrame([("LTR/Copia/Ale", 1, 10), ("LTR/Copia/Ale", 1, 20), ("LTR/Gypsy", 1, 5), ("SINE", 1, 3), ("odd", 1, 1), (None, 1, 9)], "classification string, f_start int, f_end int")
    got = {r["path"]: (r["number"], r["total_length"], r["mean_length"], r["place"]) for r in class_summary(df).collect()}
    assert got == {"LTR": (3, 35, 11.7, 1), "LTR/Copia": (2, 30, 15.0, 1), "LTR/Copia/Ale": (2, 30, 15.0, 1), "LTR/Gypsy": (1, 5, 5.0, 1), "SINE": (1, 3, 3.0, 6), "odd": (1, 1, 1.0, 13), "Total": (5, 39, 7.8, 12)}


def test_halfway_means(spark):
    # Means of 2.25 and 2.75, and of -2.25 where ends are exchanged.
    rows = [("LTR", 1, n) for n in (1, 2, 3, 3)] + [("SINE", 1, n) for n in (2, 3, 3, 3)] + [("odd", 3, n) for n in (0, 0, 0, -1)]
    sums = class_summary(spark.createDataFrame(rows, "classification string, f_start int, f_end int"))
    got = {r["path"]: r["mean_length"] for r in sums.collect()}
    assert (got["LTR"], got["SINE"], got["odd"]) == (2.3, 2.8, -2.3)
    lines = {r["path"]: r["line"].split("\t")[-1] for r in summary_lines(sums)[1].collect()}
    assert (lines["LTR"], lines["SINE"], lines["odd"]) == ("2.2", "2.8", "-2.2")


def test_summaries_with_halfway_means_like_sql(spark):
    # At this size LTR/Eryora has 12 features of 5835 in all, a mean of 486.25.
    for name in ("genome_summary", "genome_summary_lines"):
        same(spark, queries()[name], oracles()[name], "sf0.01")
