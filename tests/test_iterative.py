"""Iterative confirmation: what travels with a frame, and where its rows are cut."""

import pytest

from sekvant import staging
from sekvant.operators import screening
from sekvant.plans import queries
from tests.compare import DATA


@pytest.fixture
def conf(spark):
    """Settings that are put back after the test."""
    before = {}

    def put(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield put
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_no_neighbours_travel_with_a_frame(spark):
    plan = queries()["iterative_confirm"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "MapInPandas":
        plan = plan.children().apply(0)
    # A frame comes as rows of one candidate or hit each, not with lists that grow with its hits and their neighbours.
    assert "array" not in plan.children().apply(0).schema().catalogString()


def _confirmed(spark):
    models = [f"m{i}" for i in range(8)]
    cand = spark.createDataFrame([(f"f{k}", models[(k * j + j) % 8], float(40 - j)) for k in range(20) for j in range(1, 5)], "target_name string, parent string, score double")
    hits = spark.createDataFrame([(f"f{k}", m, float(10 + (k * i) % 7), 10.0 ** -(k * i % 13)) for k in range(20) for i, m in enumerate(models) if (k + i) % 3 for _ in range(2)], "target_name string, query_name string, dom_score double, i_evalue double")
    edges = spark.createDataFrame([(a, b, float(i * j % 5)) for i, a in enumerate(models) for j, b in enumerate(models) if i != j], "query string, target string, score double")
    fam = spark.createDataFrame([(m, "XY"[i % 2]) for i, m in enumerate(models)], "parent string, family string")
    frames = spark.createDataFrame([(f"f{k}",) for k in range(22)] + [(None,)], "target_name string")
    return sorted(map(repr, map(tuple, screening.confirm_iteratively(frames, cand, hits, edges, fam).collect())))


def test_blocks_and_batches_change_nothing(spark, conf):
    want = _confirmed(spark)
    assert len(want) > 40 and sum("unresolved" in x for x in want) == 3
    for blocks, batch in ((1, 1), (1, 3), (7, 2), (50, 10_000)):
        conf("spark.sql.shuffle.partitions", str(blocks))
        conf("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        assert _confirmed(spark) == want


def test_stages_take_one_pass_and_stage_nothing(spark):
    before = len(staging._written)
    df = queries()["iterative_stages"](spark, f"{DATA}/sf0.001")
    assert len(staging._written) == before
    # Hits meet what their frame tried in one join, not once a stage.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_stage_of_every_hit(spark):
    confirmed = spark.createDataFrame([("a", "x", "resolved"), ("b", "x", "active"), ("b", "y", "active"), ("c", None, "unresolved")], "target_name string, query_name string, status string")
    hits = spark.createDataFrame([(i, t, q) for i, (t, q) in enumerate([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("b", "z"), ("c", "x"), ("c", None), ("d", "x")])], "id int, target_name string, query_name string")
    got = screening.iterative_stages(confirmed, hits).select("id", "stage").collect()
    assert sorted(map(tuple, got)) == [(0, "confirmed"), (2, "confirmed"), (3, "confirmed"), (4, "fallback"), (5, "fallback"), (6, "fallback")]
