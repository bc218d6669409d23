"""Amino acids of hits, cut without their frames."""

from pyspark.sql import functions as F

from sekvant.plans import oracles, queries
from sekvant.sources import engines
from tests.compare import DATA, rows, views


def _evaluated_below(plan):
    """Text of the plans whose rows wait for Python."""
    if plan.nodeName() == "ArrowEvalPython":
        yield plan.toString()
    children = plan.children()
    for i in range(children.size()):
        yield from _evaluated_below(children.apply(i))


def test_no_frame_waits_for_python(spark):
    df = queries()["hit_sequences"](spark, f"{DATA}/sf0.001")
    waiting = list(_evaluated_below(df._jdf.queryExecution().optimizedPlan()))
    assert waiting and not any("repeat(" in x for x in waiting)


def test_pieces_are_cut_as_in_sql(spark, tmp_path):
    some = spark.read.parquet(f"{DATA}/sf0.001/legacy_hits.parquet").where("base_seq IS NOT NULL AND query_name IS NOT NULL AND domain_type IS NOT NULL AND dom_score > 0 AND query_len > 0 AND i_evalue IS NOT NULL AND hmm_from IS NOT NULL").limit(1)
    # Starts and ends before, at and behind both ends of the 64 letters and of the frame.
    places = [(a, b, n) for n in (1, 63, 64, 65, 150) for a in (-200, -64, -3, 0, 1, 2, 63, 64, 65, 128, 149, 150, 151) for b in (-3, 0, 1, 63, 64, 65, 129, 150, 400) if a <= b]
    hits = some.drop("id", "target_name", "env_from", "env_to", "target_len").crossJoin(spark.createDataFrame([(i, f"f{i}|fwd1", *x) for i, x in enumerate(places)], "id long, target_name string, env_from int, env_to int, target_len int"))
    hits.write.parquet(f"{tmp_path}/legacy_hits.parquet")
    spark.read.parquet(f"{DATA}/sf0.001/sequences.parquet").write.parquet(f"{tmp_path}/sequences.parquet")
    df = queries()["hit_sequences"](spark, str(tmp_path))
    cur = views(str(tmp_path)).execute(oracles()["hit_sequences"])
    want = rows([x[0] for x in cur.description], cur.fetchall())
    assert len(want) == len(places) and rows(df.columns, df.collect()) == want


def test_whole_frames_give_the_same(spark):
    d = f"{DATA}/sf0.001"
    from sekvant.plans import survey

    whole = engines.hit_records(survey._hits(spark, d), survey._frames(spark, d), survey._lengths(spark, d))
    cut = queries()["hit_sequences"](spark, d).where(F.length("seq") >= 0)
    assert rows(whole.columns, whole.collect()) == rows(cut.columns, cut.collect())
