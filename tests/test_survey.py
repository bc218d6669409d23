"""Queries that must use every database, on tables of a few rows."""

from sekvant.plans import queries
from tests.compare import DATA, views

CLASSIFICATIONS = "cls_id long, seq_id string, database string, te_order string, superfamily string, clade string, loaded_at int"
BLAST = "hit_id long, qseqid string, sseqid string, pident double, qcovs double, length int, bitscore double, classified_by string"


def test_inheritance_takes_every_database(spark, tmp_path):
    calls = [(1, "a", "axdb", "LTR", "Corvia", "x", 1), (2, "p", "plantrep", "TIR", "Hadrix", "y", 1), (3, "done", "tirscan", "TIR", "Mutavo", "z", 1)]
    # q1 has a subject that plantrep alone calls; the element done is called, without any hit in legacy_hits.
    blast = [(1, "q1", "p", 90.0, 90.0, 100, 50.0, ""), (2, "q1", "a", 90.0, 90.0, 100, 40.0, ""), (3, "done", "a", 90.0, 90.0, 100, 50.0, "")]
    spark.createDataFrame(calls, CLASSIFICATIONS).write.parquet(f"{tmp_path}/classifications.parquet")
    spark.createDataFrame(blast, BLAST).write.parquet(f"{tmp_path}/blast_hits.parquet")
    for name in ("harmonization", "legacy_hits"):
        spark.read.parquet(f"{DATA}/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    got = queries()["pass2_inherit_all"](spark, str(tmp_path)).select("id", "order", "superfamily", "source").collect()
    assert [tuple(r) for r in got] == [("q1", "TIR", "Hadrix", "p")]


def test_annotation_takes_the_prefix_database(spark):
    d = f"{DATA}/sf0.001"
    usable = """target_name IS NOT NULL AND query_name IS NOT NULL AND dom_score IS NOT NULL AND env_from IS NOT NULL AND env_to IS NOT NULL AND query_len > 0 AND target_len IS NOT NULL
      AND 100.0::DOUBLE * (hmm_to - hmm_from + 1) / query_len >= 20 AND evalue <= 1e-3 AND acc >= 0.5 AND dom_score / query_len >= 0.1"""
    want = views("sf0.001").execute(f"SELECT query_name, count(*) FROM legacy_hits WHERE database = 'gyrodb' AND {usable} GROUP BY 1").fetchall()
    every = queries()["genome_features_all"](spark, d)
    more = every.exceptAll(queries()["genome_features"](spark, d)).selectExpr("substring_index(gid, '|', -1) AS model").groupBy("model").count().collect()
    assert want and sorted(map(tuple, more)) == sorted(want)
    lines = queries()["genome_annotation"](spark, d).select("gid", "line").collect()
    names = {model for model, _ in want}
    found = [r for r in lines if r["gid"].split("|")[-1] in names]
    assert found and all("\tCDS\t" in r["line"] for r in found)


def test_reconciling_takes_the_constant_database(spark):
    d = f"{DATA}/sf0.001"
    sines = {r["id"] for r in queries()["classify_constant"](spark, d).collect()}
    got = {r["id"]: r["n_calls"] for r in queries()["reconcile_classified_all"](spark, d).collect()}
    called = {r["id"] for name in ("classify_score_vote", "classify_prefix") for r in queries()[name](spark, d).collect()}
    assert sines and set(got) == sines | called and max(got.values()) == 3
