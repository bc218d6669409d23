import sys

import pytest
from pyspark.sql import functions as F

from sekvant.sources import engines, writers

#: A stand-in for a search program: one domain line per record it reads.
PROGRAM = """
import sys
for x in sys.stdin.read().split('>')[1:]:
    name, seq = x.split('\\n')[:2]
    print('# comment')
    print(name, '-', len(seq), 'm', '-', 100, '1e-9 50 0 1 1 1e-9 2e-9 40 0 1 90', len(seq), 1, 1, len(seq), '0.9 d')
"""


def test_piped_search(spark):
    seqs = spark.createDataFrame([("a", "ACGT"), ("b", "AC"), (None, "A"), ("c", None)], "name string, seq string")
    for bases in (1, 1000):
        got = {r["target_name"]: (r["target_len"], r["dom_score"]) for r in engines.domain_search(seqs, [sys.executable, "-c", PROGRAM], batch_bases=bases).collect()}
        assert got == {"a": (4, 40.0), "b": (2, 40.0)}
    with pytest.raises(Exception, match="ended with 3"):
        engines.piped_lines(seqs, [sys.executable, "-c", "raise SystemExit(3)"]).collect()
    assert not engines.available("no-such-program")


def test_nucleotide_hits(spark):
    seqs = spark.createDataFrame([("a", "ACGT")], "name string, seq string")
    hits = engines.domain_search(seqs, [sys.executable, "-c", PROGRAM])
    r = engines.nucleotide_hits(hits, spark.createDataFrame([("a", 3_000_000)], "name string, length int")).first()
    assert (r["target_name"], r["ali_from"], r["ali_to"]) == ("a|rev1", 1, 4) and abs(r["i_evalue"] - 6e-9) < 1e-20


def test_graph_cache_and_reports(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "X")], "parent string, family string")
    edges = spark.createDataFrame([("a", "b", 1.0)], "query string, target string, score double")
    calls = []
    for _ in range(2):
        got = engines.load_or_build_graph(spark, str(tmp_path / "g"), lambda: calls.append(1) or (nodes, edges))
        assert got[1].count() == 1
    assert calls == [1]
    positions = spark.createDataFrame([("big", p, 1.0) for p in range(1, 131)], "model string, pos int, score double")
    head, lines = engines.decomposition_report(positions)
    assert writers.write_lines(lines, str(tmp_path / "r.tsv"), order=["m"], header=head) == 1
    cells = (tmp_path / "r.tsv").read_text().split("\n")[1].split("\t")
    assert cells[:2] == ["big", "130"] and cells[4] == "0.738" and cells[6] == "1.000"


def test_raw_lines(spark):
    row = {c: 1 for c in ("target_len", "query_len", "dom_num", "dom_of", "hmm_from", "hmm_to", "ali_from", "ali_to", "env_from", "env_to")}
    hits = spark.range(2).select(F.lit("d").alias("database"), F.lit("t").alias("target_name"), F.lit("q").alias("query_name"), *(F.lit(v).alias(k) for k, v in row.items()), *(F.lit(1.0).alias(c) for c in ("evalue", "score", "bias", "c_evalue", "i_evalue", "dom_bias", "acc")), F.col("id").cast("double").alias("dom_score"))
    head, all_ = engines.raw_hit_lines(hits)
    assert len(head.split("\t")) == 21 and all_.count() == 2 and engines.best_hit_lines(hits, hits.select(F.lit("t").alias("name"), F.lit(9).alias("length")).distinct())[1].count() == 1
