from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sekvant.operators import classify
from sekvant.sources import readers, writers


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">s1 some words\nACG\nTT\n>s2\nacgtn\n>empty\n>s3|x#LTR\tt\nA\n")
    got = {r["name"]: (r["description"], r["seq"], r["length"]) for r in readers.fasta(spark, path).collect()}
    assert got == {"s1": ("some words", "ACGTT", 5), "s2": ("", "acgtn", 5), "empty": ("", "", 0), "s3|x#LTR": ("t", "A", 1)}


HMM = """HMMER3/f
NAME  RT_tat
LENG  2
ALPH  amino
HMM          A        C
            m->m     m->i     m->d     i->m     i->i     d->m     d->d
  COMPO   0.5 0.9
          0.69315 0.69315
          0.1 2.0 3.0 0.5 0.9 0.0 *
      1   0.0 *  1 a - - -
          0.69315 0.69315
          0.1 2.0 3.0 0.5 0.9 0.0 *
      2   0.69315 0.69315  2 c - - -
          0.69315 0.69315
          0.1 * * 0.5 0.9 0.0 *
//
"""


def test_profiles(spark, tmp_path):
    path = put(tmp_path, "m.hmm", HMM + HMM.replace("RT_tat", "INT_del"))
    rows = {r["name"]: r for r in readers.profile_models(spark, path).collect()}
    r = rows["RT_tat"]
    assert set(rows) == {"RT_tat", "INT_del"} and (r["m"], r["alphabet"], r["consensus"]) == (2, "amino", "ac")
    assert r["match"][0] == [1.0, 0.0] and abs(r["match"][1][0] - 0.5) < 1e-4 and len(r["insert"]) == 3 and len(r["trans"][0]) == 7
    assert readers.alphabet(spark, path) == "amino" and readers.needs_translation(spark, path)
    with pytest.raises(ValueError):
        readers.alphabet(spark, put(tmp_path, "n.hmm", "NAME x\n"))


def test_frameshift_table(spark, tmp_path):
    line = "{}t1 - m1 - 100 5 90 x 30 10 500 1e-5 44.5 0.5 d\n"
    for i, (head, lead) in enumerate((("# target name\n", ""), ("# hit ID target\n", "7 "))):
        path = put(tmp_path, f"t{i}.tbl", head + line.format(lead) + "short\n")
        r = readers.frameshift_table(spark, path).collect()
        assert len(r) == 1 and r[0]["query_name"] == "m1" and r[0]["target_name"] == "t1|rev1"
        assert (r[0]["ali_from"], r[0]["ali_to"], r[0]["acc"], r[0]["dom_score"], r[0]["dom_of"]) == (10, 30, 1.0, 44.5, 1)


def test_similarity_table(spark, tmp_path):
    good = "\t".join("q s 88.5 120 1 0 1 120 5 124 1e-20 222.5 130 900 92 92 plus".split())
    path = put(tmp_path, "b.tsv", good + "\nshort\tline\n")
    assert [(r["pident"], r["length"], r["qcovs"]) for r in readers.similarity_table(spark, path).collect()] == [(88.5, 120, 92.0)]
    assert readers.similarity_table(spark, str(tmp_path / "none.tsv")).count() == 0


def test_dimension_tables(spark, tmp_path):
    h = readers.harmonization_table(spark, put(tmp_path, "h.tsv", "# c\ndb\torder_native\n" + "\t".join("abcdefg") + "\n" + "\t".join("abcdefgh") + "\nx\ty\n"))
    assert sorted(r["lineage_h"] for r in h.collect()) == ["", "h"]
    s = readers.scope_table(spark, put(tmp_path, "s.tsv", "db\tsf\tn\tr\ngy\tCopia\t3\tyes\ngy\tPao\t0\tno\n"))
    assert {(r["superfamily_h"], r["resolving"]) for r in s.collect()} == {("Copia", True), ("Pao", False)}
    c = readers.clade_map(spark, put(tmp_path, "c.tsv", "Element\tClade\tFamily\tSystem\ne\tTy-1\tCopia\tLTR\nf\tTy-1\tGypsy\tLTR\n"), {"ty_1": ("Unknown", "unknown")})
    assert {(r["clade"], r["superfamily"]) for r in c.collect()} == {("Ty-1", "Gypsy"), ("Ty_1", "Gypsy"), ("ty-1", "Gypsy"), ("ty_1", "unknown")}


def test_resolve(tmp_path, monkeypatch):
    path = put(tmp_path, "x.hmm", "")
    assert readers.resolve(path, {}) == path
    assert readers.resolve("x", {"x": "x.hmm"}, str(tmp_path)) == path
    monkeypatch.setenv("SEKVANT_DB", str(tmp_path))
    assert readers.resolve("x", {"x": "x.hmm"}) == path
    with pytest.raises(FileNotFoundError):
        readers.resolve("y", {"x": "x.hmm"})


CALL = "id string, order string, superfamily string, clade string, complete string, strand string, domains string, score double"


def test_classification_table(spark, tmp_path):
    calls = spark.createDataFrame([("b", "LTR", "Copia", "Ale", "yes", "+", "RT|Ale", 1.5), ("a", "SINE", "unknown", "unknown", "unknown", "-", None, 1.0)], CALL)
    calls = calls.withColumns({"lineage": F.lit(""), "so_name": F.lit("n"), "so_id": F.lit("SO:1"), "secondary": F.array(F.struct(F.lit("d").alias("db"), "order", "superfamily", "clade", "score"))})
    head, lines = writers.classification_lines(calls, secondary=True, ontology=True, lineage=True)
    n = writers.write_lines(lines, str(tmp_path / "o.tsv"), order=["id"], header=head)
    text = Path(tmp_path / "o.tsv").read_text().split("\n")
    assert n == 2 and text[0].split("\t")[-4:] == ["SecondaryHits", "SO_name", "SO_ID", "Lineage"]
    assert text[1] == "a\tSINE\tunknown\tunknown\tunknown\t-\t\td:SINE/unknown/unknown=1.000\tn\tSO:1\t."


def test_library_and_peptides(spark):
    seqs = spark.createDataFrame([("x#old", "ACGT" * 20), ("y", "AAC")], "name string, seq string")
    calls = spark.createDataFrame([("x#old", "LTR", "Copia", "unknown", "yes", "-", "", 1.0)], CALL)
    rows = {r["name"]: r for r in writers.library_records(seqs, calls).collect()}
    assert rows["x#old"]["head"] == "x#LTR/Copia x#old" and rows["x#old"]["seq"] == "ACGT" * 20 and rows["y"]["head"] == "y#Unknown y"
    lines = {r["name"]: r["line"] for r in writers.fasta_lines(seqs, F.col("name"), F.col("seq")).collect()}
    assert lines["x#old"].split("\n") == [">x#old", ("ACGT" * 20)[:60], ("ACGT" * 20)[60:]]
    frames = spark.createDataFrame([("x#old|fwd1", "MKLVA")], "target_name string, aa string")
    domains = spark.createDataFrame([("x#old|fwd1", "x#old", "m", 2, 4, 5, "RT", "Ale", 50.0, 1e-9, 0.9)], "target_name string, base_seq string, query_name string, env_from int, env_to int, start int, gene string, clade string, hmm_cov double, i_evalue double, acc double")
    r = writers.peptide_records(domains, frames, calls).first()
    assert (r["head"], r["seq"]) == ("x#LTR/Copia#RT|Ale x#old|m ID=x#old|m;Name=Ale-RT;gene=RT;clade=Ale;coverage=50.0;evalue=1e-09;probability=0.9", "KLV")


def test_store_and_upsert(spark, tmp_path):
    hits = spark.createDataFrame([("s|rev2", "a:b-RT", "d1", 1.0), ("raw", "GAG_x", "d2", 2.0)], "target_name string, query_name string, database string, score double")
    writers.append_hits(hits, str(tmp_path / "hits"))
    writers.append_hits(hits.limit(1), str(tmp_path / "hits"), run_mode="facet")
    back = spark.read.parquet(str(tmp_path / "hits"))
    assert back.count() == 3 and sorted((r["base_seq"], r["strand"], r["frame"], r["domain_type"]) for r in back.where("run_mode = 'legacy'").collect()) == [("raw", ".", None, "GAG"), ("s", "-", 1, "RT")]
    old = spark.createDataFrame([("a", 1), ("b", 2)], "name string, length int")
    assert {tuple(r) for r in writers.upsert_sequences(old, spark.createDataFrame([("b", 5), ("c", 6)], "name string, length int")).collect()} == {("a", 1), ("b", 5), ("c", 6)}


def test_partitions_and_ids(spark, tmp_path):
    seqs = spark.createDataFrame([(f"s{i}", "ACG") for i in range(5)], "name string, seq string")
    pairs = spark.createDataFrame([(f"s{i}", "a/b:c") for i in range(5)] * 2, "target_name string, query_name string")
    writers.write_partitions(pairs, seqs, str(tmp_path / "p"), batch_size=2)
    found = spark.read.option("lineSep", "\n").text(str(tmp_path / "p"))
    assert found.where("value LIKE '>%'").count() == 5 and {r["batch"] for r in found.select("batch").distinct().collect()} == {0, 1, 2}
    names = spark.createDataFrame([("m",), ("m",), (None,)], "name string")
    a, b = writers.id_registry(names, "model").collect(), writers.id_registry(names, "family").collect()
    assert len(a) == len(b) == 1 and a[0]["id"] != b[0]["id"]


def test_inherit_keeps_the_best_hit_only(spark):
    blast = spark.createDataFrame([("q", "lost", 90.0, 100, 95.0, 500.0, "a"), ("q", "s", 90.0, 100, 95.0, 400.0, "a"), ("p", "s", 81.0, 80, 80.0, 40.0, "b"), ("done", "s", 99.0, 900, 99.0, 900.0, "a"), ("weak", "s", 79.9, 900, 99.0, 900.0, "a")], "qseqid string, sseqid string, pident double, length int, qcovs double, bitscore double, classified_by string")
    calls = spark.createDataFrame([("s", "LTR", "Copia")], "id string, order string, superfamily string")
    done = spark.createDataFrame([("done",)], "id string")
    got = classify.inherit_from_similar(blast, done, calls).collect()
    assert [(r["id"], r["superfamily"], r["clade"], r["strand"], r["source"]) for r in got] == [("p", "Copia", "unknown", "?", "s")]
    assert classify.inherit_from_similar(blast, done, calls, database="a").count() == 0
