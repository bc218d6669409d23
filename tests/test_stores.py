"""Stored tables, caches, id registries and commands."""

import pytest
from pyspark.sql import functions as F

from sekvant import staging
from sekvant.sources import engines, readers, writers

CALLS = "id string, database string, order string, superfamily string, clade string, complete string, strand string, domains string, source string"


def test_classifications(spark, tmp_path):
    rows = [("s1", "a", "LTR", "Copia", "Ale", "no", "+", "RT|Ale", None), ("s2", "b", "LTR", "Copia", "unknown", "none", "?", "none", "s1")]
    for _ in range(2):
        writers.append_classifications(spark.createDataFrame(rows, CALLS), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "c"))
    assert got.count() == 4 and {(r["seq_id"], r["database"], r["source"], r["mode"]) for r in got.collect()} == {("s1", "a", "hmm", "legacy"), ("s2", "b", "s1", "legacy")}


def test_split_files(spark, tmp_path):
    seqs = spark.createDataFrame([(f"s{i}", "ACGT") for i in range(40)], "name string, seq string")
    writers.write_split(seqs.where("name < 's2'"), seqs.where("name >= 's2'"), str(tmp_path), parts=4)
    a, b = (spark.read.text(str(tmp_path / x)) for x in ("database", "queries"))
    assert a.where("value LIKE '>%'").count() + b.where("value LIKE '>%'").count() == 40 and b.where("value LIKE '>%'").groupBy("part").count().count() > 1


def test_registry(spark, tmp_path):
    path = str(tmp_path / "ids")
    frames = spark.createDataFrame([("s|x|fwd2",), ("s|x|rev3",), ("plain",), (None,)], "name string")
    ids = writers.frame_registry(frames)
    assert {(r["name"], r["direction"], r["frame"]) for r in ids.collect()} == {("s|x|fwd2", 1, 1), ("s|x|rev3", -1, 2), ("plain", 0, 0)}
    writers.register(ids, path)
    writers.register(ids, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 3
    asked = stored.select("id").union(spark.createDataFrame([(5,)], "id bigint"))
    assert {r["name"] for r in writers.names_of(asked, stored).collect()} == {"s|x|fwd2", "s|x|rev3", "plain", None}


def test_cache_of_steps(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert [engines.load_or_build(spark, str(tmp_path / "x"), build).count() for _ in range(2)] == [3, 3] and len(calls) == 1


def test_tables_that_may_be_asked_for(spark, tmp_path):
    spark.createDataFrame([(2, "b", 1, "x"), (1, "a", 5, "x"), (3, "a", 2, "y")], "id int, base_seq string, env_from int, database string").write.parquet(str(tmp_path / "legacy_hits.parquet"))
    d = str(tmp_path)
    assert [r["id"] for r in readers.database_hits(spark, d, "legacy_hits").collect()] == [3, 1, 2]
    assert [r["id"] for r in readers.database_hits(spark, d, "legacy_hits", "x").collect()] == [1, 2]
    with pytest.raises(ValueError):
        readers.database_hits(spark, d, "users")
    with pytest.raises(FileNotFoundError):
        readers.database_hits(spark, d, "facet_hits")
    assert readers.has_table(spark, d, "legacy_hits", "id") and not readers.has_table(spark, d, "legacy_hits", "nope") and not readers.has_table(spark, d, "none")


def test_commands():
    c = engines.search_command("protein", "m.hmm", searched=7)
    assert c[0] == "hmmsearch" and c[c.index("-Z") + 1] == c[c.index("--domZ") + 1] == "7" and c[-2:] == ["m.hmm", "-"]
    assert "--fs" in engines.search_command("frameshift", "m.bhmm") and engines.search_command("nucleotide", "m", program="/x/nhmmer")[0] == "/x/nhmmer"
    with pytest.raises(ValueError):
        engines.search_command("magic", "m")
    assert "6 qseqid sseqid pident" in engines.similarity_commands("db")[1][-1]


def test_numbers_as_text(spark):
    df = spark.createDataFrame([(1e-5,), (0.0001,), (12.25,), (1e7,), (None,)], "x double")
    assert [r[0] for r in df.select(writers.number_text(F.col("x"))).collect()] == ["1e-05", "0.0001", "12.25", "10000000.0", None]
    assert [r[0] for r in df.select(writers.number_text(F.col("x"), "{:.1f}")).collect()][2] == "12.2"


def test_fixed_clades(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("Clade\tFamily\tSystem\nTy1-x\tCopia\tLTR\nall\tz\tz\n")
    got = {r["clade"]: (r["order"], r["superfamily"]) for r in readers.clade_map(spark, str(tmp_path / "c.tsv")).collect()}
    assert got["ty1_x"] == ("LTR", "Copia") and got["all"] == ("Unknown", "unknown") and got["ty1/copia"] == ("LTR", "Copia")


def test_a_cluster_must_name_its_folder():
    class Stub:
        master = "spark://host:7077"
        conf = sparkContext = property(lambda self: self)

        def get(self, *_):
            return None

        getConf = lambda self: self
        getCheckpointDir = lambda self: None

    with pytest.raises(ValueError):
        staging.shared_dir(Stub())


def test_release_all(spark):
    df = staging.staged(spark.range(5), "t")
    table, seen = staging.measured(spark.range(5), "m", n=F.count("*"), top=F.max("id"))
    assert seen == {"n": 5, "top": 4} and df.count() == table.count() == 5
    staging.release_all(spark)
    assert not [e for e in staging._written if e[0] is spark]


def test_sub_models_are_read_back(spark, tmp_path):
    from sekvant.operators import models

    rng = __import__("random").Random(3)

    def part(n):
        xs = [rng.random() + 0.01 for _ in range(n)]
        return [x / sum(xs) for x in xs]

    m = 6
    rows = [("x", "dna", [part(4) for _ in range(m)], [part(4) for _ in range(m + 1)], [part(7) for _ in range(m + 1)])]
    df = spark.createDataFrame(rows, "name string, alphabet string, match array<array<double>>, insert array<array<double>>, trans array<array<double>>")
    sub = models.spliced(df, spark.createDataFrame([("x", 1, 4)], "model string, part_from int, part_to int"))
    writers.profile_text(sub).select(F.col("line").alias("value")).coalesce(1).write.text(str(tmp_path / "m"))
    r = readers.profile_models(spark, str(tmp_path / "m")).first()
    assert (r["name"], r["m"], r["alphabet"], len(r["insert"]), len(r["trans"])) == ("x__sub_1-4", 3, "dna", 4, 4)
    flat = lambda xs: [v for x in xs for v in x]
    assert max(abs(a - b) for a, b in zip(flat(r["match"]), flat(rows[0][2][1:4]))) < 1e-4 and max(abs(a - b) for a, b in zip(flat(r["trans"]), flat([rows[0][4][0], *rows[0][4][2:5]]))) < 1e-4


def test_new_store_and_converted_files(spark, tmp_path):
    for _ in range(2):
        writers.create_store(spark, str(tmp_path), {"sequences": "name string, length int"})
    assert readers.has_table(spark, str(tmp_path), "sequences", "name", "length")
    db = tmp_path / "a.hmm"
    assert readers.resolve_converted(str(db), {"a.hmm": "b.bhmm"}) == (f"{db}.bhmm", False)
    (tmp_path / "b.bhmm").write_text("")
    assert readers.resolve_converted(str(db), {"a.hmm": "b.bhmm"}) == (str(tmp_path / "b.bhmm"), True)
    (tmp_path / "a.hmm.bhmm").write_text("")
    assert readers.resolve_converted(str(db), {"a.hmm": "b.bhmm"}) == (f"{db}.bhmm", True)
