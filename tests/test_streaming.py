import datetime as dt

from sekvant.streaming import hits as stream

SCHEMA = "id long, database string, query_name string, dom_score double, loaded_at timestamp"


def rows(spark, path, data):
    spark.createDataFrame([(i, d, q, s, dt.datetime(2024, 1, day)) for i, d, q, s, day in data], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_repeats_and_late_rows(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows(spark, src, [(1, "a", "m", 1.0, 10), (2, "a", "m", 1.0, 11), (3, "b", "n", 2.0, 11)])
    schema = spark.read.parquet(src).schema
    run = lambda: stream.append(stream.without_repeats(stream.read_hits(spark, src, schema)), out, state).awaitTermination()
    run()
    rows(spark, src, [(4, "a", "m", 1.0, 12), (5, "a", "m", 9.0, 2)])
    run()
    got = spark.read.parquet(out)
    assert got.count() == 3 and sorted(r["dom_score"] for r in got.collect()) == [1.0, 2.0, 9.0]


def test_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    rows(spark, src, [(1, "a", "m", 1.0, 10), (2, "a", "m", 4.0, 10), (3, "a", "n", 2.0, 11)])
    q = stream.counts_by_model(stream.read_hits(spark, src, spark.read.parquet(src).schema)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["query_name"], r["n_hits"], r["best"]) for r in spark.table("counts").collect()) == [("m", 2, 4.0), ("n", 1, 2.0)]
