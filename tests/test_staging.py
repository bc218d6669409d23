from pathlib import Path

from sekvant.staging import release, shared_dir, staged


def test_staged_tables_live_in_the_shared_folder(spark):
    folder = shared_dir(spark)
    assert folder == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    df = spark.createDataFrame([(1, "a", None), (2, None, [1.5])], "i int, s string, a array<double>")
    back = staged(df, "test")
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == sorted(map(tuple, df.collect()), key=lambda r: r[0]) and back.schema == df.schema
    files = back.inputFiles()
    assert files and all(f.removeprefix("file:").lstrip("/") in {str(p).lstrip("/") for p in Path(folder.removeprefix("file://")).rglob("*.parquet")} for f in files)
    release(back)
    assert not any(Path("/" + f.removeprefix("file:").lstrip("/")).exists() for f in files)
    assert staged(df.limit(0), "empty").count() == 0
