"""Cutting lineage through tables written to the cluster's shared folder.

An iterative operator rereads its rows every round. Written parquet is
compressed, column-pruned on reading and survives the loss of any executor,
so it is used instead of a cache. ``spark.checkpoint.dir`` names the folder.
Where the session has none, a session on one machine gets a folder of its own,
which is shared there; a cluster must name one.

A table that an operator reads while it runs is released by the operator. One that
a result still reads lives until the caller, done with the result, calls
``release_all``, or until the interpreter ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares, as the session names it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="sekvant-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; same columns and types."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sekvant-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``staged`` and aggregates over its rows, taken while they are written."""
    seen = Observation()
    table = staged(df.observe(seen, *(c.alias(k) for k, c in metrics.items())), label)
    return table, seen.get


def row_bytes(*columns: str) -> Column:
    """Summed size of rows by the text of the given columns, with an allowance for each row; to be aggregated."""
    return F.coalesce(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(96))), F.lit(0))


def release(df: DataFrame) -> None:
    """Delete the files of a staged table that no later action reads."""
    files = set(df.inputFiles())
    for entry in list(_written):
        if any(entry[1].removeprefix("file://") in f for f in files):
            _drop(entry)


def release_all(spark: SparkSession) -> None:
    """Delete all tables this session has staged; results that read them must not be used any more."""
    for entry in list(_written):
        if entry[0] is spark:
            _drop(entry)


def _drop(entry: tuple[SparkSession, str]) -> None:
    spark, path = entry
    _written.remove(entry)
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder is temporary
        pass


@atexit.register
def _drop_all() -> None:
    for entry in list(_written):
        if entry[0].sparkContext._jsc is not None:
            _drop(entry)
