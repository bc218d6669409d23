"""Reading the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a lazy scan; a table is one parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
