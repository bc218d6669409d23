"""Loading hits as they come: late rows kept, repeated rows dropped.

The batch operators take finite tables; this feeds them. Rows of one hit that come
again within the lateness allowed are dropped by a state that the watermark bounds;
counts per model and window close with the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType


def read_hits(spark: SparkSession, folder: str, schema: StructType, *, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of hits as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def without_repeats(hits: DataFrame, *, time: str = "loaded_at", lateness: str = "30 days") -> DataFrame:
    """Hits once each: equal in every column but id and time."""
    same = [c for c in hits.columns if c not in ("id", time)]
    return hits.withWatermark(time, lateness).dropDuplicatesWithinWatermark(same)


def counts_by_model(hits: DataFrame, *, time: str = "loaded_at", window: str = "1 day", lateness: str = "30 days") -> DataFrame:
    """``(w_start, w_end, query_name, n_hits, best)`` per model and window of arrival."""
    rows = hits.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"), "query_name")
    return rows.agg(F.count(F.lit(1)).alias("n_hits"), F.max("dom_score").alias("best")).select("w.start", "w.end", "query_name", "n_hits", "best").toDF("w_start", "w_end", "query_name", "n_hits", "best")


def append(hits: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there, exactly once, by database; then stop."""
    return hits.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("database").trigger(availableNow=True).start()
