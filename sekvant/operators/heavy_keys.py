"""Per-key results where a handful of keys hold most rows.

Exact offset chunking: rows are put in order of key and value (or of given columns) over
range partitions, which cut through heavy keys, and written. They are counted per key and
partition, the counts prefix-summed over the partitions, and each row gets its exact
number within its key from its partition's offset. The number gives its chunk; chunks
of one key are equal in size (the last may be short) and are processed as independent
groups, so no task sees more than ``chunk_rows`` rows of a key. Every chunk leaves a
small state: what is settled inside it, and its first and last run of equal values,
which may go on in the chunks beside it. The boundary states are merged in chunk order.

Defined cases: rows with a null key belong to no key; null values count as rows
but are never the usual value, a key with only nulls has the usual value null;
equally frequent values give the smallest; repeated rows count as they lie; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sekvant.staging import measured, row_bytes, staged

CHUNK_ROWS = 65_536
BROADCAST_BYTES = 32 << 20
#: Bits of a row's place that count rows within a partition.
_PLACE_BITS = 33


def numbered(df: DataFrame, key: str | Column, value: str | Column, *, order: list[str | Column] | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(k, v, row_no, chunk)``: the row's number within its key from 1, in order of ``order``, else of the value."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    by = [f"o{i}" for i in range(len(order or ()))] or ["v"]
    rows = df.select(col(key).alias("k"), col(value).alias("v"), *(col(c).alias(o) for c, o in zip(order or (), by)), F.monotonically_increasing_id().alias("at")).where(F.col("k").isNotNull())
    # The place takes part in the ranges, so that many equal rows are cut through too.
    ranged = rows.repartitionByRange("k", *by, "at").sortWithinPartitions("k", *by, "at")
    placed = staged(ranged.select("k", "v", F.monotonically_increasing_id().alias("at")), "heavy-keys").withColumn("part", F.shiftright("at", _PLACE_BITS))
    earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # A key's rows stand together in a partition: there are at most as many counts as keys and partitions.
    offsets, seen = measured(counts.select("k", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")), "heavy-offsets", size=row_bytes("k"))
    joined = placed.join(F.broadcast(offsets) if seen["size"] <= BROADCAST_BYTES else offsets, ["k", "part"])
    row_no = F.col("offset") + F.col("at") - F.col("first") + 1
    return joined.select("k", "v", row_no.alias("row_no"), F.floor((row_no - 1) / chunk_rows).cast("bigint").alias("chunk"))


def _runs(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """``(k, v, n, lo, hi, open)``: runs of equal values of every chunk, of rows in order of their values.

    ``open`` says whether the run begins or ends with its chunk, so that it may go on in another.
    """
    runs = rows.groupBy("k", "chunk", "v").agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("lo"), F.max("row_no").alias("hi"))
    begin = F.col("chunk") * chunk_rows + 1
    return runs.select("k", "chunk", "v", "n", "lo", "hi", ((F.col("lo") == begin) | (F.col("hi") == begin + chunk_rows - 1)).alias("open"))


def _merged(open_runs: DataFrame) -> DataFrame:
    """``(k, v, n)``: boundary runs joined, in chunk order, where one goes on with the value the one before ended with."""
    ordered = Window.partitionBy("k").orderBy("lo")
    goes_on = F.lag(F.struct("v")).over(ordered)["v"].eqNullSafe(F.col("v")) & (F.lag("hi").over(ordered) + 1 == F.col("lo"))
    numbered_ = open_runs.withColumn("fresh", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(ordered))
    return numbered_.groupBy("k", "run").agg(F.first("v").alias("v"), F.sum("n").alias("n")).select("k", "v", "n")


def _state() -> list[Column]:
    """Rows, best value - the most frequent, then the smaller - and number of values of whole runs."""
    best = F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("v").alias("v"))))
    return [F.sum("n").alias("n_rows"), best.alias("b"), F.count("v").alias("n_values")]


def usual_values(df: DataFrame, key: str | Column, value: str | Column, *, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(k, n_rows, usual, n_usual, n_values)`` for every key."""
    runs = _runs(numbered(df, key, value, chunk_rows=chunk_rows), chunk_rows)
    settled = runs.where(~F.col("open")).groupBy("k", "chunk").agg(*_state()).drop("chunk")
    bounds = _merged(runs.where("open")).groupBy("k").agg(*_state())
    both = settled.unionByName(bounds).groupBy("k").agg(F.sum("n_rows").alias("n_rows"), F.min("b").alias("b"), F.sum("n_values").alias("n_values"))
    return both.select("k", "n_rows", F.col("b.v").alias("usual"), F.coalesce(-F.col("b.n"), F.lit(0)).alias("n_usual"), "n_values")


def change_counts(df: DataFrame, key: str | Column, value: str | Column, *, order: list[str | Column], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(k, n_rows, n_changes)``: how often the value differs from the row before, in the given order.

    Changes inside a chunk are counted there; one more is added between two chunks
    where the last value of one and the first of the next differ. Null equals null.
    """
    rows = numbered(df, key, value, order=order, chunk_rows=chunk_rows)
    in_chunk = Window.partitionBy("k", "chunk").orderBy("row_no")
    changed = (F.row_number().over(in_chunk) > 1) & ~F.lag("v").over(in_chunk).eqNullSafe(F.col("v"))
    states = (
        rows.withColumn("c", changed.cast("int"))
        .groupBy("k", "chunk")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.min_by(F.struct("v"), "row_no").alias("first"), F.max_by(F.struct("v"), "row_no").alias("last"))
    )
    ordered = Window.partitionBy("k").orderBy("chunk")
    between = F.lag("last").over(ordered)
    joined = states.withColumn("c", F.col("c") + (between.isNotNull() & ~between["v"].eqNullSafe(F.col("first")["v"])).cast("int"))
    return joined.groupBy("k").agg(F.sum("n").alias("n_rows"), F.sum("c").alias("n_changes"))
