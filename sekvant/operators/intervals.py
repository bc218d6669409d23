"""Merging overlapping intervals per entity and listing the gaps between them.

Sweep line: every interval becomes a plus event at its start and a minus event
one past its end; the running sum of events is the number of intervals that
cover a position. A stretch is covered while the sum is positive and a gap
while it is zero.

The running sum is split by position: an entity's axis is cut into chunks of
2**chunk_bits positions. Events are first summed per (entity, position), with
map-side combining, so a chunk holds at most 2**chunk_bits events however many
intervals lie there. Each chunk is summed by itself and starts from the total
of the entity's earlier chunks, a far smaller table. No task ever holds one
entity's events, so an entity with a third of all rows does no harm.

Defined cases: rows with a null key, start or end are left out; the two ends may
stand in either order; both ends are included; touching intervals (no position
between them) are one; repeated rows change nothing; an empty table gives an
empty result; other columns of the input are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COVERED, GAP = "covered", "gap"


def stretches(df: DataFrame, key: str | Column, start: str | Column, end: str | Column, *, chunk_bits: int = 16, name: str = "entity") -> DataFrame:
    """Columns ``(name, kind, pos_from, pos_to)``; positions are bigint, ends included."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    spans = df.select(col(key).alias("k"), col(start).cast("bigint").alias("s"), col(end).cast("bigint").alias("e")).where(F.col("k").isNotNull() & F.col("s").isNotNull() & F.col("e").isNotNull())
    # Repeated and shared spans collapse before they are turned into events.
    events = (
        spans.select("k", F.explode(F.array(F.struct(F.least("s", "e").alias("p"), F.lit(1).alias("d")), F.struct((F.greatest("s", "e") + 1).alias("p"), F.lit(-1).alias("d")))).alias("x"))
        .groupBy("k", F.col("x.p").alias("p"))
        .agg(F.sum("x.d").alias("d"))
        .where("d <> 0")
        .withColumn("chunk", F.expr(f"shiftright(p, {chunk_bits})"))
        # Never null; said here, it is said in both uses below, so that they share one shuffle.
        .where(F.col("chunk").isNotNull())
    )
    in_chunk = Window.partitionBy("k", "chunk").orderBy("p")
    earlier = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.groupBy("k", "chunk").agg(F.sum("d").alias("total")).select("k", "chunk", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("carry"))
    active = events.withColumn("local", F.sum("d").over(in_chunk)).join(carried, ["k", "chunk"]).select("k", "chunk", "p", (F.col("carry") + F.col("local")).alias("now"), (F.col("carry") + F.col("local") - F.col("d")).alias("before"))
    bounds = active.where((F.col("now") == 0) != (F.col("before") == 0)).select("k", "chunk", "p", (F.col("now") == 0).alias("opens_gap"))
    # The bound after a chunk's last one is the first of the next chunk that has any.
    later = Window.partitionBy("k").orderBy("chunk")
    first = bounds.groupBy("k", "chunk").agg(F.min("p").alias("p")).select("k", "chunk", F.lead("p").over(later).alias("beyond"))
    paired = bounds.withColumn("next", F.lead("p").over(in_chunk)).join(first, ["k", "chunk"]).withColumn("next", F.coalesce("next", "beyond"))
    return paired.where(F.col("next").isNotNull()).select(F.col("k").alias(name), F.when(F.col("opens_gap"), GAP).otherwise(COVERED).alias("kind"), F.col("p").alias("pos_from"), (F.col("next") - 1).alias("pos_to"))


def merged(df: DataFrame, key: str | Column, start: str | Column, end: str | Column, *, name: str = "entity") -> DataFrame:
    """Only the covered stretches, as ``(name, pos_from, pos_to)``."""
    return stretches(df, key, start, end, name=name).where(F.col("kind") == COVERED).drop("kind")
