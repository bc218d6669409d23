"""Resolving overlapping features, and their statistics by classification.

Features of one place and type are swept in order of start, end, falling score and
id, with one feature kept in mind: of two that overlap by more than the limit the
higher score stays, on equal scores the earlier. The sweep is sequential, but
starts anew wherever a feature begins behind all ends before it; those islands
come from the skew-safe interval sweep, are spread over the cluster and streamed in
order with one feature in memory, whatever an island's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sekvant.operators.intervals import merged

MAX_OVERLAP = 20.0
#: Order in which classes are listed in the summary.
ORDERS = ("LTR", "pararetrovirus", "DIRS", "Penelope", "LINE", "SINE", "TIR", "Helitron", "Maverick", "mixture", "Unknown", "Total")
_CHUNK = 16


def _sweep(limit: float):
    """Positions and hashes of discarded rows, from rows in sweep order, island by island."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        island, last = None, None
        for b in batches:
            keys = [*zip(*(b[c] for c in b.columns if c not in ("f_start", "f_end", "score", "h1", "h2")))]
            gone = []
            for at, h1, h2, start, end, score in zip(keys, b["h1"], b["h2"], b["f_start"], b["f_end"], b["score"]):
                i = (*at, start, end, h1, h2)
                if at != island or last is None:
                    island, last = at, (i, start, end, score)
                    continue
                if i == last[0]:
                    # The same feature again: neither copy is kept, yet it goes on shading others.
                    gone.append(i)
                    continue
                shared = max(0, min(end, last[2]) - max(start, last[1]))
                if 100.0 * shared / min(end - start + 1, last[2] - last[1] + 1) > limit:
                    gone.append(last[0] if score > last[3] else i)
                    if score <= last[3]:
                        continue
                last = (i, start, end, score)
            yield pd.DataFrame(gone, columns=[*(c for c in b.columns if c not in ("f_start", "f_end", "score", "h1", "h2")), "f_start", "f_end", "h1", "h2"])

    return run


def resolve_overlaps(features: DataFrame, *, group: tuple[str, ...] = ("chrom", "type"), max_overlap: float = MAX_OVERLAP) -> DataFrame:
    """Features left of ``(chrom, type, f_start, f_end, score, gid, ...)``; rows with a null end are left out.

    Rows equal in every column count as the same feature, and all of them go. A row is
    known by its group, its ends and two 64-bit hashes of all its columns.
    """
    places = [f"g{i}_" for i in range(len(group))]
    rows = features.where(F.col("f_start").isNotNull() & F.col("f_end").isNotNull()).withColumns({"f_start": F.least("f_start", "f_end"), "f_end": F.greatest("f_start", "f_end")})
    whole = [F.struct(*sorted(features.columns)), F.array(*(F.col(c).isNull() for c in sorted(features.columns)))]
    own = {"h1_": F.xxhash64(*whole), "h2_": F.xxhash64(F.lit("second"), *whole)}
    ends = [F.col(c).cast("bigint").alias(c) for c in ("f_start", "f_end")]
    # Only what the sweep needs, under its own names.
    slim = rows.select(*(F.col(c).alias(g) for c, g in zip(group, places)), own["h1_"].alias("h1"), own["h2_"].alias("h2"), *ends, F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), F.coalesce(F.col("gid").cast("string"), F.lit("")).alias("gid")).withColumn("k", F.struct(*places))
    chunk = lambda c: F.expr(f"shiftright(cast({c} AS bigint), {_CHUNK})")
    islands = merged(slim, "k", "f_start", "f_end", name="k")
    spans = islands.select("k", F.col("pos_from").alias("island"), "pos_to", F.explode(F.sequence(chunk("pos_from"), chunk("pos_to"))).alias("chunk"))
    placed = slim.withColumn("chunk", chunk("f_start")).join(spans, ["k", "chunk"]).where(F.col("f_start").between(F.col("island"), F.col("pos_to")))
    ordered = placed.repartition(*places, "island").sortWithinPartitions(*places, "island", "f_start", "f_end", F.desc("score"), "gid", "h1", "h2")
    streamed = ordered.select(*places, "island", "h1", "h2", "f_start", "f_end", "score")
    key = [*places, "f_start", "f_end", "h1", "h2"]
    types = {f.name: f for f in streamed.schema}
    gone = streamed.mapInPandas(_sweep(max_overlap), T.StructType([types[c] for c in (*places, "island", *key[len(places) :])])).select(*key).distinct()
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(gone[g]) for c, g in zip(group, places)))
    same &= (F.col("h1_") == gone["h1"]) & (F.col("h2_") == gone["h2"]) & (rows["f_start"] == gone["f_start"]) & (rows["f_end"] == gone["f_end"])
    known = rows.withColumns(own)
    return known.join(gone, same, "left_anti").drop("h1_", "h2_")


def class_summary(features: DataFrame, classification: str = "classification") -> DataFrame:
    """``(path, number, total_length, mean_length, place)`` for every class, its ancestors and the total.

    Paths may be one, two or three levels deep, so prefixes are listed rather than rolled up.
    A mean halfway between two tenths is rounded away from zero.
    """
    parts = F.split(classification, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    shown = F.when(F.size(parts) <= 3, prefixes).otherwise(F.array(F.col(classification)))
    rows = features.where(F.col(classification).isNotNull()).select(F.explode(F.concat(shown, F.array(F.lit("Total")))).alias("path"), (F.col("f_end") - F.col("f_start") + 1).alias("n"))
    sums = rows.groupBy("path").agg(F.count(F.lit(1)).alias("number"), F.sum("n").alias("total_length"))
    place = F.array_position(F.array(*map(F.lit, ORDERS)), F.split("path", "/")[0])
    return sums.select("path", "number", "total_length", F.round(F.col("total_length") / F.col("number"), 1).alias("mean_length"), F.when(place == 0, len(ORDERS) + 1).otherwise(place).cast("int").alias("place"))


def summary_lines(summary: DataFrame) -> tuple[str, DataFrame]:
    """Header and lines of the summary: levels in three columns with the last one filled, and the numbers.

    The file's means are taken from the sums, halfway ones rounded to the even tenth.
    """
    from sekvant.sources.writers import tab

    parts = F.split("path", "/")
    n = F.size(parts)
    last = F.element_at(parts, -1)
    levels = [F.when(n == i + 1, last).otherwise("") for i in range(2)] + [F.when(n >= 3, last).otherwise("")]
    mean = F.bround(F.col("total_length") / F.col("number"), 1)
    #: The format's column names.
    head = "\t".join(("Order", "Superfamily", "Clade", "Number", "Total_length", "Mean_length"))
    return head, summary.select("place", "path", tab(*levels, "number", "total_length", F.format_string("%.1f", mean)).alias("line"))
