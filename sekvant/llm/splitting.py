"""Cutting oversized items at natural boundaries into overlapping pieces.

An item is an axis of ``size`` positions; gaps on it are its natural boundaries. A
cut lies inside a gap, the longer the gap the stronger the boundary; a stretch
longer than a piece between two gaps gets the fewest forced cuts, of strength 0.
Cuts divide the item into atomic segments. Agglomerative merging holds all pairs
of neighbours in a heap and merges across the weakest boundary first, while the
merged segment and the overlap it shares with the one before stay within the limit.

An item's axis is worked in parts that cannot touch each other. A boundary whose two
atomic segments together with the overlap exceed the limit can never be merged over,
as segments only grow; so it stays for certain, and what lies left and right of it may
be merged apart with the same result. Cuts are gathered by blocks of about
``block_pieces`` limits; an item is parted at the first certain boundary of each block,
blocks without one stay with the part before. The result does not depend on the block
size, and one item of any size is shared out. A task's memory is bounded by the positions of
a part, not by the number of gap rows: those are first merged per item by the interval sweep.

Defined cases: null, zero and negative sizes and null names make no item; sizes
up to the limit are not cut; gaps beyond the item are clipped, gaps with a null end
left out, repeated and overlapping gaps are one; a cut nearer than the overlap to
the item's start is not used; equally strong boundaries merge from the left; one row per name is the
caller's duty; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sekvant.operators.intervals import merged

BLOCK_PIECES = 64


def atoms(start: int, end: int, cuts: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple[int, int]]:
    """``(end of segment, strength of the boundary there)`` for the segments of ``(start, end]``."""
    out, at = [], start
    for pos, strength in [*cuts, (end, 0)]:
        room = limit - (overlap if at else 0)
        while pos - at > room:
            at += room
            out.append((at, 0))
            room = limit - overlap
        if pos > at:
            out.append((pos, strength))
            at = pos
    return out


def agglomerate(start: int, segments: list[tuple[int, int]], limit: int, overlap: int) -> list[int]:
    """Ends of the pieces after merging the segments of ``(start, ...]``."""
    n = len(segments)
    begin = [start, *(e for e, _ in segments[:-1])]
    end = [e for e, _ in segments]
    right, left, live = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
    heap = [(segments[i][1], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        strength, i, j = heapq.heappop(heap)
        # A pair is stale once either side was merged away or the left side grew past it.
        if not (live[i] and live[j]) or right[i] != j:
            continue
        if end[j] - begin[i] + (overlap if begin[i] else 0) > limit:
            continue  # segments only grow: this boundary stays
        end[i], live[j], right[i] = end[j], False, right[j]
        if right[j] >= 0:
            left[right[j]] = i
            heapq.heappush(heap, (segments[j][1], i, right[j]))
    return [end[i] for i in range(n) if live[i]]


_ATOMS = T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("strength", T.LongType())]))


def certain(start: int, segments: list[tuple[int, int]], after: int | None, limit: int, overlap: int) -> int:
    """Index of the first segment of ``(start, ...]`` whose end is a boundary for certain, or -1; ``after`` is the next segment's end."""
    begin = [start, *(e for e, _ in segments)]
    for i, (beyond, _) in enumerate([*segments[1:], (after, 0)]):
        if beyond is not None and beyond - begin[i] + (overlap if begin[i] else 0) > limit:
            return i
    return -1


def _parted(limit: int, overlap: int):
    """A block's atomic segments up to its first certain boundary, and those behind it."""

    @F.pandas_udf(T.StructType([T.StructField("head", _ATOMS), T.StructField("tail", _ATOMS)]))
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for start, end, after, cuts in batches:
            heads, tails = [], []
            for s, e, n, c in zip(start, end, after, cuts):
                marks = [] if c is None else [(x["pos"], x["strength"]) for x in c if x["pos"] < e]
                last = 0 if c is None else next((x["strength"] for x in c if x["pos"] == e), 0)
                segments = [*atoms(s, e, marks, limit, overlap)]
                segments[-1] = (segments[-1][0], last)
                beyond = None if pd.isna(n) else min(int(n), e + limit - overlap)
                i = certain(s, segments, beyond, limit, overlap) + 1
                heads.append([{"pos": p, "strength": w} for p, w in segments[:i]])
                tails.append([{"pos": p, "strength": w} for p, w in segments[i:]])
            yield pd.DataFrame({"head": heads, "tail": tails})

    return run


def _ends(limit: int, overlap: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for start, segments in batches:
            yield pd.Series([agglomerate(s, [(x["pos"], x["strength"]) for x in a], limit, overlap) for s, a in zip(start, segments)], dtype=object)

    return run


def split_oversized(items: DataFrame, gaps: DataFrame, *, limit: int, overlap: int, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Pieces ``(name, piece, pos_from, pos_to)`` of items ``(name, size)`` above the limit, piece from 1.

    ``gaps`` has ``(name, gap_from, gap_to)``, ends included, positions from 1.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    step, block = limit - overlap, limit * block_pieces
    big = items.select("name", F.col("size").cast("bigint").alias("size")).where(F.col("name").isNotNull() & (F.col("size") > limit))
    known = gaps.join(big.select("name").distinct(), "name", "left_semi")
    spans = merged(known, "name", "gap_from", "gap_to", name="name").join(big, "name").select("name", "size", F.greatest("pos_from", F.lit(1)).alias("a"), F.least("pos_to", "size").alias("b")).where("a <= b")
    # A gap offers its middle and both ends, so no forced cut falls where an end inside a gap is in reach;
    # one longer than a piece offers a cut for every piece that may end in it, and its end.
    middle = F.greatest(F.floor((F.col("a") + F.col("b")) / 2).cast("bigint"), F.least("b", F.lit(max(overlap, 1)).cast("bigint")))
    many = F.array_union(F.sequence("a", "b", F.lit(step)), F.array("b"))
    cuts = (
        spans.select("name", "size", F.explode(F.when(F.col("b") - F.col("a") > step, many).otherwise(F.array_distinct(F.array("a", middle, "b")))).alias("pos"), (F.col("b") - F.col("a") + 1).alias("strength"))
        .where((F.col("pos") >= max(overlap, 1)) & (F.col("pos") < F.col("size")))
        .withColumn("w", F.floor((F.col("pos") - 1) / block).cast("bigint"))
    )
    per_block = cuts.groupBy("name", "w").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.sort_array(F.collect_list(F.struct("pos", "strength"))).alias("cuts"))
    # An item has few blocks, whose rows alone are numbered here.
    by_name = Window.partitionBy("name").orderBy("w")
    blocks = big.join(per_block, "name", "left").withColumns({"w": F.coalesce("w", F.lit(0)), "start": F.coalesce(F.lag("last").over(by_name), F.lit(0)), "after": F.lead("first").over(by_name)})
    final = F.col("after").isNull()
    ranged = blocks.select("name", "w", "size", "cuts", F.col("start").cast("bigint").alias("start"), F.when(final, F.col("size")).otherwise(F.col("last")).alias("stop"), F.when(final, None).otherwise(F.col("after")).alias("after"))
    parted = ranged.select("name", "w", _parted(limit, overlap)("start", "stop", "after", "cuts").alias("x"))
    at = F.when(F.size("x.head") > 0, F.element_at("x.head", -1)["pos"])
    parted = parted.select("name", "w", F.col("x.head").alias("head"), F.col("x.tail").alias("tail"), at.alias("at"))
    upto = F.last("at", ignorenulls=True)
    runs = parted.withColumns({"own": F.coalesce(upto.over(by_name), F.lit(0)), "before": F.coalesce(upto.over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    # The head closes the run that an earlier block began, the tail begins or goes on with the block's own.
    each = runs.select("name", F.explode(F.array(F.struct(F.col("before").alias("start"), F.col("w"), F.lit(0).alias("o"), F.col("head").alias("a")), F.struct(F.col("own").alias("start"), F.col("w"), F.lit(1).alias("o"), F.col("tail").alias("a")))).alias("r"))
    whole = each.where(F.size("r.a") > 0).groupBy("name", F.col("r.start").alias("start")).agg(F.sort_array(F.collect_list(F.struct("r.w", "r.o", "r.a"))).alias("p"))
    ends = whole.select("name", "start", _ends(limit, overlap)("start", F.flatten(F.transform("p", lambda x: x["a"]))).alias("ends"))
    earlier = Window.partitionBy("name").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    numbered = ends.withColumn("n", F.coalesce(F.sum(F.size("ends")).over(earlier), F.lit(0)))
    each = numbered.select("name", "start", "n", "ends", F.posexplode("ends").alias("i", "pos_to"))
    previous = F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(F.col("start"))
    return each.select("name", (F.col("n") + F.col("i") + 1).cast("int").alias("piece"), F.when(previous > 0, previous - overlap + 1).otherwise(1).cast("bigint").alias("pos_from"), "pos_to")
