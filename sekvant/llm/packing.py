"""Filling containers of fixed capacity with whole items.

Bounded-space online best fit: a packer keeps at most ``open_bins`` containers
open. The free spaces that occur among them are the set bits of one integer, so
the best fit - the fullest container with room - is the lowest set bit at or above
the item's size. If none has room and all places are taken, the fullest is closed
and a new one opened; a container without free space closes at once. An item
above the capacity is cut into full containers and one rest, and only the rest
meets other items.

Items equal in identifier and size are counted, and each copy gets a number from 1,
handed out in chunks so that no one task holds all copies of a frequent item. A hash
of identifier, size and number spreads the items evenly over packers; a packer
streams its items in their order and holds only the open bins. So the same items
give the same containers on every run and in any input order. A packer has about
``items_per_packer`` items, of which the last bins left open are all that the split costs.

Defined cases: null and negative sizes count as 0; an item of size 0 takes a place
in the best container and no space; null identifiers and repeated rows are items
of their own, whose containers may be exchanged among equals; ties in free space go to the container opened first; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN_BINS = 64
ITEMS_PER_PACKER = 20_000
#: Containers of one packer are numbered from its own number times this.
PACKER_STRIDE = 1 << 40
_BATCH = 50_000
_COPIES = 65_536


class Packer:
    """Open containers by free space; every placing is ``(container, place, offset)``."""

    def __init__(self, capacity: int, open_bins: int, first: int = 0) -> None:
        self.capacity, self.open_bins, self.next = capacity, open_bins, first
        self.free = 0
        self.bins: dict[int, deque[list[int]]] = {}
        self.opened = 0

    def _take(self, free: int) -> list[int]:
        waiting = self.bins[free]
        b = waiting.popleft()
        if not waiting:
            del self.bins[free]
            self.free &= ~(1 << free)
        self.opened -= 1
        return b

    def _new(self) -> list[int]:
        b, self.next = [self.next, 0, 0], self.next + 1
        return b

    def place(self, size: int) -> tuple[int, int, int]:
        """Where an item of at most the capacity goes."""
        fits = self.free >> size
        if fits:
            b = self._take(size + (fits & -fits).bit_length() - 1)
        else:
            if self.opened >= self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)
            b = self._new()
        at = (b[0], b[1], b[2])
        b[1], b[2] = b[1] + 1, b[2] + size
        rest = self.capacity - b[2]
        if rest:
            self.bins.setdefault(rest, deque()).append(b)
            self.free |= 1 << rest
            self.opened += 1
        return at

    def place_all(self, size: int) -> Iterator[tuple[int, int, int, int, int]]:
        """``(from, size, container, place, offset)`` of every piece of an item."""
        start = 0
        while size - start > self.capacity:
            yield start, self.capacity, self._new()[0], 0, 0
            start += self.capacity
        yield start, size - start, *self.place(size - start)


def _copies(items: DataFrame, chunk: int) -> DataFrame:
    """``(row_id, size, copy)``: equal items numbered from 1, without a sort and without a large group in one task."""
    counted = items.groupBy("row_id", "size").agg(F.count(F.lit(1)).alias("n"))
    chunks = counted.select("row_id", "size", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / chunk))).alias("c"))
    return chunks.select("row_id", "size", F.explode(F.sequence(F.col("c") * chunk + 1, F.least((F.col("c") + 1) * chunk, F.col("n")))).alias("copy"))


def pack(df: DataFrame, row_id: Column, size: Column, capacity: int, *, open_bins: int = OPEN_BINS, items_per_packer: int = ITEMS_PER_PACKER) -> DataFrame:
    """``(row_id, piece, piece_from, piece_size, container, place, offset)``; piece counts from 0."""
    items = df.select(row_id.alias("row_id"), F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    # The sizes are not worked out for this count, only rows are counted.
    packers = max(1, -(-df.count() // items_per_packer))
    spread = _copies(items, _COPIES).repartition(packers, F.xxhash64("row_id", "size", "copy")).sortWithinPartitions("row_id", "size", "copy")
    kind = items.schema["row_id"].dataType
    longs = ("piece", "piece_from", "piece_size", "container", "place", "offset")
    out = T.StructType([T.StructField("row_id", kind), *(T.StructField(c, T.LongType()) for c in longs)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(capacity, open_bins, TaskContext.get().partitionId() * PACKER_STRIDE)
        rows: list[tuple] = []
        for b in batches:
            for i, s in zip(b["row_id"], b["size"]):
                for k, at in enumerate(packer.place_all(s)):
                    rows.append((i, k, *at))
                    if len(rows) >= _BATCH:
                        yield pd.DataFrame(rows, columns=["row_id", *longs])
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["row_id", *longs])

    return spread.mapInPandas(run, out)
