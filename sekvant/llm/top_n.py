"""The N highest-scoring items of every group, by simultaneous bisection.

Every row gets an order-preserving code of two 64-bit halves: the score's bits,
made sortable as an integer, and the complement of the identifier, so that of
equal scores the smaller identifier has the larger code. All groups search their
cutoff code at once. A pass counts, for every open group, the rows between the
midpoints that the next ``bits`` bisection steps could visit (2**bits sections of
the group's bracket) together with each section's smallest and largest code; the
bracket shrinks to the section that holds the N-th row and to the codes that
really occur there. A group is closed once its bracket holds exactly as many rows
as it still needs; if only equal scores are left, the search goes on in the
identifiers. Rows outside their group's bracket are dropped between passes, so
the passes after the first touch few rows. In the end rows are compared with
their group's cutoff.

Nothing sorts a group or holds it in one task: counts are combined on the map
side. Cutoffs reach the rows by broadcast while their keys fit in
``broadcast_bytes``; beyond that only groups above one ten-thousandth of all rows
are broadcast (so at most 10,000) and the rest are joined by a shuffle.

Defined cases: rows with a null group part, null or NaN score, or null identifier
are left out; infinities are ordinary scores and 0.0 equals -0.0; rows equal in
group, score and identifier are one item; groups of N or fewer keep all rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sekvant.staging import measured, release, row_bytes, staged

BITS = 6
BROADCAST_BYTES = 32 << 20
HOT_SHARE = 10_000
_LEAST = -(2**63)


def score_code(score: Column) -> Column:
    """A bigint that sorts as the double does; NaN has none and must be left out before."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.when(score == 0, F.lit(0.0)).otherwise(score.cast("double"))).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(2**63 - 1)))


def code_score(code: Column) -> Column:
    """The double of a score code."""
    bits = F.when(code >= 0, code).otherwise(code.bitwiseXOR(F.lit(2**63 - 1)))
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def _meet(rows: DataFrame, groups: DataFrame, keys: list[str], size: int, total: int, broadcast_bytes: int, how: str = "inner") -> DataFrame:
    """Join of rows and their group's state; ``groups`` is staged, takes ``size`` bytes and has ``n``, its number of rows."""
    if size <= broadcast_bytes:
        return rows.join(F.broadcast(groups), keys, how)
    hot = groups.where(F.col("n") * HOT_SHARE > total)
    cold = groups.where(F.col("n") * HOT_SHARE <= total)
    few = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(few.join(cold.hint("shuffle_merge"), keys, how))


def _sections(active: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """One pass: the section counts of every open group, and the bracket they leave."""
    in_half = F.when(F.col("half") == 0, F.col("hi")).otherwise(F.col("lo"))
    counted = (
        active.withColumn("v", in_half)
        .withColumn("section", F.expr("shiftright(v, shift) - shiftright(low, shift)"))
        .groupBy(*keys, "section")
        .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"), F.min("lo").alias("lo_low"), F.max("lo").alias("lo_high"), *(F.first(x).alias(x) for x in ("n", "half", "need", "cut_hi")))
    )
    above = F.sum("c").over(Window.partitionBy(*keys).orderBy(F.desc("section")))
    held = counted.withColumn("above", above).where((F.col("above") >= F.col("need")) & (F.col("above") - F.col("c") < F.col("need")))
    left = held.withColumn("need", F.col("need") - F.col("above") + F.col("c"))
    done = F.col("c") == F.col("need")
    # Only one score is left in the bracket: go on in the other half of the code.
    turn = ~done & (F.col("half") == 0) & (F.col("low") == F.col("high"))
    state = left.select(
        *keys,
        "n",
        done.alias("done"),
        F.when(turn, 1).otherwise(F.col("half")).alias("half"),
        F.when(turn, F.col("low")).otherwise(F.col("cut_hi")).alias("cut_hi"),
        F.when(turn, F.col("lo_low")).otherwise(F.col("low")).alias("low"),
        F.when(turn, F.col("lo_high")).otherwise(F.col("high")).alias("high"),
        "need",
    )
    return _with_shift(state, bits)


def _with_shift(state: DataFrame, bits: int) -> DataFrame:
    """How many low bits a section spans, such that a bracket has at most about 2**bits sections."""
    span = F.col("high").cast("double") - F.col("low").cast("double") + 1.0
    return state.withColumn("shift", F.greatest(F.lit(0), F.ceil(F.log2(span)) - bits).cast("int"))


def _in_bracket() -> Column:
    return F.when(F.col("half") == 0, F.col("hi").between(F.col("low"), F.col("high"))).otherwise((F.col("hi") == F.col("cut_hi")) & F.col("lo").between(F.col("low"), F.col("high")))


def top_n(df: DataFrame, groups: list[Column], score: Column, row_id: Column, n: int, *, bits: int = BITS, broadcast_bytes: int = BROADCAST_BYTES, unique_ids: bool = False) -> DataFrame:
    """``(g0.., score, row_id)`` of the N first items per group; ``unique_ids`` spares the search for repeated items."""
    keys = [f"g{i}" for i in range(len(groups))]
    score = score.cast("double")
    rows = df.select(*(g.alias(k) for g, k in zip(groups, keys)), score.alias("s"), row_id.cast("bigint").alias("i"))
    rows = rows.where(reduce(Column.__and__, (F.col(k).isNotNull() for k in [*keys, "s", "i"])) & ~F.isnan("s"))
    rows = rows.select(*keys, score_code(F.col("s")).alias("hi"), F.bitwise_not("i").alias("lo"))
    rows, seen = measured(rows if unique_ids else rows.distinct(), "top-n-rows", total=F.count(F.lit(1)))
    total = seen["total"]

    ends = [f(c).alias(f"{c}_{x}") for c in ("hi", "lo") for f, x in ((F.min, "low"), (F.max, "high"))]
    start = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *ends).where(F.col("n") > n)
    tied = F.col("hi_low") == F.col("hi_high")
    state = start.select(
        *keys,
        "n",
        F.lit(False).alias("done"),
        tied.cast("int").alias("half"),
        F.col("hi_low").alias("cut_hi"),
        F.when(tied, F.col("lo_low")).otherwise(F.col("hi_low")).alias("low"),
        F.when(tied, F.col("lo_high")).otherwise(F.col("hi_high")).alias("high"),
        F.lit(n).cast("bigint").alias("need"),
    )
    # What the next pass has to know of the state is taken while it is written.
    known = {"open": F.count_if(~F.col("done")), "size": row_bytes(*keys), "left": F.coalesce(F.sum(F.when(~F.col("done"), F.octet_length(F.concat(*(F.col(k).cast("string") for k in keys))) + 96)), F.lit(0))}
    state, seen = measured(_with_shift(state, bits), "top-n-state", **known)
    active, cutoffs, states, width = rows, [], [state], seen["size"]
    while seen["open"]:
        cutoffs.append(state.where("done"))
        held = _meet(active.select(*keys, "hi", "lo"), state.where(~F.col("done")), keys, seen["left"], total, broadcast_bytes).where(_in_bracket())
        spent = active
        if len(cutoffs) > 1:
            active = held = staged(held, "top-n-active")
        state, seen = measured(_sections(held, keys, bits), "top-n-state", **known)
        states.append(state)
        width += seen["size"]
        if spent is not active and spent is not rows:
            release(spent)
    cutoffs.append(state)
    if active is not rows:
        release(active)

    found = reduce(DataFrame.unionByName, cutoffs).select(*keys, "n", F.when(F.col("half") == 0, F.col("low")).otherwise(F.col("cut_hi")).alias("c_hi"), F.when(F.col("half") == 0, F.lit(_LEAST)).otherwise(F.col("low")).alias("c_lo"))
    found = staged(found, "top-n-cutoffs")
    for x in states:
        release(x)
    code_reached = (F.col("hi") > F.col("c_hi")) | ((F.col("hi") == F.col("c_hi")) & (F.col("lo") >= F.col("c_lo")))
    chosen = _meet(rows, found, keys, width, total, broadcast_bytes, "left").where(F.col("c_hi").isNull() | code_reached)
    return chosen.select(*keys, code_score(F.col("hi")).alias("score"), F.bitwise_not("lo").alias("row_id"))
