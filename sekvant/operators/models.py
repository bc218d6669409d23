"""Profile models: their similarity graph, decomposition and size statistics."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters in the order of a profile's columns.
ALPHABETS = {"amino": "ACDEFGHIKLMNPQRSTVWY", "dna": "ACGT"}
PROTEIN_WINDOWS, NUCLEOTIDE_WINDOWS = (96, 64, 48, 32), (192, 128, 64)


def shared_element_edges(hits: DataFrame) -> DataFrame:
    """``(query, target, score)``: in how many elements two models both occur.

    Meant for selected domains, of which an element has at most one per domain type,
    so its pairs are few; they are counted on the map side.
    """
    pairs = hits.select("base_seq", "query_name").distinct()
    sets = pairs.groupBy("base_seq").agg(F.array_sort(F.collect_list("query_name")).alias("m")).where(F.size("m") > 1)
    first = sets.select("m", F.posexplode("m").alias("i", "query"))
    both = first.select("query", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("target"))
    counted = both.groupBy("query", "target").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return counted.unionByName(counted.select(F.col("target").alias("query"), F.col("query").alias("target"), "score"))


def neighbours(edges: DataFrame, k: int | None = None) -> DataFrame:
    """Each model's neighbours by falling score; the first ``k``, or all for none and zero."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "target"))
    ranked = edges.where(F.col("query") != F.col("target")).withColumn("rank", rank)
    return ranked.where(F.col("rank") <= k) if k else ranked


def traversal(edges: DataFrame, entry: str, *, breadth: int = 10, most_edges: int = 2_000_000) -> Iterator[tuple[str, float]]:
    """Models with the score that led to them, in best-first order, the entry first.

    The best-scoring open model is visited next, on equal scores the one found first;
    its ``breadth`` best neighbours become open unless visited, so a later and better
    edge to an open model counts. Neighbour lists of a graph up to ``most_edges`` are taken at
    once; of a larger one those of all open models whenever one is missing.
    """
    ranked = neighbours(edges, breadth).select("query", "target", "score", "rank")
    small = ranked.limit(most_edges + 1).count() <= most_edges
    near: dict[str, list[tuple[str, float]]] = {}

    def fetch(names: set[str] | None) -> None:
        rows = ranked if names is None else ranked.where(F.col("query").isin(*names))
        for r in sorted(rows.collect(), key=lambda r: (r["query"], r["rank"])):
            near.setdefault(r["query"], []).append((r["target"], r["score"]))
        for n in names or ():
            near.setdefault(n, [])

    if small:
        fetch(None)
    visited, heap, turn = set(), [(-float("inf"), 0, entry)], 0
    while heap:
        score, _, model = heapq.heappop(heap)
        if model in visited:
            continue
        visited.add(model)
        yield model, -score
        if not small and model not in near:
            fetch({model, *(m for _, _, m in heap if m not in near)})
        for target, s in near.get(model, []):
            if target not in visited:
                turn += 1
                heapq.heappush(heap, (-s, turn, target))


def consensus_edges(models: DataFrame, *, block: int = 256, least: float = 0.0) -> DataFrame:
    """``(query, target, score)``: every model against every model's consensus, scored without gaps; scores above ``least``.

    ``models`` has ``(name, alphabet, consensus, match)``. Searching all against all is the
    graph's meaning: consensuses, in blocks of ``block``, meet the models as a stated
    query set, so a task holds one block and streams the models.
    """
    spots = models.where(F.col("consensus").isNotNull()).select(F.col("name").alias("target"), "consensus", F.pmod(F.xxhash64("name"), F.lit(2**31 - 1)).alias("h"))
    n = spots.count()
    blocks = spots.withColumn("b", F.pmod("h", F.lit(max(1, -(-n // block))))).groupBy("b").agg(F.collect_list(F.struct("target", "consensus")).alias("targets"))
    asked = models.where(F.col("match").isNotNull()).select(F.col("name").alias("query"), "alphabet", "match", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(1, -(-n // block)) - 1).cast("bigint"))).alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for query, alphabet, match, targets in zip(batch["query"], batch["alphabet"], batch["match"], batch["targets"]):
                letters = ALPHABETS["amino" if alphabet == "amino" else "dna"]
                p = np.array([np.asarray(x, dtype=float) for x in match])
                odds = np.where(p > 0, np.log2(np.where(p > 0, p, 1.0) * p.shape[1]), -100.0)
                found = best_ungapped(odds, [t["consensus"].upper() for t in targets], letters)
                rows += [(query, t["target"], float(x)) for t, x in zip(targets, found) if x > least]
            yield pd.DataFrame(rows, columns=["query", "target", "score"])

    return asked.join(blocks, "b").select("query", "alphabet", "match", "targets").mapInPandas(run, "query string, target string, score double")


def best_ungapped(odds: np.ndarray, texts: list[str], letters: str) -> np.ndarray:
    """For every text the largest sum of a run on any diagonal of it and a score matrix by position and letter; other letters score 0."""
    place = np.full(0x110000, len(letters), dtype=np.int32)
    place[[ord(c) for c in letters]] = np.arange(len(letters))
    codes = np.full((len(texts), max(map(len, texts), default=0)), len(letters) + 1)
    for i, t in enumerate(texts):
        codes[i, : len(t)] = place[[ord(c) for c in t]]
    best, here = np.zeros(len(texts)), np.zeros((len(texts), codes.shape[1] + 1))
    for row in odds:
        # Behind a text's end no run goes on.
        score = np.concatenate([row, [0.0, -np.inf]])[codes]
        here[:, 1:] = np.maximum(here[:, :-1] + score, 0.0)
        best = np.maximum(best, here.max(axis=1))
    return best


def graph_report(edges: DataFrame, families: DataFrame) -> DataFrame:
    """``(family, n_models, within, across)``: models and edges of every family."""
    a = families.select(F.col("parent").alias("query"), "family")
    b = families.select(F.col("parent").alias("target"), F.col("family").alias("other"))
    linked = edges.join(a, "query").join(b, "target")
    counts = linked.groupBy("family").agg(F.count_if(F.col("family") == F.col("other")).alias("within"), F.count_if(F.col("family") != F.col("other")).alias("across"))
    return a.groupBy("family").agg(F.count(F.lit(1)).alias("n_models")).join(counts, "family", "left").fillna(0, ["within", "across"])


def size_outliers(models: DataFrame, length: str = "m") -> DataFrame:
    """Adds ``outlier``: squared length above the upper quartile by more than two quartile ranges.

    Quartiles are the medians of the lower and upper halves; fewer than four models have no outliers.
    The quartiles come from the distinct lengths' counts, so no column is collected.
    """
    counts = models.groupBy(F.col(length).alias("l")).agg(F.count(F.lit(1)).alias("c"))
    run = counts.withColumn("upto", F.sum("c").over(Window.orderBy("l")))
    total = F.sum("c")
    n = counts.agg(F.coalesce(total, F.lit(0)).alias("n")).scalar()
    half = F.floor(F.col("n") / 2)
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("l").cast("double") * F.col("l")))
    start = F.col("n") - half
    known = run.withColumns({"n": n}).withColumns({"low1": F.floor((half + 1) / 2), "low2": F.floor((half + 2) / 2), "high1": start + F.floor((half + 1) / 2), "high2": start + F.floor((half + 2) / 2)})
    low, high = ((at(F.col(f"{x}1")) + at(F.col(f"{x}2"))) / 2 for x in ("low", "high"))
    bounds = known.agg(F.struct(low.alias("q1"), high.alias("q3"), F.max("n").alias("n"))).scalar()
    squared = F.col(length).cast("double") * F.col(length)
    return models.withColumn("b_", bounds).withColumn("outlier", (F.col("b_.n") >= 4) & (squared > F.col("b_.q3") + 2 * (F.col("b_.q3") - F.col("b_.q1")))).drop("b_")


def position_scores(odds: Column) -> Column:
    """Largest log odds of every position of a matrix."""
    return F.transform(odds, F.array_max)


def log_odds(probabilities: Column, background: Column) -> Column:
    """log2 of each probability over its background; -100 for zero."""
    return F.zip_with(probabilities, background, lambda p, b: F.when(p > 0, F.log2(p / b)).otherwise(-100.0))


def window_sums(positions: DataFrame, size: int) -> DataFrame:
    """``(model, pos, total)``: sum of the scores of every whole window by its first position."""
    w = Window.partitionBy("model").orderBy("pos").rowsBetween(0, size - 1)
    return positions.withColumns({"total": F.sum("score").over(w), "n": F.count(F.lit(1)).over(w)}).where(F.col("n") == size).select("model", "pos", "total")


def greedy_windows(s: np.ndarray, size: int, *, most: int | None = None, least_mean: float = 0.0, overlap: float = 0.0, least_cover: float = 0.0, most_cover: float = 1.0) -> list[tuple[int, int, float]]:
    """Best windows of a score track, ``(start, end, score)`` from 0 with the end outside, by position.

    Each step takes the best window that shares at most the allowed part with those
    taken; it stops at the wished number or cover, or when the mean is too low and the
    least cover is reached. A track shorter than a window is taken whole.
    """
    m = len(s)
    if m < size:
        return [(0, m, float(s.sum()))]
    cut = np.concatenate([[0.0], np.cumsum(s)])
    total = cut[size:] - cut[:-size]
    allowed = int(size * overlap)
    used, out = np.zeros(m, dtype=np.int64), []
    while most is None or len(out) < most:
        cover = int(used.sum())
        if cover / m >= most_cover:
            break
        taken = np.concatenate([[0], np.cumsum(used)])
        open_ = taken[size:] - taken[:-size] <= allowed
        if not open_.any():
            break
        at = int(np.argmax(np.where(open_, total, -np.inf)))
        if total[at] / size < least_mean and cover / m >= least_cover:
            break
        out.append((at, at + size, float(total[at])))
        if used[at : at + size].all():
            break
        used[at : at + size] = 1
    return sorted(out)


def decompose(positions: DataFrame, *, windows: tuple[int, ...] = PROTEIN_WINDOWS, overlap: float = 0.5, least_mean: float = 0.0) -> DataFrame:
    """``(model, part_from, part_to, score)``: every model in windows of the largest tier below its length.

    A model shorter than the smallest tier, or without a window, stays whole. A model's
    positions are bounded by its length, so they travel as one array.
    """
    tracks = positions.groupBy("model").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "score"))), lambda x: x["score"]).alias("track"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for model, track in zip(b["model"], b["track"]):
                s = np.asarray(track, dtype=float)
                size = next((w for w in windows if w < len(s)), None) if len(s) >= windows[-1] else None
                found = greedy_windows(s, size, overlap=overlap, least_mean=least_mean) if size else []
                rows += [(model, a, e, t) for a, e, t in found or [(0, len(s), float(s.sum()))]]
            yield pd.DataFrame(rows, columns=["model", "part_from", "part_to", "score"])

    return tracks.mapInPandas(run, "model string, part_from int, part_to int, score double")


def spliced(models: DataFrame, parts: DataFrame) -> DataFrame:
    """Sub-models ``(name, parent, m, match, insert, trans)`` of models with matrix columns by position from 0."""
    cut = lambda c: F.slice(c, F.col("part_from") + 1, F.col("part_to") - F.col("part_from"))
    rows = parts.withColumnRenamed("model", "name").join(models, "name")
    # Inserts and transitions have an entry before the first position, which is the one of the parent's begin.
    edge = lambda c: F.concat(F.slice(c, F.lit(1), F.lit(1)), F.slice(c, F.col("part_from") + 2, F.col("part_to") - F.col("part_from")))
    more = [c for c in ("alphabet",) if c in models.columns]
    return rows.select(F.format_string("%s__sub_%d-%d", "name", "part_from", "part_to").alias("sub_name"), F.col("name").alias("parent"), (F.col("part_to") - F.col("part_from")).alias("m"), *more, cut("match").alias("match"), *(edge(c).alias(c) for c in ("insert", "trans")))


def ungapped_score(track: Column) -> Column:
    """Best sum of a run of positions: an approximate stand-in for a profile search, for tests."""
    zero = F.struct(F.lit(0.0).alias("here"), F.lit(0.0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        here = F.greatest(a["here"] + x, F.lit(0.0))
        return F.struct(here.alias("here"), F.greatest(a["best"], here).alias("best"))

    return F.aggregate(track, zero, step, lambda a: a["best"])
