"""Two-step searches: cheap sub-model screening, then verification of few pairs.

The search kernels are outside programs; these operators decide what to search and
combine what was found, as joins over hit tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sekvant.functions import names, scores
from sekvant.operators import heavy_keys
from sekvant.operators.best import best_row

#: Least sub-model scores; rounds, neighbours added, E-value that ends a family's search, hits that do not improve, neighbours left out.
MIN_PROTEIN_SCORE, MIN_NUCLEOTIDE_SCORE = 10.0, -20.0
MAX_ROUNDS, EXPAND, EJECT_EVALUE, DECLINE_LIMIT, REACH = 5, 10, 1e-10, 3, 50


def best_submodel(hits: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """``(target_name, parent, score, size)``: best sub-model hit per frame and parent model.

    ``parents`` maps ``query_name`` to ``(parent, size)``; a model without a parent is its own.
    """
    hits = hits.select("target_name", "query_name", "query_len", "dom_score")
    if parents is None:
        rows = hits.withColumns({"parent": F.col("query_name"), "size": F.col("query_len")})
    else:
        rows = hits.join(parents, "query_name", "left").withColumns({"parent": F.coalesce("parent", "query_name"), "size": F.coalesce("size", "query_len")})
    rank = F.struct(F.col("dom_score").alias("score"), (-F.col("size")).alias("s"))
    best = rows.groupBy("target_name", "parent").agg(F.max(rank).alias("b"))
    return best.select("target_name", "parent", F.col("b.score").alias("score"), (-F.col("b.s")).alias("size"))


def screened(candidates: DataFrame, families: DataFrame, *, nucleotide: bool = False) -> DataFrame:
    """Candidates above the least score, ranked per frame and family; the first is to be verified.

    ``families`` maps ``parent`` to ``family``. Secondary rows always use the protein tiers.
    """
    least = MIN_NUCLEOTIDE_SCORE if nucleotide else MIN_PROTEIN_SCORE
    rows = candidates.where(F.col("score") >= least).join(families, "parent")
    rank = F.row_number().over(Window.partitionBy("target_name", "family").orderBy(F.desc("score"), "parent"))
    rows = rows.withColumn("is_secondary", rank > 1)
    size = F.col("size")
    confidence = F.when(F.col("is_secondary"), scores.tier(F.col("score"), size)).otherwise(scores.tier(F.col("score"), size, nucleotide))
    return rows.select("target_name", "family", F.col("parent").alias("model"), F.col("score").alias("facet_score"), F.col("size").alias("facet_m"), confidence.alias("confidence"), "is_secondary")


def verified(ranked: DataFrame, hits: DataFrame) -> DataFrame:
    """Adds ``verified`` by frame and ``full_score`` by frame and model from the full search of the first candidates."""
    tried = ranked.where(~F.col("is_secondary")).select("target_name", F.col("model").alias("query_name"))
    found = hits.join(tried, ["target_name", "query_name"], "left_semi")
    full = found.groupBy("target_name", F.col("query_name").alias("model")).agg(F.max("dom_score").alias("full_score"))
    seen = found.select("target_name").distinct().withColumn("verified", F.lit(True))
    return ranked.join(full, ["target_name", "model"], "left").join(seen, "target_name", "left").withColumns({"full_score": F.coalesce("full_score", F.lit(0.0)), "verified": F.coalesce("verified", F.lit(False))})


def without_signal(frames: DataFrame, candidates: DataFrame) -> DataFrame:
    """Frames no sub-model hit at all: they go to the full search."""
    return frames.join(candidates.select("target_name").distinct(), "target_name", "left_anti")


def missing_families(found: DataFrame, families: DataFrame) -> DataFrame:
    """``(target_name, family)``: families that a classified frame lacks.

    Every frame meets every family, but families are a fixed vocabulary: they ride
    along as one array and are subtracted per frame.
    """
    every = families.select("family").distinct().agg(F.array_sort(F.collect_list("family")).alias("every")).scalar()
    have = found.groupBy("target_name").agg(F.collect_set("family").alias("have"))
    return have.select("target_name", F.explode(F.array_except(every, F.col("have"))).alias("family"))


def missing_searches(missing: DataFrame, families: DataFrame, *, batch: int = 100) -> DataFrame:
    """``(query_name, batch, target_name)``: frames to search with every model of a family they lack.

    Batches of a model hold ``batch`` frames, by exact numbering; the last may be short.
    """
    pairs = missing.join(families.select(F.col("parent").alias("query_name"), "family").distinct(), "family").select("query_name", "target_name").distinct()
    return heavy_keys.numbered(pairs, "query_name", "target_name", chunk_rows=batch).select(F.col("k").alias("query_name"), F.col("chunk").alias("batch"), F.col("v").alias("target_name"))


def search_cost(models: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(query_name, n_frames, cost, place)``: squared length times frames, dearest model first."""
    n = pairs.groupBy("query_name").agg(F.count_distinct("target_name").alias("n_frames"))
    rows = n.join(models.groupBy(F.col("name").alias("query_name")).agg(F.max("m").alias("m")), "query_name").withColumn("cost", F.col("m").cast("bigint") * F.col("m") * F.col("n_frames"))
    # As many rows as models.
    return rows.select("query_name", "n_frames", "cost", F.row_number().over(Window.orderBy(F.desc("cost"), "query_name")).alias("place"))


def models_to_search(families: DataFrame, missing: DataFrame) -> DataFrame:
    """``(family, models, frames)``: per missing family its models and the frames that lack it, regrouped."""
    named = families.groupBy("family").agg(F.array_sort(F.collect_set("parent")).alias("models"))
    return missing.groupBy("family").agg(F.count_distinct("target_name").alias("n_frames")).join(named, "family")


def facet_stages(frames: DataFrame, candidates: DataFrame, families: DataFrame, hits: DataFrame, *, nucleotide: bool = False, verify: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The two-step search from end to end: classified frames, and all its hits with the stage they come from.

    ``candidates`` are the screen's best sub-model hits, ``hits`` what full searches give.
    First candidates per frame and family are verified; frames that were verified are
    searched with the models of the families they lack; frames without any sub-model hit
    are searched with all models. Stages are told apart by ``stage``; their union keeps all rows.
    """
    ranked = screened(candidates, families, nucleotide=nucleotide)
    strict = hits if verify is None else hits.where(verify)
    classified = verified(ranked, strict)
    key = ["target_name", "query_name"]
    tried = ranked.where(~F.col("is_secondary")).select("target_name", F.col("model").alias("query_name")).distinct()
    confirmed = strict.join(tried, key, "left_semi").withColumn("stage", F.lit("verified"))
    found = classified.where("verified AND NOT is_secondary").select("target_name", "family")
    lacking = missing_families(found, families).join(families.select(F.col("parent").alias("query_name"), "family"), "family").select(*key).distinct()
    crossed = hits.join(lacking, key, "left_semi").withColumn("stage", F.lit("cross_family"))
    rest = hits.join(without_signal(frames, candidates).select("target_name").distinct(), "target_name", "left_semi").withColumn("stage", F.lit("fallback"))
    return classified, confirmed.unionByName(crossed).unionByName(rest)


def pair_filter(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hits of the frame and model pairs that a first pass found."""
    return hits.join(pairs.select("target_name", "query_name").distinct(), ["target_name", "query_name"], "left_semi")


def models_by_frame(hits: DataFrame) -> DataFrame:
    return hits.groupBy("target_name").agg(F.array_sort(F.collect_set("query_name")).alias("models"))


def first_confirming(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """``(target_name, query_name, rank)``: per frame the best-ranked candidate that the full search confirms."""
    rank = F.row_number().over(Window.partitionBy("target_name").orderBy(F.desc("score"), "parent"))
    ranked = candidates.select("target_name", F.col("parent").alias("query_name"), rank.alias("rank"))
    confirmed = ranked.join(hits.select("target_name", "query_name").distinct(), ["target_name", "query_name"], "left_semi")
    return confirmed.groupBy("target_name").agg(F.min_by("query_name", "rank").alias("query_name"), F.min("rank").alias("rank"))


def confirm_iteratively(frames: DataFrame, candidates: DataFrame, hits: DataFrame, edges: DataFrame, families: DataFrame, *, max_rounds: int = MAX_ROUNDS, expand: int = EXPAND, eject_evalue: float = EJECT_EVALUE, decline_limit: int = DECLINE_LIMIT, reach: int = REACH) -> DataFrame:
    """``(target_name, query_name, round, confirmed, status)``: models tried per frame and how the frame ended.

    Per round a frame tries its next candidate. A hit at or below ``eject_evalue`` ends
    the search in the model's family; a better score than the family's best so far adds
    the model's nearest neighbours; after ``decline_limit`` hits in a row that are no
    better the family is left. A frame without candidates is ``unresolved`` and has one
    row without a model, one whose rounds ran out stays ``active``; both go to the full search.

    Frames are independent, so each runs all its rounds in one place. They are dealt
    out to blocks by a hash of their name. A block first reads the ``reach`` nearest
    neighbours of the models that its hits name, once each and not once a frame, then
    its frames' candidates and hits, row by row; so what it holds is bounded by the models
    it meets. The graph reaches blocks by joins, never whole.
    """
    def kin(model: str) -> Column:
        return F.coalesce("family", names.domain_family(F.col(model)))

    blocks = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.xxhash64("target_name")
    block = F.pmod(place, F.lit(blocks)).cast("int")
    known = families.groupBy(F.col("parent").alias("m_")).agg(F.min("family").alias("family"))
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "target"))
    close = edges.select("query", "target", "score", order.alias("rank")).where(F.col("rank") <= reach)
    close = close.join(known, close["target"] == known["m_"], "left").select(F.col("query").alias("model"), "rank", F.col("target").alias("near"), kin("target").alias("family"))
    hits = hits.where(F.col("target_name").isNotNull())
    offered = candidates.where(F.col("target_name").isNotNull()).join(known, candidates["parent"] == known["m_"], "left")

    def part(rows: DataFrame, kind: int, **given: Column) -> DataFrame:
        # Texts that a kind of row lacks are empty: Arrow counts a run of nulls anew with every row.
        lacking = {"place": F.lit(None).cast("bigint"), "target_name": F.lit(""), "kind": F.lit(kind), "model": F.lit(""), "family": F.lit(""), "near": F.lit(""), "score": F.lit(None).cast("double"), "evalue": F.lit(None).cast("double")}
        return rows.select("block", *(c.alias(k) for k, c in (lacking | given).items()))

    def own(rows: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
        return rows.withColumn("block", block), {"place": place, "target_name": F.col("target_name")}

    # A block's models have no place, so they come first. Places are numbers and tell most
    # rows apart, which names that begin alike would not.
    met = hits.select(block.alias("block"), F.col("query_name").alias("model")).distinct().join(close, "model")
    rows, at = own(frames.select("target_name").distinct())
    every = part(met, 0, model=F.col("model"), near=F.col("near"), family=F.col("family"), score=F.col("rank").cast("double")).unionByName(part(rows, 1, **at))
    rows, at = own(offered.withColumn("family", kin("parent")))
    every = every.unionByName(part(rows, 2, **at, model=F.col("parent"), family=F.col("family"), score=(-F.col("score")).cast("double")))
    rows, at = own(hits)
    every = every.unionByName(part(rows, 3, **at, model=F.col("query_name"), score=F.col("dom_score").cast("double"), evalue=F.col("i_evalue").cast("double")))
    dealt = every.repartitionById(blocks, "block").sortWithinPartitions("place", "target_name", "kind", "score", "model", "family")

    def frame(queue: list[str], family: dict[str, str], found: dict[str, tuple[float, float, list[str]]]) -> tuple[list[tuple[str, int]], str]:
        tried, left_out, best_of, declines, out, status = set(), set(), {}, {}, [], "active"
        open_ = lambda m: m not in tried and m not in left_out
        for turn in range(1, max_rounds + 1):
            queue = [m for m in queue if open_(m)]
            if not queue:
                status = "exhausted"
                break
            model = queue[0]
            tried.add(model)
            out.append((model, turn))
            kin = family[model]
            if model in found:
                score, evalue, near = found[model]
                relatives = [m for m in near if family[m] == kin]
                if evalue <= eject_evalue:
                    left_out.update(relatives)
                elif score > best_of.get(kin, 0.0):
                    best_of[kin], declines[kin] = score, 0
                    queue += [m for m in near[:expand] if open_(m)]
                else:
                    declines[kin] = declines.get(kin, 0) + 1
                    if declines[kin] >= decline_limit:
                        left_out.update(relatives)
            if not any(map(open_, queue)):
                status = "resolved"
                break
        return out, status

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, known_as, target, wanted, queue, family, found = {}, {}, None, False, [], {}, {}

        def done() -> list[tuple]:
            if not wanted:
                return []
            if not queue:
                return [(target, None, None, False, "unresolved")]
            hit = {}
            for m, (score, evalue) in found.items():
                near = graph.get(m, ())
                family.update(near)
                hit[m] = (score, evalue, [x for x, _ in near])
            tried, status = frame(queue, family, hit)
            return [(target, m, turn, m in hit, status) for m, turn in tried]

        def table(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["target_name", "query_name", "round", "confirmed", "status"]).astype({"round": "Int32"})

        for b in batches:
            rows = []
            for name, kind, model, kin, near, score, evalue in zip(*(b[c].tolist() for c in ("target_name", "kind", "model", "family", "near", "score", "evalue"))):
                if name != target:
                    rows += done()
                    target, wanted, queue, family, found = name, False, [], {}, {}
                if kind == 0:
                    graph.setdefault(model, []).append(known_as.setdefault((near, kin), (near, kin)))
                elif kind == 1:
                    wanted = True
                elif kind == 2:
                    queue.append(model)
                    family[model] = kin
                elif model not in found:
                    found[model] = (score, evalue)
                else:
                    found[model] = (max(score, found[model][0]), min(evalue, found[model][1]))
            yield table(rows)
        yield table(done())

    return dealt.mapInPandas(run, "target_name string, query_name string, round int, confirmed boolean, status string")


def iterative_stages(confirmed: DataFrame, hits: DataFrame) -> DataFrame:
    """All hits of the iterative search with their stage: confirmed ones, and for frames that are not resolved the rest.

    Frames that never had a candidate meet all models; others only those they have not tried.
    What a frame tried, a model a round, is one row, so hits meet it in one join.
    """
    per = confirmed.groupBy("target_name").agg(F.collect_set("query_name").alias("tried_"), F.max(F.col("status") != "resolved").alias("open_"))
    stage = F.when(F.array_contains("tried_", F.col("query_name")), "confirmed").when(F.col("open_"), "fallback")
    return hits.join(per, "target_name").withColumn("stage", stage).where(F.col("stage").isNotNull()).drop("tried_", "open_")
