"""One best hit per group, and which hits count at all.

Ranks have a total order - score, then norm score, model, target, envelope, row id -
so results do not depend on partitioning. A best row per group is an argmax
aggregate, which combines on the map side; no group is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sekvant.functions import scores


def clean_hits(hits: DataFrame) -> DataFrame:
    """Hits whose columns the relational steps need are usable, with derived ``norm_score`` and ``hmm_cov``."""
    needed = ("base_seq", "target_name", "query_name", "domain_type", "dom_score", "env_from", "env_to", "query_len")
    ok = F.lit(True)
    for c in needed:
        ok &= F.col(c).isNotNull()
    rows = hits.where(ok & ~F.isnan("dom_score") & (F.col("query_len") > 0))
    rows = rows.withColumns({"domain_type": F.upper(F.trim("domain_type")), "env_from": F.least("env_from", "env_to"), "env_to": F.greatest("env_from", "env_to")})
    return rows.withColumns({"norm_score": scores.norm_score(), "hmm_cov": scores.model_coverage()})


def _tie_break(df: DataFrame) -> list[Column]:
    """Smaller model, target, envelope and id first."""
    return [F.col(c) for c in ("query_name", "target_name", "env_from", "id") if c in df.columns]


def best_row(df: DataFrame, keys: list[str], *descending: Column) -> DataFrame:
    """The first row of every group by the given columns from high to low, then by the tie-break."""
    rank = F.struct(*(F.negative(c).alias(f"d{i}") for i, c in enumerate(descending)), *(c.alias(f"t{i}") for i, c in enumerate(_tie_break(df))))
    rest = F.struct(*(F.col(c) for c in df.columns if c not in keys))
    won = df.groupBy(*keys).agg(F.min_by(rest, rank).alias("row"))
    return won.select(*(F.col(c) if c in keys else F.col(f"row.{c}") for c in df.columns))


def best_domains(hits: DataFrame, remap: dict[str, str] | None = None, *, compat_rounding: bool = False) -> DataFrame:
    """Best hit of every sequence and (remapped) domain by norm score, as column ``gene``."""
    gene = F.col("domain_type")
    for old, new in (remap or {}).items():
        gene = F.when(F.col("domain_type") == old.upper(), new).otherwise(gene)
    norm = scores.rounded(F.col("norm_score")) if compat_rounding else F.col("norm_score")
    return best_row(hits.withColumn("gene", gene), ["base_seq", "gene"], norm, F.col("dom_score"))


def selected_domains(hits: DataFrame, remap: dict[str, str] | None = None, *, compat_rounding: bool = False) -> DataFrame:
    """Best first, then the thresholds: a best hit that fails takes its whole group away."""
    return best_domains(hits, remap, compat_rounding=compat_rounding).where(scores.passes(round_norm=compat_rounding))


def best_per_family(hits: DataFrame, *, filtered: bool = False) -> DataFrame:
    """Highest domain score per sequence and family; ``filtered`` applies the thresholds first."""
    return best_row(hits.where(scores.passes()) if filtered else hits, ["base_seq", "domain_type"], F.col("dom_score"))


def best_per_frame(hits: DataFrame) -> DataFrame:
    return best_row(hits, ["target_name"], F.col("dom_score"))


def best_per_model(hits: DataFrame) -> DataFrame:
    return best_row(hits, ["target_name", "query_name"], F.col("dom_score"))


def best_with_ties(hits: DataFrame, keys: list[str]) -> DataFrame:
    """All rows that reach their group's highest score."""
    top = hits.groupBy(*keys).agg(F.max("dom_score").alias("top_score"))
    return hits.join(top, keys).where(F.col("dom_score") == F.col("top_score")).drop("top_score")
