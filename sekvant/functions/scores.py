"""Scores, thresholds and coordinates of hits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A hit passes with this much model coverage (percent), E-value, accuracy and score per model position.
MIN_COVERAGE, MAX_EVALUE, MIN_ACCURACY, MIN_NORM = 20.0, 1e-3, 0.5, 0.1
#: Tiers of sub-model scores by the sub-model's size, highest first.
PROTEIN_TIERS = {
    96: [(30.0, "confirmed_100"), (20.0, "probable_99.9"), (15.0, "probable_99"), (10.0, "probable_91")],
    64: [(15.0, "confirmed_100"), (10.0, "probable_97")],
    48: [(15.0, "confirmed_100"), (10.0, "probable_97")],
    32: [(10.0, "probable_97")],
}
NUCLEOTIDE_TIERS = {
    192: [(20.0, "confirmed_100"), (0.0, "probable_90"), (-20.0, "probable_87")],
    128: [(50.0, "confirmed_100"), (-5.0, "probable_87")],
    64: [(10.0, "confirmed_100"), (5.0, "probable_70")],
}
SMALL_TIERS = [(20.0, "confirmed_100"), (15.0, "probable_99"), (10.0, "probable_90")]


def norm_score(score: Column = None, model_len: Column = None) -> Column:
    """Score per model position."""
    return (F.col("dom_score") if score is None else score) / (F.col("query_len") if model_len is None else model_len)


def model_coverage() -> Column:
    """Percent of the model that is aligned."""
    return F.lit(100.0) * (F.col("hmm_to") - F.col("hmm_from") + 1) / F.col("query_len")


def rounded(x: Column, digits: int = 2) -> Column:
    """Half to even on the scaled value, as numeric libraries round."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def passes(evalue: str = "i_evalue", round_norm: bool = False) -> Column:
    """The four thresholds; ``round_norm`` compares the rounded norm score and coverage."""
    norm, cov = norm_score(), model_coverage()
    if round_norm:
        norm, cov = rounded(norm), rounded(cov)
    return (cov >= MIN_COVERAGE) & (F.col(evalue) <= MAX_EVALUE) & (F.col("acc") >= MIN_ACCURACY) & (norm >= MIN_NORM)


def tier(score: Column, size: Column, nucleotide: bool = False) -> Column:
    """Confidence of a sub-model hit: the largest size not above the sub-model's picks the thresholds."""

    def ladder(steps: list[tuple[float, str]]) -> Column:
        out = F.lit("low")
        for threshold, name in reversed(steps):
            out = F.when(score >= threshold, name).otherwise(out)
        return out

    out = ladder(SMALL_TIERS)
    for least, steps in sorted((NUCLEOTIDE_TIERS if nucleotide else PROTEIN_TIERS).items()):
        out = F.when(size >= least, ladder(steps)).otherwise(out)
    return out


def protein_to_bases(start: Column, end: Column, strand: Column, frame: Column, length: Column) -> tuple[Column, Column]:
    """Nucleotide ends of amino-acid positions in a frame of a sequence; other strands pass unchanged."""
    a, b = (start - 1) * 3 + frame + 1, end * 3 + frame
    plus, minus = strand == "+", strand == "-"
    return F.when(plus, a).when(minus, length - b + 1).otherwise(start), F.when(plus, b).when(minus, length - a + 1).otherwise(end)


def overlap_percent(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Percent of the shorter feature; touching features share nothing."""
    shared = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    shorter = F.least(a_end - a_start + 1, b_end - b_start + 1)
    return F.when(shorter > 0, F.lit(100.0) * shared / shorter).otherwise(0.0)


def ascending_with_strand(target: Column, start: Column, end: Column) -> tuple[Column, Column, Column]:
    """Name with the strand as frame suffix, and ascending ends, of a nucleotide hit."""
    return F.concat(target, F.when(start <= end, "|fwd1").otherwise("|rev1")), F.least(start, end), F.greatest(start, end)
