"""Whole genomes: hits on windows or chromosomes as classified genomic features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sekvant.functions import names, ontology, scores
from sekvant.operators.classify import UNKNOWN, Database

#: Engines whose hits are amino-acid positions in frames, and those that give bases.
PROTEIN, FRAMESHIFT, NUCLEOTIDE = "protein", "frameshift", "nucleotide"


def _labels(db: Database, clade_map: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Adds ``order, superfamily, clade_shown, gene, clade`` of single domains."""
    model = F.col("query_name")
    if db.style == "path":
        p = names.path_labels(model)
        shown = F.when(p["clade"].startswith("Ty"), UNKNOWN).otherwise(p["clade"])
        if db.clade_only_for:
            shown = F.when(p["superfamily"].isin(*db.clade_only_for), shown).otherwise(UNKNOWN)
        return rows.withColumns({"order": p["order"], "superfamily": p["superfamily"], "clade": p["clade"], "gene": p["gene"], "clade_shown": shown})
    if db.style == "prefix":
        p = names.prefix_labels(model)
        known = clade_map.select("clade", "order", "superfamily")
        joined = rows.withColumns({"clade": p["clade"], "gene": p["gene"]}).join(known, "clade", "left")
        return joined.withColumns({"order": F.coalesce("order", F.lit("Unknown")), "superfamily": F.coalesce("superfamily", F.lit(UNKNOWN)), "clade_shown": F.col("clade")})
    return rows.withColumns({"order": F.lit(db.constant[0]), "superfamily": F.lit(UNKNOWN), "clade": F.lit(db.constant[1]), "gene": F.lit(db.constant[1]), "clade_shown": F.lit(UNKNOWN)})


def features(hits: DataFrame, db: Database, engine: str, *, lengths: DataFrame | None = None, clade_map: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """``(chrom, source, type, f_start, f_end, score, strand, phase, classification, gene, clade, coverage, evalue, gid, so_name, so_id, extract)``.

    Hits pass the thresholds by their sequence's E-value. Protein hits are mapped from
    their frame to the window, whose length ``(window_id, length)`` must be known, and
    all window positions to the chromosome. Nucleotide hits are elements and typed by
    their ontology term, others are coding parts.
    """
    needed = F.lit(True)
    for c in ("target_name", "query_name", "dom_score", "env_from", "env_to", "query_len", "evalue"):
        needed &= F.col(c).isNotNull()
    rows = hits.where(needed & ~F.isnan("dom_score") & (F.col("query_len") > 0)).where(scores.passes("evalue"))
    suffix = names.frame_suffix(F.col("target_name"))
    rows = rows.withColumns({"window_id": suffix["base"], "sign": suffix["strand"], "no": suffix["frame"].try_cast("int")})
    if engine == PROTEIN:
        rows = rows.join(lengths.select("window_id", F.col("length").alias("w_len")), "window_id")
        low, high = scores.protein_to_bases(F.col("env_from"), F.col("env_to"), F.col("sign"), F.col("no"), F.col("w_len"))
        phase: Column = F.col("no").cast("string")
        extract = F.struct(F.col("target_name").alias("key"), F.col("env_from").alias("from"), F.col("env_to").alias("to"), F.lit("+").alias("strand"), F.lit("aa").alias("src"))
    else:
        low, high, phase = F.col("ali_from"), F.col("ali_to"), F.lit(".")
        extract = F.struct(F.col("window_id").alias("key"), F.col("ali_from").alias("from"), F.col("ali_to").alias("to"), F.col("sign").alias("strand"), F.lit("win" if engine == FRAMESHIFT else "raw").alias("src"))
    window = names.window_parts(F.col("window_id"))
    shift = F.coalesce(window["w_start"] - 1, F.lit(0))
    rows = rows.withColumns({"chrom": window["chrom"], "a": low + shift, "b": high + shift, "phase": phase, "extract": extract})
    rows = _labels(db, clade_map, rows.withColumns({"f_start": F.least("a", "b"), "f_end": F.greatest("a", "b"), "score": scores.rounded(scores.norm_score(), 3), "coverage": scores.model_coverage()}))
    rows = rows.withColumns({"classification": names.tidy_label(F.col("order"), F.col("superfamily"), F.col("clade_shown")), "gid": F.concat("chrom", F.lit(":"), "f_start", F.lit("-"), "f_end", F.lit("|"), "query_name")})
    if aliases is not None:
        rows = ontology.lookup(rows, aliases)
    else:
        rows = rows.withColumns({"so_name": F.lit(ontology.FALLBACK[0]), "so_id": F.lit(ontology.FALLBACK[1]), "gff_type": F.lit(ontology.FALLBACK[0])})
    kind = F.col("gff_type") if engine == NUCLEOTIDE else F.lit("CDS")
    return rows.select("chrom", F.lit("sekvant").alias("source"), kind.alias("type"), "f_start", "f_end", "score", F.col("sign").alias("strand"), "phase", "classification", "gene", "clade", "coverage", "evalue", "gid", "so_name", "so_id", "extract")


def attribute_text() -> Column:
    """The ninth GFF3 column of a feature."""
    from sekvant.sources.writers import number_text

    parts = (("ID", F.col("gid")), ("Name", F.concat("clade", F.lit("-"), "gene")), ("Classification", F.col("classification")), ("gene", F.col("gene")), ("clade", F.col("clade")), ("coverage", number_text(F.col("coverage"), "{:.1f}")), ("evalue", number_text(F.col("evalue"), "{:g}")), ("score", number_text(F.col("score"), "{:.3f}")), ("Ontology_term", F.col("so_id")), ("so_name", F.col("so_name")))
    return F.concat_ws(";", *(F.concat(F.lit(f"{k}="), v) for k, v in parts))


def gff_lines(resolved: DataFrame) -> DataFrame:
    """GFF3 lines of features, to be written in order of place."""
    from sekvant.sources.writers import tab

    return resolved.select("chrom", "f_start", "gid", tab("chrom", "source", "type", "f_start", "f_end", "score", "strand", "phase", attribute_text()).alias("line"))


def feature_sequences(resolved: DataFrame, frames: DataFrame, windows: DataFrame, genome: DataFrame) -> DataFrame:
    """``(gid, src, head, seq)``: each feature's own sequence from its frame, window or chromosome.

    The three sources are ``(key, seq)``; a missing key gives an empty sequence.
    """
    from sekvant.functions.sequences import slice_of

    parts = []
    for src, texts in (("aa", frames), ("win", windows), ("raw", genome)):
        rows = resolved.where(F.col("extract.src") == src).withColumn("key", F.col("extract.key")).join(texts.select("key", "seq"), "key", "left")
        cut = slice_of(F.col("seq"), F.col("extract.from"), F.col("extract.to"), F.col("extract.strand"))
        parts.append(rows.select("gid", F.lit(src).alias("src"), F.concat("gid", F.lit("#"), "classification").alias("head"), F.coalesce(cut, F.lit("")).alias("seq")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
