"""Result files: lines in a total order under one name, and the tables behind them.

Large results belong in Parquet (``append_hits``) or in folders of text written in
parallel (``write_parts``); the named text files that other tools read are streamed
to the driver partition by partition, never collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sekvant.functions import names, scores, sequences
from sekvant.operators import heavy_keys
from sekvant.operators.models import ALPHABETS

SOURCE = "sekvant"
#: Statistics that search programs demand of a model, whatever they are.
PROFILE_STATISTICS = ("STATS LOCAL MSV       -9.9014  0.70957", "STATS LOCAL VITERBI  -10.7224  0.70957", "STATS LOCAL FORWARD   -4.1637  0.70957")


def write_lines(lines: DataFrame, path: str, *, order: list[str], header: str | None = None) -> int:
    """Stream ``line`` to one local file in the given order; the number of lines without the header."""
    n = 0
    with Path(path).open("w", encoding="utf-8") as f:
        if header is not None:
            f.write(header + "\n")
        for row in lines.orderBy(*order).select("line").toLocalIterator(prefetchPartitions=True):
            f.write(row["line"] + "\n")
            n += 1
    return n


def write_parts(lines: DataFrame, path: str, *, order: list[str], header: str | None = None) -> None:
    """Write ``line`` in parallel to a folder, on any storage Spark writes to.

    The parts, read by name one after another, are in order; the header has the first of them.
    """
    rows = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    if header is None:
        rows.select(F.col("line").alias("value")).write.mode("overwrite").text(path)
        return
    first = rows.sparkSession.createDataFrame([(header,)], "value string")
    first.unionByName(rows.select(F.col("line").alias("value"))).write.mode("overwrite").text(path)


def write_result(lines: DataFrame, path: str, *, order: list[str], header: str | None = None, parts: bool = False) -> int:
    """One named local file, or with ``parts`` a folder written in parallel, of which no lines are counted."""
    if not parts:
        return write_lines(lines, path, order=order, header=header)
    write_parts(lines, path, order=order, header=header)
    return 0


def number_text(x: Column, form: str = "{!r}") -> Column:
    """Numbers as text in Python's notation, which the formats use; nulls stay null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(form.format, na_action="ignore")

    return run(x.cast("double"))


def create_store(spark: SparkSession, path: str, tables: dict[str, str]) -> None:
    """Empty tables by name and columns, where they are not there yet."""
    from sekvant.sources.readers import _exists

    for name, columns in tables.items():
        if not _exists(spark, f"{path}/{name}.parquet"):
            spark.createDataFrame([], columns).write.parquet(f"{path}/{name}.parquet")


def profile_text(models: DataFrame) -> DataFrame:
    """``(sub_name, line)``: models ``(sub_name, m, alphabet, match, insert, trans)`` as text that the profile reader takes.

    Probabilities are written as negative logarithms, zero as a star; ``insert`` and
    ``trans`` have an entry before the first position.
    """

    def number(x: float) -> str:
        return "*" if x <= 0 else f"{-math.log(x):.5f}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, m, alphabet, match, insert, trans in zip(b["sub_name"], b["m"], b["alphabet"], b["match"], b["insert"], b["trans"]):
                letters = ALPHABETS["amino" if alphabet == "amino" else "dna"]
                row = lambda xs: "          " + "  ".join(map(number, xs))
                text = ["HMMER3/f", f"NAME  {name}", f"LENG  {m}", f"ALPH  {alphabet}", *PROFILE_STATISTICS, "HMM          " + "        ".join(letters), "            m->m     m->i     m->d     i->m     i->i     d->m     d->d", row(insert[0]), row(trans[0])]
                for i in range(m):
                    best = letters[max(range(len(letters)), key=lambda k: match[i][k])].lower()
                    text += [f"{i + 1:7d} " + "  ".join(map(number, match[i])) + f"  {i + 1} {best} - - -", row(insert[i + 1]), row(trans[i + 1])]
                out.append((name, "\n".join([*text, "//"])))
            yield pd.DataFrame(out, columns=["sub_name", "line"])

    return models.select("sub_name", "m", "alphabet", "match", "insert", "trans").mapInPandas(run, "sub_name string, line string")


def append_hits(hits: DataFrame, path: str, *, run_mode: str = "legacy") -> None:
    """Add hits to the table, by run and database; what is packed in names becomes columns."""
    suffix = names.frame_suffix(F.col("target_name"))
    rows = hits.withColumns({"base_seq": suffix["base"], "strand": suffix["strand"], "frame": suffix["frame"].try_cast("int"), "domain_type": names.domain_family(F.col("query_name")), "run_mode": F.lit(run_mode)})
    rows.write.mode("append").partitionBy("run_mode", "database").parquet(path)


def upsert_sequences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sequences by name; the new row replaces the old."""
    rows = old.withColumn("v", F.lit(0)).unionByName(new.withColumn("v", F.lit(1)))
    rest = [c for c in old.columns if c != "name"]
    return rows.groupBy("name").agg(F.max_by(F.struct(*rest), "v").alias("r")).select("name", *(F.col(f"r.{c}") for c in rest))


def tab(*columns: Column | str) -> Column:
    """Columns as one line; nulls are empty."""
    return F.array_join(F.array(*(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns)), "\t")


def secondary_text(secondary: str = "secondary") -> Column:
    """``db:order/superfamily/clade=score`` of every call, or a dot."""
    text = F.array_join(F.transform(secondary, lambda x: F.format_string("%s:%s/%s/%s=%.3f", x["db"], x["order"], x["superfamily"], x["clade"], x["score"])), ";")
    return F.when(F.size(secondary) > 0, text).otherwise(".")


def classification_lines(calls: DataFrame, *, secondary: bool = False, ontology: bool = False, lineage: bool = False) -> tuple[str, DataFrame]:
    """Header and lines of the classification table."""
    head = ["#TE", "Order", "Superfamily", "Clade", "Complete", "Strand", "Domains"]
    cells: list[Column | str] = ["id", "order", "superfamily", "clade", "complete", "strand", "domains"]
    if secondary:
        head, cells = [*head, "SecondaryHits"], [*cells, secondary_text()]
    if ontology:
        head, cells = [*head, "SO_name", "SO_ID"], [*cells, "so_name", "so_id"]
    if lineage:
        head, cells = [*head, "Lineage"], [*cells, F.when(F.coalesce("lineage", F.lit("")) == "", ".").otherwise(F.col("lineage"))]
    return "\t".join(head), calls.select("id", tab(*cells).alias("line"))


def _domain_id() -> Column:
    return F.concat(names.gff_safe(F.col("base_seq")), F.lit("|"), "query_name")


def _domain_attributes() -> Column:
    """What is known of a domain, as GFF3 attributes; also the description of its sequences."""
    parts = (("ID", _domain_id()), ("Name", F.concat("clade", F.lit("-"), "shown")), ("gene", F.col("gene")), ("clade", F.col("clade")), ("coverage", number_text(F.col("hmm_cov"), "{:.1f}")), ("evalue", number_text(F.col("i_evalue"))), ("probability", number_text(F.col("acc"))))
    return F.concat_ws(";", *(F.concat(F.lit(f"{k}="), v) for k, v in parts))


def domain_gff_lines(domains: DataFrame) -> DataFrame:
    """GFF3 lines of domains ``(base_seq, query_name, start, end, strand, frame, gene, shown, clade, norm_score, hmm_cov, i_evalue, acc)``."""
    line = tab("base_seq", F.lit(SOURCE), F.lit("CDS"), "start", "end", number_text(scores.rounded(F.col("norm_score"))), "strand", "frame", _domain_attributes())
    return domains.select("base_seq", "start", "query_name", line.alias("line"))


def domain_table_lines(domains: DataFrame) -> tuple[str, DataFrame]:
    """Header - fixed values, its spelling is part of the format - and lines of the domain table."""
    head = "\t".join(("#id", "length", "evalue", "coverge", "probability", "score"))
    line = tab(_domain_id(), F.col("env_to") - F.col("env_from") + 1, number_text(F.col("i_evalue")), number_text(F.col("hmm_cov"), "{:.1f}"), number_text(F.col("acc")), number_text(scores.rounded(F.col("norm_score"))))
    return head, domains.select("base_seq", "start", "query_name", line.alias("line"))


def domain_records(domains: DataFrame, frames: DataFrame) -> DataFrame:
    """``(base_seq, start, query_name, head, seq)``: amino acids of the domains whose frame is there."""
    rows = domains.join(frames.select("target_name", "aa"), "target_name")
    return rows.select("base_seq", "start", "query_name", F.concat(_domain_id(), F.lit(" "), _domain_attributes()).alias("head"), sequences.slice_of(F.col("aa"), F.col("env_from"), F.col("env_to")).alias("seq"))


def fasta_lines(rows: DataFrame, head: Column, seq: Column, width: int | None = 60) -> DataFrame:
    """One multi-line record per row, next to the row's columns."""
    return rows.withColumn("line", F.concat(F.lit(">"), head, F.lit("\n"), sequences.wrapped(seq, width) if width else seq))


def library_records(seqs: DataFrame, calls: DataFrame, *, reverse: bool = True) -> DataFrame:
    """``(name, head, seq)``: every sequence named by its class, on its plus strand."""
    called = calls.select(F.col("id").alias("name"), names.tidy_label(F.col("order"), F.col("superfamily"), F.col("clade")).alias("cls"), "strand")
    rows = seqs.join(called, "name", "left")
    head = F.concat(F.substring_index("name", "#", 1), F.lit("#"), F.coalesce("cls", F.lit("Unknown")), F.lit(" "), "name")
    turned = F.when(F.col("strand") == "-", sequences.reverse_complement(F.col("seq"))).otherwise(F.col("seq")) if reverse else F.col("seq")
    return rows.select("name", head.alias("head"), turned.alias("seq"))


def peptide_records(domains: DataFrame, frames: DataFrame, calls: DataFrame) -> DataFrame:
    """``(base_seq, start, query_name, head, seq)``: amino acids of the domains of classified elements, named by class."""
    called = calls.select(F.col("id").alias("base_seq"), names.tidy_label(F.col("order"), F.col("superfamily"), F.col("clade")).alias("cls"))
    rows = domains.join(frames.select("target_name", "aa"), "target_name").join(called, "base_seq").withColumn("shown", F.col("gene"))
    head = F.concat(F.substring_index("base_seq", "#", 1), F.lit("#"), "cls", F.lit("#"), "gene", F.lit("|"), "clade", F.lit(" "), _domain_id(), F.lit(" "), _domain_attributes())
    return rows.select("base_seq", "start", "query_name", head.alias("head"), sequences.slice_of(F.col("aa"), F.col("env_from"), F.col("env_to")).alias("seq"))


def classification_rows(calls: DataFrame, mode: str) -> DataFrame:
    """Calls ``(id, database, ...)`` as rows to be stored; ``source`` is the element a call was inherited from, else ``hmm``."""
    source = F.coalesce("source", F.lit("hmm")) if "source" in calls.columns else F.lit("hmm")
    return calls.select(F.col("id").alias("seq_id"), "database", F.col("order").alias("te_order"), "superfamily", "clade", "complete", "strand", "domains", source.alias("source"), F.lit(mode).alias("mode"))


def append_classifications(calls: DataFrame, path: str, *, mode: str = "legacy") -> None:
    """Add calls to the stored classifications, by database."""
    classification_rows(calls, mode).write.mode("append").partitionBy("database").parquet(path)


def similarity_rows(blast: DataFrame, lists: DataFrame) -> DataFrame:
    """Similarity hits with the databases that classified the subject, ``unknown`` for none."""
    known = lists.withColumnRenamed("base_seq", "sseqid")
    return blast.drop("classified_by").join(known, "sseqid", "left").withColumn("classified_by", F.coalesce("classified_by", F.lit("unknown")))


def write_split(classified: DataFrame, others: DataFrame, path: str, *, parts: int = 8) -> None:
    """FASTA text of classified sequences as a database, and of the others in ``parts`` folders of like size.

    A hash of the name deals the others out, so no task sees all of them.
    """
    text = lambda df: fasta_lines(df, F.col("name"), F.col("seq"), None)
    text(classified).select(F.col("line").alias("value")).write.mode("overwrite").text(f"{path}/database")
    dealt = text(others).select(F.col("line").alias("value"), F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int").alias("part"))
    dealt.write.mode("overwrite").partitionBy("part").text(f"{path}/queries")


def frame_tier_lines(ranked: DataFrame) -> tuple[str, DataFrame]:
    """Header, fixed values of the format, and lines of verified sub-model classifications."""
    head = "\t".join(("frame", "family", "model", "facet_score", "facet_M", "confidence", "verified", "full_score", "is_secondary"))
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    return head, ranked.select("target_name", "family", "model", tab("target_name", "family", "model", number_text(F.col("facet_score"), "{:.1f}"), "facet_m", "confidence", yes("verified"), number_text(F.col("full_score"), "{:.1f}"), yes("is_secondary")).alias("line"))


def write_partitions(pairs: DataFrame, seqs: DataFrame, path: str, *, batch_size: int = 1000) -> None:
    """FASTA text by model and batch: a folder per model, a batch per ``batch_size`` sequences of a model.

    Batches are cut by exact numbering, so a model with most pairs needs no task of its own.
    """
    placed = heavy_keys.numbered(pairs.select("target_name", "query_name").distinct(), "query_name", "target_name", chunk_rows=batch_size)
    rows = placed.select(F.col("v").alias("name"), names.file_safe(F.col("k")).alias("model"), F.col("chunk").alias("batch")).join(seqs, "name")
    fasta_lines(rows, F.col("name"), F.col("seq"), None).select("model", "batch", F.col("line").alias("value")).write.mode("overwrite").partitionBy("model", "batch").text(path)


def id_registry(rows: DataFrame, kind: str) -> DataFrame:
    """``(id, name)`` of distinct names; families are hashed under a prefix, so they never meet a model's id."""
    text = F.concat(F.lit("family:"), F.col("name")) if kind == "family" else F.col("name")
    return rows.where(F.col("name").isNotNull()).select(names.stable_id(text).alias("id"), "name").distinct()


def frame_registry(rows: DataFrame) -> DataFrame:
    """``(id, name, seq_id, direction, frame)`` of distinct frame names; a name without a frame has direction and frame 0."""
    suffix = names.frame_suffix(F.col("name"))
    way = F.when(suffix["strand"] == "+", 1).when(suffix["strand"] == "-", -1).otherwise(0)
    number = F.coalesce(suffix["frame"].try_cast("int"), F.lit(0))
    return rows.where(F.col("name").isNotNull()).select("name").distinct().select(names.stable_id(F.col("name")).alias("id"), "name", names.stable_id(suffix["base"]).alias("seq_id"), way.alias("direction"), number.alias("frame"))


def register(registry: DataFrame, spark_path: str) -> None:
    """Add ids that are not stored yet."""
    spark = registry.sparkSession
    from sekvant.sources.readers import _exists

    fresh = registry.join(spark.read.parquet(spark_path).select("id"), "id", "left_anti") if _exists(spark, spark_path) else registry
    fresh.write.mode("append").parquet(spark_path)


def names_of(ids: DataFrame, registry: DataFrame) -> DataFrame:
    """``(id, name)`` for every id; null where none is registered."""
    return ids.select("id").distinct().join(registry.select("id", "name"), "id", "left")
