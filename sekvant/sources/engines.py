"""Outside search programs as partition functions, and the graph and report files around them.

A program reads FASTA records from its standard input and writes a table to its
standard output, so nothing lands on an executor's disk. Sequences go to it in
batches of bounded size, by partition; the table is parsed by the readers. Hits of
nucleotide programs are made comparable afterwards: E-values that a program gives
for a search space of one are scaled by the megabases searched.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sekvant.functions import names, scores
from sekvant.operators import best, models
from sekvant.sources import readers
from sekvant.sources.writers import number_text, tab

BATCH_BASES = 50_000_000


def available(program: str) -> bool:
    return shutil.which(program) is not None


def _fasta_batches(batches: Iterator[pd.DataFrame], most: int) -> Iterator[str]:
    text, size = [], 0
    for b in batches:
        for name, seq in zip(b["name"], b["seq"]):
            if size and size + len(seq) > most:
                yield "".join(text)
                text, size = [], 0
            text.append(f">{name}\n{seq}\n")
            size += len(seq)
    if text:
        yield "".join(text)


def piped_lines(seqs: DataFrame, command: list[str], *, batch_bases: int = BATCH_BASES) -> DataFrame:
    """Output lines ``value`` of a program fed with ``(name, seq)``; a failing program fails the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for text in _fasta_batches(batches, batch_bases):
            done = subprocess.run(command, input=text, capture_output=True, text=True, check=False)
            if done.returncode:
                raise RuntimeError(f"{command[0]} ended with {done.returncode}: {done.stderr[-500:]}")
            yield pd.DataFrame({"value": done.stdout.splitlines()})

    rows = seqs.where(F.col("name").isNotNull() & F.col("seq").isNotNull()).select("name", "seq")
    return rows.mapInPandas(run, "value string")


def domain_search(frames: DataFrame, command: list[str], **kw) -> DataFrame:
    """Per-domain hits of translated frames, or of sequences by a nucleotide program."""
    return readers.domain_table(piped_lines(frames, command, **kw))


def nucleotide_hits(hits: DataFrame, searched: DataFrame) -> DataFrame:
    """Ascending ends, the strand in the name, and E-values for the sequences ``(name, length)`` searched."""
    mega = searched.agg((F.coalesce(F.sum("length"), F.lit(0)) / F.lit(1e6)).alias("mb_")).scalar()
    target, low, high = scores.ascending_with_strand(F.col("target_name"), F.col("ali_from"), F.col("ali_to"))
    rows = hits.withColumns({"target_name": target, "ali_from": low, "ali_to": high})
    rows = rows.withColumns({"env_from": F.least("env_from", "env_to"), "env_to": F.greatest("env_from", "env_to")})
    return rows.withColumns({c: F.col(c) * mega for c in ("evalue", "c_evalue", "i_evalue")})


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write a similarity graph: models and edges."""
    nodes.write.mode("overwrite").parquet(f"{path}/models")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_or_build_graph(spark: SparkSession, path: str, build) -> tuple[DataFrame, DataFrame]:
    """The saved graph, or else what ``build()`` gives, saved first."""
    if not readers._exists(spark, f"{path}/edges"):
        save_graph(*build(), path)
    return spark.read.parquet(f"{path}/models"), spark.read.parquet(f"{path}/edges")


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """A saved step of a long search, or else what ``build()`` gives, saved first; a step half written does not count."""
    if not readers._exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def search_command(kind: str, models: str, *, searched: int = 1, program: str | None = None) -> list[str]:
    """Command line of a search program that reads FASTA from its input and writes its table to its output.

    ``protein`` and ``nucleotide`` report every domain, whatever its E-value, for a search
    space of ``searched`` models and without the bias filter; ``frameshift`` allows for shifts.
    """
    table = ["--noali", "-o", "/dev/null"]
    space = ["--nobias", "-Z", str(searched), "-E", "1e10", "--domE", "1e10"]
    if kind == "protein":
        return [program or "hmmsearch", *table, "--domtblout", "/dev/stdout", *space, "--domZ", str(searched), models, "-"]
    if kind == "nucleotide":
        return [program or "nhmmer", *table, "--dfamtblout", "/dev/stdout", "--nobias", "-Z", "1", "-E", "1e10", models, "-"]
    if kind == "frameshift":
        return [program or "bathsearch", *table, "--tblout", "/dev/stdout", "--fs", "-E", "0.01", models, "-"]
    raise ValueError(f"no search of kind {kind}")


def similarity_commands(database: str, *, fasta: str = "-") -> tuple[list[str], list[str]]:
    """Commands that make a database of sequences, and that search a batch of queries in it with the table's columns."""
    columns = " ".join(x.split()[0] for x in readers.BLAST_COLUMNS.split(", "))
    return ["makeblastdb", "-in", fasta, "-dbtype", "nucl", "-title", "classified", "-out", database], ["blastn", "-db", database, "-query", "-", "-outfmt", f"6 {columns}"]


def decomposition_report(positions: DataFrame, parts: DataFrame | None = None) -> tuple[str, DataFrame]:
    """Header and lines per model: length, parts, their places, cover, scores and mean score, longest model first."""
    parts = models.decompose(positions) if parts is None else parts
    by = parts.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("part_from", "part_to", "score"))).alias("p"))
    sizes = positions.groupBy("model").agg(F.count(F.lit(1)).alias("m"), F.avg("score").alias("mean"))
    # Parts may overlap: positions of a part that an earlier one holds are counted once.
    cover = F.aggregate("p", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["part_to"] - F.greatest(x["part_from"], a["upto"]))).alias("n"), F.greatest(a["upto"], x["part_to"]).alias("upto")), lambda a: a["n"])
    places = F.array_join(F.transform("p", lambda x: F.format_string("%d-%d", x["part_from"], x["part_to"])), ",")
    totals = F.array_join(F.transform("p", lambda x: F.format_string("%.1f", x["score"])), ",")
    head = "\t".join(("model", "M", "n_domains", "domain_pos", "coverage", "domains", "avg_score_per_pos"))
    rows = sizes.join(by, "model").withColumn("cover", cover)
    return head, rows.select("model", "m", tab("model", "m", F.size("p"), places, F.format_string("%.3f", F.col("cover") / F.col("m")), totals, F.format_string("%.3f", "mean")).alias("line"))


#: Columns of the exports.
RAW_COLUMNS = ("database", "target_name", "target_len", "query_name", "query_len", "evalue", "score", "bias", "dom_num", "dom_of", "c_evalue", "i_evalue", "dom_score", "dom_bias", "hmm_from", "hmm_to", "ali_from", "ali_to", "env_from", "env_to", "acc")
BEST_COLUMNS = ("database", "seq_id", "seq_len", "model", "model_len", "strand", "frame", "nuc_start", "nuc_end", "env_from_aa", "env_to_aa", "hmm_from", "hmm_to", "hmm_coverage", "evalue", "score", "bias", "accuracy")
DOMAIN_COLUMNS = ("database", "seq_id", "seq_len", "model", "model_len", "strand", "frame", "dom_num", "dom_of", "nuc_start", "nuc_end", "env_from_aa", "env_to_aa", "hmm_from", "hmm_to", "hmm_coverage", "evalue", "score", "bias", "accuracy")
CHOSEN_COLUMNS = ("seq_id", "model", "family", "strand", "frame", "nuc_start", "nuc_end", "env_from_aa", "env_to_aa", "hmm_from", "hmm_to", "hmm_cov", "score", "norm_score", "evalue", "accuracy")


def raw_hit_lines(hits: DataFrame) -> tuple[str, DataFrame]:
    """Header and lines of all hits as they are."""
    numbers = {f.name for f in hits.schema if f.dataType.typeName() == "double"}
    cells = [number_text(F.col(c)) if c in numbers else F.col(c) for c in RAW_COLUMNS]
    return "\t".join(RAW_COLUMNS), hits.select("database", "target_name", "query_name", "dom_num", tab(*cells).alias("line"))


def _readable(hits: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds the sequence's name and length, strand, frame, and ends in bases where its length ``(name, length)`` is known."""
    suffix = names.frame_suffix(F.col("target_name"))
    rows = hits.withColumns({"seq_id": suffix["base"], "way": suffix["strand"], "no": suffix["frame"]})
    rows = rows.join(lengths.select(F.col("name").alias("seq_id"), F.col("length").alias("known_")), "seq_id", "left")
    start, end = scores.protein_to_bases(F.col("env_from"), F.col("env_to"), F.col("way"), F.col("no").try_cast("int"), F.col("known_"))
    based = (F.col("way") != ".") & F.col("known_").isNotNull()
    return rows.withColumns({"based": based, "nuc_start": F.when(based, start).otherwise(F.col("env_from")), "nuc_end": F.when(based, end).otherwise(F.col("env_to")), "seq_len": F.when(based, F.col("known_")).otherwise(F.col("target_len"))})


def _coverage() -> Column:
    return number_text(scores.model_coverage(), "{:.1f}")


def _measures() -> list[Column | str]:
    return ["nuc_start", "nuc_end", "env_from", "env_to", "hmm_from", "hmm_to", _coverage(), number_text(F.col("i_evalue"), "{:.2e}"), number_text(F.col("dom_score"), "{:.1f}"), number_text(F.col("dom_bias"), "{:.1f}"), number_text(F.col("acc"), "{:.3f}")]


def best_hit_lines(hits: DataFrame, lengths: DataFrame) -> tuple[str, DataFrame]:
    """Header and lines of each frame and model's best hits, ties kept, for readers."""
    rows = _readable(best.best_with_ties(hits, ["target_name", "query_name"]), lengths)
    line = tab("database", "seq_id", "seq_len", "query_name", "query_len", "way", "no", *_measures())
    return "\t".join(BEST_COLUMNS), rows.select("database", "target_name", "dom_score", "query_name", "env_from", line.alias("line"))


def all_domain_lines(hits: DataFrame, lengths: DataFrame) -> tuple[str, DataFrame]:
    """Header and lines of every hit, for readers."""
    line = tab("database", "seq_id", "seq_len", "query_name", "query_len", "way", "no", "dom_num", "dom_of", *_measures())
    return "\t".join(DOMAIN_COLUMNS), _readable(hits, lengths).select("database", "target_name", "query_name", "dom_num", line.alias("line"))


def chosen_hit_lines(hits: DataFrame, lengths: DataFrame) -> tuple[str, DataFrame]:
    """Header and lines of hits chosen before, with ``norm_score`` and family."""
    ends = ["nuc_start", "nuc_end", "env_from", "env_to", "hmm_from", "hmm_to", _coverage()]
    line = tab("seq_id", "query_name", "domain_type", "way", "no", *ends, number_text(F.col("dom_score"), "{:.1f}"), number_text(F.col("norm_score"), "{:.4f}"), number_text(F.col("i_evalue"), "{:.2e}"), number_text(F.col("acc"), "{:.3f}"))
    return "\t".join(CHOSEN_COLUMNS), _readable(hits, lengths).select("seq_id", "query_name", "env_from", line.alias("line"))


def hit_records(hits: DataFrame, frames: DataFrame, lengths: DataFrame, piece: Column | None = None) -> DataFrame:
    """``(target_name, dom_score, query_name, head, seq)``: amino acids of each frame and model's best hits.

    ``frames`` has the amino acids whole, as ``aa``, or else what ``piece`` cuts a hit's
    part from. Heads are made before frames are joined, so that no sequence waits in a
    Python queue beside them.
    """
    rows = _readable(best.best_with_ties(hits, ["target_name", "query_name"]), lengths)
    bases = F.when(F.col("based"), F.concat(F.lit("nuc="), F.col("nuc_start").cast("string"), F.lit("-"), F.col("nuc_end").cast("string"), F.lit(";"))).otherwise("")
    parts = [F.col("seq_id"), F.lit("|"), F.col("query_name"), F.lit(" "), bases, F.lit("env="), F.col("env_from").cast("string"), F.lit("-"), F.col("env_to").cast("string")]
    parts += [x for k, v in (("score", number_text(F.col("dom_score"), "{:.1f}")), ("evalue", number_text(F.col("i_evalue"), "{:.2e}")), ("hmm_cov", _coverage()), ("acc", number_text(F.col("acc"), "{:.3f}"))) for x in (F.lit(f";{k}="), v)]
    headed = rows.select("target_name", "dom_score", "query_name", "env_from", "env_to", F.concat(*parts).alias("head"))
    if piece is None:
        frames, piece = frames.select("target_name", "aa"), F.substring("aa", F.col("env_from"), F.col("env_to") - F.col("env_from") + 1)
    return headed.join(frames, "target_name").select("target_name", "dom_score", "query_name", "head", piece.alias("seq"))
