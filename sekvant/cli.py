"""Command line over the library: classify elements, annotate genomes, translate, cut windows.

Databases are named by ``name=style=path``: the style of their model names (path,
prefix, constant, or plain for paths without known structures) and a per-domain search table, as text or parquet.
"""

from __future__ import annotations

import argparse
from dataclasses import replace
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sekvant.functions import names, ontology, scores, sequences
from sekvant.operators import best, classify, genome, overlap, screening
from sekvant.sources import readers, writers
from sekvant.staging import release, staged


def _hits(spark: SparkSession, path: str, database: str) -> DataFrame:
    rows = spark.read.parquet(path) if Path(path).is_dir() or path.endswith(".parquet") else readers.domain_table(spark.read.text(path))
    suffix = names.frame_suffix(F.col("target_name"))
    derived = {"base_seq": suffix["base"], "strand": suffix["strand"], "frame": suffix["frame"].try_cast("int"), "domain_type": names.domain_family(F.col("query_name")), "database": F.lit(database)}
    rows = rows.withColumns({k: v for k, v in derived.items() if k not in rows.columns})
    return rows if "id" in rows.columns else rows.withColumn("id", F.xxhash64(*rows.columns))


def _databases(args: argparse.Namespace) -> list[tuple[classify.Database, str]]:
    out = []
    for text in args.database:
        name, style, path = text.split("=", 2)
        if style not in classify.LAYOUTS:
            raise SystemExit(f"unknown style {style} of {name}")
        out.append((replace(classify.LAYOUTS[style], name=name), path))
    return out


def _write(args: argparse.Namespace, lines: DataFrame, name: str, order: list[str], header: str | None = None) -> int:
    return writers.write_result(lines, f"{args.out.rstrip('/')}/{name}", order=order, header=header, parts=args.parts)


def _domain_files(args: argparse.Namespace, db: classify.Database, hits: DataFrame, called: DataFrame, seqs: DataFrame) -> None:
    """What is known of the selected domains, as GFF3, table, sequences, and sequences named by class."""
    p = names.path_labels(F.col("query_name")) if db.style == "path" else names.prefix_labels(F.col("query_name"))
    rows = best.selected_domains(hits, db.remap, compat_rounding=args.count_votes).join(seqs.select(F.col("name").alias("base_seq"), F.col("length").alias("bases")), "base_seq")
    start, end = scores.protein_to_bases(F.col("env_from"), F.col("env_to"), F.col("strand"), F.col("frame"), F.col("bases"))
    rows = rows.withColumns({"start": start, "end": end, "clade": p["clade"], "shown": p["gene"]})
    order = ["base_seq", "start", "query_name"]
    _write(args, writers.domain_gff_lines(rows), f"{db.name}.dom.gff3", order)
    head, lines = writers.domain_table_lines(rows)
    _write(args, lines, f"{db.name}.dom.tsv", order, head)
    frames = sequences.six_frames(seqs.withColumn("seq", sequences.clean(F.col("seq"))))
    records = writers.domain_records(rows, frames)
    _write(args, writers.fasta_lines(records, F.col("head"), F.col("seq"), None), f"{db.name}.dom.faa", order)
    named = writers.peptide_records(rows, frames, called)
    _write(args, writers.fasta_lines(named, F.col("head"), F.col("seq")), f"{db.name}.cls.pep", order)


def run_classify(spark: SparkSession, args: argparse.Namespace) -> int:
    """Per-database tables and domain files, and with several databases or similarity hits the combined table."""
    if not args.parts:
        Path(args.out).mkdir(parents=True, exist_ok=True)
    clades = readers.clade_map(spark, args.clade_map) if args.clade_map else spark.createDataFrame([], "clade string, order string, superfamily string")
    seqs = readers.fasta(spark, args.fasta) if args.fasta else None
    calls, raw = [], []
    for db, path in _databases(args):
        hits = _hits(spark, path, db.name)
        raw.append(hits.select("base_seq", "database"))
        usable = best.clean_hits(hits)
        called = classify.classify(usable, db, clade_map=clades, count_votes=args.count_votes, compat_rounding=args.count_votes)
        head, lines = writers.classification_lines(called)
        _write(args, lines, f"{db.name}.cls.tsv", ["id"], head)
        if seqs is not None and db.style != "constant":
            _domain_files(args, db, usable, called, seqs)
        calls.append(called.withColumn("database", F.lit(db.name)))
    harmonization = readers.harmonization_table(spark, args.harmonization or f"{args.out}/no-harmonization")
    scope = readers.scope_table(spark, args.scope) if args.scope else spark.createDataFrame([], "db string, superfamily_h string, resolving boolean")
    combined = classify.reconcile(reduce(DataFrame.unionByName, calls), harmonization, scope)
    if args.similar:
        known = reduce(DataFrame.unionByName, raw)
        seen = known.select(F.col("base_seq").alias("id")).distinct()
        more = classify.inherit_from_similar(readers.similarity_table(spark, args.similar).withColumn("classified_by", F.lit("")), seen, combined)
        combined = combined.unionByName(more.drop("source", "bitscore"), allowMissingColumns=True)
    combined = combined.withColumn("secondary", F.coalesce("secondary", F.array().cast(combined.schema["secondary"].dataType)))
    if args.ontology:
        combined = ontology.lookup(combined, ontology.alias_table(readers.numbered_lines(spark, args.ontology)))
    head, lines = writers.classification_lines(combined, secondary=True, ontology=bool(args.ontology), lineage=True)
    n = _write(args, lines, "combined.cls.tsv", ["id"], head)
    if seqs is not None:
        records = writers.library_records(seqs, combined, reverse=not args.no_reverse)
        _write(args, writers.fasta_lines(records, F.col("head"), F.col("seq")), "cls.lib", ["name"])
    return n


def run_genome(spark: SparkSession, args: argparse.Namespace) -> int:
    """Resolved features as GFF3, their sequences, and their statistics by class."""
    if not args.parts:
        Path(args.out).mkdir(parents=True, exist_ok=True)
    aliases = ontology.alias_table(readers.numbered_lines(spark, args.ontology)) if args.ontology else None
    clades = readers.clade_map(spark, args.clade_map) if args.clade_map else None
    seqs = readers.fasta(spark, args.fasta).withColumn("seq", sequences.clean(F.col("seq")))
    windows = readers.sequence_lengths(seqs).withColumnRenamed("name", "window_id")
    parts = []
    for db, path in _databases(args):
        engine = genome.NUCLEOTIDE if db.style == "constant" else args.engine
        parts.append(genome.features(_hits(spark, path, db.name), db, engine, lengths=windows, clade_map=clades, aliases=aliases))
    resolved = staged(overlap.resolve_overlaps(reduce(DataFrame.unionByName, parts)), "resolved")
    order = ["chrom", "f_start", "gid"]
    n = _write(args, genome.gff_lines(resolved), "genome.gff3", order, "##gff-version 3")
    frames = sequences.six_frames(seqs).select(F.col("target_name").alias("key"), F.col("aa").alias("seq"))
    texts = seqs.select(F.col("name").alias("key"), "seq")
    records = genome.feature_sequences(resolved, frames, texts, texts)
    # A file of an alphabet is there only if a feature has it.
    for name, protein in (("genome.dom.faa", True), ("genome.dom.fna", False)):
        some = records.where((F.col("src") == "aa") == protein)
        if not resolved.where((F.col("extract.src") == "aa") == protein).isEmpty():
            _write(args, writers.fasta_lines(some, F.col("head"), F.col("seq")), name, ["gid"])
    head, lines = overlap.summary_lines(overlap.class_summary(resolved))
    _write(args, lines, "genome.summary.tsv", ["place", "path"], head)
    release(resolved)
    return n


def run_translate(spark: SparkSession, args: argparse.Namespace) -> int:
    seqs = readers.fasta(spark, args.fasta).withColumn("seq", sequences.clean(F.col("seq")))
    lines = writers.fasta_lines(sequences.six_frames(seqs), F.col("target_name"), F.col("aa"), None)
    return writers.write_result(lines, args.out, order=["target_name"], parts=args.parts)


def run_windows(spark: SparkSession, args: argparse.Namespace) -> int:
    seqs = readers.fasta(spark, args.fasta).withColumn("seq", sequences.clean(F.col("seq")))
    cut = sequences.windows(seqs, args.size, args.overlap)
    return writers.write_result(writers.fasta_lines(cut, F.col("window_id"), F.col("seq"), None), args.out, order=["chrom", "w_start"], parts=args.parts)


def run_facets(spark: SparkSession, args: argparse.Namespace) -> int:
    """The two-step search from sub-model and full hits: verified frames, and the hits of all stages."""
    if not args.parts:
        Path(args.out).mkdir(parents=True, exist_ok=True)
    screen, full = (readers.domain_table(spark.read.text(p)) for p in (args.screen, args.full))
    # A sub-model's name ends with its place in the model it was cut from.
    screen = screen.withColumn("query_name", F.regexp_replace("query_name", r"__sub_[0-9]+-[0-9]+$", ""))
    families = full.select(F.col("query_name").alias("parent")).union(screen.select("query_name")).distinct().withColumn("family", names.domain_family(F.col("parent")))
    frames = sequences.six_frames(readers.fasta(spark, args.fasta).withColumn("seq", sequences.clean(F.col("seq")))).select("target_name")
    ranked, hits = screening.facet_stages(frames, screening.best_submodel(screen), families, full, nucleotide=args.nucleotide)
    head, lines = writers.frame_tier_lines(ranked)
    n = _write(args, lines, "facets.tsv", ["target_name", "family", "model"], head)
    columns = [c.split()[0] for c in readers.HIT_COLUMNS.split(", ")]
    _write(args, hits.select("stage", "target_name", "query_name", "dom_num", writers.tab("stage", *columns).alias("line")), "stages.tsv", ["stage", "target_name", "query_name", "dom_num"], "\t".join(("stage", *columns)))
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sekvant", description=__doc__.split("\n")[0])
    sub = p.add_subparsers(dest="command", required=True)
    for name, run, many in (("classify", run_classify, True), ("genome", run_genome, True), ("translate", run_translate, False), ("windows", run_windows, False), ("facets", run_facets, False)):
        c = sub.add_parser(name, help=(run.__doc__ or name).split("\n")[0])
        c.set_defaults(run=run)
        c.add_argument("--out", required=True)
        c.add_argument("--parts", action="store_true", help="write folders in parallel, on any storage, instead of single local files")
        c.add_argument("--fasta", required=name != "classify")
        if many:
            c.add_argument("--database", action="append", required=True, metavar="NAME=STYLE=PATH")
            c.add_argument("--clade-map")
            c.add_argument("--ontology")
    c = sub.choices["classify"]
    c.add_argument("--harmonization")
    c.add_argument("--scope")
    c.add_argument("--similar", help="tabular similarity hits of unclassified against classified sequences")
    c.add_argument("--count-votes", action="store_true", help="vote by number of domains, on rounded scores")
    c.add_argument("--no-reverse", action="store_true")
    sub.choices["genome"].add_argument("--engine", choices=(genome.PROTEIN, genome.FRAMESHIFT), default=genome.PROTEIN)
    c = sub.choices["facets"]
    c.add_argument("--screen", required=True, help="per-domain hits of sub-models")
    c.add_argument("--full", required=True, help="per-domain hits of whole models")
    c.add_argument("--nucleotide", action="store_true")
    c = sub.choices["windows"]
    c.add_argument("--size", type=int, default=180_000)
    c.add_argument("--overlap", type=int, default=60_000)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    n = args.run(spark or SparkSession.builder.appName("sekvant").getOrCreate(), args)
    print(f"{n} rows")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
