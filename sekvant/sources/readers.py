"""Text formats as DataFrames: FASTA, profile models, search tables, dimension tables.

Files are read as lines or records by Spark's splittable text source and parsed with
built-in functions; only model matrices need Python. Paths may be globs or folders.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HIT_COLUMNS = "target_name string, target_accession string, target_len int, query_name string, query_accession string, query_len int, evalue double, score double, bias double, dom_num int, dom_of int, c_evalue double, i_evalue double, dom_score double, dom_bias double, hmm_from int, hmm_to int, ali_from int, ali_to int, env_from int, env_to int, acc double"
BLAST_COLUMNS = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double, qlen int, slen int, qcovs double, qcovhsp double, sstrand string"


#: Entries the prefix database's map has besides its table's.
EXTRA_CLADES = {
    "ty1/copia": ("LTR", "Copia"),
    "retroelement": ("LTR", "unknown"),
    "retroviridae": ("LTR", "unknown"),
    "B-type_betaretroviridae": ("LTR", "unknown"),
    "D-type_betaretroviridae": ("LTR", "unknown"),
    "caulimoviruses": ("LTR", "unknown"),
    "caulimoviridae_dom2": ("LTR", "unknown"),
    "errantiviridae": ("LTR", "unknown"),
    "retropepsins": ("LTR", "unknown"),
    "VPX_retroviridae": ("LTR", "unknown"),
    "cog5550": ("Unknown", "unknown"),
    "ddi": ("Unknown", "unknown"),
    "dtg_ilg_template": ("Unknown", "unknown"),
    "saspase": ("Unknown", "unknown"),
    "GIN1": ("Unknown", "unknown"),
    "shadow": ("Unknown", "unknown"),
    "all": ("Unknown", "unknown"),
    "pepsins_A1a": ("Unknown", "unknown"),
    "pepsins_A1b": ("Unknown", "unknown"),
}


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(name, description, seq, length)``; the name is the header's first word."""
    records = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace("value", "^>", "")
    head = F.substring_index(text, "\n", 1)
    seq = F.when(F.instr(text, "\n") > 0, F.regexp_replace(F.substring(text, F.instr(text, "\n") + 1, F.length(text)), r"\s", "")).otherwise("")
    rows = records.where(F.trim("value") != "").select(head.alias("head"), seq.alias("seq"))
    name = F.regexp_extract("head", r"^(\S*)", 1)
    return rows.select(name.alias("name"), F.trim(F.regexp_replace("head", r"^\S*\s*", "")).alias("description"), "seq", F.length("seq").alias("length"))


def sequence_lengths(sequences: DataFrame) -> DataFrame:
    """``(name, length)``, one row per name; of repeated names the longest."""
    return sequences.where(F.col("name").isNotNull()).groupBy("name").agg(F.max("length").alias("length"))


def _parse_models(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def number(x: str) -> float:
        return 0.0 if x == "*" else 2.718281828459045 ** -float(x)

    for b in batches:
        rows = []
        for text in b["value"]:
            fields: dict[str, str] = {}
            match, insert, trans, consensus = [], [], [], []
            lines = iter(text.split("\n"))
            for line in lines:
                if line.startswith("HMM "):
                    break
                key, _, rest = line.partition(" ")
                fields.setdefault(key, rest.strip())
            if "NAME" not in fields:
                continue
            size = len(line.split()) - 1
            body = [x.split() for x in lines if x.strip()][1:]
            if body and body[0][0] == "COMPO":
                body = body[1:]
            # Node 0 has insert and transition lines; every later node a match line before them.
            if len(body) >= 2:
                insert.append([number(x) for x in body[0][:size]])
                trans.append([number(x) for x in body[1][:7]])
            for i in range(2, len(body) - 2, 3):
                match.append([number(x) for x in body[i][1 : size + 1]])
                consensus.append(body[i][size + 2] if len(body[i]) > size + 2 else "-")
                insert.append([number(x) for x in body[i + 1][:size]])
                trans.append([number(x) for x in body[i + 2][:7]])
            rows.append((fields["NAME"], int(fields.get("LENG", len(match))), fields.get("ALPH", "").lower(), "".join(consensus), match, insert, trans))
        yield pd.DataFrame(rows, columns=["name", "m", "alphabet", "consensus", "match", "insert", "trans"])


def profile_models(spark: SparkSession, path: str) -> DataFrame:
    """``(name, m, alphabet, consensus, match, insert, trans)`` of a profile text file; probabilities by position."""
    matrix = "array<array<double>>"
    records = spark.read.option("lineSep", "//\n").text(path).where(F.col("value").contains("NAME"))
    return records.mapInPandas(_parse_models, f"name string, m int, alphabet string, consensus string, match {matrix}, insert {matrix}, trans {matrix}")


def alphabet(spark: SparkSession, path: str) -> str:
    """``amino``, ``dna`` or ``rna``: the first alphabet line of a model file."""
    first = spark.read.text(path).where(F.col("value").startswith("ALPH")).limit(1).collect()
    word = first[0]["value"].split()[1].lower() if first and len(first[0]["value"].split()) > 1 else ""
    if word not in ("amino", "dna", "rna"):
        raise ValueError(f"{path} names no known alphabet")
    return word


def needs_translation(spark: SparkSession, path: str) -> bool:
    return alphabet(spark, path) == "amino"


def _typed(parts: Column, ddl: str, at: int = 0) -> list[Column]:
    return [F.get(parts, F.lit(i + at)).try_cast(x.split()[1]).alias(x.split()[0]) for i, x in enumerate(ddl.split(", "))]


def domain_table(lines: DataFrame) -> DataFrame:
    """Hits of a per-domain search table, from lines in ``value``; comments and short lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.trim("value").startswith("#")).withColumn("p", parts).where(F.size("p") >= 22)
    return rows.select(*_typed(F.col("p"), HIT_COLUMNS), F.array_join(F.slice("p", F.lit(23), F.greatest(F.size("p") - 22, F.lit(0))), " ").alias("description"))


def frameshift_table(spark: SparkSession, path: str) -> DataFrame:
    """Hits of a frameshift-aware search's table.

    A header that begins with a hit id shifts the columns by one. Lines have at least 15
    columns behind that. Sequence values stand for domain values; the strand goes
    into the name's suffix and ends become ascending.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    shifted = lines.where(F.col("value").rlike(r"^#\s*hit ID")).select("file").distinct().withColumn("base", F.lit(1))
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.trim("value").startswith("#")).join(shifted, "file", "left").withColumns({"p": parts, "b": F.coalesce("base", F.lit(0))}).where(F.size("p") >= F.col("b") + 15)
    at = lambda i, kind: F.get("p", F.col("b") + i).try_cast(kind)
    low, high = at(8, "int"), at(9, "int")
    named = {
        "target_name": F.concat(at(0, "string"), F.when(low <= high, "|fwd1").otherwise("|rev1")),
        "target_len": at(10, "int"), "query_name": at(2, "string"), "query_len": at(4, "int"),
        "evalue": at(11, "double"), "score": at(12, "double"), "bias": at(13, "double"),
        "hmm_from": at(5, "int"), "hmm_to": at(6, "int"),
        "ali_from": F.least(low, high), "ali_to": F.greatest(low, high),
    }
    rows = rows.select(*(c.alias(n) for n, c in named.items()))
    same = {"c_evalue": "evalue", "i_evalue": "evalue", "dom_score": "score", "dom_bias": "bias", "env_from": "ali_from", "env_to": "ali_to"}
    return rows.withColumns({k: F.col(v) for k, v in same.items()} | {"dom_num": F.lit(1), "dom_of": F.lit(1), "acc": F.lit(1.0)})


def similarity_table(spark: SparkSession, path: str) -> DataFrame:
    """Tabular similarity hits with 17 columns; shorter lines are skipped, a missing file is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], BLAST_COLUMNS)
    parts = F.split("value", "\t")
    return spark.read.text(path).withColumn("p", parts).where(F.size("p") >= 17).select(*_typed(F.col("p"), BLAST_COLUMNS))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def harmonization_table(spark: SparkSession, path: str) -> DataFrame:
    """Harmonized names; comment and header lines skipped, seven columns get an empty lineage, other widths dropped."""
    columns = ("db", "order_native", "superfamily_native", "clade_native", "order_h", "superfamily_h", "clade_h", "lineage_h")
    if not _exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & ~F.col("value").startswith("db\t")).withColumn("p", p).where(F.size("p").isin(7, 8))
    return rows.select(*(F.trim(F.coalesce(F.get("p", F.lit(i)), F.lit(""))).alias(c) for i, c in enumerate(columns)))


def scope_table(spark: SparkSession, path: str) -> DataFrame:
    """``(db, superfamily_h, resolving)``."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & ~F.col("value").startswith("db\t")).withColumn("p", p).where(F.size("p") >= 4)
    return rows.select(F.trim(p[0]).alias("db"), F.trim(p[1]).alias("superfamily_h"), (F.trim(p[3]) == "yes").alias("resolving"))


def clade_map(spark: SparkSession, path: str, extra: dict[str, tuple[str, str]] | None = EXTRA_CLADES) -> DataFrame:
    """``(clade, order, superfamily)`` from a tab-separated table with Clade, Family and System columns.

    Each clade is listed as written, with underscores for hyphens, in lower case and
    both; later lines win, ``extra`` entries over all.
    """
    lines = spark.read.option("sep", "\t").option("header", True).csv(path).withColumn("line", F.monotonically_increasing_id())
    c = F.trim("Clade")
    forms = F.array_distinct(F.array(c, F.replace(c, F.lit("-"), F.lit("_")), F.lower(c), F.lower(F.replace(c, F.lit("-"), F.lit("_")))))
    rows = lines.where(c.isNotNull()).select(F.explode(forms).alias("clade"), F.trim("System").alias("order"), F.trim("Family").alias("superfamily"), "line")
    last = rows.groupBy("clade").agg(F.max_by(F.struct("order", "superfamily"), "line").alias("x")).select("clade", "x.order", "x.superfamily")
    if not extra:
        return last
    more = spark.createDataFrame([(k, *v) for k, v in extra.items()], "clade string, order string, superfamily string")
    return last.join(F.broadcast(more.select("clade")), "clade", "left_anti").unionByName(more)


#: Tables of hits that may be asked for.
HIT_TABLES = ("legacy_hits", "pass1_hits", "pass2_hits", "facet_hits")


def has_table(spark: SparkSession, folder: str, name: str, *columns: str) -> bool:
    """Whether a data directory has the table, with the columns named."""
    path = f"{folder}/{name}.parquet"
    return _exists(spark, path) and set(columns) <= set(spark.read.parquet(path).columns)


def database_hits(spark: SparkSession, folder: str, table: str, database: str | None = None) -> DataFrame:
    """Hits of one database, or of all, from one of the known tables, by sequence and envelope."""
    if table not in HIT_TABLES:
        raise ValueError(f"{table} is no table of hits")
    if not has_table(spark, folder, table):
        raise FileNotFoundError(f"no table {table} in {folder}")
    hits = spark.read.parquet(f"{folder}/{table}.parquet")
    return (hits.where(F.col("database") == database) if database else hits).orderBy("base_seq", "env_from")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, value)`` in file order."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def resolve(name: str, known: dict[str, str], folder: str | None = None, variable: str = "SEKVANT_DB") -> str:
    """Path of a database: a file by that name, else the known file in the folder given, named by the environment, or here."""
    if os.path.isfile(name):
        return name
    at = folder or os.environ.get(variable) or os.getcwd()
    if name in known and os.path.isfile(path := os.path.join(at, known[name])):
        return path
    raise FileNotFoundError(f"no database {name} in {at}")


def resolve_converted(path: str, known: dict[str, str], folder: str | None = None, suffix: str = ".bhmm") -> tuple[str, bool]:
    """A database in a search program's own form, and whether it is there: the file beside the original, else the known one, else where to convert to."""
    beside = path + suffix
    if os.path.isfile(beside):
        return beside, True
    name = known.get(os.path.basename(path))
    if name and os.path.isfile(at := os.path.join(folder or os.path.dirname(path), name)):
        return at, True
    return beside, False
