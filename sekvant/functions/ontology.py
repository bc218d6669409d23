"""Ontology terms of classification labels, by a ladder of ever more general names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which an order's superfamilies are listed.
ORDER_PREFIXES = {"tir": ("TIR", "DNA", "MITE"), "line": ("LINE", "nonLTR"), "ltr": ("LTR",), "sine": ("SINE",)}
#: Terms that override the table's.
EXTRA_ALIASES = {
    "dirs": ("LTR_retrotransposon", "SO:0000186"),
    "penelope": ("non_LTR_retrotransposon", "SO:0000189"),
    "pararetrovirus": ("LTR_retrotransposon", "SO:0000186"),
    "maverick": ("DNA_transposon", "SO:0000182"),
    "ltr/retrovirus": ("LTR_retrotransposon", "SO:0000186"),
    "tir": ("terminal_inverted_repeat_element", "SO:0000208"),
}
#: The real name of each generic accession.
CANONICAL = {
    "SO:0000182": "DNA_transposon",
    "SO:0000186": "LTR_retrotransposon",
    "SO:0000189": "non_LTR_retrotransposon",
    "SO:0000194": "LINE_element",
    "SO:0000206": "SINE_element",
    "SO:0000208": "terminal_inverted_repeat_element",
    "SO:0000544": "helitron",
    "SO:0000657": "repeat_region",
}
FALLBACK = ("repeat_region", "SO:0000657")


def normal(alias: Column) -> Column:
    """Lower case, underscores for hyphens, no blanks."""
    return F.translate(F.lower(F.trim(alias)), "- ", "_")


def candidates(order: Column, superfamily: Column) -> Column:
    """Normalized labels to look up, the most particular first; unset levels give none."""
    o, s = F.trim(order), F.trim(superfamily)
    is_set = lambda c: c.isNotNull() & ~F.lower(c).isin("", "unknown", "na")
    prefixes = F.array().cast("array<string>")
    for name, listed in ORDER_PREFIXES.items():
        prefixes = F.when(F.lower(o) == name, F.array(*map(F.lit, listed))).otherwise(prefixes)
    both = is_set(o) & is_set(s)
    paired = F.when(both, F.concat(F.array(F.concat(o, F.lit("/"), s)), F.transform(prefixes, lambda p: F.concat(p, F.lit("/"), s)))).otherwise(F.array().cast("array<string>"))
    alone = F.filter(F.array(F.when(is_set(s), s), F.when(is_set(o), o)), lambda x: x.isNotNull())
    return F.transform(F.concat(paired, alone), normal)


def alias_table(lines: DataFrame) -> DataFrame:
    """``(alias, so_name, so_id)`` from lines ``(line_no, value)`` of name, id and comma-separated aliases.

    The first line that gives an alias wins, then the overriding terms; lines
    without tabs and comments are skipped.
    """
    fields = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(fields) >= 3)).select("line_no", F.trim(fields[0]).alias("so_name"), F.trim(fields[1]).alias("so_id"), F.posexplode(F.split(fields[2], ",")).alias("at", "a"))
    rows = rows.select(normal(F.col("a")).alias("alias"), F.struct("line_no", "at", "so_name", "so_id").alias("r")).where("alias <> ''")
    first = rows.groupBy("alias").agg(F.min("r").alias("r")).select("alias", "r.so_name", "r.so_id")
    extra = lines.sparkSession.createDataFrame([(k, *v) for k, v in EXTRA_ALIASES.items()], "alias string, so_name string, so_id string")
    return first.join(F.broadcast(extra.select("alias")), "alias", "left_anti").unionByName(extra)


def lookup(labels: DataFrame, aliases: DataFrame, order: str = "order", superfamily: str = "superfamily") -> DataFrame:
    """Adds ``so_name, so_id, gff_type``: the first candidate in the table, else a plain repeat.

    Terms are found once per distinct label and joined back.
    """
    found = labels.select(order, superfamily).distinct()
    tried = found.select(order, superfamily, F.posexplode(candidates(F.col(order), F.col(superfamily))).alias("rung", "alias"))
    best = tried.join(aliases, "alias").groupBy(order, superfamily).agg(F.min(F.struct("rung", "so_name", "so_id")).alias("so_best_"))
    same = [labels[c].eqNullSafe(best[c]) for c in (order, superfamily)]
    joined = labels.join(best, same[0] & same[1], "left").select(labels["*"], F.coalesce("so_best_.so_name", F.lit(FALLBACK[0])).alias("so_name"), F.coalesce("so_best_.so_id", F.lit(FALLBACK[1])).alias("so_id"))
    canonical = F.create_map(*(F.lit(x) for kv in CANONICAL.items() for x in kv))
    return joined.withColumn("gff_type", F.coalesce(F.try_element_at(canonical, F.col("so_id")), F.col("so_name")))
