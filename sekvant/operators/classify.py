"""Classifying elements from their domains, and reconciling several databases.

Votes are windows over an element's selected domains, of which there is at most
one per domain type, so all of them share one shuffle on the element and no group
grows with the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sekvant.functions import names
from sekvant.operators.best import selected_domains

UNKNOWN, MIXTURE = "unknown", "mixture"


@dataclass(frozen=True)
class Database:
    """How a database's model names read and what its elements look like."""

    name: str
    style: str  # "path", "prefix" or "constant"
    structures: dict[tuple[str, str], list[str]] = field(default_factory=dict)
    remap: dict[str, str] = field(default_factory=dict)
    clade_only_for: tuple[str, ...] = ()
    constant: tuple[str, str] = ("SINE", "SINE")


#: Genes in order of complete elements, other names of genes, superfamilies whose clades are told.
LAYOUTS = {
    "path": Database(
        "path",
        "path",
        structures={("LTR", "Copia"): ["GAG", "PROT", "INT", "RT", "RH"], ("LTR", "Gypsy"): ["GAG", "PROT", "RT", "RH", "INT"], ("LTR", "Bel-Pao"): ["GAG", "PROT", "RT", "RH", "INT"]},
        remap={"aRH": "RH", "TPase": "INT"},
        clade_only_for=("Copia", "Gypsy"),
    ),
    "prefix": Database(
        "prefix",
        "prefix",
        structures={
            ("LTR", "Copia"): ["GAG", "AP", "INT", "RT", "RNaseH"],
            ("LTR", "Gypsy"): ["GAG", "AP", "RT", "RNaseH", "INT"],
            ("LTR", "Pao"): ["GAG", "AP", "RT", "RNaseH", "INT"],
            ("LTR", "Retroviridae"): ["GAG", "AP", "RT", "RNaseH", "INT", "ENV"],
            ("LTR", "Caulimoviridae"): ["GAG", "AP", "RT", "RNaseH"],
        },
    ),
    "plain": Database("plain", "path"),
    "constant": Database("constant", "constant"),
}


def _labelled(domains: DataFrame, db: Database, clade_map: DataFrame | None) -> DataFrame:
    """Adds ``o, s, c, g``: order, superfamily, clade and displayed gene of each domain's model."""
    model = F.col("query_name")
    if db.style == "path":
        p = names.path_labels(model)
        rows = domains.withColumns({"o": p["order"], "s": p["superfamily"], "c": p["clade"], "g": p["gene"]})
    elif db.style == "prefix":
        p = names.prefix_labels(model)
        rows = domains.withColumns({"c": p["clade"], "g": p["gene"]})
        known = clade_map.select(F.col("clade").alias("c"), F.col("order").alias("o"), F.col("superfamily").alias("s"))
        rows = rows.join(known, "c", "left")
    else:
        rows = domains.withColumns({"o": F.lit(db.constant[0]), "s": F.lit(UNKNOWN), "c": F.lit(db.constant[1]), "g": F.lit(db.constant[1])})
    shown = F.col("g")
    for old, new in db.remap.items():
        shown = F.when(F.col("g") == old, new).otherwise(shown)
    return rows.withColumn("g", shown)


def classify(hits: DataFrame, db: Database, *, clade_map: DataFrame | None = None, count_votes: bool = False, compat_rounding: bool = False) -> DataFrame:
    """``(id, order, superfamily, clade, complete, strand, domains, score)`` per element.

    The clade with the largest summed norm score wins, ties going to the first in
    position; with ``count_votes`` the most frequent. An unclear win makes the clade,
    and the levels its models disagree on, a mixture.
    """
    # The vote's own columns alone, so that others may have any name.
    chosen = selected_domains(hits, db.remap, compat_rounding=compat_rounding).select("base_seq", "gene", "query_name", "target_name", "env_from", "norm_score")
    rows = _labelled(chosen, db, clade_map)
    element = Window.partitionBy("base_seq")
    strand = F.when(F.min("strand").over(element) == F.max("strand").over(element), F.max("strand").over(element)).otherwise("?")
    way = F.when(F.col("target_name").contains("|fwd"), "+").when(F.col("target_name").contains("|rev"), "-").otherwise(".")
    rows = rows.withColumn("strand", way).withColumn("fold", strand)
    ahead = F.row_number().over(element.orderBy("env_from", "gene"))
    rows = rows.withColumn("pos", F.when(F.col("fold") == "-", F.count(F.lit(1)).over(element) + 1 - ahead).otherwise(ahead))
    clade = Window.partitionBy("base_seq", "c")
    weight = F.count(F.lit(1)).over(clade).cast("double") if count_votes else F.sum("norm_score").over(clade)
    rows = rows.withColumns({"weight": F.round(weight, 9), "first": F.min("pos").over(clade)})
    groups = rows.groupBy("base_seq").agg(
        F.first("fold").alias("strand"),
        F.sum("norm_score").alias("score"),
        F.sort_array(F.collect_list(F.struct("pos", "g", "c", "o", "s"))).alias("d"),
        F.sort_array(F.collect_set(F.struct((-F.col("weight")).alias("w"), "first", "c"))).alias("v"),
        # Null labels count as one more value.
        *((F.count_distinct(x) + F.max(F.col(x).isNull().cast("int"))).alias(f"n_{x}") for x in ("o", "s")),
    )
    best = F.get("v", F.lit(0))
    n = F.size("v")
    if not count_votes:
        clear = (n == 1) | (F.get("v", F.lit(1))["w"] > best["w"])
    elif db.style == "prefix":
        clear = (n == 1) | (best["w"] < -1)
    else:
        seen = F.transform(F.sort_array(F.transform("v", lambda x: F.struct(x["first"], x["w"]))), lambda x: x["w"])
        clear = (n == 1) | ((best["w"] < -1) & (F.get(seen, F.lit(0)) < F.get(seen, F.lit(1))))
    lead = F.get(F.filter("d", lambda x: x["c"] == best["c"]), F.lit(0))
    groups = groups.withColumns({"clear": clear, "win": best["c"], "lead": lead})
    mixed = ~F.col("clear")
    order = F.when(mixed & (F.col("n_s") > 1) & (F.col("n_o") > 1), MIXTURE).otherwise(F.coalesce("lead.o", F.lit("Unknown")))
    family = F.when(mixed & (F.col("n_s") > 1), MIXTURE).otherwise(F.coalesce("lead.s", F.lit(UNKNOWN)))
    out = groups.withColumns({"order": order, "superfamily": family, "shown": F.when(mixed, MIXTURE).otherwise(F.col("win"))})
    if db.style == "constant":
        out = out.withColumn("shown", F.lit(UNKNOWN))
    if db.style == "path":
        restricted = (~F.col("superfamily").isin(*db.clade_only_for)) if db.clade_only_for else F.lit(False)
        out = out.withColumn("shown", F.when(restricted | F.col("shown").startswith("Ty"), UNKNOWN).otherwise(F.col("shown")))
    text = F.array_join(F.transform("d", lambda x: F.concat_ws("|", x["g"], x["c"])), " ")
    return out.select(F.col("base_seq").alias("id"), "order", "superfamily", F.col("shown").alias("clade"), _complete(db).alias("complete"), "strand", text.alias("domains"), "score")


def _complete(db: Database) -> Column:
    """Whether the expected genes are there in order and number; unknown where nothing is expected."""
    genes = F.transform("d", lambda x: x["g"])
    out = F.lit(UNKNOWN)
    for (order, family), expected in db.structures.items():
        wanted = F.array(*map(F.lit, expected))
        whole = F.filter(genes, lambda g: F.array_contains(wanted, g)) == wanted
        out = F.when((F.col("order") == order) & (F.col("superfamily") == family), F.when(whole, "yes").otherwise("no")).otherwise(out)
    return out


def harmonized(calls: DataFrame, harmonization: DataFrame) -> DataFrame:
    """Adds ``order_h, superfamily_h, clade_h, lineage_h``; a pair that is not listed stays as it is."""
    table = harmonization.dropDuplicates(["db", "order_native", "superfamily_native", "clade_native"])
    same = (F.col("db") == F.col("database")) & (F.col("order_native") == F.col("order")) & (F.col("superfamily_native") == F.col("superfamily")) & (F.col("clade_native") == F.col("clade"))
    joined = calls.join(table, same, "left")
    return joined.select(calls["*"], *(F.coalesce(f"{x}_h", x).alias(f"{x}_h") for x in ("order", "superfamily", "clade")), F.coalesce("lineage_h", F.lit("")).alias("lineage_h"))


def _labels_won(pool: Column, level: str) -> Column:
    """The label of the level with the largest summed score among calls, first database on a tie; null for no calls."""

    def rank(x: Column) -> Column:
        same = F.filter(pool, lambda y: y[level].eqNullSafe(x[level]))
        total = F.round(F.aggregate(same, F.lit(0.0), lambda a, y: a + y["score"]), 9)
        return F.struct((-total).alias("t"), F.array_min(F.transform(same, lambda y: y["database"])).alias("f"), x[level].alias("label"))

    return F.array_min(F.transform(pool, rank))["label"]


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once per row: unlike a projection, a generator is not put into the expressions that use it."""
    return rows.select(*(c for c in rows.columns if c != name), F.explode(F.array(value)).alias(name))


def reconcile(calls: DataFrame, harmonization: DataFrame, scope: DataFrame) -> DataFrame:
    """One call per element from the databases' calls ``(database, id, order, superfamily, clade, score, ...)``.

    Labels are harmonized where two databases or more speak. Order, superfamily and
    clade are voted in turn by summed score, each among the calls that agree with the
    winners so far. A superfamily that only its own database can resolve wins over the
    vote if that database can also resolve a competing one and no other claim
    qualifies. The primary call is the highest of those left; the lineage is voted
    among those that have one; ``secondary`` keeps all calls under native names.

    A call without a score counts with 0. An element's calls, at most one per database, are gathered once and voted on as an
    array, so the whole takes one shuffle and no sort.
    """
    kept = [c for c in calls.columns if c not in ("id", "database", "order", "superfamily", "clade", "score")]
    # Which superfamilies each database resolves.
    can = scope.where("resolving").groupBy(F.col("db").alias("database")).agg(F.collect_set("superfamily_h").alias("can"))
    rows = harmonized(calls, harmonization).join(can, "database", "left").withColumn("can", F.coalesce("can", F.array().cast("array<string>")))
    labels = [f"{x}{s}" for x in ("order", "superfamily", "clade") for s in ("", "_h")]
    each = F.struct("database", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), *labels, "lineage_h", "can", F.struct(F.lit(0).alias("_"), *kept).alias("kept"))
    groups = rows.groupBy("id").agg(F.sort_array(F.collect_list(each)).alias("calls"))

    several = F.array_min(F.transform("calls", lambda x: x["database"])) != F.array_max(F.transform("calls", lambda x: x["database"]))
    speak = lambda x, level: F.when(F.col("several"), x[f"{level}_h"]).otherwise(x[level]).alias(level)
    line = lambda x: F.when(F.col("several"), x["lineage_h"]).otherwise("").alias("lineage")
    spoken = lambda x: F.struct(x["database"].alias("database"), x["score"].alias("score"), *(speak(x, v) for v in ("order", "superfamily", "clade")), line(x), x["can"].alias("can"), x["kept"].alias("kept"))
    left = _once(groups.withColumn("several", several), "pool", F.transform("calls", spoken))
    left = _once(left, "top", _labels_won(F.col("pool"), "order"))
    left = _once(left, "pool", F.filter("pool", lambda x: x["order"].eqNullSafe(F.col("top"))))

    contested = lambda x: F.exists("pool", lambda y: (y["database"] != x["database"]) & F.array_contains(y["can"], x["superfamily"]))
    competent = lambda x: F.exists("pool", lambda y: (y["superfamily"] != x["superfamily"]) & F.array_contains(x["can"], y["superfamily"]))
    qualified = F.array_distinct(F.transform(F.filter("pool", lambda x: F.col("several") & ~F.coalesce(contested(x), F.lit(False)) & F.coalesce(competent(x), F.lit(False))), lambda x: x["superfamily"]))
    left = _once(left, "qualified", qualified)
    left = _once(left, "top", F.when(F.size("qualified") == 1, F.get("qualified", F.lit(0))).otherwise(_labels_won(F.col("pool"), "superfamily")))
    left = _once(left, "pool", F.filter("pool", lambda x: x["superfamily"] == F.col("top")))
    left = _once(left, "top", _labels_won(F.col("pool"), "clade"))
    left = _once(left, "pool", F.filter("pool", lambda x: x["clade"] == F.col("top")))
    lineage = F.coalesce(_labels_won(F.filter("pool", lambda x: x["lineage"] != ""), "lineage"), F.lit(""))
    first = F.array_sort("pool", lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).when(x["database"] < y["database"], -1).when(x["database"] > y["database"], 1).otherwise(0))
    # All calls under native names, by falling score.
    native = F.sort_array(F.transform("calls", lambda x: F.struct((-x["score"]).alias("neg"), x["database"].alias("database"), x["order"].alias("order"), x["superfamily"].alias("superfamily"), x["clade"].alias("clade"))))
    secondary = F.transform(native, lambda x: F.struct(x["database"].alias("db"), x["order"].alias("order"), x["superfamily"].alias("superfamily"), x["clade"].alias("clade"), (-x["neg"]).alias("score")))
    out = left.where(F.size("pool") > 0).select("id", F.get(first, F.lit(0)).alias("p"), lineage.alias("lineage"), secondary.alias("secondary"))
    return out.select("id", *(F.col(f"p.{x}").alias(x) for x in ("order", "superfamily", "clade")), *(F.col("p.score") if c == "score" else F.col(f"p.kept.{c}") for c in calls.columns if c in kept or c == "score"), "lineage", F.col("p.database").alias("primary_db"), "secondary")


def inherit_from_similar(blast: DataFrame, classified: DataFrame, calls: DataFrame, *, database: str | None = None) -> DataFrame:
    """Calls of unclassified queries from their best strong similarity hit.

    Hits need 80 percent identity, 80 percent query coverage and 80 bases; of these
    the highest bit score of a query counts even if its subject has no call; hits
    without subject or bit score do not count. Only order and superfamily are inherited.
    """
    strong = blast.where(F.col("bitscore").isNotNull() & F.col("sseqid").isNotNull() & (F.col("pident") >= 80) & (F.col("qcovs") >= 80) & (F.col("length") >= 80))
    if database:
        strong = strong.where(F.col("classified_by").contains(database))
    open_ = strong.join(classified.select(F.col("id").alias("qseqid")).distinct(), "qseqid", "left_anti")
    best = open_.groupBy("qseqid").agg(F.min_by("sseqid", F.struct(-F.col("bitscore"), F.col("sseqid"))).alias("sseqid"), F.max("bitscore").alias("bitscore"))
    source = calls.select(F.col("id").alias("sseqid"), "order", "superfamily")
    lit = {"clade": UNKNOWN, "complete": "none", "strand": "?", "domains": "none"}
    return best.join(source, "sseqid").select(F.col("qseqid").alias("id"), "order", "superfamily", *(F.lit(v).alias(k) for k, v in lit.items()), F.col("sseqid").alias("source"), "bitscore")


def split_by_hits(sequences: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences with any hit, and those without."""
    known = hits.select(F.col("base_seq").alias("name")).distinct()
    return sequences.join(known, "name", "left_semi"), sequences.join(known, "name", "left_anti")


def database_lists(hits: DataFrame) -> DataFrame:
    """``(base_seq, classified_by)``: the sequence's databases, sorted and comma separated."""
    pairs = hits.where(F.col("base_seq").isNotNull() & F.col("database").isNotNull()).select("base_seq", "database").distinct()
    return pairs.groupBy("base_seq").agg(F.array_join(F.array_sort(F.collect_list("database")), ",").alias("classified_by"))
