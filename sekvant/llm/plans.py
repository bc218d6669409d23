"""Queries of this package's operators over a data directory, and the SQL they are checked against."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sekvant.llm import abuse, bpe, consensus, packing, splitting, top_n
from sekvant.staging import staged
from sekvant.tables import table

#: Problem 1: hits kept per sequence and domain type.
TOP_HITS = 3
#: Problem 2, fixed values: words that stand for "nothing known".
PLACEHOLDERS = ("unknown", "mixture", "none", "na", "?", ".")
#: Problem 4: bases of a piece and bases shared with the next, and the names of unknown-base stretches.
PIECE_LIMIT, PIECE_OVERLAP = 100_000, 1_000
GAP_TYPES = ("gap", "assembly_gap", "N_region")
#: Coordinates at the end of a name, 1-based with both ends, as different tools write them.
COORDINATES = r"[:_\[]c?([0-9][0-9,]*)(?:-|\.\.|:)([0-9][0-9,]*)\]?(?:\([+-]\))?$"
#: Problem 9, fixed values: labels of cases and of others.
CASES, OTHERS = ("abusive", "hateful", "sexual"), ("ok",)
#: Problem 8: tokens of a container.
CONTAINER_TOKENS = 1_024


def _single_hits(hits: DataFrame) -> DataFrame:
    """Rows equal in every column but id and loaded_at as one, under their smallest id.

    The columns the search needs are compared themselves, the others through two
    64-bit hashes with different starts, to which the pattern of nulls is added.
    """
    own = ("base_seq", "domain_type", "dom_score")
    rest = [F.col(c) for c in sorted(hits.columns) if c not in (*own, "id", "loaded_at")]
    nulls = F.concat(*(c.isNull().cast("int").cast("string") for c in rest))
    hashes = [F.xxhash64(nulls, *rest).alias("h1"), F.xxhash64(F.lit("second"), nulls, *rest).alias("h2")]
    return hits.where(F.col("base_seq").isNotNull() & F.col("domain_type").isNotNull() & F.col("dom_score").isNotNull() & ~F.isnan("dom_score")).select(*own, "id", *hashes).groupBy(*own, "h1", "h2").agg(F.min("id").alias("id"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the best hits of every sequence and domain type."""
    hits = _single_hits(table(spark, sf_dir, "legacy_hits"))
    best = top_n.top_n(hits, [F.col("base_seq"), F.upper(F.trim("domain_type"))], F.col("dom_score"), F.col("id"), TOP_HITS, unique_ids=True)
    return best.select(F.col("row_id").alias("id"))


def _bare(c: str) -> Column:
    return F.lower(F.trim(c))


def _names(harmonization: DataFrame, column: str) -> DataFrame:
    """The harmonization's spelling of each harmonized name."""
    return harmonization.where(F.col(column).isNotNull()).groupBy(_bare(column).alias(f"{column}_key")).agg(F.min(F.trim(column)).alias(f"{column}_name"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each database's word on each element, harmonized: ``(item, annotator, grp, part)``.

    The harmonization is joined without a hint: Spark broadcasts it by its size, or shuffles.
    """
    rows = table(spark, sf_dir, "classifications").where(F.col("seq_id").isNotNull() & F.col("database").isNotNull())
    latest = rows.groupBy("seq_id", "database").agg(F.max(F.struct("loaded_at", "cls_id", "superfamily", "clade")).alias("w")).select("seq_id", "database", "w.superfamily", "w.clade")
    given = lambda c: F.col(c).isNotNull() & (F.trim(c) != "") & ~_bare(c).isin(*PLACEHOLDERS)
    said = latest.where(given("superfamily")).withColumn("clade", F.when(given("clade"), F.col("clade")))
    said = said.withColumn("c_key", F.coalesce(_bare("clade"), F.lit("unknown")))
    names = table(spark, sf_dir, "harmonization")
    h = names.groupBy(_bare("db").alias("d_"), _bare("superfamily_native").alias("s_"), _bare("clade_native").alias("c_")).agg(F.min(F.struct("superfamily_h", "clade_h")).alias("h"))
    joined = said.join(h, (_bare("database") == F.col("d_")) & (_bare("superfamily") == F.col("s_")) & (F.col("c_key") == F.col("c_")), "left")
    joined = joined.select("seq_id", "database", F.trim(F.coalesce("h.superfamily_h", "superfamily")).alias("s"), F.trim(F.when(F.col("clade").isNotNull(), F.coalesce("h.clade_h", "clade"))).alias("c"))
    spelt = joined.join(_names(names, "superfamily_h"), _bare("s") == F.col("superfamily_h_key"), "left").join(_names(names, "clade_h"), _bare("c") == F.col("clade_h_key"), "left")
    part = F.coalesce("clade_h_name", "c")
    return spelt.select(F.col("seq_id").alias("item"), F.col("database").alias("annotator"), F.coalesce("superfamily_h_name", "s").alias("grp"), F.when(~F.lower(part).isin(*PLACEHOLDERS), part).alias("part"))


def _consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = consensus.annotations(staged(_words(spark, sf_dir), "words"))
    return consensus.consensus(votes, consensus.learn(votes))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements whose databases contradict each other, with the names they really have."""
    return _consensus(spark, sf_dir).where("contradicts").select(F.col("item").alias("seq_id"), F.col("grp").alias("superfamily"), F.coalesce("part", F.lit("unknown")).alias("clade"))


def p2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One harmonized label per element with the databases' agreement."""
    found = _consensus(spark, sf_dir)
    return found.select(F.col("item").alias("seq_id"), F.col("grp").alias("superfamily"), F.coalesce("part", F.lit("unknown")).alias("clade"), "confidence", "agreement", F.col("n_votes").alias("n_databases"))


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the databases agree on every element, and whether they contradict each other."""
    found = _consensus(spark, sf_dir)
    return found.select(F.col("item").alias("seq_id"), F.col("n_votes").cast("bigint").alias("n_databases"), F.round("agreement", 9).alias("agreement"), "contradicts")


def p2_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of every database on superfamilies and on clades, and whom it copies."""
    model = consensus.learn(consensus.annotations(staged(_words(spark, sf_dir), "words")))
    copied = {b: (model.annotators[a], rate) for b, a, rate in model.copies}
    rows = [(w, float(model.group_accuracy[i]), float(model.part_accuracy[i]), *copied.get(i, (None, None))) for i, w in enumerate(model.annotators)]
    return spark.createDataFrame(rows, "database string, superfamily_accuracy double, clade_accuracy double, copies string, copy_rate double")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name's size by its latest row, from the coordinates in the name if the length is no use."""
    latest = table(spark, sf_dir, "sequences").where(F.col("name").isNotNull()).groupBy("name").agg(F.max(F.struct("loaded_at", "length"))["length"].alias("length"))
    ends = [F.expr(f"try_cast(replace(regexp_extract(name, r'{COORDINATES}', {k}), ',', '') AS bigint)") for k in (1, 2)]
    return latest.select("name", F.when(F.col("length") > 0, F.col("length").cast("bigint")).otherwise(F.abs(ends[0] - ends[1]) + 1).alias("size"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that are too large to search at once."""
    gaps = table(spark, sf_dir, "gff_features").where(F.col("f_type").isin(*GAP_TYPES)).select(F.col("seqid").alias("name"), F.col("f_start").alias("gap_from"), F.col("f_end").alias("gap_to"))
    return splitting.split_oversized(_sizes(spark, sf_dir), gaps, limit=PIECE_LIMIT, overlap=PIECE_OVERLAP)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the sequences that were cut."""
    return p4_pieces(spark, sf_dir).where("piece = 2").select("name")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every review's text."""
    return table(spark, sf_dir, "documents").select("doc_id", bpe.token_ids(F.col("text")).alias("ids"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and place of every review, in tokens; a review above a container in pieces."""
    docs = table(spark, sf_dir, "documents").select("doc_id", bpe.token_count(F.col("text")).alias("tokens"))
    return packing.pack(docs, F.col("doc_id"), F.col("tokens"), CONTAINER_TOKENS).withColumnRenamed("row_id", "doc_id")


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the containers in one row: containers too full or with holes in their places, reviews cut for no need, and whether they are dense."""
    rows = p8_containers(spark, sf_dir)
    place = F.col("place")
    bins = rows.groupBy("container").agg(F.sum("piece_size").alias("size"), F.count(F.lit(1)).alias("n"), F.sum(place).alias("places"), F.max(place).alias("last"))
    holes = (F.col("last") + 1 != F.col("n")) | (F.col("places") * 2 != F.col("n") * (F.col("n") - 1))
    by_bin = bins.agg(F.count_if(F.col("size") > CONTAINER_TOKENS).alias("n_over"), F.count_if(holes).alias("n_holes"), (F.count(F.lit(1)) <= F.coalesce(F.sum("size"), F.lit(0)) / CONTAINER_TOKENS * 1.01 + 2).alias("dense"))
    # Every review has one first piece; only whole containers are cut off one that is too large.
    by_doc = rows.agg(F.count_if(F.col("piece") == 0).alias("n_reviews"), F.count_if(F.col("piece_from") != F.col("piece") * CONTAINER_TOKENS).alias("n_cut"))
    fault = by_bin.select(F.struct("*")).scalar()
    return by_doc.select("n_reviews", "n_cut", *(fault[c].alias(c) for c in ("n_over", "n_holes", "dense")))


#: Models by what they were fitted on, so that one process fits the same labels once.
_models: dict[str, abuse.Model] = {}


def abuse_model(spark: SparkSession, sf_dir: str) -> abuse.Model:
    """The model of the labelled reviews; at most ``abuse.MAX_LABELLED`` of them, chosen by their text's hash.

    The word list, a vocabulary, is taken whole.
    """
    label = F.lower(F.trim("label"))
    judged = table(spark, sf_dir, "review_labels").where(label.isin(*CASES, *OTHERS) & F.col("doc_id").isNotNull()).select("doc_id", "labeller", label.isin(*CASES).alias("case"))
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")
    votes = F.sort_array(F.collect_list(F.struct("labeller", "case")))
    rows = docs.join(judged.groupBy("doc_id").agg(votes.alias("votes")), "doc_id").orderBy(F.xxhash64("text"), "doc_id").limit(abuse.MAX_LABELLED).collect()
    rows.sort(key=lambda r: r.doc_id)
    labels = [(r.doc_id, v.labeller, v.case) for r in rows for v in r.votes]
    words = table(spark, sf_dir, "abuse_terms").where(F.col("term").isNotNull()).select("term", "kind", "strength").distinct().collect()
    given = ({r.doc_id: r.text for r in rows}, labels, sorted((tuple(w) for w in words), key=str))
    key = hashlib.sha256(repr(given).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _models:
        if len(_models) >= 4:
            _models.clear()
        _models[key] = abuse.fit(*given)
    return _models[key]


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every review, between 0 and 1."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", abuse.scores(F.col("text"), abuse_model(spark, sf_dir)).alias("score"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that are taken for cases."""
    return p9_scores(spark, sf_dir).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cases per source."""
    case = (F.col("score") >= abuse.THRESHOLD).cast("int")
    return p9_scores(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_reviews"), F.sum(case).alias("n_cases"), F.avg(case).alias("rate"), F.avg("score").alias("mean_score"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_consensus": p2_consensus, "p2_agreement": p2_agreement, "p2_reliability": p2_reliability, "p4_found": p4_found, "p4_pieces": p4_pieces, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_check": p8_check, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}

#: Sequences above the limit with their sizes.
_BIG = r"""latest AS (
  SELECT name, length FROM sequences WHERE name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY loaded_at DESC, length DESC NULLS LAST) = 1),
c AS (
  SELECT name, length, regexp_extract(name, '[:_\[]c?([0-9][0-9,]*)(?:-|\.\.|:)([0-9][0-9,]*)\]?(?:\([+-]\))?$', ['a', 'b']) AS e FROM latest),
big AS (
  SELECT * FROM (SELECT name, CASE WHEN length > 0 THEN length::BIGINT
    ELSE abs(try_cast(replace(e.a, ',', '') AS BIGINT) - try_cast(replace(e.b, ',', '') AS BIGINT)) + 1 END AS size FROM c) WHERE size > 100000)"""

ORACLES = {
    "p1_found": """
WITH one AS (
  SELECT min(id) AS id, base_seq, upper(trim(domain_type)) AS d, dom_score
  FROM legacy_hits
  WHERE base_seq IS NOT NULL AND domain_type IS NOT NULL AND dom_score IS NOT NULL AND NOT isnan(dom_score)
  GROUP BY database, target_name, base_seq, strand, frame, target_len, query_name, domain_type, query_len, evalue,
    score, bias, dom_num, dom_of, c_evalue, i_evalue, dom_score, dom_bias, hmm_from, hmm_to, ali_from, ali_to,
    env_from, env_to, acc, search_mode, run_at)
SELECT id FROM one QUALIFY row_number() OVER (PARTITION BY base_seq, d ORDER BY dom_score DESC, id) <= 3""",
    "p2_agreement": """
WITH latest AS (
  SELECT seq_id, database, superfamily, clade FROM classifications WHERE seq_id IS NOT NULL AND database IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY seq_id, database ORDER BY loaded_at DESC NULLS LAST, cls_id DESC) = 1),
said AS (
  SELECT seq_id, database, superfamily, CASE WHEN lower(trim(clade)) NOT IN ('', 'unknown', 'mixture', 'none', 'na', '?', '.') THEN clade END AS clade FROM latest
  WHERE lower(trim(superfamily)) NOT IN ('', 'unknown', 'mixture', 'none', 'na', '?', '.')),
h AS (SELECT lower(trim(db)) AS d, lower(trim(superfamily_native)) AS s, lower(trim(clade_native)) AS c, min({'s': superfamily_h, 'c': clade_h}) AS x FROM harmonization GROUP BY 1, 2, 3),
w AS (
  SELECT seq_id, database, lower(trim(coalesce(x.s, superfamily))) AS s, CASE WHEN clade IS NOT NULL THEN lower(trim(coalesce(x.c, clade))) END AS c
  FROM said LEFT JOIN h ON h.d = lower(trim(database)) AND h.s = lower(trim(superfamily)) AND h.c = coalesce(lower(trim(clade)), 'unknown')),
v AS (SELECT * REPLACE (CASE WHEN c NOT IN ('unknown', 'mixture', 'none', 'na', '?', '.') THEN c END AS c) FROM w),
p AS (
  SELECT x.seq_id, count(*) AS n, count(*) FILTER (x.s = y.s) AS same, bool_or(x.s <> y.s OR coalesce(x.c <> y.c, FALSE)) AS against
  FROM v x JOIN v y ON x.seq_id = y.seq_id AND x.database < y.database GROUP BY 1),
k AS (SELECT seq_id, count(*) AS n FROM v GROUP BY 1)
SELECT k.seq_id, k.n AS n_databases, round(p.same::DOUBLE / p.n, 9) AS agreement, coalesce(p.against, FALSE) AS contradicts FROM k LEFT JOIN p USING (seq_id)""",
    "p4_found": f"WITH {_BIG} SELECT name FROM big",
    # Boundaries are taken from the weakest to the strongest and merged over where the piece still fits.
    "p4_pieces": f"""
WITH RECURSIVE {_BIG},
g AS (
  SELECT DISTINCT seqid AS name, least(f_start, f_end) AS f, greatest(f_start, f_end) AS t FROM gff_features
  WHERE f_type IN ('gap', 'assembly_gap', 'N_region') AND seqid IS NOT NULL AND f_start IS NOT NULL AND f_end IS NOT NULL),
m AS (SELECT *, max(t) OVER (PARTITION BY name ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR f > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS island FROM m),
s AS (SELECT name, size, greatest(min(f), 1) AS a, least(max(t), size) AS b FROM i JOIN big USING (name) GROUP BY name, size, island),
u AS (
  SELECT name, size, b - a + 1 AS strength, unnest(list_distinct(CASE WHEN b - a > 99000 THEN list_append(range(a, b + 1, 99000), b) ELSE [a, greatest((a + b) // 2, least(b, 1000)), b] END)) AS pos FROM s WHERE a <= b),
cut AS (SELECT * FROM u WHERE pos >= 1000 AND pos < size),
marks AS (SELECT name, size, pos FROM cut UNION ALL SELECT name, size, size FROM big),
steps AS (SELECT name, pos, coalesce(lag(pos) OVER (PARTITION BY name ORDER BY pos), 0) AS before FROM marks),
bound AS (
  SELECT name, pos, strength FROM cut
  UNION ALL SELECT name, unnest(range(before + CASE WHEN before = 0 THEN 100000 ELSE 99000 END, pos, 99000)), 0 FROM steps),
ranked AS (SELECT name, pos, row_number() OVER (PARTITION BY name ORDER BY strength, pos) AS r FROM bound),
kept AS (
  SELECT big.name, 0::BIGINT AS r, list_concat([0::BIGINT], coalesce(list(pos ORDER BY pos) FILTER (pos IS NOT NULL), []::BIGINT[]), [size]) AS ends FROM big LEFT JOIN bound USING (name) GROUP BY big.name, size
  UNION ALL
  SELECT k.name, b.r, CASE WHEN k.ends[list_position(k.ends, b.pos) + 1] - k.ends[list_position(k.ends, b.pos) - 1] + CASE WHEN k.ends[list_position(k.ends, b.pos) - 1] > 0 THEN 1000 ELSE 0 END <= 100000
    THEN list_filter(k.ends, lambda x: x <> b.pos) ELSE k.ends END
  FROM kept k JOIN ranked b ON b.name = k.name AND b.r = k.r + 1),
last AS (SELECT name, ends FROM kept QUALIFY row_number() OVER (PARTITION BY name ORDER BY r DESC) = 1),
e AS (SELECT name, ends, unnest(range(1, len(ends))) AS k FROM last)
SELECT name, k::INTEGER AS piece, CASE WHEN k = 1 THEN 1 ELSE ends[k] - 999 END AS pos_from, ends[k + 1] AS pos_to FROM e""",
    "p8_check": "SELECT count(*) AS n_reviews, 0::BIGINT AS n_cut, 0::BIGINT AS n_over, 0::BIGINT AS n_holes, TRUE AS dense FROM documents",
}
