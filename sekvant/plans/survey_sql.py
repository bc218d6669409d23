"""SQL of the domain's queries, in DuckDB's dialect, written apart from the plans it checks."""

from __future__ import annotations

from sekvant.functions.sequences import amino_acids

#: Usable hits with derived columns.
H = """h AS (
  SELECT * REPLACE (upper(trim(domain_type)) AS domain_type, least(env_from, env_to) AS env_from, greatest(env_from, env_to) AS env_to),
    dom_score / query_len AS norm_score, 100.0::DOUBLE * (hmm_to - hmm_from + 1) / query_len AS hmm_cov
  FROM legacy_hits
  WHERE base_seq IS NOT NULL AND target_name IS NOT NULL AND query_name IS NOT NULL AND domain_type IS NOT NULL AND dom_score IS NOT NULL
    AND NOT isnan(dom_score) AND env_from IS NOT NULL AND env_to IS NOT NULL AND query_len > 0)"""
PASS = "hmm_cov >= 20 AND i_evalue <= 1e-3 AND acc >= 0.5 AND norm_score >= 0.1"
R2 = "round_even({0} * 100, 0) / 100"
KEEP = "id, base_seq, target_name, query_name, domain_type, dom_score, env_from, env_to"
TIE = "query_name, target_name, env_from, id"
SPLIT = r"""regexp_full_match({0}, '(?s).*\|(fwd|rev)[^|]*[0-9]')"""


def _best(keys: str, score: str = "dom_score DESC", where: str = "TRUE", source: str = "h") -> str:
    return f"SELECT * FROM {source} WHERE {where} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {score}, {TIE}) = 1"


def _gene(remap: bool) -> str:
    return "CASE domain_type WHEN 'TPASE' THEN 'INT' WHEN 'ARH' THEN 'RH' ELSE domain_type END" if remap else "domain_type"


def _domains(database: str | None, remap: bool = False, rounded: bool = False) -> str:
    """CTEs up to ``d``: the best domains that pass."""
    norm = R2.format("norm_score") if rounded else "norm_score"
    ok = f"{R2.format('hmm_cov')} >= 20 AND i_evalue <= 1e-3 AND acc >= 0.5 AND {norm} >= 0.1" if rounded else PASS
    where = f"WHERE database = '{database}'" if database else ""
    return f"""{H}, g AS (SELECT *, {_gene(remap)} AS gene FROM h {where}),
b AS ({_best("base_seq, gene", f"{norm} DESC, dom_score DESC", source="g")}),
d AS (SELECT * FROM b WHERE {ok})"""


_PATH = "split_part(query_name, ':', 1)"
_HAS = "contains(query_name, ':')"


def _path(column: str) -> dict[str, str]:
    p, has = f"split_part({column}, ':', 1)", f"contains({column}, ':')"
    part = lambda i: f"coalesce(nullif(split_part({p}, '/', {i + 1}), ''), 'unknown')"
    rest = f"substr({column}, instr({column}, ':') + 1)"
    case = lambda a, b, c: f"CASE WHEN NOT {has} THEN '{c}' WHEN starts_with({p}, 'Class_I/LTR/Ty1_copia') THEN '{a[0]}' WHEN starts_with({p}, 'Class_I/LTR/Ty3_gypsy') THEN '{a[1]}' WHEN starts_with({p}, 'Class_I/') THEN {part(b[0])} WHEN starts_with({p}, 'Class_II/') THEN {part(b[1])} WHEN starts_with({p}, 'NA') THEN '{a[2]}' ELSE '{c}' END"
    return {
        "o": case(("LTR", "LTR", "LTR"), (1, 2), "Unknown"),
        "s": case(("Copia", "Gypsy", "Retrovirus"), (2, 3), "unknown"),
        "c": f"CASE WHEN {has} THEN split_part({p}, '/', -1) ELSE {column} END",
        "g": f"CASE WHEN {has} THEN split_part({rest}, '-', -1) ELSE {column} END",
    }


def _classify(database: str, style: str, structures: dict, only: tuple = (), count: bool = False, rounded: bool = False) -> str:
    """CTEs up to ``calls``: a database's call on every element."""
    if style == "path":
        p = _path("query_name")
        labelled = f"l AS (SELECT d.*, {p['o']} AS o, {p['s']} AS s, {p['c']} AS c, {p['g']} AS g FROM d)"
    elif style == "prefix":
        labelled = """cm AS (
  SELECT clade_native AS c, min({'o': order_h, 's': superfamily_h}) AS x FROM harmonization WHERE db = 'gyrodb' AND clade_native <> 'unknown' GROUP BY 1),
n AS (SELECT d.*, CASE WHEN contains(query_name, '_') THEN substr(query_name, instr(query_name, '_') + 1) ELSE query_name END AS c, split_part(query_name, '_', 1) AS g FROM d),
l AS (SELECT n.*, x.o AS o, x.s AS s FROM n LEFT JOIN cm USING (c))"""
    else:
        labelled = "l AS (SELECT d.*, 'SINE' AS o, 'unknown' AS s, 'SINE' AS c, 'SINE' AS g FROM d)"
    weight = "count(*)::DOUBLE" if count else "round(sum(norm_score), 9)"
    if not count:
        clear = "n = 1 OR top > second"
    elif style == "prefix":
        clear = "n = 1 OR top > 1"
    else:
        clear = "n = 1 OR (top > 1 AND seen1 > seen2)"
    complete = " ".join(f"WHEN ord = '{o}' AND fam = '{s}' THEN CASE WHEN list_filter(genes, lambda x: list_contains({e}, x)) = {e} THEN 'yes' ELSE 'no' END" for (o, s), e in structures.items())
    restrict = " OR ".join([f"fam NOT IN ({', '.join(repr(x) for x in only)})"] * bool(only) + ["starts_with(shown, 'Ty')"] * (style == "path"))
    shown = f"CASE WHEN {restrict} THEN 'unknown' ELSE shown END" if restrict else ("'unknown'" if style == "constant" else "shown")
    return f"""{_domains(database, rounded=rounded)}, {labelled},
w AS (SELECT *, CASE WHEN contains(target_name, '|fwd') THEN '+' WHEN contains(target_name, '|rev') THEN '-' ELSE '.' END AS way FROM l),
f AS (SELECT *, CASE WHEN min(way) OVER e = max(way) OVER e THEN max(way) OVER e ELSE '?' END AS fold, row_number() OVER (PARTITION BY base_seq ORDER BY env_from, gene) AS a, count(*) OVER e AS cnt FROM w WINDOW e AS (PARTITION BY base_seq)),
q AS (SELECT *, CASE WHEN fold = '-' THEN cnt + 1 - a ELSE a END AS pos FROM f),
v AS (SELECT base_seq, c, {weight} AS wt, min(pos) AS first FROM q GROUP BY 1, 2),
k AS (SELECT base_seq, count(*) AS n, max(wt) AS top, list(wt ORDER BY wt DESC)[2] AS second, list(c ORDER BY wt DESC, first)[1] AS win,
  list(wt ORDER BY first)[1] AS seen1, list(wt ORDER BY first)[2] AS seen2 FROM v GROUP BY 1),
z AS (SELECT q.base_seq, any_value(q.fold) AS strand, sum(norm_score) AS score, list(g ORDER BY pos) AS genes,
  string_agg(g || '|' || c, ' ' ORDER BY pos) AS domains, any_value(win) AS win, bool_and({clear}) AS clear,
  list(o ORDER BY pos) FILTER (q.c = win) AS lo, list(s ORDER BY pos) FILTER (q.c = win) AS ls,
  count(DISTINCT coalesce(o, '~null')) AS n_o, count(DISTINCT coalesce(s, '~null')) AS n_s FROM q JOIN k USING (base_seq) GROUP BY 1),
y AS (SELECT *, CASE WHEN NOT clear AND n_s > 1 AND n_o > 1 THEN 'mixture' ELSE coalesce(lo[1], 'Unknown') END AS ord,
  CASE WHEN NOT clear AND n_s > 1 THEN 'mixture' ELSE coalesce(ls[1], 'unknown') END AS fam, CASE WHEN clear THEN win ELSE 'mixture' END AS shown FROM z),
calls AS (SELECT base_seq AS id, ord AS "order", fam AS superfamily, {shown} AS clade, {f"CASE {complete} ELSE 'unknown' END" if complete else "'unknown'"} AS complete, strand, domains, score FROM y)"""


_AX = {("LTR", "Corvia"): ["GAG", "PROT", "INT", "RT", "RH"], ("LTR", "Gestrel"): ["GAG", "PROT", "RT", "RH", "INT"], ("LTR", "Belmar"): ["GAG", "PROT", "RT", "RH", "INT"]}
_GY = {("LTR", "Corvia"): ["GAG", "PROT", "INT", "RT", "RH"]}
_CALL = 'SELECT id, "order", superfamily, clade, complete, strand, domains, round(score, 6) AS score FROM calls'
_AX_CALLS = _classify("axdb", "path", _AX, ("Corvia", "Gestrel"))

DNA = """dna AS (SELECT 'doc' || doc_id AS name, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'),
  'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTNNACGTACGTACGTACGTACGTACGTNN') AS seq FROM documents WHERE text IS NOT NULL)"""
_RC = "reverse(translate(seq, 'ACGTacgt', 'TGCAtgca'))"

#: The stored classifications as calls, and what reconciling makes of them.
REC = """rows AS (
  SELECT seq_id AS id, database, te_order AS "order", superfamily, clade, (cls_id % 97 + 1)::DOUBLE AS score FROM classifications
  WHERE seq_id IS NOT NULL AND database IS NOT NULL AND superfamily IS NOT NULL AND clade IS NOT NULL AND te_order IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY seq_id, database ORDER BY loaded_at DESC, cls_id DESC) = 1)"""
HARM = """hz AS (
  SELECT r.*, coalesce(t.order_h, r."order") AS oh, coalesce(t.superfamily_h, r.superfamily) AS sh, coalesce(t.clade_h, r.clade) AS ch, coalesce(t.lineage_h, '') AS lh
  FROM rows r LEFT JOIN (SELECT DISTINCT ON (db, order_native, superfamily_native, clade_native) * FROM harmonization) t
  ON t.db = r.database AND t.order_native = r."order" AND t.superfamily_native = r.superfamily AND t.clade_native = r.clade)"""
SCOPE = "scope(db, sf) AS (VALUES ('axdb','Corvia'), ('axdb','Gestrel'), ('gyrodb','Gestrel'), ('gyrodb','Belmar'), ('plantrep','Corvia'), ('plantrep','Hadrix'), ('tirscan','Hadrix'), ('tirscan','Mutavo'))"


def _won(name: str, source: str, level: str) -> str:
    return f"""{name}v AS (SELECT id, {level}, round(sum(score), 9) AS t, min(database) AS f FROM {source} GROUP BY 1, 2),
{name}w AS (SELECT id, {level} AS top FROM {name}v QUALIFY row_number() OVER (PARTITION BY id ORDER BY t DESC, f, {level}) = 1)"""


def _reconcile(rows: str) -> str:
    """CTEs up to ``prim``: the primary call of every element of ``rows``."""
    return f"""{rows}, {HARM}, {SCOPE},
m AS (SELECT *, min(database) OVER (PARTITION BY id) <> max(database) OVER (PARTITION BY id) AS several FROM hz),
p0 AS (SELECT * REPLACE (CASE WHEN several THEN oh ELSE "order" END AS oh, CASE WHEN several THEN sh ELSE superfamily END AS sh,
  CASE WHEN several THEN ch ELSE clade END AS ch, CASE WHEN several THEN lh ELSE '' END AS lh) FROM m),
{_won("a", "p0", "oh")}, p1 AS (SELECT p0.* FROM p0 JOIN aw ON p0.id = aw.id AND p0.oh = aw.top),
{_won("b", "p1", "sh")},
qual AS (SELECT DISTINCT x.id, x.sh FROM p1 x WHERE x.several
  AND NOT EXISTS (SELECT 1 FROM p1 y JOIN scope s ON s.db = y.database AND s.sf = x.sh WHERE y.id = x.id AND y.database <> x.database)
  AND EXISTS (SELECT 1 FROM p1 y JOIN scope s ON s.db = x.database AND s.sf = y.sh WHERE y.id = x.id AND y.sh <> x.sh)),
only1 AS (SELECT id, min(sh) AS sh FROM qual GROUP BY 1 HAVING count(*) = 1),
p2 AS (SELECT p1.* FROM p1 JOIN bw ON p1.id = bw.id LEFT JOIN only1 o ON o.id = p1.id WHERE p1.sh = coalesce(o.sh, bw.top)),
{_won("c", "p2", "ch")}, p3 AS (SELECT p2.* FROM p2 JOIN cw ON p2.id = cw.id AND p2.ch = cw.top),
{_won("l", "(SELECT * FROM p3 WHERE lh <> '')", "lh")},
prim AS (SELECT * FROM p3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, database) = 1)"""


_FEAT = """feat AS (SELECT seqid AS chrom, f_type AS type, f_start, f_end, score, strand, coalesce(regexp_extract(attributes, 'ID=([^;]*)', 1), '') AS gid,
  CASE WHEN f_type = 'CDS' THEN 'LTR/' ELSE 'SINE/' END || coalesce(regexp_extract(attributes, 'clade=([^;]*)', 1), '') AS classification
  FROM gff_features WHERE seqid IS NOT NULL AND score IS NOT NULL)"""
_SCREEN = f"""{H}, par AS (SELECT DISTINCT name AS query_name, name AS parent, least(m, 96) AS size FROM models),
sub AS (SELECT h.target_name, coalesce(par.parent, h.query_name) AS parent, h.dom_score AS score, coalesce(par.size, h.query_len) AS size FROM h LEFT JOIN par USING (query_name)),
scr AS (SELECT * FROM sub QUALIFY row_number() OVER (PARTITION BY target_name, parent ORDER BY score DESC, size) = 1)"""
_FAM = "fam AS (SELECT DISTINCT name AS parent, family FROM models)"
_TIER = """CASE WHEN size >= 96 THEN CASE WHEN score >= 30 THEN 'confirmed_100' WHEN score >= 20 THEN 'probable_99.9' WHEN score >= 15 THEN 'probable_99' WHEN score >= 10 THEN 'probable_91' ELSE 'low' END
  WHEN size >= 48 THEN CASE WHEN score >= 15 THEN 'confirmed_100' WHEN score >= 10 THEN 'probable_97' ELSE 'low' END
  WHEN size >= 32 THEN CASE WHEN score >= 10 THEN 'probable_97' ELSE 'low' END
  ELSE CASE WHEN score >= 20 THEN 'confirmed_100' WHEN score >= 15 THEN 'probable_99' WHEN score >= 10 THEN 'probable_90' ELSE 'low' END END"""
_RANKED = f"""{_SCREEN}, {_FAM}, rk AS (SELECT target_name, family, parent AS model, score AS facet_score, size AS facet_m, {_TIER} AS confidence,
  row_number() OVER (PARTITION BY target_name, family ORDER BY score DESC, parent) > 1 AS is_secondary FROM scr JOIN fam USING (parent) WHERE score >= 10)"""
_EDGES = f"""{H}, bf AS ({_best("base_seq, domain_type")}), pr AS (SELECT DISTINCT base_seq, query_name FROM bf),
edges AS (SELECT a.query_name AS query, b.query_name AS target, count(*)::DOUBLE AS score FROM pr a JOIN pr b ON a.base_seq = b.base_seq AND a.query_name <> b.query_name GROUP BY 1, 2)"""
_START = "CASE WHEN strand = '+' THEN (env_from - 1) * 3 + frame + 1 WHEN strand = '-' THEN target_len * 3 + frame - (env_to * 3 + frame) + 1 ELSE env_from END"
_END = "CASE WHEN strand = '+' THEN env_to * 3 + frame WHEN strand = '-' THEN target_len * 3 + frame - ((env_from - 1) * 3 + frame) ELSE env_to END"
_FRAME = lambda way, k: f"SELECT name || '|{way}{k + 1}' AS target_name, name AS base_seq, '{'+' if way == 'fwd' else '-'}' AS strand, {k} AS frame, array_to_string(list_transform(range(((length(seq) - {k}) // 3)::BIGINT), lambda i: substr('{''.join(amino_acids())}', substr(t_{way}, ({k} + 3 * i + 1)::BIGINT, 3)::INTEGER + 1, 1)), '') AS aa FROM digits WHERE length(seq) >= {k + 3}"
_SHA = "sha256({0})"
_BYTES = lambda x: " || ".join(f"substr({_SHA.format(x)}, {15 - 2 * i}, 2)" for i in range(8))
_ID = lambda x: f"(('0x' || {_BYTES(x)})::UBIGINT & 9223372036854775807::UBIGINT)::BIGINT"
_SO_CASE = {"ltr/corvia": ("LTR_retrotransposon", "SO:0000186"), "ltr": ("LTR_retrotransposon", "SO:0000186"), "ltr/gestrel": ("Gestrel_retrotransposon", "SO:0009001"), "gestrel": ("Gestrel_retrotransposon", "SO:0009001"), "helitron": ("helitron", "SO:0000544"), "line": ("LINE_element", "SO:0000194"), "sine": ("SINE_element", "SO:0000206"), "dna/hadrix": ("Hadrix_transposon", "SO:0009002"), "tir": ("terminal_inverted_repeat_element", "SO:0000208"), "dirs": ("LTR_retrotransposon", "SO:0000186"), "penelope": ("non_LTR_retrotransposon", "SO:0000189"), "pararetrovirus": ("LTR_retrotransposon", "SO:0000186"), "maverick": ("DNA_transposon", "SO:0000182"), "ltr/retrovirus": ("LTR_retrotransposon", "SO:0000186")}
_SO_ROWS = ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in _SO_CASE.items())
_N = lambda x: f"replace(replace(lower(trim({x})), '-', '_'), ' ', '')"

_X = f"""x AS (
  SELECT *, {_START} AS start, {_END} AS "end", {_path("query_name")["c"]} AS clade, {_path("query_name")["g"]} AS shown, printf('%.1f', hmm_cov) AS cov,
    regexp_replace(base_seq, '[;=|]', '_', 'g') || '|' || query_name AS gid,
    array_to_string(list_filter(['ID=' || gid, 'Name=' || clade || '-' || shown, 'gene=' || gene, 'clade=' || clade, 'coverage=' || cov, 'evalue=' || i_evalue::VARCHAR, 'probability=' || acc::VARCHAR], lambda v: v IS NOT NULL), ';') AS attr FROM d)"""
_DOM = f"{_domains('axdb')}, {_X}"
_AA = """fr AS (SELECT target_name, substr(repeat(translate(sha256(target_name), '0123456789abcdef', 'ACDEFGHIKLMNPQRS'), ceil(max(target_len) / 64.0)::BIGINT), 1, max(target_len)) AS aa
  FROM legacy_hits WHERE target_name IS NOT NULL AND target_len > 0 GROUP BY target_name)"""
_VERIFIED = f"""{_RANKED}, fnd AS (SELECT h.* FROM h JOIN rk ON rk.target_name = h.target_name AND rk.model = h.query_name AND NOT rk.is_secondary WHERE h.i_evalue <= 1e-5),
ful AS (SELECT target_name, query_name AS model, max(dom_score) AS full_score FROM fnd GROUP BY 1, 2),
vf AS (SELECT rk.*, coalesce(ful.full_score, 0.0) AS full_score, rk.target_name IN (SELECT target_name FROM fnd) AS verified FROM rk LEFT JOIN ful USING (target_name, model))"""
_READ = rf"""{H}, ln AS (SELECT name AS seq_id, max(length) AS known FROM sequences WHERE length > 0 AND name IS NOT NULL GROUP BY 1),
r0 AS (SELECT *, {SPLIT.format("target_name")} AS ok, CASE WHEN ok THEN regexp_extract(target_name, '(?s)^(.*)\|(fwd|rev)', 1) ELSE target_name END AS seq_id,
  CASE WHEN NOT ok THEN '.' WHEN contains(split_part(target_name, '|', -1), 'fwd') THEN '+' ELSE '-' END AS way, CASE WHEN ok THEN (right(target_name, 1)::INTEGER - 1)::VARCHAR ELSE '.' END AS no FROM h),
rd AS (SELECT r0.*, ok AND known IS NOT NULL AS based, CASE WHEN based THEN known ELSE target_len END AS seq_len,
  CASE WHEN NOT based THEN env_from WHEN way = '+' THEN (env_from - 1) * 3 + no::INTEGER + 1 ELSE known - (env_to * 3 + no::INTEGER) + 1 END AS nuc_start,
  CASE WHEN NOT based THEN env_to WHEN way = '+' THEN env_to * 3 + no::INTEGER ELSE known - ((env_from - 1) * 3 + no::INTEGER) END AS nuc_end FROM r0 LEFT JOIN ln USING (seq_id))"""
_MEASURES = "nuc_start::VARCHAR, nuc_end::VARCHAR, env_from::VARCHAR, env_to::VARCHAR, hmm_from::VARCHAR, hmm_to::VARCHAR, printf('%.1f', hmm_cov), printf('%.2e', i_evalue), printf('%.1f', dom_score), printf('%.1f', dom_bias), printf('%.3f', acc)"
_MISSING = f"""{H}, {_FAM}, have AS (SELECT DISTINCT target_name, family FROM h JOIN fam ON fam.parent = h.query_name WHERE dom_score >= 30),
miss AS (SELECT t.target_name, f.family FROM (SELECT DISTINCT target_name FROM have) t, (SELECT DISTINCT family FROM models) f EXCEPT SELECT target_name, family FROM have)"""
_STAGES = f"""{_RANKED.replace("WHERE score >= 10", "WHERE score >= 15")}, tried AS (SELECT DISTINCT target_name, model AS query_name FROM rk WHERE NOT is_secondary),
cf AS (SELECT h.* FROM h SEMI JOIN tried USING (target_name, query_name) WHERE i_evalue <= 1e-5),
hv AS (SELECT DISTINCT target_name, family FROM rk WHERE NOT is_secondary AND target_name IN (SELECT target_name FROM cf)),
lk AS (SELECT DISTINCT target_name, parent AS query_name FROM (SELECT t.target_name, f.family FROM (SELECT DISTINCT target_name FROM hv) t, (SELECT DISTINCT family FROM models) f EXCEPT SELECT target_name, family FROM hv) JOIN fam USING (family)),
st AS (SELECT id, target_name, query_name, 'verified' AS stage FROM cf UNION ALL SELECT id, target_name, query_name, 'cross_family' FROM h SEMI JOIN lk USING (target_name, query_name) WHERE i_evalue <= 1e-3
  UNION ALL SELECT id, target_name, query_name, 'fallback' FROM h WHERE i_evalue <= 1e-3 AND target_name NOT IN (SELECT target_name FROM scr WHERE score >= 15))"""
_MAT = "mat AS (SELECT name, substr(repeat(translate(sha256(name), '0123456789abcdef', 'ACGTACGTACGTACGT'), 8), 1, least(min(m), 12)) AS consensus FROM models GROUP BY name)"
#: Features of the three readable databases.
_GENOME = rf"""x AS (SELECT *, {SPLIT.format("target_name")} AS ok, CASE WHEN ok THEN regexp_extract(target_name, '(?s)^(.*)\|(fwd|rev)', 1) ELSE target_name END AS win FROM legacy_hits),
n AS (SELECT win, max(target_len) * 3 + 2 AS len FROM x WHERE target_name IS NOT NULL AND target_len IS NOT NULL GROUP BY 1),
cm AS (SELECT clade_native AS c, min({{'o': order_h, 's': superfamily_h}}) AS x FROM harmonization WHERE db = 'gyrodb' AND clade_native <> 'unknown' GROUP BY 1),
q AS (SELECT *, dom_score / query_len AS norm_score, 100.0::DOUBLE * (hmm_to - hmm_from + 1) / query_len AS hmm_cov, regexp_matches(win, '^(.+):(\d+)-(\d+)$') AS isw FROM x
  WHERE database IN ('axdb', 'gyrodb', 'sinefold') AND target_name IS NOT NULL AND query_name IS NOT NULL AND dom_score IS NOT NULL AND NOT isnan(dom_score) AND env_from IS NOT NULL AND env_to IS NOT NULL AND query_len > 0 AND evalue IS NOT NULL
    AND hmm_cov >= 20 AND evalue <= 1e-3 AND acc >= 0.5 AND norm_score >= 0.1),
y AS (SELECT q.*, len, CASE WHEN ok THEN right(target_name, 1)::INTEGER - 1 END AS fr, CASE WHEN NOT ok THEN '.' WHEN contains(split_part(target_name, '|', -1), 'fwd') THEN '+' ELSE '-' END AS sign FROM q LEFT JOIN n ON n.win = q.win WHERE database = 'sinefold' OR len IS NOT NULL),
z AS (SELECT *, CASE WHEN database = 'sinefold' THEN ali_from WHEN sign = '+' THEN (env_from - 1) * 3 + fr + 1 WHEN sign = '-' THEN len - (env_to * 3 + fr) + 1 ELSE env_from END AS a,
  CASE WHEN database = 'sinefold' THEN ali_to WHEN sign = '+' THEN env_to * 3 + fr WHEN sign = '-' THEN len - ((env_from - 1) * 3 + fr) ELSE env_to END AS b,
  CASE WHEN isw THEN regexp_extract(win, '^(.+):(\d+)-(\d+)$', 1) ELSE win END AS chrom, CASE WHEN isw THEN regexp_extract(win, '^(.+):(\d+)-(\d+)$', 2)::BIGINT - 1 ELSE 0 END AS sh,
  CASE WHEN contains(query_name, '_') THEN substr(query_name, instr(query_name, '_') + 1) ELSE query_name END AS pc, {_path("query_name")["o"]} AS ao, {_path("query_name")["s"]} AS as_, {_path("query_name")["c"]} AS ac, {_path("query_name")["g"]} AS ag FROM y),
w AS (SELECT z.*, least(a, b) + sh AS f_start, greatest(a, b) + sh AS f_end, CASE database WHEN 'axdb' THEN ao WHEN 'gyrodb' THEN coalesce(cm.x.o, 'Unknown') ELSE 'SINE' END AS o, CASE database WHEN 'axdb' THEN as_ WHEN 'gyrodb' THEN coalesce(cm.x.s, 'unknown') ELSE 'unknown' END AS s,
  CASE database WHEN 'axdb' THEN ac WHEN 'gyrodb' THEN pc ELSE 'SINE' END AS clade, CASE database WHEN 'axdb' THEN ag WHEN 'gyrodb' THEN split_part(query_name, '_', 1) ELSE 'SINE' END AS gene,
  CASE database WHEN 'axdb' THEN CASE WHEN starts_with(ac, 'Ty') OR as_ NOT IN ('Corvia', 'Gestrel') THEN 'unknown' ELSE ac END WHEN 'gyrodb' THEN pc ELSE 'unknown' END AS shown FROM z LEFT JOIN cm ON cm.c = z.pc),
gf AS (SELECT chrom, CASE WHEN database = 'sinefold' THEN 'repeat_region' ELSE 'CDS' END AS type, f_start, f_end, round_even(norm_score * 1000, 0) / 1000 AS score, sign AS strand, CASE WHEN database = 'sinefold' THEN '.' ELSE fr::VARCHAR END AS phase,
  array_to_string(list_filter([o, CASE WHEN s <> o THEN s END, CASE WHEN shown NOT IN (o, s) THEN shown END], lambda v: v IS NOT NULL AND v <> 'unknown'), '/') AS classification, gene, clade, hmm_cov AS coverage, evalue,
  chrom || ':' || f_start || '-' || f_end || '|' || query_name AS gid, CASE WHEN database = 'sinefold' THEN 'raw' ELSE 'aa' END AS src, CASE WHEN database = 'sinefold' THEN win ELSE target_name END AS xkey,
  CASE WHEN database = 'sinefold' THEN ali_from ELSE env_from END AS xfrom, CASE WHEN database = 'sinefold' THEN ali_to ELSE env_to END AS xto FROM w WHERE f_start IS NOT NULL AND f_end IS NOT NULL)"""

ORACLES = {
    "family_parse": rf"""
SELECT id, CASE WHEN contains(query_name, ':') THEN split_part(split_part(query_name, ':', 2), '-', -1) ELSE split_part(query_name, '_', 1) END AS family,
  CASE WHEN ok THEN regexp_extract(target_name, '(?s)^(.*)\|(fwd|rev)', 1) ELSE target_name END AS base,
  CASE WHEN NOT ok THEN '.' WHEN contains(split_part(target_name, '|', -1), 'fwd') THEN '+' ELSE '-' END AS sign,
  CASE WHEN ok THEN (right(target_name, 1)::INTEGER - 1)::VARCHAR ELSE '.' END AS frame_no,
  CASE WHEN contains(target_name, '|') THEN regexp_extract(target_name, '(?s)^(.*)\|', 1) ELSE target_name END AS stripped
FROM (SELECT *, {SPLIT.format("target_name")} AS ok FROM legacy_hits WHERE query_name IS NOT NULL AND target_name IS NOT NULL)""",
    "path_labels": f"""
WITH l AS (SELECT name, {_path("name")["o"]} AS o, {_path("name")["s"]} AS s, {_path("name")["c"]} AS c, {_path("name")["g"]} AS g FROM models)
SELECT name, o AS "order", s AS superfamily, c AS clade, g AS gene,
  array_to_string(list_filter([o, CASE WHEN s <> o THEN s END, CASE WHEN c NOT IN (o, s) THEN c END], lambda x: x IS NOT NULL AND x <> 'unknown'), '/') AS label FROM l""",
    "prefix_labels": """
SELECT name, split_part(name, '_', 1) AS gene, CASE WHEN contains(name, '_') THEN substr(name, instr(name, '_') + 1) ELSE name END AS clade,
  regexp_replace(name, '[;=|]', '_', 'g') AS gff_name, translate(name, '/: ', '___') AS file_name FROM models""",
    "stable_ids": f"SELECT name, {_ID('name')} AS model_id, {_ID(chr(39) + 'family:' + chr(39) + ' || family')} AS family_id FROM models",
    "window_ids": r"""
SELECT DISTINCT name, CASE WHEN ok THEN regexp_extract(name, '^(.+):(\d+)-(\d+)$', 1) ELSE name END AS chrom,
  CASE WHEN ok THEN regexp_extract(name, '^(.+):(\d+)-(\d+)$', 2)::BIGINT END AS w_start, CASE WHEN ok THEN regexp_extract(name, '^(.+):(\d+)-(\d+)$', 3)::BIGINT END AS w_end
FROM (SELECT *, regexp_matches(name, '^(.+):(\d+)-(\d+)$') AS ok FROM sequences WHERE name IS NOT NULL)""",
    "hit_filters": f"WITH {H} SELECT id, norm_score, hmm_cov FROM h WHERE {PASS}",
    "hit_filters_rounded": f"WITH {H}, r AS (SELECT * REPLACE ({R2.format('norm_score')} AS norm_score, {R2.format('hmm_cov')} AS hmm_cov) FROM h) SELECT id, norm_score, hmm_cov FROM r WHERE {PASS}",
    "best_domain": f"WITH {_domains(None, True)} SELECT base_seq, gene, id, dom_score FROM b",
    "selected_domains": f"WITH {_domains(None, True)} SELECT base_seq, gene, id, dom_score FROM d",
    "best_per_family": f"WITH {H}, b AS ({_best('base_seq, domain_type')}) SELECT {KEEP} FROM b",
    "best_per_family_filtered": f"WITH {H}, b AS ({_best('base_seq, domain_type', where=PASS)}) SELECT {KEEP} FROM b",
    "best_per_frame": f"WITH {H}, b AS ({_best('target_name')}) SELECT {KEEP} FROM b",
    "best_per_model": f"WITH {H}, b AS ({_best('target_name, query_name')}) SELECT {KEEP} FROM b",
    "best_with_ties": f"WITH {H} SELECT {KEEP} FROM h WHERE dom_score = (SELECT max(x.dom_score) FROM h x WHERE x.target_name = h.target_name AND x.query_name = h.query_name)",
    "classify_score_vote": f"WITH {_AX_CALLS} {_CALL}",
    "classify_count_vote": f"WITH {_classify('axdb', 'path', _AX, ('Corvia', 'Gestrel'), count=True, rounded=True)} {_CALL}",
    "classify_prefix": f"WITH {_classify('gyrodb', 'prefix', _GY)} {_CALL}",
    "classify_constant": f"WITH {_classify('sinefold', 'constant', {})} {_CALL}",
    "reconcile_vote": f"""WITH {_reconcile(REC)}, nc AS (SELECT id, count(*) AS n FROM rows GROUP BY 1)
SELECT prim.id, oh AS "order", sh AS superfamily, ch AS clade, coalesce(lw.top, '') AS lineage, database AS primary_db, score, nc.n::INTEGER AS n_calls
FROM prim JOIN nc USING (id) LEFT JOIN lw ON lw.id = prim.id""",
    "reconcile_classified": f"""WITH {_reconcile(f"""rows AS (SELECT 'axdb' AS database, * FROM (WITH {_AX_CALLS} SELECT * FROM calls)
  UNION ALL SELECT 'gyrodb', * FROM (WITH {_classify('gyrodb', 'prefix', _GY)} SELECT * FROM calls))""")}
SELECT id, oh AS "order", sh AS superfamily, ch AS clade, complete, strand, domains, database AS primary_db, round(score, 6) AS score FROM prim""",
    "reconcile_classified_all": f"""WITH {_reconcile(f"""rows AS (SELECT 'axdb' AS database, * FROM (WITH {_AX_CALLS} SELECT * FROM calls)
  UNION ALL SELECT 'gyrodb', * FROM (WITH {_classify('gyrodb', 'prefix', _GY)} SELECT * FROM calls)
  UNION ALL SELECT 'sinefold', * FROM (WITH {_classify('sinefold', 'constant', {})} SELECT * FROM calls))""")}, nc AS (SELECT id, count(*) AS n FROM rows GROUP BY 1)
SELECT prim.id, oh AS "order", sh AS superfamily, ch AS clade, complete, strand, domains, database AS primary_db, round(score, 6) AS score, nc.n::INTEGER AS n_calls FROM prim JOIN nc ON nc.id = prim.id""",
    "secondary_strings": f"""WITH {REC}
SELECT id, string_agg(printf('%s:%s/%s/%s=%.3f', database, "order", superfamily, clade, score), ';' ORDER BY score DESC, database) AS secondary_hits FROM rows GROUP BY id""",
    "so_lookup": f"""
WITH t(alias, so_name, so_id) AS (VALUES {_SO_ROWS}), l AS (SELECT DISTINCT te_order AS o, superfamily AS s FROM classifications WHERE te_order IS NOT NULL),
u AS (SELECT o, s, lower(trim(o)) NOT IN ('', 'unknown', 'na') AS so, s IS NOT NULL AND lower(trim(s)) NOT IN ('', 'unknown', 'na') AS ss FROM l),
c AS (SELECT o, s, unnest(list_concat(CASE WHEN so AND ss THEN [trim(o) || '/' || trim(s)] ELSE [] END,
  CASE WHEN NOT (so AND ss) THEN [] WHEN lower(trim(o)) = 'tir' THEN ['TIR/' || trim(s), 'DNA/' || trim(s), 'MITE/' || trim(s)] WHEN lower(trim(o)) = 'line' THEN ['LINE/' || trim(s), 'nonLTR/' || trim(s)]
    WHEN lower(trim(o)) = 'ltr' THEN ['LTR/' || trim(s)] WHEN lower(trim(o)) = 'sine' THEN ['SINE/' || trim(s)] ELSE [] END,
  CASE WHEN ss THEN [trim(s)] ELSE [] END, CASE WHEN so THEN [trim(o)] ELSE [] END)) AS a, generate_subscripts(list_concat(CASE WHEN so AND ss THEN [1] ELSE [] END,
  CASE WHEN NOT (so AND ss) THEN [] WHEN lower(trim(o)) = 'tir' THEN [1, 1, 1] WHEN lower(trim(o)) = 'line' THEN [1, 1] WHEN lower(trim(o)) IN ('ltr', 'sine') THEN [1] ELSE [] END,
  CASE WHEN ss THEN [1] ELSE [] END, CASE WHEN so THEN [1] ELSE [] END), 1) AS i FROM u),
b AS (SELECT c.o, c.s, t.so_name, t.so_id FROM c JOIN t ON t.alias = {_N("c.a")} QUALIFY row_number() OVER (PARTITION BY c.o, c.s ORDER BY i) = 1),
r AS (SELECT l.o, l.s, coalesce(b.so_name, 'repeat_region') AS so_name, coalesce(b.so_id, 'SO:0000657') AS so_id FROM l LEFT JOIN b ON b.o = l.o AND b.s IS NOT DISTINCT FROM l.s)
SELECT o AS "order", s AS superfamily, so_name, so_id, CASE so_id WHEN 'SO:0000182' THEN 'DNA_transposon' WHEN 'SO:0000186' THEN 'LTR_retrotransposon' WHEN 'SO:0000189' THEN 'non_LTR_retrotransposon'
  WHEN 'SO:0000194' THEN 'LINE_element' WHEN 'SO:0000206' THEN 'SINE_element' WHEN 'SO:0000208' THEN 'terminal_inverted_repeat_element' WHEN 'SO:0000544' THEN 'helitron' WHEN 'SO:0000657' THEN 'repeat_region' ELSE so_name END AS gff_type FROM r""",
    "pass2_inherit": f"""WITH {REC}, s AS (
  SELECT * FROM blast_hits b WHERE bitscore IS NOT NULL AND sseqid IS NOT NULL AND pident >= 80 AND qcovs >= 80 AND length >= 80
  AND NOT EXISTS (SELECT 1 FROM legacy_hits h WHERE h.base_seq = b.qseqid AND h.i_evalue <= 1e-30)),
t AS (SELECT qseqid, sseqid, bitscore FROM s QUALIFY row_number() OVER (PARTITION BY qseqid ORDER BY bitscore DESC, sseqid) = 1)
SELECT t.qseqid AS id, r."order", r.superfamily, 'unknown' AS clade, 'none' AS complete, '?' AS strand, 'none' AS domains, t.sseqid AS source, t.bitscore
FROM t JOIN rows r ON r.id = t.sseqid AND r.database = 'axdb'""",
    "pass2_inherit_all": f"""WITH {_reconcile(REC)}, s AS (
  SELECT * FROM blast_hits b WHERE bitscore IS NOT NULL AND sseqid IS NOT NULL AND pident >= 80 AND qcovs >= 80 AND length >= 80
  AND NOT EXISTS (SELECT 1 FROM rows r WHERE r.id = b.qseqid)),
t AS (SELECT qseqid, sseqid, bitscore FROM s QUALIFY row_number() OVER (PARTITION BY qseqid ORDER BY bitscore DESC, sseqid) = 1)
SELECT t.qseqid AS id, oh AS "order", sh AS superfamily, 'unknown' AS clade, 'none' AS complete, '?' AS strand, 'none' AS domains, t.sseqid AS source, t.bitscore
FROM t JOIN prim ON prim.id = t.sseqid""",
    "split_classified": "SELECT name, max(length) AS length, name IN (SELECT base_seq FROM legacy_hits WHERE base_seq IS NOT NULL) AS has_hit FROM sequences WHERE name IS NOT NULL GROUP BY name",
    "blast_classified_by": """
WITH l AS (SELECT base_seq, string_agg(database, ',' ORDER BY database) AS c FROM (SELECT DISTINCT base_seq, database FROM legacy_hits WHERE base_seq IS NOT NULL AND database IS NOT NULL) GROUP BY 1)
SELECT hit_id, qseqid, sseqid, coalesce(l.c, 'unknown') AS classified_by FROM blast_hits LEFT JOIN l ON l.base_seq = sseqid""",
    "classified_ids": "SELECT base_seq, string_agg(database, ',' ORDER BY database) AS classified_by FROM (SELECT DISTINCT base_seq, database FROM legacy_hits WHERE base_seq IS NOT NULL AND database IS NOT NULL) GROUP BY 1",
    "aa_to_nucl": f"WITH {H} SELECT id, ({_START})::BIGINT AS nuc_from, ({_END})::BIGINT AS nuc_to FROM h",
    "strand_normalize": """
WITH n AS (SELECT sum(l) / 1e6::DOUBLE AS mb FROM (SELECT name, max(length) AS l FROM sequences WHERE length > 0 AND name IS NOT NULL GROUP BY 1))
SELECT id, base_seq || CASE WHEN env_from <= env_to THEN '|fwd1' ELSE '|rev1' END AS target, least(env_from, env_to) AS low, greatest(env_from, env_to) AS high, i_evalue * mb AS scaled_evalue
FROM legacy_hits, n WHERE base_seq IS NOT NULL AND env_from IS NOT NULL AND env_to IS NOT NULL""",
    "domain_keep_semi": f"WITH {_domains(None)} SELECT {KEEP} FROM h WHERE (target_name, query_name, env_from, env_to) IN (SELECT (target_name, query_name, env_from, env_to) FROM d)",
    "clean_seq": "SELECT doc_id, regexp_replace(upper(regexp_replace(regexp_replace(text, '[^ -~]', '?', 'g'), '[^ACGTNacgtn]', 'N', 'g')), '[^ACGTN]', 'N', 'g') AS seq FROM documents WHERE text IS NOT NULL",
    "revcomp": f"WITH {DNA} SELECT name, {_RC} AS rc FROM dna",
    "six_frames": f"""WITH {DNA}, digits AS (SELECT name, seq, translate(seq, 'TCAGN', '01234') AS t_fwd, translate({_RC}, 'TCAGN', '01234') AS t_rev FROM dna)
{" UNION ALL ".join(_FRAME(way, k) for way in ("fwd", "rev") for k in range(3))}""",
    "genome_windows": f"""WITH {DNA}, w AS (SELECT name, seq, unnest(range(0, 1 + greatest(0, ceil((length(seq) - 250) / 200.0))::BIGINT)) AS i FROM dna WHERE length(seq) > 0)
SELECT name || ':' || (i * 200 + 1) || '-' || least(i * 200 + 250, length(seq)) AS window_id, name AS chrom, (i * 200 + 1)::INTEGER AS w_start, least(i * 200 + 250, length(seq))::INTEGER AS w_end,
  substr(seq, i * 200 + 1, 250) AS seq FROM w""",
    "cls_lib": f"""WITH {_AX_CALLS}, {DNA},
few AS (SELECT 'doc' || try_cast(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) AS name, min({{'o': "order", 's': superfamily, 'c': clade, 'd': strand}}) AS x FROM calls
  WHERE try_cast(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) IS NOT NULL GROUP BY 1)
SELECT dna.name, split_part(dna.name, '#', 1) || '#' || CASE WHEN few.name IS NULL THEN 'Unknown' ELSE array_to_string(list_filter([x.o, CASE WHEN x.s <> x.o THEN x.s END, CASE WHEN x.c NOT IN (x.o, x.s) THEN x.c END],
  lambda v: v IS NOT NULL AND v <> 'unknown'), '/') END || ' ' || dna.name AS head, CASE WHEN x.d = '-' THEN {_RC} ELSE seq END AS seq FROM dna LEFT JOIN few ON few.name = dna.name""",
    "genome_summary": f"""WITH {_FEAT}, p AS (SELECT f_end - f_start + 1 AS n, unnest(CASE WHEN contains(classification, '/') THEN [split_part(classification, '/', 1), classification, 'Total'] ELSE [classification, 'Total'] END) AS path FROM feat)
SELECT path, count(*) AS number, sum(n)::BIGINT AS total_length, round(sum(n) / count(*), 1) AS mean_length,
  CASE split_part(path, '/', 1) WHEN 'LTR' THEN 1 WHEN 'SINE' THEN 6 ELSE 12 END::INTEGER AS place FROM p GROUP BY path""",
    "genome_features": rf"""
WITH x AS (SELECT *, CASE WHEN {SPLIT.format("target_name")} THEN regexp_extract(target_name, '(?s)^(.*)\|(fwd|rev)', 1) ELSE target_name END AS win FROM legacy_hits),
n AS (SELECT win, max(target_len) * 3 + 2 AS len FROM x WHERE target_name IS NOT NULL AND target_len IS NOT NULL GROUP BY 1),
q AS (SELECT *, dom_score / query_len AS norm_score, 100.0::DOUBLE * (hmm_to - hmm_from + 1) / query_len AS hmm_cov FROM x
  WHERE database = 'axdb' AND target_name IS NOT NULL AND query_name IS NOT NULL AND dom_score IS NOT NULL AND NOT isnan(dom_score) AND env_from IS NOT NULL AND env_to IS NOT NULL AND query_len > 0 AND evalue IS NOT NULL),
y AS (SELECT q.*, len, right(target_name, 1)::INTEGER - 1 AS fr, contains(split_part(target_name, '|', -1), 'fwd') AS fwd, regexp_matches(q.win, '^(.+):(\d+)-(\d+)$') AS isw
  FROM q JOIN n ON n.win = q.win WHERE hmm_cov >= 20 AND evalue <= 1e-3 AND acc >= 0.5 AND norm_score >= 0.1),
z AS (SELECT *, CASE WHEN fwd THEN (env_from - 1) * 3 + fr + 1 ELSE len - (env_to * 3 + fr) + 1 END AS a, CASE WHEN fwd THEN env_to * 3 + fr ELSE len - ((env_from - 1) * 3 + fr) END AS b,
  CASE WHEN isw THEN regexp_extract(win, '^(.+):(\d+)-(\d+)$', 1) ELSE win END AS chrom, CASE WHEN isw THEN regexp_extract(win, '^(.+):(\d+)-(\d+)$', 2)::BIGINT - 1 ELSE 0 END AS sh,
  {_path("query_name")["o"]} AS o, {_path("query_name")["s"]} AS s, {_path("query_name")["c"]} AS c FROM y),
w AS (SELECT *, least(a, b) + sh AS f_start, greatest(a, b) + sh AS f_end, CASE WHEN starts_with(c, 'Ty') OR s NOT IN ('Corvia', 'Gestrel') THEN 'unknown' ELSE c END AS shown FROM z)
SELECT chrom, 'CDS' AS type, f_start, f_end, round_even(norm_score * 1000, 0) / 1000 AS score, CASE WHEN fwd THEN '+' ELSE '-' END AS strand, fr::VARCHAR AS phase,
  array_to_string(list_filter([o, CASE WHEN s <> o THEN s END, CASE WHEN shown NOT IN (o, s) THEN shown END], lambda v: v IS NOT NULL AND v <> 'unknown'), '/') AS classification,
  chrom || ':' || f_start || '-' || f_end || '|' || query_name AS gid, 'aa' AS src FROM w""",
    "genome_elements": f"""
WITH q AS (SELECT *, dom_score / query_len AS norm_score, 100.0::DOUBLE * (hmm_to - hmm_from + 1) / query_len AS hmm_cov, {SPLIT.format("target_name")} AS ok FROM legacy_hits
  WHERE database = 'sinefold' AND target_name IS NOT NULL AND query_name IS NOT NULL AND dom_score IS NOT NULL AND NOT isnan(dom_score) AND env_from IS NOT NULL AND env_to IS NOT NULL AND query_len > 0 AND evalue IS NOT NULL
  AND ali_from IS NOT NULL AND ali_to IS NOT NULL),
y AS (SELECT *, regexp_matches(w, '^(.+):([0-9]+)-([0-9]+)$') AS isw FROM (SELECT *, CASE WHEN ok THEN regexp_extract(target_name, '(?s)^(.*)[|](fwd|rev)', 1) ELSE target_name END AS w FROM q)
  WHERE hmm_cov >= 20 AND evalue <= 1e-3 AND acc >= 0.5 AND norm_score >= 0.1),
z AS (SELECT *, CASE WHEN isw THEN regexp_extract(w, '^(.+):([0-9]+)-([0-9]+)$', 1) ELSE w END AS chrom, CASE WHEN isw THEN regexp_extract(w, '^(.+):([0-9]+)-([0-9]+)$', 2)::BIGINT - 1 ELSE 0 END AS sh FROM y)
SELECT chrom, 'SINE_element' AS type, least(ali_from, ali_to) + sh AS f_start, greatest(ali_from, ali_to) + sh AS f_end, round_even(norm_score * 1000, 0) / 1000 AS score,
  CASE WHEN NOT ok THEN '.' WHEN contains(split_part(target_name, '|', -1), 'fwd') THEN '+' ELSE '-' END AS strand, '.' AS phase, 'SINE' AS classification,
  chrom || ':' || (least(ali_from, ali_to) + sh) || '-' || (greatest(ali_from, ali_to) + sh) || '|' || query_name AS gid, 'raw' AS src FROM z""",
    "features_resolved": f"""WITH RECURSIVE {_FEAT},
o AS (SELECT *, row(f_start, f_end, score, strand, gid, classification) AS val, row_number() OVER (PARTITION BY chrom, type ORDER BY f_start, f_end, score DESC, gid, strand, classification) AS rn
  FROM (SELECT * REPLACE (least(f_start, f_end) AS f_start, greatest(f_start, f_end) AS f_end) FROM feat WHERE f_start IS NOT NULL AND f_end IS NOT NULL)),
sw AS (
  SELECT chrom, type, rn, rn AS last, NULL::BIGINT AS gone FROM o WHERE rn = 1
  UNION ALL
  SELECT f.chrom, f.type, f.rn,
    CASE WHEN f.val = l.val THEN s.last WHEN 100.0 * greatest(0, least(f.f_end, l.f_end) - greatest(f.f_start, l.f_start)) / least(f.f_end - f.f_start + 1, l.f_end - l.f_start + 1) > 20 AND f.score <= l.score THEN s.last ELSE f.rn END,
    CASE WHEN f.val = l.val THEN f.rn WHEN 100.0 * greatest(0, least(f.f_end, l.f_end) - greatest(f.f_start, l.f_start)) / least(f.f_end - f.f_start + 1, l.f_end - l.f_start + 1) > 20 THEN CASE WHEN f.score > l.score THEN s.last ELSE f.rn END END
  FROM sw s JOIN o f ON f.chrom = s.chrom AND f.type = s.type AND f.rn = s.rn + 1 JOIN o l ON l.chrom = s.chrom AND l.type = s.type AND l.rn = s.last),
lost AS (SELECT DISTINCT o.chrom, o.type, o.val FROM sw JOIN o ON o.chrom = sw.chrom AND o.type = sw.type AND o.rn = sw.gone)
SELECT chrom, type, f_start, f_end, score, gid FROM o ANTI JOIN lost USING (chrom, type, val)""",
    "overlap_pairs": f"""WITH {_FEAT}, u AS (SELECT DISTINCT * FROM feat), p AS (
  SELECT *, lag(f_start) OVER w AS ps, lag(f_end) OVER w AS pe FROM u WINDOW w AS (PARTITION BY chrom, type ORDER BY f_start, f_end, score DESC, gid, strand))
SELECT chrom, type, f_start, f_end, gid, round(CASE WHEN least(f_end - f_start + 1, pe - ps + 1) > 0 THEN 100.0::DOUBLE * greatest(0, least(f_end, pe) - greatest(f_start, ps)) / least(f_end - f_start + 1, pe - ps + 1) ELSE 0 END, 6) AS pct
FROM p WHERE ps IS NOT NULL""",
    "facet_primary_secondary": f"WITH {_RANKED} SELECT * FROM rk",
    "facet_verified": f"""WITH {_RANKED}, fnd AS (SELECT h.* FROM h JOIN rk ON rk.target_name = h.target_name AND rk.model = h.query_name AND NOT rk.is_secondary WHERE h.i_evalue <= 1e-5),
ful AS (SELECT target_name, query_name AS model, max(dom_score) AS full_score FROM fnd GROUP BY 1, 2)
SELECT rk.*, coalesce(ful.full_score, 0.0) AS full_score, rk.target_name IN (SELECT target_name FROM fnd) AS verified FROM rk LEFT JOIN ful USING (target_name, model)""",
    "missing_families": f"""WITH {H}, {_FAM}, have AS (SELECT DISTINCT target_name, family FROM h JOIN fam ON fam.parent = h.query_name WHERE dom_score >= 30)
SELECT t.target_name, f.family FROM (SELECT DISTINCT target_name FROM have) t, (SELECT DISTINCT family FROM models) f EXCEPT SELECT target_name, family FROM have""",
    "unclassified_frames": f"WITH {_SCREEN} SELECT DISTINCT target_name FROM h WHERE target_name NOT IN (SELECT target_name FROM scr WHERE score >= 15)",
    "quick_first_confirming": f"""WITH {_SCREEN}, r AS (SELECT target_name, parent AS query_name, row_number() OVER (PARTITION BY target_name ORDER BY score DESC, parent)::INTEGER AS rank FROM scr)
SELECT target_name, query_name, rank FROM r WHERE (target_name, query_name) IN (SELECT (target_name, query_name) FROM h WHERE i_evalue <= 1e-10) QUALIFY row_number() OVER (PARTITION BY target_name ORDER BY rank) = 1""",
    "pass2_pair_filter": f"WITH {H} SELECT {KEEP} FROM h WHERE (target_name, query_name) IN (SELECT (target_name, query_name) FROM h WHERE evalue <= 1e-10)",
    "models_by_frame": f"WITH {H} SELECT target_name, string_agg(query_name, ',' ORDER BY query_name) AS models FROM (SELECT DISTINCT target_name, query_name FROM h) GROUP BY 1",
    "graph_neighbors_topk": f"WITH {_EDGES} SELECT query, target, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, target)::INTEGER AS rank FROM edges QUALIFY rank <= 5",
    "graph_report": f"""WITH {_EDGES}, f AS (SELECT name AS parent, min(family) AS family FROM models GROUP BY 1),
e AS (SELECT a.family, count(*) FILTER (a.family = b.family) AS within, count(*) FILTER (a.family <> b.family) AS across FROM edges JOIN f a ON a.parent = query JOIN f b ON b.parent = target GROUP BY 1)
SELECT n.family, n.n_models, coalesce(within, 0) AS within, coalesce(across, 0) AS across FROM (SELECT family, count(*) AS n_models FROM f GROUP BY 1) n LEFT JOIN e USING (family)""",
    "model_size_iqr": """
WITH s AS (SELECT m::DOUBLE * m AS q, row_number() OVER (ORDER BY m) AS i, count(*) OVER () AS n FROM models),
b AS (SELECT median(q) FILTER (i <= n // 2) AS q1, median(q) FILTER (i > n - n // 2) AS q3, any_value(n) AS n FROM s)
SELECT name, m, n >= 4 AND m::DOUBLE * m > q3 + 2 * (q3 - q1) AS outlier FROM models, b""",
    "window_sums": """
WITH t AS (SELECT name AS model, min(m) AS m FROM models GROUP BY 1), p AS (SELECT model, unnest(range(1, m + 1)) AS pos FROM t),
s AS (SELECT model, pos, ((length(model) * 31 + pos * 17) % 23) / 10.0::DOUBLE AS score FROM p),
w AS (SELECT model, pos, sum(score) OVER w AS total, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY model ORDER BY pos ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING))
SELECT model, pos::INTEGER AS pos, round(total, 6) AS total FROM w WHERE n = 32""",
    "id_registry": f"SELECT DISTINCT {_ID('name')} AS id, name, 'model' AS kind FROM models UNION SELECT {_ID(chr(39) + 'family:' + chr(39) + ' || family')}, family, 'family' FROM models",
    "dom_gff3_lines": f"""WITH {_DOM}
SELECT base_seq, start, query_name, concat_ws(chr(9), base_seq, 'sekvant', 'CDS', start, "end", {R2.format("norm_score")}, coalesce(strand, ''), coalesce(frame::VARCHAR, ''), attr) AS line FROM x""",
    "dom_table_lines": f"""WITH {_DOM}
SELECT base_seq, start, query_name, concat_ws(chr(9), gid, env_to - env_from + 1, coalesce(i_evalue::VARCHAR, ''), cov, coalesce(acc::VARCHAR, ''), {R2.format("norm_score")}) AS line FROM x""",
    "dom_sequences": f"""WITH {_DOM}, {_AA}
SELECT base_seq, start, query_name, gid || ' ' || attr AS head, substr(aa, env_from, env_to - env_from + 1) AS seq FROM x JOIN fr USING (target_name)""",
    "class_sequences": f"""WITH {_AX_CALLS}, {_X}, {_AA},
named AS (SELECT id AS base_seq, array_to_string(list_filter([ord, CASE WHEN superfamily <> ord THEN superfamily END, CASE WHEN clade NOT IN (ord, superfamily) THEN clade END], lambda v: v IS NOT NULL AND v <> 'unknown'), '/') AS cls
  FROM (SELECT *, "order" AS ord FROM calls))
SELECT base_seq, start, query_name, '>' || split_part(base_seq, '#', 1) || '#' || cls || '#' || gene || '|' || clade || ' ' || gid || ' ' || replace(attr, ';Name=' || clade || '-' || shown, ';Name=' || clade || '-' || gene) || chr(10)
  || rtrim(regexp_replace(substr(aa, env_from, env_to - env_from + 1), '(.{{60}})', '\\1' || chr(10), 'g'), chr(10)) AS line FROM x JOIN fr USING (target_name) JOIN named USING (base_seq)""",
    "class_table_lines": f"""WITH {_reconcile(REC)}, sec AS (
  SELECT id, string_agg(printf('%s:%s/%s/%s=%.3f', database, "order", superfamily, clade, score), ';' ORDER BY score DESC, database) AS s FROM rows GROUP BY id)
SELECT prim.id, concat_ws(chr(9), prim.id, oh, sh, ch, 'unknown', '+', 'none', sec.s, coalesce(nullif(lw.top, ''), '.')) AS line FROM prim JOIN sec ON sec.id = prim.id LEFT JOIN lw ON lw.id = prim.id""",
    "frame_tiers": f"""WITH {_VERIFIED}
SELECT target_name, family, model, concat_ws(chr(9), target_name, family, model, printf('%.1f', facet_score), facet_m, confidence, CASE WHEN verified THEN 'yes' ELSE 'no' END, printf('%.1f', full_score), CASE WHEN is_secondary THEN 'yes' ELSE 'no' END) AS line FROM vf""",
    "raw_hit_lines": f"""WITH {H}
SELECT database, target_name, query_name, dom_num, array_to_string([coalesce(v, '') FOR v IN [database, target_name, target_len::VARCHAR, query_name, query_len::VARCHAR, evalue::VARCHAR, score::VARCHAR, bias::VARCHAR, dom_num::VARCHAR, dom_of::VARCHAR,
  c_evalue::VARCHAR, i_evalue::VARCHAR, dom_score::VARCHAR, dom_bias::VARCHAR, hmm_from::VARCHAR, hmm_to::VARCHAR, ali_from::VARCHAR, ali_to::VARCHAR, env_from::VARCHAR, env_to::VARCHAR, acc::VARCHAR]], chr(9)) AS line FROM h""",
    "best_hit_lines": f"""WITH {_READ}, top AS (SELECT * FROM rd QUALIFY dom_score = max(dom_score) OVER (PARTITION BY target_name, query_name))
SELECT database, target_name, dom_score, query_name, env_from, array_to_string([coalesce(v, '') FOR v IN [database, seq_id, seq_len::VARCHAR, query_name, query_len::VARCHAR, way, no, {_MEASURES}]], chr(9)) AS line FROM top""",
    "all_domain_lines": f"""WITH {_READ}
SELECT database, target_name, query_name, dom_num, array_to_string([coalesce(v, '') FOR v IN [database, seq_id, seq_len::VARCHAR, query_name, query_len::VARCHAR, way, no, dom_num::VARCHAR, dom_of::VARCHAR, {_MEASURES}]], chr(9)) AS line FROM rd""",
    "chosen_hit_lines": f"""WITH {_READ}, c AS ({_best("base_seq, domain_type", source="rd")})
SELECT seq_id, query_name, env_from, array_to_string([coalesce(v, '') FOR v IN [seq_id, query_name, domain_type, way, no, nuc_start::VARCHAR, nuc_end::VARCHAR, env_from::VARCHAR, env_to::VARCHAR, hmm_from::VARCHAR, hmm_to::VARCHAR,
  printf('%.1f', hmm_cov), printf('%.1f', dom_score), printf('%.4f', norm_score), printf('%.2e', i_evalue), printf('%.3f', acc)]], chr(9)) AS line FROM c""",
    "hit_sequences": f"""WITH {_READ}, {_AA}, top AS (SELECT * FROM rd QUALIFY dom_score = max(dom_score) OVER (PARTITION BY target_name, query_name))
SELECT target_name, dom_score, query_name, seq_id || '|' || query_name || ' ' || CASE WHEN based THEN 'nuc=' || nuc_start || '-' || nuc_end || ';' ELSE '' END || 'env=' || env_from || '-' || env_to || ';score=' || printf('%.1f', dom_score)
  || ';evalue=' || printf('%.2e', i_evalue) || ';hmm_cov=' || printf('%.1f', hmm_cov) || ';acc=' || printf('%.3f', acc) AS head, substr(aa, env_from, env_to - env_from + 1) AS seq FROM top JOIN fr USING (target_name)""",
    "database_hits": "SELECT id, base_seq, env_from FROM legacy_hits WHERE database = 'gyrodb'",
    "union_calls": f"""WITH {_reconcile(REC)}, s AS (
  SELECT * FROM blast_hits b WHERE bitscore IS NOT NULL AND sseqid IS NOT NULL AND pident >= 80 AND qcovs >= 80 AND length >= 80 AND NOT EXISTS (SELECT 1 FROM rows r WHERE r.id = b.qseqid)),
t AS (SELECT qseqid, sseqid FROM s QUALIFY row_number() OVER (PARTITION BY qseqid ORDER BY bitscore DESC, sseqid) = 1),
every AS (SELECT 'axdb' AS database, * FROM (WITH {_AX_CALLS} SELECT * FROM calls)
  UNION ALL SELECT 'gyrodb', * FROM (WITH {_classify('gyrodb', 'prefix', _GY)} SELECT * FROM calls)
  UNION ALL SELECT 'sinefold', * FROM (WITH {_classify('sinefold', 'constant', {})} SELECT * FROM calls))
SELECT id AS seq_id, database, "order" AS te_order, superfamily, clade, complete, strand, domains, 'hmm' AS source, 'legacy' AS mode FROM every
UNION ALL SELECT t.qseqid, 'similar', oh, sh, 'unknown', 'none', '?', 'none', t.sseqid, 'legacy' FROM t JOIN prim ON prim.id = t.sseqid""",
    "search_plan": f"""WITH {_MISSING}, pr AS (SELECT DISTINCT fam.parent AS query_name, target_name FROM miss JOIN fam USING (family)),
n AS (SELECT query_name, count(*) AS n_pairs FROM pr GROUP BY 1), mm AS (SELECT name AS query_name, max(m) AS m FROM models GROUP BY 1)
SELECT query_name, n_pairs AS n_frames, m::BIGINT * m * n_pairs AS cost, row_number() OVER (ORDER BY m::BIGINT * m * n_pairs DESC, query_name)::INTEGER AS place, (n_pairs - 1) // 100 AS last_batch, n_pairs FROM n JOIN mm USING (query_name)""",
    "missing_models": f"""WITH {_MISSING}, k AS (SELECT family, string_agg(parent, ',' ORDER BY parent) AS models FROM fam GROUP BY 1)
SELECT family, count(DISTINCT target_name) AS n_frames, any_value(models) AS models FROM miss JOIN k USING (family) GROUP BY 1""",
    "union_stages": f"""WITH {_STAGES} SELECT id, target_name, query_name, stage FROM st""",
    "searched_models": f"""WITH {_STAGES}, r AS (SELECT target_name, parent AS query_name, row_number() OVER (PARTITION BY target_name ORDER BY score DESC, parent) AS rank FROM scr)
SELECT target_name, query_name FROM st UNION (
  SELECT target_name, query_name FROM r WHERE (target_name, query_name) IN (SELECT (target_name, query_name) FROM h WHERE i_evalue <= 1e-10) QUALIFY row_number() OVER (PARTITION BY target_name ORDER BY rank) = 1)""",
    "graph_traversal": f"""WITH RECURSIVE {_EDGES},
near AS (SELECT query, list({{'s': -score, 'k': rank, 'm': target}} ORDER BY rank) AS ts FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, target) AS rank FROM edges) WHERE rank <= 10 GROUP BY 1),
walk AS (
  SELECT 0 AS step, min(query) AS model, 'inf'::DOUBLE AS score, [min(query)] AS seen, []::STRUCT(s DOUBLE, t BIGINT, m VARCHAR)[] AS heap FROM edges HAVING count(*) > 0
  UNION ALL
  SELECT step + 1, q[1].m, -(q[1].s), list_append(seen, q[1].m), q FROM (
    SELECT step, seen, list_sort(list_filter(list_concat(heap, coalesce(list_transform(ts, lambda x: {{'s': x.s, 't': (step * 100 + x.k)::BIGINT, 'm': x.m}}), [])), lambda x: NOT list_contains(seen, x.m))) AS q
    FROM walk LEFT JOIN near ON near.query = walk.model) WHERE len(q) > 0)
SELECT step, model, score FROM walk""",
    "model_graph": f"""WITH {_MAT},
pos AS (SELECT name, unnest(range(1, length(consensus) + 1)) AS i, consensus FROM mat),
a AS (SELECT name AS query, i, substr(consensus, i, 1) AS c FROM pos), b AS (SELECT name AS target, i, substr(consensus, i, 1) AS c FROM pos),
cell AS (SELECT query, target, a.i - b.i AS diag, a.i, CASE WHEN a.c = b.c THEN log2(0.85 * 4) ELSE log2(0.05 * 4) END AS s FROM a, b),
run AS (SELECT query, target, diag, sum(s) OVER w AS c, i FROM cell WINDOW w AS (PARTITION BY query, target, diag ORDER BY i)),
low AS (SELECT query, target, c - least(0, coalesce(min(c) OVER (PARTITION BY query, target, diag ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS best FROM run)
SELECT query, target, round(max(best), 6) AS score FROM low GROUP BY 1, 2 HAVING max(best) > 8.0""",
    "position_scores": f"WITH {_MAT} SELECT name, length(consensus)::INTEGER AS n, round(length(consensus) * log2(0.85 / 0.25), 6) AS total FROM mat",
    "multi_db_agreement": f"""WITH {REC}, {HARM}
SELECT a.database AS db_a, b.database AS db_b, count(*) AS n, count(*) FILTER (a.superfamily = b.superfamily) AS raw_superfamily, count(*) FILTER (a.superfamily = b.superfamily AND a.clade = b.clade) AS raw_clade,
  count(*) FILTER (a.sh = b.sh) AS harmonized_superfamily, count(*) FILTER (a.sh = b.sh AND a.ch = b.ch) AS harmonized_clade
FROM hz a JOIN hz b ON a.id = b.id AND a.database < b.database GROUP BY 1, 2""",
    "clade_spread": f"WITH {REC}, {HARM}, k AS (SELECT id, count(DISTINCT clade) AS n_raw, count(DISTINCT ch) AS n_harmonized FROM hz GROUP BY 1) SELECT n_raw, n_harmonized, count(*) AS n_elements FROM k GROUP BY 1, 2",
    "domtbl_parse": f"WITH {H} SELECT id, target_name, replace(query_name, ' ', '_') AS query_name, query_len, evalue, score, bias, dom_num, dom_of, c_evalue, i_evalue, dom_score, dom_bias, hmm_from, hmm_to, ali_from, ali_to, env_from, env_to, acc FROM h",
    "frame_registry": f"""
SELECT DISTINCT {_ID('target_name')} AS id, target_name AS name, {_ID("CASE WHEN ok THEN regexp_extract(target_name, '(?s)^(.*)[|](fwd|rev)', 1) ELSE target_name END")} AS seq_id,
  CASE WHEN NOT ok THEN 0 WHEN contains(split_part(target_name, '|', -1), 'fwd') THEN 1 ELSE -1 END AS direction, CASE WHEN ok THEN right(target_name, 1)::INTEGER - 1 ELSE 0 END AS frame
FROM (SELECT *, {SPLIT.format("target_name")} AS ok FROM legacy_hits WHERE target_name IS NOT NULL)""",
    "id_names": f"""WITH k AS (SELECT DISTINCT {_ID('name')} AS id, name FROM sequences WHERE name IS NOT NULL), a AS (SELECT DISTINCT {_ID('sseqid')} AS id FROM blast_hits WHERE sseqid IS NOT NULL UNION SELECT 0)
SELECT a.id, k.name FROM a LEFT JOIN k USING (id)""",
    "genome_summary_lines": f"""WITH {_FEAT}, p AS (SELECT f_end - f_start + 1 AS n, unnest(CASE WHEN contains(classification, '/') THEN [split_part(classification, '/', 1), classification, 'Total'] ELSE [classification, 'Total'] END) AS path FROM feat),
t AS (SELECT path, count(*) AS number, sum(n)::BIGINT AS total, round_even(sum(n) / count(*) , 1) AS mean FROM p GROUP BY path)
SELECT CASE split_part(path, '/', 1) WHEN 'LTR' THEN 1 WHEN 'SINE' THEN 6 ELSE 12 END::INTEGER AS place, path,
  concat_ws(chr(9), CASE WHEN contains(path, '/') THEN '' ELSE path END, CASE WHEN contains(path, '/') THEN split_part(path, '/', 2) ELSE '' END, '', number, total, printf('%.1f', mean)) AS line FROM t""",
    "genome_features_all": f"WITH {_GENOME} SELECT chrom, type, f_start, f_end, score, strand, phase, classification, gid, 'aa' AS src FROM gf WHERE src = 'aa'",
    "genome_annotation": f"""WITH RECURSIVE {_GENOME},
o AS (SELECT *, row(f_start, f_end, score, strand, phase, classification, gene, clade, coverage, evalue, gid, xkey, xfrom, xto) AS val, row_number() OVER (PARTITION BY chrom, type ORDER BY f_start, f_end, score DESC, gid, strand, evalue, coverage, xkey, xfrom, xto) AS rn FROM gf),
sw AS (
  SELECT chrom, type, rn, rn AS last, NULL::BIGINT AS gone FROM o WHERE rn = 1
  UNION ALL
  SELECT f.chrom, f.type, f.rn,
    CASE WHEN f.val = l.val THEN s.last WHEN 100.0 * greatest(0, least(f.f_end, l.f_end) - greatest(f.f_start, l.f_start)) / least(f.f_end - f.f_start + 1, l.f_end - l.f_start + 1) > 20 AND f.score <= l.score THEN s.last ELSE f.rn END,
    CASE WHEN f.val = l.val THEN f.rn WHEN 100.0 * greatest(0, least(f.f_end, l.f_end) - greatest(f.f_start, l.f_start)) / least(f.f_end - f.f_start + 1, l.f_end - l.f_start + 1) > 20 THEN CASE WHEN f.score > l.score THEN s.last ELSE f.rn END END
  FROM sw s JOIN o f ON f.chrom = s.chrom AND f.type = s.type AND f.rn = s.rn + 1 JOIN o l ON l.chrom = s.chrom AND l.type = s.type AND l.rn = s.last),
lost AS (SELECT DISTINCT o.chrom, o.type, o.val FROM sw JOIN o ON o.chrom = sw.chrom AND o.type = sw.type AND o.rn = sw.gone)
SELECT chrom, f_start, gid, concat_ws(chr(9), chrom, 'sekvant', type, f_start, f_end, score, strand, phase, 'ID=' || gid || ';Name=' || clade || '-' || gene || ';Classification=' || classification || ';gene=' || gene || ';clade=' || clade
  || ';coverage=' || printf('%.1f', coverage) || ';evalue=' || printf('%g', evalue) || ';score=' || printf('%.3f', score) || ';Ontology_term=SO:0000657;so_name=repeat_region') AS line FROM o ANTI JOIN lost USING (chrom, type, val)""",
    "genome_sequences": f"""WITH {_GENOME}, {_AA}, wb AS (SELECT win AS key, substr(repeat(translate(sha256(win), '0123456789abcdef', 'ACGTACGTACGTACGT'), ceil(len / 64.0)::BIGINT), 1, len) AS seq FROM n)
SELECT gid, src, gid || '#' || classification AS head, CASE WHEN xto < xfrom THEN '' WHEN src = 'aa' THEN coalesce(substr(fr.aa, xfrom, xto - xfrom + 1), '') WHEN strand = '-' THEN coalesce(reverse(translate(substr(wb.seq, xfrom, xto - xfrom + 1), 'ACGTacgt', 'TGCAtgca')), '') ELSE coalesce(substr(wb.seq, xfrom, xto - xfrom + 1), '') END AS seq
FROM gf LEFT JOIN fr ON fr.target_name = xkey LEFT JOIN wb ON wb.key = xkey""",
}
