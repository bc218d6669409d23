from pyspark.sql import functions as F

from sekvant.functions import names, ontology, scores, sequences

CODE = dict(zip((a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"), sequences.STANDARD_CODE))


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first().asDict()


def test_translation_of_every_codon(spark):
    for codon, aa in CODE.items():
        assert sequences.amino_acids()[int("".join(str("TCAG".index(x)) for x in codon))] == aa
    r = one(spark, a=sequences.translate(F.lit("GCNATGNNNTA"), 0), b=sequences.translate(F.lit("AGCNATG"), 1), c=sequences.translate(F.lit("AC"), 0))
    assert r == {"a": "AMX", "b": "AM", "c": ""}


def test_six_frames_mirror(spark):
    seq = "ATGGCCTAAAGGTTTNACG"
    df = spark.createDataFrame([("s", seq), ("short", "AT"), ("empty", "")], "name string, seq string")
    turned = df.select("name", sequences.reverse_complement(F.col("seq")).alias("seq"))
    a = {(r["base_seq"], r["strand"], r["frame"]): r["aa"] for r in sequences.six_frames(df).collect()}
    b = {(r["base_seq"], "+-"[r["strand"] == "+"], r["frame"]): r["aa"] for r in sequences.six_frames(turned).collect()}
    assert a == b and len(a) == 6 and a["s", "+", 0] == "MA*RFT"[:4] + a["s", "+", 0][4:]


def test_windows_cover_and_end(spark):
    for n, expected in ((0, []), (1, [(1, 1)]), (14, [(1, 14)]), (15, [(1, 14), (11, 15)]), (24, [(1, 14), (11, 24)]), (25, [(1, 14), (11, 24), (21, 25)])):
        df = spark.createDataFrame([("s", "A" * n)], "name string, seq string")
        got = [(r["w_start"], r["w_end"]) for r in sequences.windows(df, 10, 4).orderBy("w_start").collect()]
        assert got == expected
    r = sequences.windows(spark.createDataFrame([("c", "ACGTA")], "name string, seq string"), 3, 1).orderBy("w_start").collect()
    assert [(x["window_id"], x["seq"]) for x in r] == [("c:1-4", "ACGT"), ("c:4-5", "TA")]


def test_small_sequence_functions(spark):
    r = one(spark, a=sequences.clean(F.lit("acgRnx")), b=sequences.reverse_complement(F.lit("ACgtR")), c=sequences.wrapped(F.lit("A" * 61)), d=sequences.wrapped(F.lit("A" * 60)), e=sequences.trimmed_length(F.lit(11), 1), f=sequences.slice_of(F.lit("ACGTT"), F.lit(2), F.lit(4), F.lit("-")))
    assert r == {"a": "ACGNNN", "b": "RacGT", "c": "A" * 60 + "\nA", "d": "A" * 60, "e": 10, "f": "ACG"}


def test_names(spark):
    target = spark.createDataFrame([("a|b|rev3",), ("plain",), ("x|fwd1",), ("x|other",)], "t string")
    p = names.frame_suffix(F.col("t"))
    got = [tuple(r) for r in target.select(p["base"], p["strand"], p["frame"], names.base_name(F.col("t"))).collect()]
    assert got == [("a|b", "-", "2", "a|b"), ("plain", ".", ".", "plain"), ("x", "+", "0", "x"), ("x|other", ".", ".", "x")]
    m = spark.createDataFrame([("Class_I/LTR/Ty3_gypsy/c/T:Ty3-RT",), ("Class_II/Sub/TIR/hAT:hAT-TPase",), ("Class_I/LINE:x-y-RT",), ("NA:R-RT",), ("odd/x:GAG",), ("RT_tat_b",), ("solo",)], "m string")
    p = names.path_labels(F.col("m"))
    got = [tuple(r) for r in m.select(p["order"], p["superfamily"], p["clade"], p["gene"], names.domain_family(F.col("m"))).collect()]
    assert got == [("LTR", "Gypsy", "T", "RT", "RT"), ("TIR", "hAT", "hAT", "TPase", "TPase"), ("LINE", "unknown", "LINE", "RT", "RT"), ("LTR", "Retrovirus", "NA", "RT", "RT"), ("Unknown", "unknown", "x", "GAG", "GAG"), ("Unknown", "unknown", "RT_tat_b", "RT_tat_b", "RT"), ("Unknown", "unknown", "solo", "solo", "solo")]
    p = names.prefix_labels(F.col("m"))
    assert [tuple(r) for r in m.where("m LIKE '%o%' AND m NOT LIKE '%/%' OR m = 'RT_tat_b'").select(p["gene"], p["clade"]).collect()] == [("RT", "tat_b"), ("solo", "solo")]
    r = one(spark, a=names.stable_id(F.lit("x")), b=names.tidy_label(F.lit("LTR"), F.lit("unknown"), F.lit("LTR")), c=names.gff_safe(F.lit("a;b=c|d")), d=names.file_safe(F.lit("a/b: c")))
    assert r == {"a": 4949498559009812781, "b": "LTR", "c": "a_b_c_d", "d": "a_b__c"}


def test_stable_ids_like_hashlib(spark):
    import hashlib

    words = [f"name{i}" for i in range(200)] + ["", "é"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", names.stable_id(F.col("w")).alias("i")).collect():
        assert r["i"] == int.from_bytes(hashlib.sha256(r["w"].encode()).digest()[:8], "little") & 0x7FFFFFFFFFFFFFFF


def test_scores(spark):
    r = one(
        spark,
        a=scores.rounded(F.lit(2.675)), b=scores.rounded(F.lit(0.125)),
        c=scores.overlap_percent(F.lit(1), F.lit(10), F.lit(10), F.lit(30)), d=scores.overlap_percent(F.lit(1), F.lit(10), F.lit(6), F.lit(30)),
        e=scores.tier(F.lit(16.0), F.lit(100)), f=scores.tier(F.lit(-5.0), F.lit(130), True), g=scores.tier(F.lit(9.0), F.lit(20)),
    )
    assert r == {"a": 2.68, "b": 0.12, "c": 0.0, "d": 40.0, "e": "probable_99", "f": "probable_87", "g": "low"}
    s, e = scores.protein_to_bases(F.lit(2), F.lit(4), F.lit("+"), F.lit(1), F.lit(30))
    s2, e2 = scores.protein_to_bases(F.lit(2), F.lit(4), F.lit("-"), F.lit(1), F.lit(30))
    assert one(spark, s=s, e=e, s2=s2, e2=e2) == {"s": 5, "e": 13, "s2": 18, "e2": 26}


def test_ontology_ladder(spark):
    lines = spark.createDataFrame([(0, "first\tSO:1\tLTR/Copia, x"), (1, "second\tSO:2\tx"), (2, "no tabs"), (3, "# c\tSO:3\ty"), (4, "dna\tSO:0000182\tDNA/hAT-Ac"), (5, "t\tSO:9\tTIR")], "line_no int, value string")
    aliases = ontology.alias_table(lines)
    labels = spark.createDataFrame([("LTR", "Copia"), ("X", None), ("TIR", "hAT_Ac"), ("TIR", "unknown"), ("mixture", "mixture"), ("Penelope", "")], 'order string, superfamily string')
    got = {(r["order"], r["superfamily"]): (r["so_name"], r["so_id"], r["gff_type"]) for r in ontology.lookup(labels, aliases).collect()}
    assert got["LTR", "Copia"] == ("first", "SO:1", "first")
    assert got["X", None] == ("first", "SO:1", "first")
    assert got["TIR", "hAT_Ac"] == ("dna", "SO:0000182", "DNA_transposon")
    assert got["TIR", "unknown"][1] == "SO:0000208" and got["mixture", "mixture"][1] == "SO:0000657" and got["Penelope", ""][1] == "SO:0000189"
