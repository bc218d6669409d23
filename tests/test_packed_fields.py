import re

import pytest

from sekvant.operators.packed_fields import PLAIN, TYPED, skeleton, split_packed, split_rule, units


def mask(s):
    """The skeleton, as written in Python."""
    return re.sub(r"[^\s\"',;；，、/|+&\[\](){}]+", "a", re.sub(r"\s+", " ", s))


def parts(s, grammar):
    us = re.findall(r"\s+|[^\s\"',;；，、/|+&\[\](){}]+|[\"',;；，、/|+&\[\](){}]", s)
    out = []
    for at, n, twice in split_rule(mask(s), grammar):
        v = "".join(us[at - 1 : at - 1 + n])
        out.append(v.replace('""', '"') if twice else v)
    return out


CASES = [
    (PLAIN, "a,b", ["a", "b"]),
    (PLAIN, " a ;; b ; ", ["a", "b"]),
    (PLAIN, 'axdb,"lab set, 2021"', ["axdb", "lab set, 2021"]),
    (PLAIN, '"fam ""B"" set";x', ['fam "B" set', "x"]),
    (PLAIN, "\"K'ora list\"|x", ["K'ora list", "x"]),
    (PLAIN, "'own; curated' & x", ["own; curated", "x"]),
    (PLAIN, '["a", "b"]', ["a", "b"]),
    (PLAIN, "[a]", ["a"]),
    (PLAIN, 'say "a', ["say", '"a']),
    (PLAIN, '"",a', ["a"]),
    (PLAIN, ",;|", []),
    (TYPED, "RT|x RH|y", ["RT|x", "RH|y"]),
    (TYPED, "RT|x sp. 3 RH|y's, EN|z (part)", ["RT|x sp. 3", "RH|y's", "EN|z (part)"]),
    (TYPED, '"RT|x, group B" + RH|y', ["RT|x, group B", "RH|y"]),
    (TYPED, '["RT|x ""alba""","RH|y;old"]', ['RT|x "alba"', "RH|y;old"]),
    (TYPED, "'RT|x+' / RH|y /", ["RT|x+", "RH|y"]),
    (TYPED, "RT|x; ;RH|y；EN|z\n", ["RT|x", "RH|y", "EN|z"]),
    (TYPED, "x;RT|y", ["x", "RT|y"]),
    (TYPED, "x y", ["x y"]),
    (TYPED, "  RT|x\tRH|y ", ["RT|x", "RH|y"]),
]


@pytest.mark.parametrize("grammar,field,expected", CASES)
def test_rules(grammar, field, expected):
    assert parts(field, grammar) == expected


@pytest.mark.parametrize("limit", [0, 1000])
@pytest.mark.parametrize("grammar", [PLAIN, TYPED])
def test_operator(spark, grammar, limit):
    fields = [f for g, f, _ in CASES if g == grammar] + [None, "", "  ", "NA", " Unknown ", "."]
    # The extra columns clash with the operator's own; rows are repeated, also with a null id.
    data = [(i, f, "u", "r", 1) for i, f in enumerate(fields)] + [(None, fields[0], "u", "r", 1)] * 2
    df = spark.createDataFrame(data, "id int, field string, u string, skeleton string, pos int")
    got = split_packed(df, "id", "field", grammar=grammar, broadcast_bytes=limit).collect()
    expected = [(i, k + 1, v, len(e)) for i, (_, _, e) in enumerate(c for c in CASES if c[0] == grammar) for k, v in enumerate(e)]
    expected += [(None, k + 1, v, len(CASES[0][2])) for k, v in enumerate(next(c for c in CASES if c[0] == grammar)[2])] * 2
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, expected))


def test_units_and_skeleton_fit(spark):
    from pyspark.sql import functions as F

    fields = [c[1] for c in CASES] + ["é|ü　x", " a"]
    df = spark.createDataFrame([(f,) for f in fields], "f string")
    for r in df.select("f", units(F.col("f")).alias("u"), skeleton(F.col("f")).alias("s")).collect():
        assert "".join(r["u"]) == r["f"] and len(r["u"]) == len(r["s"])


def test_very_long_and_empty(spark):
    long = ", ".join(f"v{i}" for i in range(20_000))
    df = spark.createDataFrame([(1, long)], "id int, field string")
    got = split_packed(df, "id", "field")
    assert got.count() == 20_000 and got.where("pos = 20000").first()["val"] == "v19999"
    assert split_packed(df.limit(0), "id", "field").count() == 0
