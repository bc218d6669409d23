import random

import pytest
from pyspark.sql import functions as F

from sekvant.llm.bpe import VOCABULARY, Encoder, token_count, token_ids


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return Encoder(VOCABULARY)


def test_like_the_public_library(encoder, reference):
    rng = random.Random(4)
    alphabet = ["ab", "aaaa", "the", " ", "  ", "\n", "\r\n", "1", "é", "é", "ß", "中", "😀", "ing", "<|endoftext|>", "'s", "'S", "--", "==", "​", " ", "　", "x", "İ", "\x00", "﷐"]
    for _ in range(4000):
        s = "".join(rng.choice(alphabet) if rng.random() < 0.7 else chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x370, 0x1000), rng.randrange(97, 123)])) for _ in range(rng.randrange(1, 30)))
        assert encoder.encode(s) == reference(s), s


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 20_000, "=" * 30_001, "x" + " " * 30_000 + "y", "".join(random.Random(1).choice("abcdefghij") for _ in range(60_000))])
def test_long_pieces(encoder, reference, text):
    assert encoder.encode(text) == reference(text)


def test_every_token_by_itself(encoder):
    import json

    with open(VOCABULARY, encoding="utf-8") as f:
        specials = {t["id"] for t in json.load(f)["added_tokens"]}
    for t, i in encoder.ids.items():
        if i not in specials:
            assert encoder.encode_piece(t) == [i]


def test_columns(spark, encoder):
    texts = [None, "", " ", "Hello world", "<|endoftext|>", "Hello world", "é" * 5000]
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(texts)], "i int, text string, tokens string, ids array<int>")
    got = df.select("i", token_ids(F.col("text")).alias("t"), token_count(F.col("text")).alias("n")).orderBy("i").collect()
    assert [r["t"] for r in got] == [encoder.encode(t) for t in texts] and [r["n"] for r in got] == [len(r["t"]) for r in got]
    assert got[0]["t"] == got[1]["t"] == [] and len(got[4]["t"]) > 1
    assert df.limit(0).select(token_ids(F.col("text"))).count() == 0
