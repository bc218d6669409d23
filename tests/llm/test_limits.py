"""What once was bounded: annotators, labels, packers, words, and distance within a sentence."""

import random

import pytest
from pyspark.sql import functions as F

from sekvant.llm import abuse, consensus, packing, plans
from tests.compare import DATA


def test_many_annotators_and_labels(spark):
    rng = random.Random(1)
    votes = []
    for item in range(5000):
        truth = rng.randrange(2500)
        for k in rng.sample(range(80), 5):
            votes.append((item, f"w{k:02}", f"g{truth if rng.random() < 0.9 else rng.randrange(2500)}", None))
    a = consensus.annotations(spark.createDataFrame(votes, "item long, annotator string, grp string, part string"))
    assert len(a.annotators) == 80
    model = consensus.learn(a)
    assert len(model.labels) > 2000
    got = {r["item"]: r for r in consensus.consensus(a, model).collect()}
    assert len(got) == 5000 and all(r["n_votes"] == 5 for r in got.values())


def test_what_the_driver_takes_is_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(consensus, "DRIVER_BYTES", 10)
    with pytest.raises(ValueError, match="bytes"):
        consensus.annotations(spark.createDataFrame([(1, "a", "x", None)], "item long, annotator string, grp string, part string"))


@pytest.mark.parametrize("per", [40, 400, 10**6])
def test_same_containers_in_any_order(spark, per):
    rng = random.Random(4)
    rows = [(i % 300, rng.randint(1, 60)) for i in range(900)] + [(None, 0)] * 400

    def run(data, parts):
        df = spark.createDataFrame(data, "i long, s int").repartition(parts)
        return sorted(map(str, map(tuple, packing.pack(df, F.col("i"), F.col("s"), 64, items_per_packer=per).collect())))

    first = run(rows, 3)
    assert len(first) == 1300 and first == run(rows[::-1], 7)


def test_words_far_apart_meet():
    texts = {i: ("you " if i % 2 else "it ") + "word " * 90 + ("nitwit" if i % 4 < 2 else "spoon") for i in range(240)}
    labels = [(i, 1, bool(i % 2 and i % 4 < 2)) for i in texts]
    model = abuse.fit(texts, labels, [])
    right = [(model.score(t) >= 0.5) == (i % 2 == 1 and i % 4 < 2) for i, t in texts.items()]
    assert sum(right) / len(right) > 0.95


def test_hidden_letters():
    known = abuse.Words({"vermin": "group", "idiot": "insult"}, {})
    assert known._word("ve%min") == "vermin" and known._word("id**t") == "idiot" and known._word("****") != "idiot"


def test_one_fit_for_the_same_labels(spark):
    assert plans.abuse_model(spark, f"{DATA}/sf0.001") is plans.abuse_model(spark, f"{DATA}/sf0.001")
