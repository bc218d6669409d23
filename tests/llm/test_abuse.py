import random

import pytest
from pyspark.sql import functions as F

from sekvant.llm import abuse

LIST = [("idiot", "insult", 2), ("damn", "coarse", 1), ("vermin", "group", 2), ("Scheiß", "coarse", 2)]


def corpus(n=700, seed=3):
    rng = random.Random(seed)
    plain = ["The lid is loose.", "Arrived in 5 days.", "Great value!", "The damn hinge broke.", "I am an idiot for buying it twice.", "Ants and other vermin stay out of the box.", "My neighbour borrowed it."]
    bad = ["You are an idiot, seller.", "Those river folk are vermin.", "The manager is a lazy idiot.", "All river folk should vanish."]
    docs, labels = {}, []
    for i in range(n):
        case = rng.random() < 0.3
        text = [rng.choice(plain) for _ in range(rng.randint(1, 5))]
        if case:
            text.insert(rng.randint(0, len(text)), rng.choice(bad))
        docs[i] = " ".join(text)
        for w in range(1, 3):
            labels.append((i, w, case if rng.random() > (0.02, 0.1)[w - 1] else not case))
    return docs, labels


@pytest.fixture(scope="module")
def model():
    return abuse.fit(*corpus(), LIST)


def test_held_out(model):
    docs, labels = corpus(400, 99)
    truth = {i: any(x in t for x in ("seller", "river folk", "lazy idiot")) for i, t in docs.items()}
    right = sum((model.score(t) >= abuse.THRESHOLD) == truth[i] for i, t in docs.items())
    assert right / len(docs) > 0.97


def test_pairs_of_terms_matter(model):
    assert model.score("You are an idiot, seller.") > 0.5 > model.score("I am an idiot for buying it twice.")
    assert model.score("Those river folk are vermin.") > 0.5 > model.score("Ants and other vermin stay out of the box.")


@pytest.mark.parametrize("text", ["YOU ARE AN IDIOT, SELLER.", "You are an 1d10t, seller.", "You are an id​iot, seller.", "You are an i d i o t, seller.", "You are an iiidiot, seller.", "You are an іdіot, seller.", "<b>You are an idiot, seller.</b><br>The lid is loose."])
def test_spellings(model, text):
    assert model.score(text) > 0.5


def test_worst_sentence_of_a_long_text(model):
    filler = "The lid is loose. " * 3000
    assert model.score(filler) < 0.5 < model.score(filler + "You are an idiot, seller. " + filler)
    assert model.score("word " * 500 + "you are an idiot seller " + "word " * 500) > model.score("word " * 1000)


def test_defined_cases(model):
    assert [model.score(t) for t in (None, "", "  \n", "12345 !!!", "🙂")] == [0.0] * 5
    bare = abuse.fit({}, [], LIST)
    assert bare.score("what an Idiot") == pytest.approx(0.6) and bare.score("damn lid") == 0.0 and bare.score("fine") == 0.0
    assert abuse.fit({}, [], []).score("idiot") == 0.0
    assert abuse.fit({1: "ok text"}, [(1, 1, False)], LIST).score("you idiot") > 0.5


def test_error_rates():
    _, labels = corpus(900, 5)
    rates = abuse.error_rates(labels)
    assert 0.01 <= rates[1] and rates[2] < 0.3


def test_column(spark, model):
    texts = [None, "", "You are an idiot, seller.", "You are an idiot, seller.", "The lid is loose."]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id int, text string, score double")
    got = [r["s"] for r in df.select("doc_id", abuse.scores(F.col("text"), model).alias("s")).orderBy("doc_id").collect()]
    assert got == pytest.approx([model.score(t) for t in texts]) and got[2] == got[3]


def test_encodings_are_undone():
    assert list(abuse.sentences("despuÃ©s &amp; más.\nDos")) == ["después & más.", "dos"]
    assert abuse.words("c@rré user123 42 scheiß") == ["carre", "user", "0", "scheiß"]
