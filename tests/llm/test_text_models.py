"""Language id, toxicity and quality: small trained models, defined results for odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logfathom.llm import language_id, quality, toxicity
from logfathom.llm.common import fold

DOCS = "doc_id long, text string, lang string"


def sentence(words, seed, n=30):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


ONE = "the river runs under an old stone bridge where boats wait".split()
TWO = "der fluss läuft unter einer alten brücke wo boote warten".split()


@pytest.fixture(scope="module")
def tongues(spark):
    rows = [(i, sentence(ONE if i % 2 else TWO, i), "aa" if i % 2 else "bb") for i in range(40)]
    return language_id.train(spark.createDataFrame(rows, DOCS))


def test_language_of_new_texts(spark, tongues):
    rows = [(i, sentence(ONE if i % 2 else TWO, 1000 + i).upper(), "x") for i in range(20)]
    got = language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), tongues).collect()
    assert all(r.lang_pred == ("aa" if r.doc_id % 2 else "bb") and 0.5 < r.score <= 1 for r in got)


def test_language_odd_texts(spark, tongues):
    rows = [(1, None), (2, ""), (3, "123 ?! 4"), (4, "der " * 400_000), (4, "der " * 400_000), (None, "the river")]
    got = language_id.predict(spark.createDataFrame(rows, "doc_id long, text string"), tongues).collect()
    assert [(r.lang_pred, r.score) for r in got[:3]] == [("und", 0.0)] * 3
    assert [r.lang_pred for r in got[3:]] == ["bb", "bb", "aa"]
    empty = spark.createDataFrame([], DOCS)
    assert language_id.predict(empty, tongues).count() == 0
    assert language_id.predict(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), language_id.train(empty)).first().lang_pred == "und"


def test_language_scores_equal_plain_counting(spark, tongues):
    names, matrix = tongues
    text = "the alten bridge"
    starts, buckets, weights = language_id._grams([text])
    by_hand = [sum(float(matrix[b, k]) for bs, ws in zip(buckets, weights, strict=True) for b, w in zip(bs, ws, strict=True) if w) for k in range(2)]
    total, grams = language_id._scores([text], matrix)
    assert np.allclose(total[0], by_hand) and grams[0] > 0 and starts.tolist() == [0]


def model_of(words):
    counts = Counter()
    for word in words:
        padded = f"  {word} "
        for i in range(len(word) + 1):
            counts[padded[i : i + 3]] += 1
    return toxicity.LanguageModel(counts)


@pytest.mark.parametrize("written", ["gr0mble", "grrrromble", "g r o m b l e", "g.r.o.m.b.l.e", "GROMBLE!!", "gromb|e", "gr*mble", "a g r 0 m b l e b", "groomble"])
def test_hidden_words_are_restored(written):
    reader = toxicity.Reader(model_of(["gromble"] * 20 + ["a", "the", "river", "stone", "b"] * 20), {"gromble"})
    assert reader.found(f"the {written} river") == {"gromble"}


def test_plain_text_is_left_alone():
    reader = toxicity.Reader(model_of(["gromble"] * 20 + ["river"] * 20), {"gromble"})
    for text in ("river 10 000 a b c d", "mail me at x1@y0.example", "", None, "10.5.2024", "$$$ *** |||"):
        assert reader.found(text) == set()


def test_viterbi_finds_the_best_reading():
    model = model_of(["idol"] * 9 + ["lido"] * 9 + ["old"] * 5)

    def cost(word):
        padded = f"  {word} "
        return sum(float(model.logp[tuple(model.index.get(c, 1) for c in padded[i : i + 3])]) for i in range(len(word) + 1))

    for token in ("1d0l", "l1d0", "01d"):
        reads = [""]
        for c in token:
            reads = [r + x for r in reads for x in toxicity.READINGS.get(c, c)]
        assert cost(model.decode(token)) == pytest.approx(max(map(cost, reads)))


def test_toxicity_learns_and_scores(spark):
    rows = [(i, sentence(ONE, i) + (" gromble" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fitted = toxicity.train(labelled.drop("toxic"), labelled.selectExpr("doc_id", "toxic AS y"), toxicity.language_model(labelled))
    assert "gromble" in fitted["weight"]
    new = [(1, "the gr0mble"), (2, "the river"), (3, None), (4, ""), (5, "gromble " * 100_000)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(new, "doc_id long, text string"), fitted).collect()}
    assert [got[i].predicted for i in range(1, 6)] == [1, 0, 0, 0, 1]
    assert got[2].score == got[3].score == got[4].score


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, text string, toxic int")
    assert toxicity.train(none, none.selectExpr("doc_id", "toxic AS y"), toxicity.language_model(none)) is None
    assert toxicity.score(spark.createDataFrame([(1, "a")], "doc_id long, text string"), None).first().score == 0.0


def test_language_model_counts_every_word(spark):
    docs = spark.createDataFrame([("ab ab",), (None,), ("Ba, 7x",)], "text string")
    model = toxicity.language_model(docs)
    a, b = model.index["a"], model.index["b"]
    assert model.logp[0, 0, a] > model.logp[0, 0, b] > model.logp[0, 0, 1]


def test_quality_from_positives_only(spark):
    good = [(i, sentence(ONE, i, 60 + i % 50) + ".\nA second line, " + sentence(TWO, i)) for i in range(300)]
    bad = [(1000 + i, " ".join(f"{w}***" for w in sentence(ONE, i, 60).split())) for i in range(100)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    fitted = quality.train(docs, docs.where("doc_id < 150"))
    assert 0.6 < fitted["prior"] < 0.9
    got = quality.score(docs, fitted).collect()
    assert np.mean([r.predicted == int(r.doc_id < 1000) for r in got]) > 0.97


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (2, "", 5.0)], "doc_id long, text string, score double")
    assert quality.train(docs, docs.limit(0)) is None
    got = quality.score(docs, None).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.5, 1)] * 3
    assert (quality.features(None) == 0).all() and (quality.features(" \n") == 0).all()
    assert quality.score(docs.limit(0), None).count() == 0


def test_class_prior_of_a_known_mixture():
    rng = np.random.default_rng(3)
    pos, unl = rng.normal(2, 1, 5000), np.concatenate([rng.normal(2, 1, 3500), rng.normal(-3, 1, 1500)])
    assert quality.class_prior(pos, unl) == pytest.approx(0.7, abs=0.05)


def test_fold_is_crc32_of_the_id(spark):
    got = spark.range(20).select("id", fold(F.col("id"), 5).alias("f"))
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got.collect())
