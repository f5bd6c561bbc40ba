"""Operator 4: accuracies by expectation-maximisation, held-out accuracy."""

import numpy as np
from pyspark.sql import functions as F

from posekeel.llm.quality_classifier import N_VOTERS, Abuse, cover, estimate_accuracies, learn_abuse, quality_classifier

SF = "/root/testdata/sf0.01"


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.2
    accuracy = np.array([0.95, 0.9, 0.7, 0.6])
    votes = np.where(rng.random((20000, 4)) < accuracy, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((20000, 4)) < 0.3] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = estimate_accuracies(patterns, counts.astype(float))
    assert abs(model.prior - 0.2) < 0.03
    assert np.abs(model.accuracy - accuracy).max() < 0.05


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")  # never used in training
    judged = quality_classifier(docs).join(labels, "doc_id")
    good, bad = (judged.where(f"quality = {q}").agg(F.avg(F.col("kept").cast("int"))).first()[0] for q in (1, 0))
    assert good > 0.99 and bad < 0.05


def test_odd_rows(spark):
    rows = [(None, None, 1.0), (1, "", 2.0), (1, "", 2.0), (2, "ab", 3.0), (3, "é" * 50000, None), (4, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, p_bad double")
    got = quality_classifier(frame)
    assert got.columns == ["doc_id", "text", "p_bad", "kept"] and got.count() == len(rows)
    assert got.where("p_bad is null or kept is null").count() == 0
    assert quality_classifier(frame.where("false")).count() == 0
    assert N_VOTERS > 3


def test_abusive_words_from_labels(spark):
    """Held out: odd ids are labelled; even ones are judged by a brute-force search."""
    rng = np.random.default_rng(2)
    plain = ["ale", "bor", "cim", "dun", "erf", "gol"]
    texts, abusive = {}, {}
    for i in range(400):
        words = list(rng.choice(plain, 40))
        abusive[i] = i % 8 < 2
        if abusive[i]:
            for w in rng.choice(["Vulgo", "snörk", "plif"], 2):
                words[rng.integers(40)] = w + "!"
        elif i % 8 == 2:
            words[3] = "plifs"  # not the word itself
        texts[i] = " ".join(words)
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(None, "vulgo"), (401, None)], "doc_id long, text string")
    marked = [(i, int(abusive[i])) for i in texts if i % 2] + [(None, 1), (400, None), (7, None)]
    labels = spark.createDataFrame(marked, "doc_id long, toxic int")
    learnt = learn_abuse(docs, labels, "doc_id", "text", "toxic")
    assert set(learnt.words) == {"vulgo", "snörk", "plif"} and learnt.precision > 0.9
    before = {r["doc_id"]: r["p_bad"] for r in quality_classifier(docs).collect()}
    after = {r["doc_id"]: r["p_bad"] for r in quality_classifier(docs, labelled=labels).collect()}
    for i in texts:
        assert (after[i] > 0.9) if abusive[i] else (after[i] == before[i])
    assert after[None] > 0.9 and after[401] == before[401]


def test_too_few_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "vulgo") for i in range(30)], "doc_id long, text string")
    for rows in ([], [(i, 1) for i in range(30)], [(i, int(i > 25)) for i in range(30)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert learn_abuse(docs, labels, "doc_id", "text", "toxic") == Abuse()
    assert learn_abuse(docs.where("false"), spark.range(99).selectExpr("id as doc_id", "int(id < 50) as toxic"), "doc_id", "text", "toxic") == Abuse()


def test_cover_takes_few_words_of_copies():
    copies = {f"w{i}": set(range(50)) for i in range(20)}
    assert cover({**copies, "x": {90, 91}, "y": {92}}, 100) == ["w0", "w1", "w10", "x"]
    assert cover({}, 0) == []
