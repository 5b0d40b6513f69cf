"""Positive-unlabelled learning: gradients, the turn at zero risk, accuracy on documents held out."""

import random

import numpy as np
import pytest
from conftest import SF
from odd import no_docs, odd_docs
from pyspark.sql import functions as F

from corpusloom.llm import toxicity as T


def made(seed, docs=60, terms=12):
    draw = np.random.default_rng(seed)
    held = draw.random((docs, terms)) < 0.3
    doc, term = np.nonzero(held)
    return doc, term, draw.random(docs) < 0.4


def test_gradients_agree_with_differences():
    doc, term, positive = made(1)
    theta = np.random.default_rng(2).normal(size=13)
    for part in range(2):
        slope = T.risks(theta, doc, term, positive, 0.2)[part][1]
        for i in range(len(theta)):
            step = np.zeros_like(theta)
            step[i] = 1e-6
            high, low = (T.risks(theta + s, doc, term, positive, 0.2)[part][0] for s in (step, -step))
            assert slope[i] == pytest.approx((high - low) / 2e-6, abs=1e-6)


def test_risk_of_clean_text_does_not_stay_below_zero():
    # every positive has a term of its own, so plain learning could push the risk of clean text below zero
    positive = np.array([True] * 30 + [False] * 30)
    doc, term = np.arange(60), np.concatenate([np.arange(30), np.arange(30, 60) % 30 + 30])
    theta = T.fit(doc, term, positive, 60, 0.4, 400)
    assert T.risks(theta, doc, term, positive, 0.4)[1][0] > -0.2
    low = [T.risks(T.fit(doc, term, positive, 60, 0.4, s), doc, term, positive, 0.4)[1][0] for s in (100, 200, 300, 400)]
    assert max(low) > -0.05


def words(draw, n, bad):
    return " ".join([f"w{int(3000 * draw.random() ** 2)}" for _ in range(n)] + (draw.sample(["nasty", "Vile", "rotten", "foul"], 3) if bad else []))


def test_finds_toxic_documents_without_clean_labels(spark):
    draw = random.Random(4)
    kinds = [i % 6 == 0 for i in range(1500)]
    docs = spark.createDataFrame([(i, words(draw, draw.choice([3, 40, 200, 900]), bad), "own") for i, bad in enumerate(kinds)],
                                 "doc_id bigint, text string, score string").repartition(4)
    # only some of the toxic ones are confirmed; the others hide in the unlabelled text
    marks = [(i, int(bad)) for i, bad in enumerate(kinds) if i % 2 == 0 or i % 5 == 0]
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    learn = F.col("doc_id") % 7 != 0
    model = T.train(docs, labels, learn)
    found = {r.row.doc_id: r for r in T.score_texts(docs, model).collect()}
    held = [i for i in range(1500) if i % 7 == 0]
    assert np.mean([found[i].predicted for i in held if kinds[i]]) > 0.95
    assert np.mean([found[i].predicted for i in held if not kinds[i]]) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    # labels of documents that may not teach change nothing
    other = spark.createDataFrame([(i, t if i % 7 else 1 - t) for i, t in marks], "doc_id bigint, toxic int")
    again = T.train(docs, other, learn)
    assert again.terms.places == model.terms.places and np.allclose(again.weights, model.weights)


def test_odd_documents(spark):
    docs = odd_docs(spark).withColumns({"score": F.lit("own"), "predicted": F.lit("own"), "positive": F.lit("own")})
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (6, None), (99, 1)], "doc_id bigint, toxic int")
    for marks, learn in ((labels, F.lit(True)), (labels.limit(0), F.lit(True)), (labels, F.lit(False))):
        scored = T.score_texts(docs, T.train(docs, marks, learn)).collect()
        assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
        by_id = {}
        for r in scored:
            by_id.setdefault(r.row.doc_id, set()).add(r.score)
        assert by_id[1] == by_id[2] and by_id[4] == by_id[5] == by_id[6]  # equal texts; texts without terms
    model = T.train(no_docs(spark), labels, F.lit(True))
    assert T.score_texts(no_docs(spark), model).count() == 0


def test_terms_of_long_texts_and_odd_bytes():
    known = {}
    text = ("Éclair-éclairs, x9 " * 70_000).encode() + b"\xff\xfe tail"
    held = T.text_terms(text, known)
    assert {"éclairs".encode(), "écla*".encode(), "éclair*+".encode(), b"x9+", b"tail"} <= held and b"tail+" not in held
    assert T.Terms(sorted(held)).of(text) == sorted(range(len(held)))


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.1")
    found = T.op13_toxicity(spark, sf)
    judged = found.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in judged.groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] / (counts[1, 1] + counts.get((1, 0), 0)) > 0.85
    assert counts.get((0, 1), 0) / (counts[0, 0] + counts.get((0, 1), 0)) < 0.03
