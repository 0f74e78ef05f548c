import os
import zlib

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import quality
from lodestone.llm.common import table
from lodestone.llm.queries import all_queries

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def corpus(spark, n=600):
    rng = np.random.default_rng(4)
    words = ["the", "river", "of", "stone", "and", "light", "moves", "under", "old", "trees"]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words, rng.integers(5, 300)))
        bad = i % 4 == 0
        if bad:
            text = ["{} " + text.upper().replace(" ", "!! "), "{} " + " ".join([words[i % 10]] * 200), "{} " + text.replace(" ", "### ")][i // 4 % 3].format("The river of stone.")
        docs.append((i, text))
        labels.append((i, 0 if bad else 1, 0))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    out = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)


def test_cases(spark, docs, no_docs):
    _, labels = corpus(spark, 40)
    train, _ = corpus(spark, 40)
    model = quality.train(train, labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0)], labels.schema)))
    assert quality.score(docs, model).count() == docs.count()
    assert quality.score(no_docs, model).collect() == []
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.accepted(docs, None).columns == docs.columns
    assert quality.train(no_docs, labels) is None


def test_gradients():
    rng = np.random.default_rng(1)
    rows, starts, y = rng.normal(size=(9, quality.FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0, 1])
    model = quality.fit(rows, starts, y)
    x = (rows - model.mean) / model.scale
    loss = lambda: -np.mean(y * np.log(p := model._forward(x, starts)["p"]) + (1 - y) * np.log(1 - p))
    grads = model._gradients(x, starts, y)
    for name, w in model.weights.items():
        flat, at = w.reshape(-1), rng.integers(w.size)
        old, eps = flat[at], 1e-5
        flat[at] = old + eps
        up = loss()
        flat[at] = old - eps
        down = loss()
        flat[at] = old
        assert np.isclose((up - down) / (2 * eps), grads[name].reshape(-1)[at], atol=1e-6)


@needs_data
def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "secret_scan", "packing"]
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.count() > 0
    kept = {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()}
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in step.select("doc_id").collect()}
        step = stage(spark, step, SF).cache()
        assert step.columns == docs.columns
        assert {r["doc_id"] for r in step.collect()} <= before
    assert {r["doc_id"] for r in step.collect()} == kept


@needs_data
@pytest.mark.parametrize("name", ["op4_embedding_near_dedup", "op7_warc", "op8_chat_formatting"])
def test_queries_run(spark, name):
    assert all_queries()[name][0](spark, SF).count() > 0


def test_repeated_ids_and_long_texts_are_bounded(spark, monkeypatch):
    """The fit gets one row per id and label, and no text over the bound; scores are given to every row all the same."""
    monkeypatch.setattr(quality, "TRAIN_CHARS", 2000)
    docs, labels = corpus(spark, 200)
    more = docs.unionByName(docs).unionByName(spark.createDataFrame([(1, "the river " * 5000)], docs.schema))
    assert quality.score(more, quality.train(more, labels)).count() == 401
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, starts, y: (seen.append(len(y)), fit(rows, starts, y))[1])
    quality.train(more, labels.unionByName(labels))
    assert seen[0] <= 200
