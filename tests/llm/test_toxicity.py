import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.conftest import words
from tidemill.llm import queries, toxicity
from tidemill.llm._common import gram_hashes, hash_strings, mix64

LABELS = "doc_id long, toxic int, quality int"


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = queries.op7_toxicity(spark, d).collect()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"] and r["doc_id"] in label]
    assert np.mean([r["predicted"] == label[r["doc_id"]] for r in held]) >= 0.9


def test_unseen_misspellings_share_vectors():
    clean = [words(k, 60) for k in range(300)]
    toxic = [" ".join([*w[:20], ["horrible", "worthless", "pathetic"][k % 3], *w[20:], "disgusting"]) for k, w in ((k, words(1000 + k, 60).split()) for k in range(150))]
    model = toxicity.train(clean + toxic, np.array([0] * 300 + [1] * 150), {0: 1.0, 1: 1.0}, buckets=1 << 16)
    score = lambda text: toxicity.scores(model, pa.array([text]))[0]
    new = [words(5000 + k, 60).split() for k in range(40)]
    misspelt = [" ".join([*w[:30], ["horribble", "worthlesss", "pathetiic"][k % 3], "disgustingg", *w[30:]]) for k, w in enumerate(new)]
    assert np.mean([score(" ".join(w)) < 0.5 for w in new]) >= 0.95
    assert np.mean([score(t) >= 0.5 for t in misspelt]) >= 0.9


def test_same_inputs_same_model():
    texts, y = [words(k, 20) for k in range(40)], np.array([0, 1] * 20)
    a, b = (toxicity.train(texts, y, {0: 1.0, 1: 1.0}, buckets=1 << 12, epochs=2) for _ in range(2))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def plain_features(word, buckets):
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in range(3, 7) for i in range(len(marked) - n + 1)]
    hashes = [int(mix64(hash_strings(pa.array([word])))[0]), *(int(h) for h in gram_hashes(grams))]
    return [h % buckets for h in hashes]


def plain_words(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def test_scores_against_a_plain_loop():
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(size=512).astype(np.float32) * 30, -0.2, 100.0)
    texts = ["one Two, two!", "", None, "x1 été-naïve", words(3, 200), "!!"]
    for text, got in zip(texts, toxicity.scores(model, pa.array(texts)), strict=True):
        features = [f for w in plain_words(text) for f in plain_features(w, 512)]
        odds = sum(float(model.weights[f]) for f in features) / (len(features) + model.blank) + model.bias
        assert np.isclose(got, 1 / (1 + np.exp(-odds)))


def test_training_against_a_plain_loop():
    """The same steps with one dense row of feature counts for each document."""
    texts = [" ".join(words(k, 12).split() + ["bad"] * (k % 3 == 0)) for k in range(20)] + [None, "a a a b"]
    toxic = np.array([int(k % 3 == 0) for k in range(20)] + [0, 1])
    weights, buckets, size, epochs, rate, gain, blank, batch, seed = {0: 1.0, 1: 2.0}, 300, 3, 3, 0.3, 30.0, 100.0, 8, 7
    got = toxicity.train(texts, toxic, weights, buckets, size, epochs, rate, gain, blank, batch, seed)
    kept = [k for k, t in enumerate(texts) if plain_words(t)]
    counts = np.array([np.bincount([f for w in plain_words(texts[k]) for f in plain_features(w, buckets)], minlength=buckets) for k in kept], float)
    shares = counts * (gain / (counts.sum(axis=1, keepdims=True) + blank))
    y = toxic[kept]
    importance = np.array([weights[c] for c in y])
    importance /= importance.mean()
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.01, (buckets, size))
    layer, bias = rng.normal(0, 0.5, (size, 2)), np.zeros(2)
    seen, seen_layer, seen_bias = np.full(buckets, 1e-6), 1e-6, 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            chosen = order[at : at + batch]
            means = shares[chosen] @ table
            logits = means @ layer + bias
            slope = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
            slope[np.arange(len(chosen)), y[chosen]] -= 1
            slope *= (importance[chosen] / len(chosen))[:, None]
            change = shares[chosen].T @ (slope @ layer.T)
            on = counts[chosen].any(axis=0)
            seen[on] += (change[on] ** 2).mean(axis=1)
            table[on] -= rate * change[on] / np.sqrt(seen[on])[:, None]
            change_layer, change_bias = means.T @ slope, slope.sum(axis=0)
            seen_layer += (change_layer**2).mean()
            seen_bias += (change_bias**2).mean()
            layer = layer - rate / np.sqrt(seen_layer) * change_layer
            bias = bias - rate / np.sqrt(seen_bias) * change_bias
    want = table @ (layer[:, 1] - layer[:, 0]) * gain
    assert np.allclose(got.weights, want, rtol=0.02, atol=0.02 * np.abs(want).max())
    assert np.isclose(got.bias, bias[1] - bias[0], atol=0.01)


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, words(k, 50)) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], LABELS)
    texts, toxic, _ = toxicity.sample(docs, labels, (8, 5), 10**6)
    assert (toxic == 0).sum() == 8 and (toxic == 1).sum() == 5
    few, _, weights = toxicity.sample(docs, labels, (8, 5), 1000)
    assert 0 < sum(len(t.as_py()) for t in few) <= 1000 and all(w > 0 for w in weights.values())


def test_messy(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, 1), (None, 1, 0), (7, 0, 0), (9, 1, 1), (3, 1, 0), (4, 0, 0)], LABELS)
    got = toxicity.classify(messy, labels, buckets=1 << 12, epochs=2).collect()
    assert len(got) == messy.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by[1]) == 1 and by[3] == by[4] == by[5]
    assert not [r for r in got if r["doc_id"] is None and r["held_out"]]
    assert toxicity.classify(empty, labels).count() == 0
    constant = toxicity.classify(messy, labels.limit(0)).collect()
    assert len({r["score"] for r in constant}) == 1


def test_labels_of_held_out_documents_are_not_used(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(toxicity.in_training(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (toxicity.classify(docs, x, epochs=2).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


def test_accepted(messy):
    model = toxicity.Model(np.zeros(64, np.float32), 3.0, 100.0)
    assert toxicity.accepted(messy, model).count() == 0
    model = toxicity.Model(np.zeros(64, np.float32), -3.0, 100.0)
    kept = toxicity.accepted(messy, model)
    assert kept.columns == messy.columns and kept.count() == messy.count()
