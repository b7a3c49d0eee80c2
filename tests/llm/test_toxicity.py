import random
import zlib

import numpy as np

from runqc.llm import toxicity as X


def corpus(n=900):
    rng = random.Random(4)
    fair = ["".join(rng.choice(["on", "er", "th", "an", "ti", "ble"]) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    foul = ["idiotic", "wretched", "scoundrel", "vermin"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        words = [rng.choice(fair) for _ in range(rng.randrange(30, 200))]
        for _ in range(4 * toxic):
            words[rng.randrange(len(words))] = rng.choice(foul)
        docs.append((i, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((i, int(toxic)))
    return docs, labels, {i for i, t in docs if any(f in t for f in foul)}


def test_held_out_accuracy(spark):
    docs, labels, toxic = corpus()
    rows = X.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == (r.doc_id in toxic) for r in held]) > 0.95
    assert np.mean([r.predicted for r in held if r.doc_id in toxic]) > 0.85


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs, labels, _ = corpus(300)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    one, other = (X.toxicity(frame, spark.createDataFrame(y, "doc_id long, toxic int")).collect() for y in (labels, turned))
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))


def test_risk_is_not_driven_below_nothing():
    rng = np.random.default_rng(0)
    truth = rng.random(800) < 0.2
    features = (rng.random((800, 20)) < np.where(truth[:, None] & (np.arange(20) < 5), 0.7, 0.1)).astype(np.float32)
    w, b = X.fit_nnpu(features[truth], features, 0.2, 0)
    assert np.mean(((features @ w + b) > 0) == truth) > 0.9


def test_odd_documents(spark, odd_docs, no_docs):
    schema = "doc_id long, toxic int"
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(40)] + [(None, 1), (3, None), (999, 1)], schema)
    rows = X.toxicity(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (100, 101, 102)}
    assert len(empty) == 1
    assert X.toxicity(no_docs, labels).collect() == []
    for none in ([], [(1, 0), (2, 0)]):
        assert {r.predicted for r in X.toxicity(odd_docs, spark.createDataFrame(none, schema)).collect()} == {0}
