import zlib

import numpy as np

from tests.llm.helpers import SCHEMA, frame, odd_rows
from tidemark.llm import mil


def test_gradients_are_those_of_finite_differences():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, mil.FEATURES)) for n in (1, 4, 7)]
    label = np.array([0.0, 1.0, 1.0])
    model = mil.fit([b.astype(np.float32) for b in bags], label)
    owner = np.repeat(np.arange(3), [1, 4, 7])

    def loss():
        p = model.forward(np.concatenate(bags), owner, 3)["p"]
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    for w in model.weights.values():
        w *= 0.3
    gradients = model.gradients(model.forward(np.concatenate(bags), owner, 3), owner, label)
    for name, g in gradients.items():
        w = model.weights[name].reshape(-1)
        for k in rng.integers(0, len(w), 4):
            old = w[k]
            w[k] = old + 1e-5
            up = loss()
            w[k] = old - 1e-5
            down = loss()
            w[k] = old
            assert abs((up - down) / 2e-5 - g.reshape(-1)[k]) < 1e-6


def test_attention_weights_sum_to_one_in_each_bag():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, mil.FEATURES)).astype(np.float32) for n in (2, 5)]
    model = mil.fit(bags, np.array([0.0, 1.0]))
    weight = model.forward(np.concatenate(bags), np.array([0, 0, 1, 1, 1, 1, 1]), 2)["weight"]
    assert np.allclose([weight[:2].sum(), weight[2:].sum()], 1)


def test_held_out_documents_are_classified(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = {r.doc_id: r for r in mil.classify(docs, labels).collect()}
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in out.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    held = [(out[r.doc_id].predicted, r.quality) for r in labels.collect() if out[r.doc_id].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    bags, y = mil.training_bags(docs, labels, most=50)
    assert len(bags) == len(y) == 50


def test_labels_of_held_out_rows_are_never_read(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", (mil.held_out(labels.doc_id).cast("int") + labels.quality) % 2)
    score = lambda x: sorted(map(tuple, mil.classify(docs, x).collect()))
    assert score(labels) == score(turned)


def test_odd_rows_and_missing_labels(spark):
    docs = frame(spark, odd_rows())
    none = spark.createDataFrame([(1, None, 0), (2, 7, 0), (3, 0, 0), (3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in mil.classify(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(k, k % 2, 0) for k in range(12)], "doc_id long, quality int, toxic int")
    assert mil.classify(docs, some).count() == docs.count()
    assert mil.classify(spark.createDataFrame([], SCHEMA), some).count() == 0


def test_repeats_of_a_labelled_id_and_long_texts_leave_one_bounded_bag(spark):
    long = "\n".join(f"passage {k} with some words in it and an end ." for k in range(4000))
    one, two, three = [k for k in range(50) if zlib.crc32(str(k).encode()) % 3 != 1][:3]
    rows = [(one, "a short text of one passage")] * 5000 + [(one, "another text of the same id"), (two, long), (three, "good words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    bags, y = mil.training_bags(docs, spark.createDataFrame([(one, 0), (two, 1), (three, 1)], "doc_id long, quality int"))
    assert y.tolist() == [0, 1, 1] and [len(b) for b in bags][1] == mil.TRAIN_PASSAGES and max(map(len, bags)) <= mil.TRAIN_PASSAGES
