import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from platter.llm import quality
from platter.llm.queries import op1_quality


def corpus(n=400):
    r = random.Random(2)
    vocabulary = [a + b for a in ("tor", "mel", "shan", "de", "qui", "ro") for b in ("a", "en", "ith", "ou", "er", "ing")]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(12, 80))]
        good = i % 4 != 0
        if not good:
            words = r.choice([[w + "###" for w in words], [w.upper() + "!!" for w in words], words[:1] * 40])
        docs.append((i, " ".join(words)))
        labels.append((i, int(good)))
    return docs, labels


def test_learns_what_marks_quality(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame([*docs, (9999, None), (None, ""), (1, docs[1][1])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (5, None), (77777, 1), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op1_quality(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema][:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.collect()
    assert len(rows) == len(docs) + 3
    truth = dict(labels)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_held_out_fold(spark):
    import zlib

    rows = spark.range(50).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_bounded_sample(spark, monkeypatch):
    docs, labels = corpus(300)
    monkeypatch.setattr(quality, "MAX_TRAIN", 100)
    w = quality.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert w.shape == (quality.WIDTH,) and np.abs(w).sum() > 0


def test_no_labels(spark):
    w = quality.train(spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int"))
    docs = spark.createDataFrame([(1, "x y"), (2, None)], "doc_id long, text string")
    assert [r.s for r in docs.select(quality.scorer(spark, w)("text").alias("s")).collect()] == [0.5, 0.5]
    assert spark.createDataFrame([], "text string").select(quality.scorer(spark, w)("text")).count() == 0


@pytest.mark.parametrize("text", [b"", b" \n", b"a", "é ß 𝔸".encode(), b"x " * 100_000])
def test_features_are_a_unit_vector(text):
    places, values = quality.Features()(text)
    own = values[places < quality.SIZE]
    assert len(own) == 0 or abs(float(own @ own) - 1) < 1e-9


def test_updates_follow_the_definition():
    """Against a plain per-coordinate version of the update."""
    from math import exp, sqrt

    examples = [(np.array([1, 5]), np.array([0.6, 0.8]), 1), (np.array([5]), np.array([1.0]), 0), (np.array([1]), np.array([1.0]), 1)] * 3
    z, n = {}, {}
    for places, values, label in examples:
        x = dict(zip([*places.tolist(), quality._BIAS], [*values.tolist(), 1.0], strict=True))
        w = {i: 0.0 if abs(z.get(i, 0)) <= 0.02 else -(z[i] - (0.02 if z[i] > 0 else -0.02)) / ((1 + sqrt(n[i])) / 0.5 + 0.01) for i in x}
        g = 1 / (1 + exp(-sum(w[i] * x[i] for i in x))) - label
        for i in x:
            sigma = (sqrt(n.get(i, 0) + (g * x[i]) ** 2) - sqrt(n.get(i, 0))) / 0.5
            z[i] = z.get(i, 0) + g * x[i] - sigma * w[i]
            n[i] = n.get(i, 0) + (g * x[i]) ** 2
    got = quality.ftrl(examples, 1)
    for i in (1, 5, quality._BIAS):
        want = 0.0 if abs(z[i]) <= 0.02 else -(z[i] - (0.02 if z[i] > 0 else -0.02)) / ((1 + sqrt(n[i])) / 0.5 + 0.01)
        assert abs(got[i] - want) < 1e-12
