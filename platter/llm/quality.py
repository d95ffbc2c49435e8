"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text, hashed into 2^18 places: words and pairs of words as written, their shapes (classes of characters, runs
shortened) alone, in pairs and in threes, and how often five-word windows and words repeat what stands before them. A place's value is the logarithm
of one more than its count, and a text's vector has length one, so scores do not depend on length.

Training takes a bounded sample of labelled rows (MAX_TRAIN, by a hash of the id), dealt to SHARDS groups that are trained
side by side; their weights are averaged. Each update touches the places of one text only. A score is the logistic function
of one sparse dot product with the averaged weights, a fixed 1 MB.

Defined results: null and empty texts have no features and score the bias; labels that are null are not used; a row
labelled twice counts with its lower label; repeated rows are scored each; without labels of both kinds every score is 0.5.
Only the text enters a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platter.llm.common import utf8

BITS = 18
SIZE = 1 << BITS
MAX_TRAIN = 20_000
SHARDS = 4
EPOCHS = 3
#: Words whose hashes a task remembers.
_REMEMBERED = 500_000

_SHAPE = bytes(ord("a") if chr(b).islower() and b < 128 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("9") if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1\1+", re.DOTALL)


class Features:
    """Texts to (places, values)."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int]] = {}

    def __missing(self, words: list[bytes]) -> None:
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        for word in set(words).difference(self.known):
            shape = _RUNS.sub(rb"\1\1", word.translate(_SHAPE))
            self.known[word] = xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest(shape, 1)

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.float64)
        self.__missing(words)
        pairs = np.array([self.known[w] for w in words], np.uint64)
        word, shape = pairs[:, 0], pairs[:, 1]
        m = np.uint64(0x9E3779B97F4A7C15)
        grams = [word, word[:-1] * m + word[1:], shape, shape[:-1] * m + shape[1:], (shape[:-2] * m + shape[1:-1]) * m + shape[2:]]
        places, counts = np.unique(np.concatenate(grams) >> np.uint64(64 - BITS), return_counts=True)
        values = np.log1p(counts)
        values /= np.sqrt(values @ values)
        five = word.copy()
        for k in range(1, 5):
            five = five[:-1] * m + word[k:]
        again = [1 - len(np.unique(five)) / max(1, len(five)), float((word[1:] == word[:-1]).mean()) if len(word) > 1 else 0.0]
        own = [i for i, x in enumerate(again) if x > 0]
        return np.concatenate([places.astype(np.int64), [SIZE + i for i in own]]).astype(np.int64), np.concatenate([values, [again[i] for i in own]])


#: Hashed places, two for repetition, the bias.
WIDTH = SIZE + 3
_BIAS = SIZE + 2


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> np.ndarray:
    """Weights after per-coordinate follow-the-regularised-leader passes over the examples."""
    z, n = np.zeros(WIDTH), np.zeros(WIDTH)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for places, values, label in examples:
            at, x = np.append(places, _BIAS), np.append(values, 1.0)
            w = weights(at)
            gradient = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            squared = gradient * gradient
            z[at] += gradient - (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / alpha * w
            n[at] += squared
    return weights(np.arange(WIDTH))


def held_out(id_column) -> object:
    """crc32 of the id as text has the remainder 1 by 3."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        rows = [features(t) for t in utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("doc_id"), batch.column("label"), pa.array([p.astype(np.int32).tobytes() for p, _ in rows], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in rows], pa.binary())], ["shard", "doc_id", "label", "places", "vals"])


def _train(group: pd.DataFrame) -> pd.DataFrame:
    # Ids alone would bring what happens to be stored together one after another.
    order = sorted(range(len(group)), key=lambda i: xxhash.xxh64_intdigest(str(group.doc_id.iloc[i])))
    examples = [(np.frombuffer(group.places.iloc[i], np.int32).astype(np.int64), np.frombuffer(group.vals.iloc[i], np.float32).astype(float), int(group.label.iloc[i])) for i in order]
    return pd.DataFrame({"weights": [ftrl(examples, EPOCHS).astype(np.float32).tobytes()]})


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Averaged weights; of labels only the rows given are used."""
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label")).filter("_label IN (0, 1)")
    n = known.count()
    if n > MAX_TRAIN:
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * MAX_TRAIN / n))
    # At most about MAX_TRAIN pairs of numbers, so the broadcast is bounded.
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(F.broadcast(known), F.col("_doc") == F.col("_id"))
    rows = rows.select(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(SHARDS)).cast("int").alias("shard"), F.col("_id").cast("bigint").alias("doc_id"), F.col("_label").cast("int").alias("label"), "text")
    examples = rows.mapInArrow(_examples, "shard int, doc_id bigint, label int, places binary, vals binary")
    found = [np.frombuffer(r.weights, np.float32) for r in examples.groupBy("shard").applyInPandas(_train, "weights binary").collect()]
    return np.mean(found, axis=0) if found else np.zeros(WIDTH, np.float32)


def scorer(spark, weights: np.ndarray):
    """Column function: the score of a text."""
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        features, w = Features(), shared.value
        out = []
        for text in utf8(texts):
            places, values = features(text)
            out.append(1 / (1 + np.exp(-np.clip(float(w[places] @ values) + float(w[_BIAS]), -35, 35))))
        return pa.array(out, pa.float64())

    return score
