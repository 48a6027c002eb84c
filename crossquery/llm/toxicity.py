"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of lower-cased character n-grams (``SIZES``) in a document, hashed to
``1 << BITS`` slots. From a bounded labelled sample come each slot's log-count ratio
r = log((p / |p|) / (q / |q|)) of smoothed document counts, and a logistic regression over r * x.
The ``max_features`` slots of largest |r| * sqrt(count) stay. A document's score is the sigmoid of
bias + sum of weights of the features it holds anywhere in its whole text.

Null and empty texts hold no feature and score the bias. One row in, one row out, also for repeated rows, which score
alike; of slots of equal rank the smaller number stays. No rows give none; extra columns are ignored. With labelled rows
of one class only every score is that class's (sigmoid of -4 or 4); without any it is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, held_out, release_held, table
from .learning import Adam, code_points, in_parts, labelled_sample, sigmoid

SIZES, BITS = (4, 6, 8), 20
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def slots(texts: list[str], bits: int = BITS):
    """For each n-gram size: the document and the slot of every n-gram that lies within one text."""
    codes, ends = code_points([f" {t.lower()} " for t in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends))
    codes = np.where((codes >= 9) & (codes <= 13), np.uint32(32), codes)
    hashed = codes * np.uint32(0x9E3779B1)
    for n in range(2, max(SIZES) + 1):
        hashed = hashed[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in SIZES and len(hashed) > 0:
            inside = owner[: len(hashed)] == owner[n - 1 :]
            mixed = hashed ^ (hashed >> np.uint32(15))
            yield owner[: len(hashed)][inside], ((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits))[inside]


@dataclass
class Model:
    """feature: slot -> number of its feature, or -1; weight: of each feature."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        out = []
        for part in in_parts(texts, 1 << 17):
            held = np.zeros((len(part), len(self.weight) + 1), bool)
            for owner, slot in slots(part):
                held[owner, self.feature[slot]] = True  # -1 is the last column
            out.append(held[:, :-1].astype(np.float32) @ self.weight + self.bias)
        return sigmoid(np.concatenate(out).astype(np.float64)) if out else np.zeros(0)


def fit(sample: list[tuple[int, str, int]], max_features: int = 4096, steps: int = 150, decay: float = 1e-3) -> Model:
    labels = np.array([x[2] for x in sample])
    none = Model(np.full(1 << BITS, -1, np.int32), np.zeros(0, np.float32), 0.0)
    if len(set(labels)) < 2:
        return none if not len(labels) else Model(none.feature, none.weight, -4.0 if labels[0] == 0 else 4.0)
    docs, kinds, first = [], [], 0
    for part in in_parts([x[1] for x in sample], 1 << 20):
        pairs = np.unique(np.concatenate([(o.astype(np.int64) << BITS) | s for o, s in slots(part)]))
        docs.append(((pairs >> BITS) + first).astype(np.int32))
        kinds.append((pairs & ((1 << BITS) - 1)).astype(np.int32))
        first += len(part)
    docs, kinds = np.concatenate(docs), np.concatenate(kinds)
    counts = [np.bincount(kinds[labels[docs] == k], minlength=1 << BITS).astype(float) for k in (0, 1)]
    both = counts[0] + counts[1]
    ratio = np.log(((1 + counts[1]) / (1 + counts[1]).sum()) / ((1 + counts[0]) / (1 + counts[0]).sum()))
    rank = np.where(both >= 3, np.abs(ratio) * np.sqrt(both), 0)
    chosen = np.sort(np.argsort(-rank, kind="stable")[: min(max_features, int((rank > 0).sum()))])
    feature = np.full(1 << BITS, -1, np.int32)
    feature[chosen] = np.arange(len(chosen))
    own = feature[kinds] >= 0
    docs, kinds = docs[own], feature[kinds[own]]
    scaled = ratio[chosen]
    weight, bias = np.ones(len(chosen)) * 0.01, np.zeros(1)
    optimiser = Adam([weight, bias], 0.02)
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    for _ in range(steps):
        z = np.bincount(docs, (weight * scaled)[kinds], len(labels)) + bias[0]
        error = (sigmoid(z) - labels) * share
        optimiser.update([np.bincount(kinds, error[docs], len(chosen)) * scaled + decay * weight, np.array([error.sum()])])
    return Model(feature, (weight * scaled).astype(np.float32), float(bias[0]))


def score(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 4 MB at most: bounded by BITS and max_features

    def make():
        model = shared.value
        release_held()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = model.score([x.as_py() or "" for x in batch.column(2)])
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return one

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, make, SCHEMA)


def query(spark: SparkSession, sf_dir: str, per_class: int = 800) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(labelled_sample(documents, table(spark, sf_dir, "labels"), "toxic", per_class)))
