"""Bounded labelled samples, and texts as code points in numpy, for the operators that learn."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int) -> list[tuple[int, str, int]]:
    """At most ``per_class`` documents of each label 0 and 1, those of smallest id hash, held-out rows never.

    Labels other than 0 and 1 are ignored; of several labels of a document the largest counts, and of
    several documents with an id the first text. The result is bounded by its parameter, so it may come
    to the driver; whole texts are taken.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_label"))
    known = known.where(F.col("_label").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("_label").alias("_label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # limits applied to whole orders: TakeOrderedAndProject, no full sort
    picked = [known.where(F.col("_label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(picked, "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    return sorted((r["doc_id"], r["text"] or "", r["_label"]) for r in found.collect())


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, one after the other, and the n + 1 offsets between them."""
    ends = np.cumsum([0, *map(len, texts)])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), ends


def in_parts(texts: list[str], limit: int) -> Iterator[list[str]]:
    """Runs of texts of at most ``limit`` characters, or one text."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > limit:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Adam:
    """The usual optimiser over a list of arrays, changed in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.step = arrays, rate, 0
        self.first = [np.zeros_like(a) for a in arrays]
        self.second = [np.zeros_like(a) for a in arrays]

    def update(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        for a, g, m, v in zip(self.arrays, gradients, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
