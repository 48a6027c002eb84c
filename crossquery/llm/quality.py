"""Quality: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of ``PASSAGE`` characters (the last may be shorter); every passage
of the whole text is encoded: what it says, as signed counts of its lower-cased character 4-grams in ``GRAMS`` slots
and of its words in ``WORDS``; and how, as shares of character classes, of class changes, and of repetition within
the passage and with the document's earlier passages; through a learned tanh layer. Gated attention
a_k ~ exp(w . (tanh(V h_k) * sigmoid(U h_k))), learned from document labels alone, weighs the
passages, and a logistic layer scores the weighted representation. A document's features and score do
not depend on the documents that share its batch.

Null and empty texts have one passage without characters, scored like any other. One row in, one
row out, also for repeated rows, which score alike; nothing is ranked, so there are no ties. No rows give none; extra
columns are ignored. Without labelled rows of both classes every score is 0.5, so ``predicted`` is 1 and ``keep`` keeps all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, held_out, keep_rows, mix, release_held, table
from .learning import Adam, code_points, in_parts, labelled_sample, sigmoid

PASSAGE = 400
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: Characters with a class of their own; the others are lower case, upper case, digits, other space, other.
ALONE = " \n.,!?*#$%&|\"'-:;/@<>=_(){}[]~^+\\"
_LOWER, _UPPER, _DIGIT, _SPACE, _OTHER = range(len(ALONE), len(ALONE) + 5)
CLASSES = len(ALONE) + 5
GRAMS, WORDS = 32, 32
#: What passages say has many more, noisier features than how they say it, so each counts for less.
SAID = 0.25
FEATURES = 2 * CLASSES + 6 + GRAMS + WORDS


def _class_table() -> np.ndarray:
    out = np.full(1 << 16, _OTHER, np.uint8)
    for c in range(1 << 16):
        x = chr(c)
        out[c] = _LOWER if x.islower() else _UPPER if x.isupper() else _DIGIT if x.isdigit() else _SPACE if x.isspace() else _LOWER if x.isalpha() else _OTHER
    for k, x in enumerate(ALONE):
        out[ord(x)] = k
    return out


_TABLE = _class_table()


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and the document of each."""
    codes, ends = code_points(texts)
    sizes = np.diff(ends)
    n_passages = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(n_passages)])
    total = int(first[-1])
    document = np.repeat(np.arange(len(texts)), n_passages)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    own = first[owner] + (np.arange(len(codes)) - ends[owner]) // PASSAGE
    kind = _TABLE[np.minimum(codes, 0xFFFF)].astype(np.int64)
    length = np.bincount(own, minlength=total).astype(np.float64)
    over = 1 / np.maximum(length, 1)[:, None]
    shares = np.bincount(own * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES) * over
    after = np.zeros((total, CLASSES))
    if len(codes) > 1:  # classes that follow letters
        letter = ((kind[:-1] == _LOWER) | (kind[:-1] == _UPPER)) & (owner[1:] == owner[:-1])
        after = np.bincount((own[1:] * CLASSES + kind[1:])[letter], minlength=total * CLASSES).reshape(total, CLASSES) * over
    extra = np.zeros((total, 6))
    extra[:, 0] = np.log1p(length) / 6
    extra[:, 1] = (np.log1p(sizes) / 10)[document]
    for k, n in enumerate((8, 32)):  # repeated n-grams: in the passage's document so far
        if len(codes) >= n:
            hashed = codes.astype(np.uint64)
            width = 1
            while width < n:  # doubling: the hash of 2w characters from two of w
                hashed = hashed[:-width] * np.uint64(0x9E3779B97F4A7C15) + (hashed[width:] ^ (hashed[width:] >> np.uint64(29)))
                width *= 2
            at = np.flatnonzero(owner[: len(hashed)] == owner[n - 1 :])
            if n == 32:
                at = at[(at == ends[owner[at]]) | (kind[at - 1] == 1)]  # starts of lines
            key = (hashed[at] * np.uint64(0xBF58476D1CE4E5B9)) ^ (owner[at].astype(np.uint64) * np.uint64(0x94D049BB133111EB))
            _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            again = counts[inverse] > 1
            seen = np.bincount(own[at], minlength=total)
            extra[:, 2 + k] = np.bincount(own[at], again, total) / np.maximum(seen, 1)
            extra[:, 4 + k] = (np.bincount(document[own[at]], again, len(texts)) / np.maximum(np.bincount(document[own[at]], minlength=len(texts)), 1))[document]
    low = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint64)
    return np.hstack([np.sqrt(shares), np.sqrt(after), extra, *_said(low, owner, own, total)]), document


def _said(low: np.ndarray, owner: np.ndarray, own: np.ndarray, total: int) -> list[np.ndarray]:
    """Signed counts, by slot, of each passage's character 4-grams and words (those that begin there), over the root of their number."""
    step = np.uint64(0x9E3779B97F4A7C15)
    grams, width = low, 1
    while width < 4:
        grams = grams[:-width] * step + (grams[width:] ^ (grams[width:] >> np.uint64(29)))
        width *= 2
    at = np.flatnonzero(owner[: len(grams)] == owner[3:]) if len(low) > 3 else np.zeros(0, np.int64)
    out = [_slots(grams[at], own[at], total, GRAMS)]
    # words: runs of anything but white space; the sum of their characters' hashes, each by its place in the word
    inside = (low > 32) & (low != 160)
    new = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(low) else np.zeros(0, bool)
    start = np.flatnonzero(inside & (new | ~np.concatenate([[False], inside[:-1]]))) if len(low) else np.zeros(0, np.int64)
    if not len(start):
        return [*out, np.zeros((total, WORDS))]
    word = np.cumsum(np.bincount(start, minlength=len(low))) - 1
    place = np.arange(len(low)) - start[np.maximum(word, 0)]
    hashed = mix(low * step + place.astype(np.uint64))
    hashed[~inside] = 0
    return [*out, _slots(np.add.reduceat(hashed, start), own[start], total, WORDS)]


def _slots(hashed: np.ndarray, own: np.ndarray, total: int, size: int) -> np.ndarray:
    hashed = mix(hashed)
    sign = np.where(hashed & np.uint64(1), 1.0, -1.0)
    slot = (hashed >> np.uint64(40)).astype(np.int64) % size
    sums = np.bincount(own * size + slot, sign, minlength=total * size).reshape(total, size)
    return sums / np.sqrt(np.maximum(np.bincount(own, minlength=total), 1))[:, None]


def in_order(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, added up in one order whatever the number of rows, so that a row's result does not depend on the others."""
    out = np.zeros((len(x), w.shape[1]))
    for k in range(len(w)):
        out += x[:, k : k + 1] * w[k]
    return out


class Model:
    """Gated attention over tanh-encoded passages, trained by full-batch Adam."""

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        shape = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.e, self.eb = shape(FEATURES, hidden), np.zeros(hidden)
        self.v, self.u, self.w = shape(hidden, gate), shape(hidden, gate), shape(gate, 1)[:, 0]
        self.c, self.cb = shape(hidden, 1)[:, 0], np.zeros(1)
        self.mean, self.std = np.zeros(FEATURES), np.ones(FEATURES)
        self.trained = False

    def _forward(self, x, document, n, times=np.matmul):
        h = np.tanh(times(x, self.e) + self.eb)
        t, g = np.tanh(times(h, self.v)), sigmoid(times(h, self.u))
        a = times(t * g, self.w[:, None])[:, 0]
        top = np.full(n, -np.inf)
        np.maximum.at(top, document, a)
        a = np.exp(a - top[document])
        a /= np.bincount(document, a, n)[document]
        starts = np.flatnonzero(np.diff(document, prepend=-1))
        z = np.add.reduceat(a[:, None] * h, starts)
        return h, t, g, a, z, starts

    def fit(self, texts: list[str], labels: np.ndarray, steps: int = 200, decay: float = 1e-4) -> Model:
        if len(set(labels.tolist())) < 2:
            return self
        x, document, first = [], [], 0
        for part in in_parts(texts, 1 << 20):
            a, b = passages(part)
            x.append(a)
            document.append(b + first)
            first += len(part)
        x, document = np.concatenate(x), np.concatenate(document)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        self.std[-GRAMS - WORDS :] /= SAID
        x = np.clip((x - self.mean) / self.std, -8, 8)
        n = len(texts)
        share = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
        weights = [self.e, self.eb, self.v, self.u, self.w, self.c, self.cb]
        optimiser = Adam(weights, 0.01)
        for _ in range(steps):
            h, t, g, a, z, _ = self._forward(x, document, n)
            d = (sigmoid(z @ self.c + self.cb[0]) - labels) * share
            dz = d[:, None] * self.c
            da = (dz[document] * h).sum(1)
            da = a * (da - np.bincount(document, a * da, n)[document])  # through the softmax
            dt, dg = da[:, None] * self.w * g * (1 - t * t), da[:, None] * self.w * t * g * (1 - g)
            dh = (a[:, None] * dz[document] + dt @ self.v.T + dg @ self.u.T) * (1 - h * h)
            gradients = [x.T @ dh, dh.sum(0), h.T @ dt, h.T @ dg, (t * g).T @ da, z.T @ d, np.array([d.sum()])]
            optimiser.update([q + decay * p for p, q in zip(weights, gradients, strict=True)])
        self.trained = True
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.trained:
            return np.full(len(texts), 0.5)
        out = [np.zeros(0)]
        for part in in_parts(texts, 1 << 17):
            x, document = passages(part)
            z = self._forward(np.clip((x - self.mean) / self.std, -8, 8), document, len(part), in_order)[4]
            out.append(sigmoid(in_order(z, self.c[:, None])[:, 0] + self.cb[0]))
        return np.concatenate(out)


def fit(sample: list[tuple[int, str, int]]) -> Model:
    return Model().fit([x[1] for x in sample], np.array([x[2] for x in sample]))


def score(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a few KB

    def make():
        model = shared.value
        release_held()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = model.score([x.as_py() or "" for x in batch.column(2)])
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return one

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, make, SCHEMA)


def keep(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents, with all their columns, of at least this score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        release_held()
        return lambda texts: shared.value.score(texts) >= threshold

    return keep_rows(documents, make)


def train(spark: SparkSession, sf_dir: str, per_class: int = 800) -> Model:
    return fit(labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", per_class))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), train(spark, sf_dir))
