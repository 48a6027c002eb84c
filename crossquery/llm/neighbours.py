"""Approximate nearest neighbours by stable projections under a kd-tree with a chi-square stopping test.

Largest inner product is made nearest Euclidean neighbour: with M the largest norm, a row x becomes
(x, sqrt(M^2 - |x|^2)) and a query (q, 0), so |x' - q'|^2 = |q|^2 + M^2 - 2 q.x. Gaussian (2-stable)
projections to ``PROJECTED`` dimensions then follow: a point at distance D is projected to a squared
distance D^2 * chi-square(PROJECTED). A query takes projected neighbours in order from a kd-tree, verifies
them on the original vectors, and stops once the next one's squared projected distance is over
t * d_k^2, d_k being the k-th best distance so far and t the chi-square quantile of ``confidence``: any
point nearer than d_k would have been met before with that probability.

Spread over a cluster: the top of the kd-tree is cut from the projections of a bounded sample
(``sample`` rows of smallest id hash); each cell's rows, in parts of about ``shard_rows``, are a shard with
its own tree below. A query first gets its d_k from the sample, so it is sent only to cells within reach of the
stopping radius; the sample's k best count as verified. Rows go to shards that have queries, and are repeated only there
for each ``query_block`` of these. Every row is indexed. Vectors whose cells coincide are split by id, so equal vectors never gather.

In a shard a query opens leaves in order of their distance, and verifies what the test leaves of one; queries that open the
same leaf are multiplied together, and what can be among the k best is computed anew in an order that nothing else changes.

Vectors that are null, zero, or hold null or non-finite components, and rows without an id, take no part,
neither as queries nor as candidates; nor do vectors of another length than most of the sample have.
An id that repeats names several candidates; each is another row than a query of the same id
only if its id differs. No rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, sliced, table
from .sets import grouped
from .vectors import dot, matrix

PROJECTED = 8
SCHEMA = "query_id long, vec_id long, score double"


def chi_square_quantile(p: float, k: int = PROJECTED) -> float:
    """By bisection; for an even number of degrees the distribution has a closed form."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def kd_boxes(points: np.ndarray, leaves: int) -> tuple[list, np.ndarray]:
    """Splits (dimension, value, left, right; a leaf is its number) of about ``leaves`` cells, and the cells' boxes."""
    nodes: list = []
    boxes: list = []

    def grow(own: np.ndarray, want: int, box: np.ndarray) -> int:
        me = len(nodes)
        nodes.append(None)
        spread = points[own].max(0) - points[own].min(0) if len(own) else np.zeros(points.shape[1])
        axis = int(np.argmax(spread))
        value = float(np.median(points[own, axis])) if len(own) else 0.0
        left = own[points[own, axis] < value] if len(own) else own
        if want <= 1 or len(own) < 4 or spread[axis] <= 0 or not 0 < len(left) < len(own):
            nodes[me] = len(boxes)
            boxes.append(box)
            return me
        right = own[points[own, axis] >= value]
        low, high = box.copy(), box.copy()
        low[1, axis], high[0, axis] = value, value
        nodes[me] = (axis, value, grow(left, want // 2, low), grow(right, want - want // 2, high))
        return me

    box = np.array([[-np.inf], [np.inf]]).repeat(points.shape[1], 1)
    grow(np.arange(len(points)), leaves, box)
    return nodes, np.array(boxes)


def cells_of(nodes: list, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    stack = [(0, np.arange(len(points)))]
    while stack:
        node, own = stack.pop()
        if isinstance(nodes[node], int):
            out[own] = nodes[node]
            continue
        axis, value, left, right = nodes[node]
        go = points[own, axis] < value
        stack += [(left, own[go]), (right, own[~go])]
    return out


def box_distances(boxes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of projected queries from boxes: queries x boxes."""
    out = np.zeros((len(q), len(boxes)))
    for axis in range(q.shape[1]):
        below = boxes[None, :, 0, axis] - q[:, None, axis]
        above = q[:, None, axis] - boxes[None, :, 1, axis]
        out += np.maximum(np.maximum(below, above), 0) ** 2
    return out


class Model:
    """Projection, largest norm, the top of the tree, and the sample that gives first distances."""

    def __init__(self, dims: int, largest: float, k: int, confidence: float, sample_ids: np.ndarray, sample: np.ndarray, cells: int, salts: int, seed: int = 11):
        self.dims, self.largest, self.k = dims, largest, k
        self.reach = chi_square_quantile(confidence)
        self.axes = np.random.default_rng(seed).normal(size=(dims + 1, PROJECTED))
        self.sample_ids, self.sample, self.salts = sample_ids, sample, salts
        self.nodes, self.boxes = kd_boxes(self.project(sample), cells)

    def project(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        out = x @ self.axes[:-1]
        if not query:
            out += np.sqrt(np.maximum(self.largest - dot(x, x), 0))[:, None] * self.axes[-1]
        return out

    def squared(self, norm: np.ndarray, score: np.ndarray) -> np.ndarray:
        return np.maximum(norm + self.largest - 2 * score, 0)

    def sample_tree(self) -> Shard:
        if not hasattr(self, "_tree"):
            self._tree = Shard(self, self.sample_ids, self.sample)
        return self._tree

    def first(self, ids: np.ndarray, q: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """The k best in the sample (queries' places, ids, scores), and the squared distance of each query's k-th, infinite if there are fewer."""
        place, found, scores = self.sample_tree().search(ids, q, np.full(len(q), np.inf))
        out, n = np.full(len(q), np.inf), np.bincount(place, minlength=len(q))
        full = np.flatnonzero(n >= self.k)
        out[full] = self.squared(dot(q, q)[full], scores[np.cumsum(n)[full] - 1]) * (1 + 1e-9)
        return (place, found, scores), out


class Shard:
    """A kd-tree over projections of its rows, searched in order of projected distance."""

    LEAF = 512

    def __init__(self, model: Model, ids: np.ndarray, x: np.ndarray):
        self.model = model
        p = model.project(x)
        leaves: list[np.ndarray] = []
        stack = [np.arange(len(p))]
        while stack:
            own = stack.pop()
            if len(own) <= self.LEAF:
                leaves.append(own)
                continue
            axis = int(np.argmax(p[own].max(0) - p[own].min(0)))
            own = own[np.argpartition(p[own, axis], len(own) // 2)]  # halves, whatever ties there are
            stack += [own[len(own) // 2 :], own[: len(own) // 2]]
        order = np.concatenate(leaves)
        self.ids, self.x, self.p = ids[order], x[order], p[order]
        self.squares = dot(self.p, self.p)
        self.ends = np.cumsum([0, *map(len, leaves)])
        self.boxes = np.stack([np.minimum.reduceat(self.p, self.ends[:-1]), np.maximum.reduceat(self.p, self.ends[:-1])], 1) if len(p) else np.zeros((0, 2, PROJECTED))

    def search(self, me: np.ndarray, q: np.ndarray, first: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, ids and scores of the k nearest found of each, nearest first; ``first``: squared distances that k rows are known to be within."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for low in range(0, len(q) if len(self.ids) else 0, block):
            place, ids, scores = self._search(*(v[low : low + block] for v in (me, q, first)))
            out.append((place + low, ids, scores))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _search(self, me, q, first):
        model, k, n = self.model, self.model.k, len(q)
        projected, norm, d_k = model.project(q, True), dot(q, q), first.copy()
        bounds = box_distances(self.boxes, projected)
        leaves = np.argsort(bounds, axis=1, kind="stable")
        # a score below this is not among the k best, or not known to be; products of matrices round otherwise than dot()
        slack = 1e-9 * np.sqrt(norm * model.largest)
        least = np.where(np.isfinite(d_k), (norm + model.largest - d_k) / 2, -np.inf)
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        alive = np.arange(n)
        for step in range(leaves.shape[1]):
            leaf = leaves[alive, step]
            go = bounds[alive, leaf] <= model.reach * d_k[alive]
            alive, leaf = alive[go], leaf[go]  # leaves come in order, so the test holds for all that follow
            if not len(alive):
                break
            order = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[order], prepend=-1, append=len(bounds[0])))
            new = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                own, rows = alive[order[a:b]], slice(self.ends[leaf[order[a]]], self.ends[leaf[order[a]] + 1])
                left = (q[own] @ self.x[rows].T) >= (least - slack)[own][:, None]
                at, row = np.nonzero(left)
                at, row = own[at], row + rows.start
                near = ((self.p[row] - projected[at]) ** 2).sum(1) <= model.reach * d_k[at] * (1 + 1e-9)
                near &= self.ids[row] != me[at]
                at, row = at[near], row[near]
                new.append((at, self.ids[row], dot(self.x[row], q[at])))
            best = self._best(k, best, *new)
            counts = np.bincount(best[0], minlength=n)
            full = np.flatnonzero(counts >= k)
            kth = best[2][np.cumsum(counts)[full] - 1]
            least[full] = np.maximum(least[full], kth)
            d_k[full] = np.minimum(d_k[full], model.squared(norm[full], kth) * (1 + 1e-9))
        return best

    @staticmethod
    def _best(k: int, *found: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query in order: of largest score, then of smallest id."""
        at, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        begin = np.searchsorted(at, at)
        own = np.arange(len(at)) - begin < k
        return at[own], ids[own], scores[own]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, confidence: float = 0.95, sample: int = 4096, shard_rows: int = 16384, query_block: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest found. Both frames: vec_id long, embedding array."""
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    drawn = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    at, points = matrix(drawn.column("embedding").combine_chunks())
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(at):
        if not drawn.num_rows:
            return empty
        points = np.zeros((0, max(x for x in pc.list_value_length(drawn.column("embedding")).to_pylist())))
    dims = points.shape[1]

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = matrix(batch.column(0), dims)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([float(dot(x, x).max())]), pa.array([len(x)])], ["largest", "n"])

    total = base.select("embedding").mapInArrow(norms, "largest double, n long").agg(F.max("largest"), F.sum("n")).first()
    if not total[1]:
        return empty
    wanted = math.ceil(total[1] / shard_rows)
    cells = min(wanted, max(1, len(points) // 4))
    model = Model(dims, total[0], k, confidence, np.asarray(drawn.column("vec_id"))[at], points, cells, math.ceil(wanted / cells))
    shared = spark.sparkContext.broadcast(model)  # the sample, and at most a cell for four of its rows

    def vectors_of(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, (len(x) + 1) * dims, dims), pa.int32()), pa.array(x.ravel()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row, and its shard."""
        model = shared.value
        for batch in batches:
            at, x = matrix(batch.column(1), dims)
            ids = np.asarray(batch.column(0))[at]
            if len(ids):
                shard = cells_of(model.nodes, model.project(x)) * model.salts + ids % model.salts
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(ids), vectors_of(x)], ["shard", "id", "vector"])

    def asking(with_vectors: bool):
        """Every query, and each shard in its reach."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in sliced(batches, 500):
                at, x = matrix(batch.column(1), dims)
                ids = np.asarray(batch.column(0))[at]
                if not len(ids):
                    continue
                first = model.first(ids, x)[1]
                row, cell = np.nonzero(box_distances(model.boxes, model.project(x, True)) <= model.reach * first[:, None])
                row, salt = row.repeat(model.salts), np.tile(np.arange(model.salts), len(row))
                shard = pa.array(cell.repeat(model.salts) * model.salts + salt)
                if not with_vectors:
                    yield pa.RecordBatch.from_arrays([shard], ["shard"])
                    continue
                for low in range(0, len(row), 4096):
                    own = row[low : low + 4096]
                    yield pa.RecordBatch.from_arrays([shard.slice(low, 4096), pa.array(ids[own]), vectors_of(x[own]), pa.array(first[own])], ["shard", "id", "vector", "first"])

        return run

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            at, x = matrix(batch.column(1), dims)
            ids = np.asarray(batch.column(0))[at]
            if len(ids):
                place, near, scores = shared.value.first(ids, x)[0]
                yield pa.RecordBatch.from_arrays([pa.array(ids[place]), pa.array(near), pa.array(scores)], ["query_id", "vec_id", "score"])

    counts = cut(asked.mapInArrow(asking(False), "shard long").groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("blocks")))
    tile = lambda block: F.xxhash64("shard", block).alias("tile")
    held = base.mapInArrow(placed, "shard long, id long, vector array<double>").join(counts, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.select(tile(F.col("block")), F.lit(False).alias("query"), "id", "vector", F.lit(0.0).alias("first"))
    asks = asked.mapInArrow(asking(True), "shard long, id long, vector array<double>, first double").join(counts, "shard")
    asks = asks.select(tile(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), F.lit(True).alias("query"), "id", "vector", "first")
    dealt = held.unionByName(asks)

    def found(group: pa.Table):
        group = group.combine_chunks()
        is_query, ids = np.array(group.column(1)), np.asarray(group.column(2))
        if is_query.all() or not is_query.any():
            return None
        x = np.array(group.column(3).combine_chunks().flatten()).reshape(len(ids), dims)
        names = ids[is_query]
        place, near, scores = Shard(shared.value, ids[~is_query], x[~is_query]).search(names, x[is_query], np.asarray(group.column(4))[is_query])
        return {"query_id": pa.array(names[place]), "vec_id": pa.array(near), "score": pa.array(scores)}

    # the sample's best are verified already: with them a query has k rows wherever there are k; shards find the same rows again
    met = grouped(dealt, "tile", found, SCHEMA).withColumn("drawn", F.lit(0)).unionByName(asked.mapInArrow(sampled, SCHEMA).withColumn("drawn", F.lit(1)))
    met = met.groupBy("query_id", "vec_id", "score").agg(F.greatest(F.sum("drawn"), F.sum(1 - F.col("drawn"))).cast("int").alias("copies"))
    met = met.select("query_id", "vec_id", "score", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_")).drop("_")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k rows of each shard
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
