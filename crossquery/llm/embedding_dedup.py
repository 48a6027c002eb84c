"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A unit vector o is rotated by a random orthogonal matrix and kept as the signs of its components, a code
c with entries +-1/sqrt(D), and the factor f = <c, Ro>. For a unit vector q, <c, Rq> / f estimates <o, q>
without bias, with an error that exceeds e * sqrt((1 - f^2) / (f^2 (D - 1))) with a probability that falls
like exp(-c e^2). Pairs whose estimate plus that bound (``width`` = e) stays under the threshold are left out; all
others are recomputed exactly, in double precision, so no pair below the threshold links.

Candidates share a band: runs of code bits under one label, their number of bits following from the
label's own count (none, so all pairs, up to ``bucket`` vectors) and the number of bands from the
recall wanted for pairs at the threshold. Bands of over ``tile`` vectors are dealt to pairs of blocks; a pair
counts in the first band that it shares.

Bands are screened first, with codes, factors and rotated vectors of 8 bits a component alone (what rounding can change
in an estimate is stored too, and added to the bound). Only vectors that have a pair left in a band are then sent
there themselves. Tasks return counts and spanning forests, never all pairs.

Equal vectors of a label are one class, counted with its size; classes are told apart by 128 bits of hashes. Null, empty,
zero and non-finite vectors, those of another length than most, null labels and null ids link with nothing: n_links 0, and
their own component. Repeated ids are separate vectors. One row in, one row out; no rows give none. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix, table
from .sets import Renamed, bit_filter, components, grouped, renamed
from .vectors import dot, matrix

SCHEMA = "vec_id long, n_links long, component_id long, kept boolean"


class Coder:
    """Rotations, codes, factors, bands."""

    def __init__(self, dims: int, bands: int, bits: int, seed: int = 10):
        self.dims, self.bands, self.bits = dims, bands, bits
        self.size = -(-max(dims, 8) // 8) * 8
        rng = np.random.default_rng(seed)
        n = max(1, math.ceil(bands * bits / self.size))
        self.rotations = [np.linalg.qr(rng.normal(size=(self.size, self.size)))[0] for _ in range(n)]

    def padded(self, unit: np.ndarray) -> np.ndarray:
        return np.hstack([unit, np.zeros((len(unit), self.size - self.dims))])

    def encode(self, unit: np.ndarray, bands: int | None = None, bits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs of all rotations, factors, and each band's bits (of as many bands and bits as there are, or fewer)."""
        bands, bits = (self.bands, self.bits) if bands is None else (bands, bits)
        turned = [self.padded(unit) @ r for r in self.rotations]
        signs = np.hstack([t > 0 for t in turned])
        factor = np.abs(turned[0]).sum(1) / math.sqrt(self.size)
        weights = 1 << np.arange(bits)
        keys = np.stack([signs[:, b * bits : (b + 1) * bits] @ weights for b in range(bands)], 1) if bits else np.zeros((len(unit), 1), np.int64)
        return np.packbits(signs, axis=1), factor, keys.astype(np.int32)

    def turned(self, unit: np.ndarray) -> np.ndarray:
        return (self.padded(unit) @ self.rotations[0]).astype(np.float32)

    def rounded(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rotated vectors in 8 bits a component, their scales, and the lengths of what rounding took."""
        turned = self.turned(unit)
        scale = np.abs(turned).max(1) / 127
        whole = np.rint(turned / scale[:, None])
        return whole.astype(np.int8), scale, np.sqrt(((turned - whole * scale[:, None]) ** 2).sum(1))

    def estimates(self, codes: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> np.ndarray:
        """Unbiased estimates of inner products: coded vectors x rotated vectors."""
        signs = np.unpackbits(codes, axis=1)[:, : self.size].astype(np.float32) * 2 - 1
        return (signs @ turned.T) / (math.sqrt(self.size) * factor[:, None].astype(np.float32))

    def error(self, factor: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(1 - factor**2, 0) / (factor**2 * (self.size - 1)))


def plan(largest: int, threshold: float, bucket: int, recall: float) -> tuple[int, int]:
    """(bands, bits): bits so that a label's buckets hold about ``bucket`` vectors, bands for the recall at the threshold."""
    bits = max(0, math.ceil(math.log2(max(1, largest) / bucket)))
    if not bits:
        return 1, 0
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - agree)), bits


class Side:
    """Vectors of a tile as the screening sees them."""

    def __init__(self, coder: Coder, codes: np.ndarray, factor: np.ndarray, turned: np.ndarray, lost: np.ndarray, keys: np.ndarray, width: float):
        self.coder, self.codes, self.factor, self.turned, self.keys = coder, codes[:, : coder.size // 8], factor, turned, keys
        self.lost, self.bound = lost, width * coder.error(factor) + 1e-5

    def near(self, one: np.ndarray, other: np.ndarray, threshold: float, band: int) -> np.ndarray:
        """Pairs (one x other) that either vector's code cannot rule out, and that share no earlier band."""
        out = np.zeros((len(one), len(other)), bool)
        for x, y, turn in ((one, other, False), (other, one, True)):
            most = self.coder.estimates(self.codes[x], self.factor[x], self.turned[y]) + self.bound[x][:, None] + self.lost[y] / self.factor[x][:, None]
            out |= (most >= threshold).T if turn else most >= threshold
        out &= one[:, None] != other
        for b in range(band):
            out &= self.keys[one, b][:, None] != self.keys[other, b]
        return out


def screen(side: Side, first: np.ndarray, second: np.ndarray | None, band: int, threshold: float) -> np.ndarray:
    """The rows that have a pair left."""
    some, others = np.zeros(len(side.factor), bool), first if second is None else second
    for low in range(0, len(first), 512):
        near = side.near(first[low : low + 512], others, threshold, band)
        some[first[low : low + 512]] |= near.any(1)
        some[others] |= near.any(0)
    return np.flatnonzero(some)


def compare(side: Side, unit: np.ndarray, counts: np.ndarray, first: np.ndarray, second: np.ndarray | None, band: int, threshold: float):
    """Links between rows ``first`` and ``second`` (or within ``first``): links of each row, and a spanning forest."""
    links, label, edges = np.zeros(len(unit), np.int64), np.arange(len(unit)), []
    others = first if second is None else second
    for low in range(0, len(first), 512):
        own = first[low : low + 512]
        i, j = np.nonzero(side.near(own, others, threshold, band))
        i, j = own[i], others[j]
        for part in range(0, len(i), 1 << 16):
            x, y = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            linked = dot(unit[x], unit[y]) >= threshold
            x, y = x[linked], y[linked]
            np.add.at(links, x, counts[y])
            if second is not None:
                np.add.at(links, y, counts[x])
            starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else []
            for a, s in zip(starts, [*starts[1:], len(x)], strict=True) if len(x) else ():
                me = x[a]
                kinds, one = np.unique(label[y[a:s]], return_index=True)
                for other, at in zip(kinds.tolist(), one.tolist(), strict=True):
                    if other != label[me]:
                        edges.append((me, y[a:s][at]))
                        label[label == other] = label[me]
    return links, edges


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]  # so that squares neither vanish nor overflow
    return x / np.sqrt(dot(x, x))[:, None]


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().cast(pa.float64())).reshape(len(column), dims) + 0.0  # no negative zeros


def link(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.999, width: float = 3.5, bucket: int = 1024, tile: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector."""
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(kind).alias("embedding"))
    size = F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.size("embedding"))
    sizes = base.groupBy(size.alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    alone = lambda x: x.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if sizes is None:
        return alone(base)
    dims = sizes["n"]

    def usable(others: Renamed | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            for batch in batches:
                at, x = matrix(batch.column(2), dims)
                named = np.array([v.as_py() is not None and y.as_py() is not None for v, y in zip(batch.column(0), batch.column(1), strict=True)], bool)
                own = named[at]
                at, x = at[own], x[own] + 0.0
                labels = batch.column(1).to_pylist()
                out, none = np.zeros((batch.num_rows, 2), np.int64), np.ones(batch.num_rows, bool)
                raw = b"".join([xxhash.xxh3_128_digest(labels[r].encode() + b"\0" + v.tobytes()) for r, v in zip(at.tolist(), x, strict=True)])
                out[at] = np.frombuffer(raw, np.int64).reshape(-1, 2)
                none[at] = False
                ids = out[:, 0] if others is None else others.apply(np.ascontiguousarray(out[:, 0]), out[:, 1])
                columns = [batch.column(0), batch.column(1), pa.array(ids, mask=none), pa.array(np.ascontiguousarray(out[:, 1]), mask=none), batch.column(2)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "id", "check", "embedding"])

        return run

    schema = f"vec_id long, label string, id long, check long, embedding {kind}"
    others = renamed(base.mapInArrow(usable(None), schema).where("id is not null"), "id", "check")
    named = base.mapInArrow(usable(others), schema)
    classes = cut(named.where("id is not null").groupBy("id").agg(F.first("label").alias("label"), F.min("vec_id").alias("own"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")))
    per_label = cut(classes.groupBy("label").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > bucket))
    largest = per_label.agg(F.max("members")).first()[0] or 0
    coder = Coder(dims, *plan(largest, threshold, bucket, recall))
    shared = spark.sparkContext.broadcast(coder)
    #: signs of all rotations, rounded vector, factor, scale, what rounding took, hash of the label, band, bits
    record = np.dtype([("signs", np.uint8, (len(coder.rotations) * coder.size // 8,)), ("whole", np.int8, (coder.size,)), ("factor", np.float64), ("scale", np.float32), ("lost", np.float32), ("label", np.int64), ("band", np.int32), ("bits", np.int32)])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        coder = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_vectors(batch.column(2), dims))
            labels = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in batch.column(1).to_pylist()], np.uint64)
            members = np.asarray(batch.column(3))
            for count in np.unique(members):
                own = members == count
                bands, bits = plan(int(count), threshold, bucket, recall)
                signs, factor, keys = coder.encode(unit[own], bands, bits)
                data = np.zeros(len(signs), record)
                data["signs"], data["factor"], data["label"], data["bits"] = signs, factor, labels[own].view(np.int64), bits
                data["whole"], data["scale"], data["lost"] = coder.rounded(unit[own])
                ids = batch.column(0).filter(pa.array(own))
                for b in range(keys.shape[1]):
                    data["band"] = b
                    place = mix(labels[own] + mix(np.array([b + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + keys[:, b].astype(np.uint64)))
                    yield pa.RecordBatch.from_arrays([pa.array(place.view(np.int64)), ids, pa.array([x.tobytes() for x in data], pa.binary())], ["bucket", "id", "data"])

    sized = classes.join(per_label, "label", "left").select("id", "label", "embedding", F.coalesce("members", F.lit(0)).alias("members"))
    bands = sized.mapInArrow(coded, "bucket long, id long, data binary")
    counts = bands.select("bucket").groupBy("bucket").agg(F.count(F.lit(1)).alias("members"))
    large = cut(counts.where(F.col("members") > tile).select("bucket", F.ceil(F.col("members") / tile).cast("int").alias("blocks")))
    # buckets that are few enough go to their task as they are; others in blocks, each pair of which meets in a task
    filtered = spark.sparkContext.broadcast(bit_filter(large, "bucket", 20))

    def with_size(is_large: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in coded(batches):
                own = filtered.value.has(np.asarray(batch.column(0))) == is_large
                if own.any():
                    yield batch.filter(pa.array(own))

        return run

    rows = lambda is_large: sized.mapInArrow(with_size(is_large), "bucket long, id long, data binary")
    whole = rows(False).select(F.col("bucket").alias("tile"), F.lit(0).alias("block"), F.lit(True).alias("same"), "id", "data")
    blocks = rows(True).join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select(F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))).alias("tile"), "block", (F.col("block") == F.col("other")).alias("same"), "id", "data")

    def sides(block: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray | None] | None:
        first = np.flatnonzero(block == block[0])
        second = np.flatnonzero(block != block[0])
        return (first, None) if same else (first, second) if len(second) else None

    def screened(group: pa.Table):
        if group.num_rows < 2:
            return None
        coder, block = shared.value, np.asarray(group.column(1))
        data = np.frombuffer(b"".join(group.column(4).to_pylist()), record)
        found = []
        for label in np.unique(data["label"]):  # one, unless two buckets' names are equal
            for band in np.unique(data["band"][data["label"] == label]):
                at = np.flatnonzero((data["label"] == label) & (data["band"] == band))
                two = sides(block[at], bool(group.column(2)[0].as_py()))
                if len(at) < 2 or two is None:
                    continue
                own = data[at]
                signs = np.unpackbits(own["signs"], axis=1)
                bits = int(own["bits"][0])
                keys = np.stack([signs[:, b * bits : (b + 1) * bits] @ (1 << np.arange(bits)) for b in range(band + 1)], 1) if bits else np.zeros((len(at), 1), np.int64)
                side = Side(coder, own["signs"], own["factor"], own["whole"].astype(np.float32) * own["scale"][:, None], own["lost"].astype(np.float64), keys, width)
                left = at[screen(side, *two, int(band), threshold)]
                found.append((left, np.full(len(left), band), np.full(len(left), bits)))
        if not found or not sum(len(x) for x, _, _ in found):
            return None
        at, band, bits = (np.concatenate(x) for x in zip(*found, strict=True))
        column = lambda c: group.column(c).combine_chunks().take(pa.array(at))
        return {"tile": column(0), "block": column(1), "same": column(2), "id": column(3), "band": pa.array(band.astype(np.int32)), "bits": pa.array(bits.astype(np.int32))}

    left = grouped(whole.unionByName(blocks), "tile", screened, "tile long, block int, same boolean, id long, band int, bits int")
    met = left.join(classes.select("id", "label", "n", "embedding"), "id").select(F.xxhash64("tile", "label", "band").alias("tile"), "block", "same", "id", "band", "bits", "n", "embedding")

    def compared(group: pa.Table):
        two = sides(np.asarray(group.column(1)), bool(group.column(2)[0].as_py())) if group.num_rows > 1 else None
        if two is None:
            return None
        coder = shared.value
        band, bits = (int(group.column(c)[0].as_py()) for c in (4, 5))
        unit = _unit(_vectors(group.column(7).combine_chunks(), dims))
        codes, factor, keys = coder.encode(unit, band + 1, bits)
        side = Side(coder, codes, factor, coder.turned(unit), np.zeros(len(unit)), keys, width)
        ids = np.asarray(group.column(3))
        links, edges = compare(side, unit, np.asarray(group.column(6)), *two, band, threshold)
        own = np.flatnonzero(links)
        if not len(own):
            return None
        x = [ids[a] for a, _ in edges]
        y = [ids[b] for _, b in edges]
        some = len(own)
        return {
            "id": pa.array(np.concatenate([ids[own], np.array(x, np.int64)])),
            "links": pa.array(np.concatenate([links[own], np.zeros(len(x), np.int64)])),
            "to": pa.array([None] * some + y, pa.int64()),
        }

    found = cut(grouped(met, "tile", compared, "id long, links long, to long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    parts = classes.select("id", "own", "n").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = parts.groupBy("component").agg(F.min("own").alias("component_id"))
    answers = parts.join(least, "component").join(links, "id", "left").select("id", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = named.where("id is not null").select("vec_id", "id").join(answers, "id").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(alone(named.where("id is null")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))
