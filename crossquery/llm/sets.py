"""Distributed helpers of the operators that find links: bounded filters, components, grouped streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, sweep


class BitFilter:
    """A set of 64-bit hashes as one bit each in a table of fixed size: never a false no, and never larger.

    It only thins out rows before a shuffle; an exact step must follow. When more keys come than
    bits, it thins out less, and results stay the same.
    """

    SLICES = 64

    def __init__(self, bits: int, words: bytes):
        self.bits, self.words = bits, np.frombuffer(words, np.uint8)

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = mix(keys.view(np.uint64)) >> np.uint64(64 - self.bits)
        return (self.words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bit_filter(keys: DataFrame, column: str, bits: int = 26) -> BitFilter:
    """Bits of all values of a long column; the driver gets at most 2 ** bits / 8 bytes, whatever the rows.

    Each task sets bits in its own slices, which are or-ed slice by slice.
    """
    slice_bytes = (1 << bits) // 8 // BitFilter.SLICES
    sweep(keys.sparkSession)  # what the keys were cut from

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros((1 << bits) // 8, np.uint8)
        some = False
        for batch in batches:
            at = mix(np.asarray(batch.column(0)).view(np.uint64)) >> np.uint64(64 - bits)
            np.bitwise_or.at(words, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            some |= len(at) > 0
        if some:
            parts = words.reshape(BitFilter.SLICES, slice_bytes)
            own = [k for k in range(BitFilter.SLICES) if parts[k].any()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([_squeezed(parts[k]) for k in own], pa.binary())], ["slice", "words"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(k, np.zeros(slice_bytes, np.uint8))
                held[k] |= _unsqueezed(x)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([_squeezed(x) for x in held.values()], pa.binary())], ["slice", "words"])

    parts = keys.select(F.col(column).cast("long")).where(F.col(column).isNotNull()).mapInArrow(tasks, "slice int, words binary")
    parts = parts.repartition(16, "slice").mapInArrow(join, "slice int, words binary")
    words = np.zeros((BitFilter.SLICES, slice_bytes), np.uint8)
    for r in parts.collect():
        words[r["slice"]] = _unsqueezed(r["words"])
    return BitFilter(bits, words.tobytes())


def _squeezed(x: np.ndarray) -> bytes:
    import zlib

    return zlib.compress(x.tobytes(), 1)


def _unsqueezed(x: bytes) -> np.ndarray:
    import zlib

    return np.frombuffer(zlib.decompress(x), np.uint8)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component: the smallest id reachable, for every id in an edge. Edges may repeat; nulls have no place here.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each vertex links its larger
    neighbours, then its smaller ones, to the smallest of them; rounds grow with the logarithm of a
    path's length, and edges never get more. Every round is checkpointed to the shared folder.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = cut(pairs)
    n = pairs.count()
    while True:
        # large star: for a vertex x and its least neighbour m (or x), larger neighbours go to m
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, F.least("u", "m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours, and the vertex itself, go to the smallest
        small = _with_least(large, F.col("m"))
        small = small.select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = cut(small.coalesce(1 + n // 100_000))  # as few files as the last round's number of edges needs
        before, n = n, small.count()
        if n == before and not small.join(pairs, ["u", "v"], "left_anti").limit(1).count():
            break
        pairs = small
    ends = small.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return small.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(ends).groupBy("id").agg(F.min("component").alias("component"))


def _with_least(edges: DataFrame, least: Column) -> DataFrame:
    """u, v, m: every edge with what ``least`` makes of u and the least neighbour m of u."""
    ends = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), least.alias("m"))
    return edges.join(ends, F.col("u") == F.col("x")).select("u", "v", "m")


class Renamed:
    """New names for what has another's 64-bit name: (name, second hash) -> name. Two hashes of 128 bits tell things apart."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.pairs, self.names = pairs, np.array([n for n, _ in pairs], np.int64)

    def apply(self, names: np.ndarray, checks: np.ndarray) -> np.ndarray:
        if len(self.names) and len(at := np.flatnonzero(np.isin(names, self.names))):
            names = names.copy()
            names[at] = [self.pairs.get((n, c), n) for n, c in zip(names[at].tolist(), checks[at].tolist(), strict=True)]
        return names


def renamed(named: DataFrame, name: str, check: str) -> Renamed:
    """What a second hash finds to be different under one name: n names of 64 bits make about n * n / 2 ** 65 such pairs, a few in 10 ** 10."""
    several = named.groupBy(name).agg(F.min(check).alias("least"), F.max(check).alias("most")).where("least <> most").select(name)
    found = named.join(several, name).select(name, check).distinct().collect()
    kept: dict[int, int] = {}
    for r in found:
        kept[r[0]] = min(kept.get(r[0], r[1]), r[1])
    return Renamed({(r[0], r[1]): int(mix(np.array([r[0] ^ (r[1] >> 1)], np.int64).view(np.uint64)).view(np.int64)[0]) for r in found if r[1] != kept[r[0]]})


def groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """The groups of rows with one key in a task's batches, which must be sorted by that column."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        for low, high in zip(starts, [*starts[1:], len(keys)], strict=True):
            if held and keys[low] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = keys[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def grouped(frame: DataFrame, key: str, run: Callable[[pa.Table], Iterator[dict] | None], schema: str, partitions: int | None = None) -> DataFrame:
    """``run`` gets each group of a key (a long, first column) as one Arrow table; groups must be bounded."""
    names = [x.split()[0] for x in schema.split(", ")]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches):
            if (out := run(group)) is not None:
                yield pa.RecordBatch.from_arrays([out[n] for n in names], names)

    dealt = frame.repartition(key) if partitions is None else frame.repartition(partitions, key)
    return dealt.sortWithinPartitions(key).mapInArrow(tasks, schema)


class Forest:
    """Union-find over 0 .. n - 1; the smallest member is the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True
