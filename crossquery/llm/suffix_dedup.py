"""Removal of every byte that a repeated ``LENGTH``-byte string covers, by hash-compared suffix sorting.

1. Anchors. Of the ``GRAM``-byte strings inside a window of ``LENGTH`` bytes the one of smallest hash
   (the first, of equals) is the window's anchor. Equal windows have equal anchors at equal places, so
   they meet under the anchor's hash. Neighbouring windows share an anchor: a run of windows is one
   segment of at most 2 * LENGTH - GRAM bytes.
2. Only runs whose anchor occurs at least twice can hold repeated windows: hashes are counted, and a
   bit filter of fixed size lets only such runs pass; what it passes needlessly is found unrepeated.
3. Equal segments are counted before they are dealt out, so copies and shared passages cost one row.
   The distinct segments of an anchor are then sorted twice, by what follows the anchor and by what
   precedes it: a merge sort whose comparisons find the common extension of two suffixes by binary
   search over prefix polynomial hashes. Extensions of neighbours are verified byte by byte; on a
   collision the bytes themselves are sorted. A window that starts ``l`` bytes before the anchor is
   repeated where another segment shares ``l`` bytes before and ``LENGTH - l`` bytes after it.
4. Runs of an anchor that occurs over ``hot`` times never meet in a task: their windows are counted by two
   64-bit hashes instead, and the bytes of windows with equal hashes are compared (least with greatest; windows of
   a collision are counted by their bytes).

What joins a segment or a text to its places are 128 bits of hashes of the whole of it.

Results are judged on the input. Null is empty. Repeated rows (same id, same text) each count as a
document, so their windows repeat, and each gives its row. Texts shorter than ``LENGTH`` bytes keep all. An empty
table gives an empty one. Extra columns are ignored, or carried along by ``strip``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, cut, release_held, row_columns, row_struct, sliced, table, text_bytes
from .sets import BitFilter, bit_filter

LENGTH, GRAM = 200, 64
SPAN = LENGTH - GRAM + 1  # anchors' choices in a window
_POSITION = np.uint64((1 << 24) - 1)
_PIECE = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every string of ``size`` (a power of two) bytes, by doubling."""
    h, width = _VALUES[data], 1
    while width < size:
        left = h[:-width] * _MULTIPLIER
        left ^= left >> np.uint64(31)
        left += h[width:]
        h = left
        width *= 2
    h *= _MULTIPLIER
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by block-wise minima from either side."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
    """Arrays (text, first window, last window, anchor, hash of anchor, bytes): runs of windows with one anchor.

    Positions are within the text; bytes is what the positions plus the text's place in it point to.
    """
    for low, high in by_bytes(offsets, _PIECE):
        base, end = int(offsets[low]), int(offsets[high])
        for start in range(base, max(base + 1, end - LENGTH + 1), _PIECE):  # one round, but for very long texts
            stop = min(end, start + _PIECE + LENGTH - 1) if high == low + 1 else end
            piece = data[start:stop]
            if len(piece) < LENGTH:
                continue
            h = _gram_hashes(piece, GRAM)
            anchor = (_sliding_min((h & ~_POSITION) | np.arange(len(h), dtype=np.uint64), SPAN) & _POSITION).astype(np.int64)
            owner = np.repeat(np.arange(low, high), np.minimum(offsets[low + 1 : high + 1], stop) - np.maximum(offsets[low:high], start))
            inside = owner[: len(anchor)] == owner[LENGTH - 1 :]
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            a = anchor[at]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)]))
            last = np.concatenate([first[1:], [len(at)]]) - 1
            text = owner[at[first]]
            place = offsets[text] - start
            yield text, at[first] - place, at[last] - place, a[first] - place, h[a[first]].view(np.int64), piece, place


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(0xD6E8FEB86659FD93))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Suffixes:
    """Comparisons of suffixes of a byte string by prefix polynomial hashes and binary search."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.data, self.starts, self.sizes = data, starts.astype(np.int64), sizes.astype(np.int64)
        self.power = _powers(len(data))
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * self.power[:-1], dtype=np.uint64)])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes i and j (hashes only)."""
        x, y = self.starts[i], self.starts[j]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.sizes[i], self.sizes[j])
        px, py, wx, wy = self.prefix[x], self.prefix[y], self.power[x], self.power[y]
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            same = (self.prefix[x + middle] - px) * wy == (self.prefix[y + middle] - py) * wx
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(i, j)
        end_i, end_j = n == self.sizes[i], n == self.sizes[j]
        top = len(self.data) - 1
        byte = self.data[np.minimum(self.starts[i] + n, top)] < self.data[np.minimum(self.starts[j] + n, top)]
        return np.where(end_i, ~end_j | or_equal, ~end_j & byte)

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of suffixes within each group (groups are runs of equal numbers), and each one's common
        extension with the one before it, -1 at a group's first."""
        n = len(group)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.concatenate([first, [n]]))
        begin, stop = np.repeat(first, sizes), np.repeat(first + sizes, sizes)
        order, k, width = np.arange(n), np.arange(n) - begin, 1
        while width < sizes.max(initial=1):
            run = k // width
            low = begin + (run ^ 1) * width
            slot = np.flatnonzero(low < stop)
            high = np.minimum(low + width, stop)[slot]
            rank_from, low = low[slot], low[slot]
            right, own = (run[slot] & 1).astype(bool), order[slot]
            while len(live := np.flatnonzero(low < high)):
                middle = (low[live] + high[live]) >> 1
                before = self.less(order[middle], own[live], right[live])
                low[live] = np.where(before, middle + 1, low[live])
                high[live] = np.where(before, high[live], middle)
            to = begin[slot] + (run[slot] & ~1) * width + k[slot] % width + (low - rank_from)
            moved = order.copy()
            moved[to] = own
            order, width = moved, width * 2
        extension = np.full(n, -1, np.int64)
        extension[1:] = self.common(order[1:], order[:-1])
        extension[first] = -1
        if not self._verified(order, extension):
            order = np.array(sorted(range(n), key=lambda s: (group[s], self._bytes(s))), np.int64)
            for s in range(1, n):
                x, y = self._bytes(order[s]), self._bytes(order[s - 1])
                extension[s] = -1 if group[order[s]] != group[order[s - 1]] else next((c for c in range(min(len(x), len(y))) if x[c] != y[c]), min(len(x), len(y)))
        return order, extension

    def _bytes(self, s: int) -> bytes:
        return self.data[self.starts[s] : self.starts[s] + self.sizes[s]].tobytes()

    def _verified(self, order: np.ndarray, extension: np.ndarray) -> bool:
        """Neighbours agree on the bytes their hashes say they share, and are in order after them."""
        at = np.flatnonzero(extension >= 0)
        for low in range(0, len(at), 4096):
            s = at[low : low + 4096]
            n, x, y = extension[s], order[s - 1], order[s]
            steps = np.arange(int(n.max(initial=0)))
            top = len(self.data) - 1
            same = self.data[np.minimum(self.starts[x][:, None] + steps, top)] == self.data[np.minimum(self.starts[y][:, None] + steps, top)]
            if not (same | (steps >= n[:, None])).all() or not self.less(x, y, np.ones(len(s), bool)).all():
                return False
        return True


def repeated(segments: list[bytes], anchors: np.ndarray, first: np.ndarray, last: np.ndarray, counts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """bool matrix: whether segment s's window that starts ``l`` bytes before the anchor is repeated.

    ``anchors``: places of anchors in the segments; ``first`` and ``last``: the range of ``l`` of a segment.
    """
    out = np.zeros((len(segments), SPAN), bool)
    span = np.arange(SPAN)
    out |= (counts > 1)[:, None] & (span >= first[:, None]) & (span <= last[:, None])
    several = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1)
    if not len(several):
        return out
    data = np.frombuffer(b"".join([segments[s] for s in several]), np.uint8)
    sizes = np.array([len(segments[s]) for s in several])
    ends = np.cumsum(sizes)
    at = ends - sizes + anchors[several]
    after = Suffixes(data, at, ends - at).sort(group[several])
    before = Suffixes(np.ascontiguousarray(data[::-1]), len(data) - at, anchors[several]).sort(group[several])
    n = len(several)
    lo, hi = first[several], last[several]
    for l in range(SPAN):  # noqa: E741
        own = np.flatnonzero((lo <= l) & (l <= hi))
        if len(own) < 2:
            continue
        kinds = np.empty((2, n), np.int64)
        for k, ((order, extension), need) in enumerate(((after, LENGTH - l), (before, l))):
            kinds[k][order] = np.cumsum(extension < need)
        both = kinds[0][own] * (n + 1) + kinds[1][own]
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        out[several[own[order[1:][same]]], l] = True
        out[several[own[order[:-1][same]]], l] = True
    return out


#: What names a text: its id, and two hashes.
TEXT = ["jd", "th", "tk"]


def _each_run(documents: DataFrame, work, schema: str) -> DataFrame:
    """Maps rows of TEXT and the text: ``work(names, run arrays)`` gives a record batch for each piece of text."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_held()
        for batch in sliced(batches):
            data, offsets = text_bytes(batch.column(3))
            for found in runs(data, offsets):
                if (out := work([np.asarray(batch.column(k)) for k in range(3)], found)) is not None:
                    yield out

    return documents.mapInArrow(tasks, schema)


def _named(documents: DataFrame) -> list:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("jd"), F.xxhash64(text).alias("th"), F.xxhash64(F.lit(1), text).alias("tk"), text.alias("whole")]


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], [*columns])


def _digests(pieces: list) -> dict[str, np.ndarray]:
    """128 bits of each byte string, as two columns."""
    import xxhash

    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in pieces]), np.int64).reshape(-1, 2)
    return {"one": both[:, 0], "two": both[:, 1]}


def _windows_hashes(piece: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the windows at these places."""
    h = _gram_hashes(piece, 64)
    one = np.zeros(len(at), np.uint64)
    two = np.zeros(len(at), np.uint64)
    for step in (0, 64, 128, LENGTH - 64):
        one = (one ^ h[at + step]) * _MULTIPLIER
        one ^= one >> np.uint64(32)
        two = (two + h[at + step]) * np.uint64(0xC2B2AE3D27D4EB4F)
        two ^= two >> np.uint64(33)
    return one.view(np.int64), two.view(np.int64)


def _hot_windows(found: tuple, hot: BitFilter):
    """The windows of runs with a hot anchor: run numbers, places in the text, two hashes."""
    text, first, last, _, key, piece, place = found
    own = np.flatnonzero(hot.has(key))
    sizes = (last - first + 1)[own]
    run = np.repeat(own, sizes)
    at = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[run]
    return run, at, *_windows_hashes(piece, at + place[run])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From TEXT, the place of an anchor and a bitmap of ``l``: the ranges that its repeated windows cover."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bits = np.unpackbits(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1)[:, :SPAN].astype(np.int8)
        edge = np.diff(bits, axis=1, prepend=0, append=0)
        row, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)  # runs of l in [low, high): windows from anchor - (high - 1) to anchor - low
        anchor = np.asarray(batch.column(3))[row]
        names = {n: np.asarray(batch.column(k))[row] for k, n in enumerate(TEXT)}
        yield _batch(**names, begin=anchor - high + 1, end=anchor - low + LENGTH)


def covered(documents: DataFrame, hot: int = 50_000, bits: int = 26) -> DataFrame:
    """jd, th, tk, begin, end: byte ranges covered by repeated windows (ranges may overlap), by text."""
    rows = documents.select(*_named(documents)).where(F.octet_length("whole") >= LENGTH)
    keys = _each_run(rows, lambda names, found: _batch(key=found[4]), "key long").groupBy("key").count().where("count > 1")
    keys = cut(keys)
    some = bit_filter(keys, "key", bits)
    hot_keys = keys.where(F.col("count") > hot)
    any_hot = bool(hot_keys.limit(1).count())
    hot_filter = bit_filter(hot_keys, "key", 20) if any_hot else BitFilter(20, bytes(1 << 17))
    shared = documents.sparkSession.sparkContext.broadcast((some, hot_filter))  # 2 ** bits / 8 bytes, whatever the rows

    def warm(found):
        some, hot_filter = shared.value
        return np.flatnonzero(some.has(found[4]) & ~hot_filter.has(found[4]))

    def cut_out(found, own):
        _, first, last, _, _, piece, place = found
        return [piece[f:e].tobytes() for f, e in zip((first + place)[own].tolist(), (last + place + LENGTH)[own].tolist(), strict=True)]

    def segments(names, found):
        text, first, last, anchor, key, piece, place = found
        own = warm(found)
        return _batch(key=key[own], lo=(anchor - last)[own].astype(np.int16), hi=(anchor - first)[own].astype(np.int16), segment=pa.array(cut_out(found, own), pa.binary()))

    def places(names, found):
        own = warm(found)
        text = found[0][own]
        return _batch(key=found[4][own], **_digests(cut_out(found, own)), **{n: v[text] for n, v in zip(TEXT, names, strict=True)}, anchor=found[3][own])

    distinct = _each_run(rows, segments, "key long, lo short, hi short, segment binary").groupBy("key", "lo", "hi", "segment").count()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last_key = [], 0, None

        def out():
            key = np.concatenate([np.asarray(b.column(0)) for b in held])
            lo, hi = (np.concatenate([np.asarray(b.column(c)) for b in held]).astype(np.int64) for c in (1, 2))
            bytes_ = [x for b in held for x in b.column(3).to_pylist()]
            counts = np.concatenate([np.asarray(b.column(4)) for b in held])
            group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            found = repeated(bytes_, hi, lo, hi, counts, group)
            own = np.flatnonzero(found.any(1))
            bitmaps = np.packbits(found[own], axis=1)
            return _batch(key=key[own], **_digests([bytes_[s] for s in own]), windows=pa.array([x.tobytes() for x in bitmaps], pa.binary()))

        release_held()
        for batch in batches:
            keys = np.asarray(batch.column(0))
            while batch.num_rows:
                if size > 4_000 and keys[0] != last_key:
                    yield out()
                    held, size = [], 0
                # up to the end of the first run of one key, if a cut is due, or the whole batch
                n = len(keys) if size + len(keys) <= 4_000 else int(np.argmax(keys != keys[0])) or len(keys)
                held.append(batch.slice(0, n))
                size += n
                last_key = keys[n - 1]
                batch, keys = batch.slice(n), keys[n:]
        if held:
            yield out()

    resolved = distinct.repartition("key").sortWithinPartitions("key").mapInArrow(resolve, "key long, one long, two long, windows binary")
    at = _each_run(rows, places, "key long, one long, two long, jd long, th long, tk long, anchor long")
    spans = "jd long, th long, tk long, begin long, end long"
    out = at.join(resolved, ["key", "one", "two"]).select(*TEXT, "anchor", "windows").mapInArrow(_ranges, spans)
    return out.unionByName(_of_hot(rows, shared).mapInArrow(_ranges, spans)) if any_hot else out


def _of_hot(rows: DataFrame, shared) -> DataFrame:
    """TEXT, anchor, windows (a bitmap of ``l``) of the repeated windows of hot anchors.

    Hashes say which windows can be repeated; their bytes are compared before they count.
    """

    def windows(with_places: bool):
        def one(names, found):
            run, at, one, two = _hot_windows(found, shared.value[1])
            if not len(run):
                return None
            _, _, _, anchor, _, piece, place = found
            own = at + place[run]
            out = {"one": one, "two": two, "window": pa.array([piece[p : p + LENGTH].tobytes() for p in own.tolist()], pa.binary())}
            if with_places:
                out |= {n: v[found[0][run]] for n, v in zip(TEXT, names, strict=True)} | {"anchor": anchor[run], "l": (anchor[run] - at).astype(np.int16)}
            return _batch(**out)

        return one

    counted = _each_run(rows, windows(False), "one long, two long, window binary").groupBy("one", "two")
    # cut, so that the join below deals both sides itself and a window that is everywhere can be split
    again = cut(counted.agg(F.count(F.lit(1)).alias("n"), F.min("window").alias("least"), F.max("window").alias("most")).where("n > 1"))
    places = _each_run(rows, windows(True), "one long, two long, window binary, jd long, th long, tk long, anchor long, l short")
    found = places.drop("window").join(again.where("least = most").select("one", "two"), ["one", "two"])
    if again.where("least <> most").limit(1).count():  # a collision of both hashes
        both = places.join(again.where("least <> most").select("one", "two"), ["one", "two"])
        exact = both.groupBy("window").count().where("count > 1").select("window")
        found = found.unionByName(both.join(exact, "window").drop("window"))

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.zeros((batch.num_rows, SPAN), bool)
            for k, own in enumerate(batch.column(4).to_pylist()):
                bits[k, own] = True
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], [*TEXT, "anchor", "windows"])

    runs_ = found.groupBy(*TEXT, "anchor").agg(F.collect_set("l").alias("l"))  # SPAN members at most
    return runs_.mapInArrow(bitmaps, "jd long, th long, tk long, anchor long, windows binary")


def _joined(ranges: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def kept(documents: DataFrame, columns: list[str], finish, schema: str, hot: int = 50_000, bits: int = 26) -> DataFrame:
    """``finish(rows, raws, ranges)`` gives the record batch for a batch of rows: a struct array ``row`` of the given columns,
    each text's bytes, and its maximal removed ranges. Texts without a removed range are never dealt out."""
    spans = covered(documents, hot, bits)
    spans = cut(spans.groupBy(*TEXT).agg(F.collect_set(F.struct("begin", "end")).alias("ranges")))  # a range for each run of windows, at most
    touched = bit_filter(spans, "th", 24)
    shared = documents.sparkSession.sparkContext.broadcast(touched)
    rows = documents.select(row_struct(documents, columns), *_named(documents))
    raw = lambda x: x.as_py().encode("utf-8", "surrogatepass")

    # one Python step in a stage: each more would be one more worker for every core
    def perhaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_held()
        for batch in sliced(batches):
            yield batch.filter(pa.array(shared.value.has(np.asarray(batch.column(2)))))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_held()
        for batch in sliced(batches):
            own = batch.filter(pa.array(~shared.value.has(np.asarray(batch.column(2)))))
            if own.num_rows:
                yield finish(own.column(0), [raw(x) for x in own.column(4)], [[]] * own.num_rows)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ranges = [_joined([(y["begin"], y["end"]) for y in r.as_py() or []]) for r in batch.column(2)]
            yield finish(batch.column(0), [raw(x) for x in batch.column(1)], ranges)

    hit = rows.mapInArrow(perhaps, rows.schema).join(spans, TEXT, "left").select("row", "whole", "ranges")
    return hit.mapInArrow(strip, schema).unionByName(rows.mapInArrow(clean, schema))


def _left(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    ends = [0, *[e for span in ranges for e in span], len(raw)]
    return b"".join([raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)]) if ranges else raw


def strip(documents: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, without repeated passages; characters cut apart go; ``n_chars`` follows where there is one."""
    others = [c for c in documents.columns if c != "text"]
    inner = documents.select(row_struct(documents, others)).schema["row"].dataType.simpleString()

    def finish(rows, raws, ranges):
        texts = [_left(x, r).decode("utf-8", "ignore") for x, r in zip(raws, ranges, strict=True)]
        return _batch(row=rows, text=pa.array(texts, pa.string()))

    out = kept(documents, others, finish, f"row {inner}, text string", **options)
    length = {"n_chars": F.length("text").cast(documents.schema["n_chars"].dataType)} if "n_chars" in others else {}
    named = dict(zip(others, row_columns(others, length), strict=True))
    return out.select(*[named.get(c, F.col("text")) for c in documents.columns])


def digests(documents: DataFrame, hot: int = 50_000, bits: int = 26) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""

    def finish(rows, raws, ranges):
        gone = [sum(b - a for a, b in r) for r in ranges]
        sha = [hashlib.sha256(_left(x, r)).hexdigest() for x, r in zip(raws, ranges, strict=True)]
        ids, count = rows.field("c0").cast(pa.int64()), lambda x: pa.array(x, pa.int64())
        return _batch(doc_id=ids, n_bytes=count([len(x) for x in raws]), n_removed=count(gone), n_spans=count([len(r) for r in ranges]), kept_sha256=pa.array(sha, pa.string()))

    return kept(documents, ["doc_id"], finish, SCHEMA, hot, bits)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
