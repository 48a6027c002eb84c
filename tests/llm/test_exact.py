"""Operators with exact results, against the libraries or brute force."""

import hashlib
import math
import random
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest

from crossquery.llm import embedding_dedup, jaccard_join, licenses, neighbours, packing, sentencepiece_codec, sets, suffix_dedup

ODD = [None, "", "  ", " a", "a ", "▁", " ▁ a", "a\0b", "\n", "  \n x  ", "é́ ñ", "日本 語 😀  x", "<s> </s>", "a▁▁b", "<0x0A> a", "'s it's O'Neil's", "<|startoftext|> a<|endoftext|>b", "<|STARTOFTEXT|>", "İ ΑΣ Σ. x", "\x1c a\x1fb\x85c", "²½1.5%x", "don't, 'll.'s", "٣.٤! x", "ab.'s", "x" * 3000]


def texts(seed, n=300):
    rng = random.Random(seed)
    return [*ODD, *("".join(rng.choice("aAbB '.,!s\n\té́😀日▁1²<|>Σ") for _ in range(rng.randint(0, 60))) for _ in range(n))]


def frame(spark, rows):
    """Documents with repeated rows, a null id and columns whose names could clash."""
    rows = [(k if k != 2 else None, t) for k, t in enumerate(rows)]
    rows += [rows[4], rows[5]]
    full = [(d, t, "x", 1, "y", 2, 3, 4) for d, t in rows]
    names = "doc_id long, text string, row string, id long, signature string, th long, text_id long, component long"
    return spark.createDataFrame(full, names), rows


def same(got, expected):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(expected, key=key)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_sentencepiece(spark):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    documents, rows = frame(spark, texts(1))
    expected = []
    for d, t in rows:
        ids = p.encode(t or "", add_bos=True, add_eos=True)
        expected.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(p.decode(ids).encode()).hexdigest()))
    same(sentencepiece_codec.digests(documents).collect(), expected)
    same([(r["doc_id"], len(r["ids"]) // 4) for r in sentencepiece_codec.encode_decode(documents, max_chunks=20).collect()], [e[:2] for e in expected])
    assert sentencepiece_codec.digests(empty(spark)).count() == 0


def _ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("max_open", [2048, 3])
def test_packing(spark, max_open):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    long = ["word " * n for n in (1099, 1100, 1100, 1100, 2047, 2048, 5000, 30)]
    documents, rows = frame(spark, texts(2) + long)
    pieces = packing.pack(documents.coalesce(2), with_ids=True, max_open=max_open).collect()
    by_document, by_sequence = {}, {}
    for r in pieces:
        assert len(r["ids"]) == 4 * r["length"] and r["ids_crc32"] == zlib.crc32(r["ids"])
        by_document.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, t in rows:
        if sum(x == d for x, _ in rows) > 1:
            continue
        own = sorted(by_document[d])
        ids = [i for _, x, _ in own for i in x]
        assert ids == _ids(tokenizer, t) and {x[2] for x in own} == {len(ids)}
        assert [x[0] for x in own] == np.cumsum([0, *(len(x[1]) for x in own)])[:-1].tolist()
    assert sum(r["length"] for r in pieces) == sum(len(_ids(tokenizer, t)) for _, t in rows)
    for own in by_sequence.values():
        own.sort()
        fill = own[-1][0] + own[-1][1]
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist()
        assert fill == 2048 or fill & (fill - 1) == 0
    assert packing.pack(empty(spark)).count() == 0


def test_packing_ids_are_the_tokenizers():
    """Letters that lower-casing or normalising takes apart, marks and every character of a chunk's tail."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, words = Tokenizer.from_file(path), packing.WordTable(path, 10_000)
    rng = random.Random(6)
    tail = packing._TAIL.decode()
    alphabet = tail + "İIıiſßŉΣς\u0958\u0344\u0300\u0338\u212a\u1e9eǅé日가ᄀ각a1²½'<|> \t\u00a0\u0660x"
    made = [c + t for c in alphabet for t in tail]
    made += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 8))) + rng.choice(tail) for _ in range(20_000)]
    expected = tokenizer.encode_batch(made, add_special_tokens=False)
    assert [t for t, e in zip(made, expected, strict=True) if words.encode(t).tolist() != e.ids] == []


def test_packing_minimises_squares():
    """Each placement, against the sum of squares tried for every level."""
    rng, got = random.Random(4), []
    p = packing.Packer(lambda *a: got.append(a), window=16)
    for k in range(400):
        size = rng.randint(1, 15)

        def squares(h, size=size):
            c = p.count.copy()
            if h:
                c[h] -= 1
            if h + size < 16:
                c[h + size] += 1
            return int((c**2).sum())

        choices = {h: squares(h) for h in range(17 - size) if h == 0 or p.count[h]}
        assert squares(p.level(size)) == min(choices.values())
        p.add(k, np.ones(size, "<u2"))
    p.close()
    assert sum(len(a[2]) for a in got) and not p.n_open


def _suffix_brute(rows):
    raws = [(t or "").encode() for _, t in rows]
    seen = {}
    for d, r in enumerate(raws):
        for p in range(len(r) - 199):
            seen.setdefault(r[p : p + 200], []).append((d, p))
    covered = [np.zeros(len(r), bool) for r in raws]
    for places in seen.values():
        for d, p in places if len(places) > 1 else ():
            covered[d][p : p + 200] = True
    return [(row[0], len(r), int(c.sum()), int((np.diff(c.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(r, np.uint8)[~c].tobytes()).hexdigest()) for row, r, c in zip(rows, raws, covered, strict=True)]


@pytest.mark.parametrize("hot", [50_000, 3])
def test_suffix_dedup(spark, hot):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [noise(n) for n in (150, 199, 200, 201, 250, 400, 900)]
    out = [None, "", noise(100), "a" * 1000, "ab" * 400, noise(3000)]
    out += ["".join(noise(rng.randint(0, 200)) + rng.choice([*passages, ""]) for _ in range(4)) for _ in range(40)]
    base = noise(1200)
    for _ in range(20):
        b = list(base)
        for _ in range(rng.randint(0, 6)):
            b[rng.randrange(len(b))] = "X"
        out.append("".join(b))
    documents, rows = frame(spark, out)
    same(suffix_dedup.digests(documents, hot=hot, bits=18).collect(), _suffix_brute(rows))
    assert suffix_dedup.digests(empty(spark)).count() == 0


def test_suffix_sort_falls_back_on_collisions():
    """With hashes that say everything is equal, neighbours fail verification and the bytes decide."""
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 400).astype(np.uint8)
    starts, sizes, group = np.arange(0, 40), np.full(40, 60), np.zeros(40, np.int64)
    honest = suffix_dedup.Suffixes(data, starts, sizes)
    order, extension = honest.sort(group)
    texts_ = [data[s : s + 60].tobytes() for s in starts]
    assert [texts_[k] for k in order] == sorted(texts_)
    broken = suffix_dedup.Suffixes(data, starts, sizes)
    broken.prefix = np.zeros_like(broken.prefix)
    again, extension_again = broken.sort(group)
    assert [texts_[k] for k in again] == sorted(texts_) and extension_again.tolist() == extension.tolist()


def _shingles(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(x + 32 if 65 <= x <= 90 else x for x in (t or "").encode()))
    return frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()


def _jaccard_brute(rows):
    s, parent = [_shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root(k)] = min(least.get(root(k), d), d)
    return [(d, len(s[k]), least.get(root(k)) if s[k] else d) for k, (d, _) in enumerate(rows)]


def _near_copies(seed, n=25):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["É", "Ab", "aB", "x\x0by"]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    out, passage = [None, "", " \n", "a", "A", "a b", "b a", "a b c", "a b c d", "A b  c\td", "a b c d e"], draw(60)
    for _ in range(n):
        base = draw(rng.choice([5, 8, 12, 20, 30, 60, 120, 200]))
        for _ in range(rng.randint(1, 7)):
            b = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                k = rng.randrange(len(b))
                b[k : k + 1] = rng.choice([[rng.choice(words)], [b[k], rng.choice(words)], []]) or (["q"] if len(b) == 1 else [])
            out.append(rng.choice([" ", "\n", "  "]).join(b + (passage if rng.random() < 0.2 else [])))
    base = draw(150)
    for _ in range(40):
        b = list(base)
        for _ in range(rng.randint(0, 5)):
            b[rng.randrange(len(b))] = rng.choice(words)
        out.append(" ".join(b))
    return out


def _connected(pairs, n):
    known = sets.Forest(n)
    for a, b in pairs:
        known.union(a, b)
    return [known.find(k) for k in range(n)]


@pytest.mark.parametrize("shingles", [1 << 20, 300])
def test_jaccard_tiles_of_many_sets(monkeypatch, shingles):
    """Blocks of more sets than are compared at a time, also in runs of few shingles, give what all pairs give."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", shingles)
    rng, bound = np.random.default_rng(5), jaccard_join.Bound()
    values = []
    for _ in range(40):
        core = rng.choice(400, rng.integers(1, 60), replace=False)
        values += [np.unique(np.concatenate([core[rng.integers(0, 4) :], rng.integers(400, 2000, rng.integers(0, 4))])).astype(np.uint64) for _ in range(8)]
    values = [v for v in values if len(v)]
    links = [(a, b) for b in range(len(values)) for a in range(b) if bound.linked(len(np.intersect1d(values[a], values[b])), len(values[a]), len(values[b]))]
    assert len(links) > 300
    every = np.arange(len(values))
    assert _connected(jaccard_join.connecting([(every, None)], values, bound, 20), len(values)) == _connected(links, len(values))
    left, right = every[every % 3 > 0], every[every % 3 == 0]
    across = [(a, b) for a, b in links if (a % 3 > 0) != (b % 3 > 0)]
    assert _connected(jaccard_join.connecting([(left, right)], values, bound, 20), len(values)) == _connected(across, len(values))
    assert not jaccard_join.connecting([(every[:0], None), (every, every[:0])], values, bound, 20)


def test_jaccard_hot_tile_is_not_compared_pair_by_pair(monkeypatch):
    """Sets that share most members, each with enough of its own, need no comparison: before, a tile compared all pairs."""
    compared = []
    monkeypatch.setattr(jaccard_join, "forest", lambda stored, probes, bound: compared.append(len(stored) + len(probes or [])) or [])
    hot, own = np.arange(30, dtype=np.uint64), np.arange(1000, 1000 + 3000 * 8, dtype=np.uint64)
    values = [np.concatenate([hot, own[8 * k : 8 * k + 8]]) for k in range(3000)]
    assert not jaccard_join.connecting([(np.arange(3000), None)], values, jaccard_join.Bound(), 1000)
    assert not compared


@pytest.mark.parametrize("tile", [1000, 7])
def test_jaccard_join(spark, tile):
    documents, rows = frame(spark, _near_copies(tile))
    same(jaccard_join.link(documents, tile=tile, bits=16).select("doc_id", "n_shingles", "component_id").collect(), _jaccard_brute(rows))


def test_jaccard_join_keeps_one_of_each(spark):
    documents, rows = frame(spark, _near_copies(3, 6))
    kept = jaccard_join.keep_one(documents, bits=16)
    assert kept.columns == documents.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    brute = _jaccard_brute(rows)
    wordless = [r for r, b in zip(rows, brute, strict=True) if not b[1]]
    assert len(got) == len(wordless) + len({b[2] for b in brute if b[1]})
    ids = {b[2] for b in brute if b[1]}
    assert {d for d, t in got if _shingles(t)} == ids
    assert jaccard_join.link(empty(spark)).count() == 0 and jaccard_join.keep_one(empty(spark)).count() == 0


def test_jaccard_join_keeps_unlinked_texts_of_null_and_repeated_ids(spark):
    one, two, three, four = (" ".join(f"{t}{k}" for k in range(12)) for t in "abcd")
    rows = [(None, one), (None, one), (None, two), (7, three), (7, four), (8, three), (7, three)]
    got = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, one), (0, two), (7, three), (7, four)]


def test_trie_finds_all_links():
    rng = random.Random(9)
    bound = jaccard_join.Bound(60)
    for _ in range(30):
        own = [np.array(sorted(rng.sample(range(25), rng.randint(1, 20))), np.uint64) for _ in range(12)]
        pairs = jaccard_join.forest(own, None, bound, cells=40)
        label = list(range(12))
        for a, b in pairs:
            assert bound.linked(len(set(own[a].tolist()) & set(own[b].tolist())), len(own[a]), len(own[b]))
            label = [label[a] if x == label[b] else x for x in label]
        for a in range(12):
            for b in range(12):
                if bound.linked(len(set(own[a].tolist()) & set(own[b].tolist())), len(own[a]), len(own[b])):
                    assert label[a] == label[b]


# ---- vectors


def _vectors(seed, n=700, dims=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).astype(np.float32)
    x[50:200] = x[50] + rng.normal(size=(150, dims)).astype(np.float32) * 0.12
    x[200:215] = x[200]
    rows = [(k, x[k].tolist(), int(k % 3 if k > 215 else 1), "c", 5) for k in range(n)]
    odd = [None, [], [0.0] * dims, [float("nan")] * dims, [float("inf")] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [1.0] * (dims + 1)]
    rows += [(1000 + 20 * k, v, 1, "c", 5) for k, v in enumerate(odd)] + [(None, x[50].tolist(), 1, "c", 5), (2001, x[50].tolist(), None, "c", 5), (2002, (-x[50]).tolist(), 1, "c", 5)]
    return x, rows


NAMES = "vec_id long, embedding array<float>, label int, id string, n long"


def test_neighbours(spark):
    x, rows = _vectors(1)
    frame_ = spark.createDataFrame(rows, NAMES)
    got = {}
    for r in neighbours.search(frame_, frame_.where("vec_id % 20 = 0"), sample=100, shard_rows=150, query_block=20, confidence=0.99).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = [r[0] for r in rows if r[0] is not None and r[0] < 700] + [2001, 2002]
    points = np.array([x[k] if k < 700 else x[50] if k == 2001 else -x[50] for k in ids], float)
    assert sorted(got) == [k for k in range(700) if k % 20 == 0]
    hit = 0
    for q, found in got.items():
        found.sort()
        scores = points @ points[ids.index(q)]
        order = sorted((k for k in range(len(ids)) if ids[k] != q), key=lambda k: (-scores[k], ids[k]))[:20]
        assert [r[0] for r in found] == list(range(1, 21))
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(found, found[1:], strict=False))
        assert np.allclose([r[2] for r in found], [scores[ids.index(r[1])] for r in found])
        hit += len({ids[k] for k in order} & {r[1] for r in found})
    assert hit / (20 * len(got)) > 0.95


def test_neighbours_break_ties_by_id(spark):
    """More copies of a vector than are asked for, in several shards and blocks."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 16)).repeat(60, 0)
    ids = rng.permutation(2400)
    frame_ = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(frame_, frame_.where("vec_id % 20 = 0"), sample=200, shard_rows=300, query_block=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    point = dict(zip(ids.tolist(), x, strict=True))
    assert len(got) == 120
    for q, found in got.items():
        scores = {int(k): float(np.einsum("i,i->", v, point[q])) for k, v in point.items() if k != q}
        assert [v for _, v in sorted(found)] == sorted(scores, key=lambda k: (-scores[k], k))[:20]


def test_neighbours_by_default(spark):
    """Recall with the query's own parameters, over several shards."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 24)).repeat(70, 0) + 0.4 * rng.normal(size=(21_000, 24))
    frame_ = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(frame_, frame_.where("vec_id % 300 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q, found in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        hit += len(found & set(np.argpartition(scores, -20)[-20:].tolist()))
    assert len(got) == 70 and hit / (20 * 70) >= 0.95


def test_neighbours_of_little(spark):
    none = spark.createDataFrame([], NAMES)
    assert neighbours.search(none, none).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0], 1, "", 1), (1, [0.0, 1.0], 1, "", 1)], NAMES)
    assert [tuple(r) for r in neighbours.search(two, two.where("vec_id = 0")).collect()] == [(0, 1, 1, 0.0)]
    zeros = spark.createDataFrame([(0, [0.0, 0.0], 1, "", 1)], NAMES)
    assert neighbours.search(zeros, zeros).count() == 0


def test_chi_square_quantile():
    draws = (np.random.default_rng(1).normal(size=(200_000, 8)) ** 2).sum(1)
    assert abs((draws <= neighbours.chi_square_quantile(0.9)).mean() - 0.9) < 0.01


@pytest.mark.parametrize("options", [{}, {"bucket": 20, "tile": 30, "recall": 0.99999}])
def test_embedding_dedup(spark, options):
    x, rows = _vectors(2)
    got = {}
    for r in embedding_dedup.link(spark.createDataFrame(rows, NAMES), **options).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    labels = np.array([r[2] for r in rows[:700]])
    near = (unit @ unit.T >= 0.93) & (labels[:, None] == labels)
    parent = list(range(700))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in zip(*np.nonzero(near), strict=True):
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    for k in range(700):
        assert got[k] == [(int(near[k].sum()) - 1, root(k), root(k) == k)]
    for r in rows[700:]:
        assert got[r[0]] == [(0, r[0], True)]
    assert embedding_dedup.link(spark.createDataFrame([], NAMES)).count() == 0


def test_estimates_are_unbiased():
    rng = np.random.default_rng(5)
    o = rng.normal(size=(1, 64))
    q = rng.normal(size=(1, 64)) * 0.5 + o
    o, q = o / np.linalg.norm(o), q / np.linalg.norm(q)
    found, within = [], 0
    for seed in range(400):
        coder = embedding_dedup.Coder(64, 1, 0, seed)
        codes, factor, _ = coder.encode(o)
        found.append(coder.estimates(codes[:, :8], factor, coder.turned(q))[0, 0])
        whole, scale, lost = coder.rounded(q)
        assert abs(coder.estimates(codes[:, :8], factor, whole * scale[:, None])[0, 0] - found[-1]) <= lost[0] / factor[0] + 1e-6
        within += abs(found[-1] - (o @ q.T)[0, 0]) <= 3.5 * coder.error(factor)[0]
    assert abs(np.mean(found) - (o @ q.T)[0, 0]) < 0.01 and within == 400


def test_neighbours_are_twenty_in_tight_clusters(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(143, 64)), 21, 0) + 0.02 * rng.normal(size=(3003, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(rows, rows.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert len(got) == 151 and all(len(v) == len(set(v)) == 20 for v in got.values())
    assert all({v // 21 for v in near} == {q // 21} for q, near in got.items())


def test_embedding_dedup_of_labels_over_the_bucket(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(700, 32))
    near = centres + 0.36 * rng.normal(size=centres.shape)
    x = np.concatenate([centres, near, centres[:40] + 0.36 * rng.normal(size=(40, 32))])
    labels = np.array(["large"] * 1400 + ["small"] * 40)
    labels[:40] = "small"
    rows = [(k, v.tolist(), str(c)) for k, (v, c) in enumerate(zip(x, labels, strict=True))]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    expected = ((unit @ unit.T >= 0.93) & (labels[:, None] == labels)).sum(1) - 1
    found = np.array([got[k] for k in range(len(x))])
    assert expected.sum() > 300 and (found <= expected).all() and found.sum() >= 0.99 * expected.sum()
    assert found[labels == "small"].tolist() == expected[labels == "small"].tolist()


def test_bands_find_nearly_all_pairs_at_the_threshold():
    import inspect

    recall, bucket = (inspect.signature(embedding_dedup.link).parameters[p].default for p in ("recall", "bucket"))
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(2, 20_000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b = 0.931 * a + math.sqrt(1 - 0.931**2) * b / np.linalg.norm(b, axis=1)[:, None]
    for largest in (5_000, 100_000):
        coder = embedding_dedup.Coder(64, *embedding_dedup.plan(largest, 0.93, bucket, recall))
        met = (coder.encode(a)[2] == coder.encode(b)[2]).any(1).mean()
        assert met >= 0.998


# ---- licences


def test_licenses(spark):
    mit = licenses.SHORT["MIT"]
    variants = [f"MIT License\n\n{mit}", mit.upper().replace(",", " ;"), f"The MIT Licence (MIT)\n\nCopyright (c) 2020 A. Person\nCopyright 2021, B. Person\nAll rights reserved.\n\n{mit}", mit.replace("sublicense", "sub-licence"), mit.replace('"', "\u201c").replace("-", "\u2014")]
    rows = [*variants, f"before {mit}", None, "", "...", "Released under the MIT licence", "(c) 2001 nobody", mit.replace("Software", "Hardware", 1), f"{mit}\ncopyright holders may not use it"]
    documents = spark.createDataFrame([(k, t, "z", "w") for k, t in enumerate(rows)], "doc_id long, text string, license string, canonical_sha256 string")
    got = {r["doc_id"]: (r["license"], r["canonical_sha256"]) for r in licenses.scan(documents).collect()}
    assert [got[k][0] for k in range(len(rows))] == ["MIT"] * 5 + [None] * 4 + ["notice:MIT"] + [None] * 3
    assert [got[k][1] is None for k in range(len(rows))] == [False] * 6 + [True] * 3 + [False, True, False, False]
    own = spark.createDataFrame([("a", "X y"), ("b", "x, Y"), ("c", None)], "name string, text string")
    assert [r["license"] for r in licenses.scan(spark.createDataFrame([(1, "x y")], "doc_id long, text string"), own).collect()] == ["a"]
    assert licenses.scan(empty(spark)).count() == 0


def test_licenses_are_found_however_they_are_wrapped(spark):
    """Every known text at all widths from 40 to 120, with a copyright statement before the short ones; by Spark and by SQL."""
    rows = []
    for name, text in licenses.known_texts():
        paragraphs = re.split(r"\n[ \t]*\n", text)
        for width in range(40, 121) if text in licenses.SHORT.values() else range(40, 121, 4):
            wrapped = "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False) for p in paragraphs)
            rows.append((len(rows), name, "Copyright (c) 1999, 2004 Some Body <a@b.c>\n\n" + wrapped if name in licenses.SHORT else wrapped))
    documents = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "name", "text"]))
    got = {r["doc_id"]: (r["canonical_sha256"], r["license"]) for r in licenses.scan(documents).collect()}
    assert [r[1] for r in rows if got[r[0]][1] != r[1]] == []
    with duckdb.connect() as db:
        db.register("documents", pd.DataFrame([(r[0], r[2]) for r in rows], columns=["doc_id", "text"]))
        assert {d: (c, x) for d, c, x in db.execute(licenses.oracle()).fetchall()} == got


def test_licenses_sql(spark, sf_dir):
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        expected = db.execute(licenses.oracle()).fetchall()
    same(licenses.query(spark, sf_dir).select("doc_id", "canonical_sha256", "license").collect(), expected)


def test_text_buffers():
    from crossquery.llm.common import by_bytes, text_bytes

    data, offsets = text_bytes(pa.array(["x", "ab", None, "é", ""])[1:])
    assert data.tobytes() == "abé".encode() and offsets.tolist() == [0, 2, 2, 4, 4]
    assert [*by_bytes(np.array([0, 5, 6, 20, 20]), 6)] == [(0, 2), (2, 3), (3, 4)]
