"""Language ID by unigram pieces with all segmentations summed.

The pieces are a fixed public vocabulary (all those of ``piece_bpe_32k.model`` that lower-casing leaves
alone, and the 256 bytes, so that every word has a segmentation). Each language has a probability for every piece, learned by expectation-maximisation:
the forward-backward algorithm gives each piece's expected count over all segmentations of the
language's words. A text's score under a language is the sum, over its words, of the log of the
forward algorithm's total, that is of all segmentations of the word; the language of largest score
wins and its posterior is the result's score.

Words are runs of letters, lower-cased; runs of over ``BLOCK`` bytes are scored in blocks. A null
text, or one without letters, is ``und`` with score 0; so is every text if no language was learned.
Ties go to the first language in alphabetical order. One row in, one row out, also for repeated rows; extra
columns are ignored. Every label is learned, however many there are; a model has one number for each piece
and language.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, held_by_worker, held_out, keep_rows, mix, sliced, table
from .learning import in_parts

BLOCK = 256
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
#: ASCII bytes other than letters become spaces; bytes of longer characters stay until words are distinct.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def vocabulary(path: str) -> list[bytes]:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {p.id_to_piece(i).replace("▁", " ") for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_byte(i) or p.is_unknown(i))}
    return sorted({bytes([b]) for b in range(256)} | {x.encode() for x in pieces if x == x.lower() and x.strip()}, key=lambda x: (len(x), x))


def split_words(text: str) -> list[bytes]:
    """Candidates for words, not yet distinct; ``clean`` makes words of them."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def clean(candidate: bytes) -> list[bytes]:
    """The marked words in what ``split_words`` gives: only letters, lower-cased, in blocks."""
    if candidate.isascii():
        words = [candidate]
    else:
        text = "".join(c if c.isalpha() else " " for c in candidate.decode("utf-8", "replace").lower())
        words = [x.encode() for x in text.split()]
    return [b" " + w[k : k + BLOCK] for w in words for k in range(0, len(w), BLOCK)]


_BASE = 0xD6E8FEB86659FD93
_BYTES = np.random.default_rng(4).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(ratio: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(ratio))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Model:
    """languages, and piece probabilities (pieces x languages).

    Pieces are found in words by their hash, which a word's prefix hashes give for all its substrings, and then compared byte by byte.
    """

    SIEVE = 18  # bits of a hash by which most substrings are known to be no piece

    def __init__(self, pieces: list[bytes], languages: list[str]):
        self.languages = languages
        self.sizes = np.unique([len(p) for p in pieces])
        self.longest = int(self.sizes[-1])
        self.p = np.full((len(pieces), max(1, len(languages))), 1 / len(pieces))
        self.bytes = np.zeros((len(pieces), self.longest), np.uint8)
        for k, piece in enumerate(pieces):
            self.bytes[k, : len(piece)] = np.frombuffer(piece, np.uint8)
        prefix = np.cumsum(_BYTES[self.bytes] * _powers(_BASE, self.longest), axis=1, dtype=np.uint64)
        keys = self._key(prefix[np.arange(len(pieces)), [len(p) - 1 for p in pieces]], np.array([len(p) for p in pieces], np.uint64))
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces of this vocabulary have one hash")
        self.sieve = np.zeros(1 << self.SIEVE, bool)
        self.sieve[self.keys >> np.uint64(64 - self.SIEVE)] = True

    @staticmethod
    def _key(hashed: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(hashed + size * np.uint64(0x9E3779B97F4A7C15))

    def _found(self, rows: np.ndarray, prefix: np.ndarray, back: np.ndarray, active: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, rows, pieces) of the pieces that end at ``end`` in the first ``active`` rows."""
        sizes = self.sizes[self.sizes <= end]
        begin = end - sizes
        key = self._key((prefix[end, None, :active] - prefix[begin, :active]) * back[begin, None], sizes.astype(np.uint64)[:, None])
        which, row = np.nonzero(self.sieve[key >> np.uint64(64 - self.SIEVE)])
        key = key[which, row]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        own = np.flatnonzero(self.keys[at] == key)
        which, row, piece = which[own], row[own], self.order[at[own]]
        cuts = np.searchsorted(which, np.arange(len(sizes) + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            own, size = slice(cuts[k], cuts[k + 1]), int(sizes[k])
            same = (rows[row[own], end - size : end] == self.bytes[piece[own], :size]).all(1)
            yield size, row[own][same], piece[own][same]

    def _parts(self, by_size: list[int], words: list[bytes]) -> Iterator[list[int]]:
        """Words taken at a time: fewer of long ones, and with many languages."""
        low = 0
        while low < len(by_size):
            longest = len(words[by_size[min(len(by_size), low + 8192) - 1]])
            n = max(64, min(8192, (1 << 19) // (longest * self.p.shape[1])))
            yield by_size[low : low + n]
            low += n

    @staticmethod
    def _matrix(words: list[bytes]) -> tuple[np.ndarray, ...]:
        """Words as rows, longest first, and their prefix hashes; powers that shift these back; their lengths; their places among ``words``."""
        sizes = np.array([len(w) for w in words])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        rows = np.zeros((len(words), sizes[0]), np.uint8)
        flat = np.frombuffer(b"".join([words[k] for k in order]), np.uint8)
        rows[np.arange(sizes[0]) < sizes[:, None]] = flat
        prefix = np.zeros((sizes[0] + 1, len(words)), np.uint64)
        np.cumsum(_BYTES[rows.T] * _powers(_BASE, sizes[0])[:, None], axis=0, dtype=np.uint64, out=prefix[1:])
        return rows, prefix, _powers(pow(_BASE, -1, 1 << 64), sizes[0] + 1), sizes, order

    def log_totals(self, words: list[bytes]) -> np.ndarray:
        """log of the summed probability of all segmentations: words x languages, by the forward algorithm."""
        out = np.zeros((len(words), self.p.shape[1]))
        by_size = sorted(range(len(words)), key=lambda k: len(words[k]))
        for part in self._parts(by_size, words):
            rows, prefix, back, sizes, order = self._matrix([words[k] for k in part])
            n, scale = len(rows), np.zeros(len(rows))
            ring = {0: np.ones((n, self.p.shape[1]))}
            for end in range(1, rows.shape[1] + 1):
                active = int(np.searchsorted(-sizes, -end, "right"))
                total = np.zeros((n, self.p.shape[1]))
                for size, hit, piece in self._found(rows, prefix, back, active, end):
                    total[hit] += ring[end - size][hit] * self.p[piece]
                ring[end] = total
                ring.pop(end - self.longest, None)
                done = np.flatnonzero(sizes[:active] == end)
                if len(done):
                    out[[part[k] for k in order[done]]] = np.log(total[done]) + scale[done][:, None]
                if end % 16 == 0:  # keep the ring's numbers near 1
                    most = np.maximum.reduce([x.max(1) for x in ring.values()])
                    most[most == 0] = 1
                    ring = {k: x / most[:, None] for k, x in ring.items()}
                    scale += np.log(most)
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected counts of pieces over all segmentations, by forward-backward; counts: words x languages."""
        out = np.zeros_like(self.p)
        by_size = sorted(range(len(words)), key=lambda k: len(words[k]))
        for part in map(np.array, self._parts(by_size, words)):
            rows, prefix, back, sizes, order = self._matrix([words[k] for k in part])
            weight, last = counts[part[order]], rows.shape[1]
            forward, arcs = [np.ones_like(weight)], []
            for end in range(1, last + 1):
                active = int(np.searchsorted(-sizes, -end, "right"))
                total = np.zeros_like(weight)
                for size, hit, piece in self._found(rows, prefix, back, active, end):
                    total[hit] += forward[end - size][hit] * self.p[piece]
                    arcs.append((end, size, hit, piece))
                forward.append(total)
            backward = [np.zeros_like(weight) for _ in range(last + 1)]
            whole = np.zeros_like(weight)
            for end in range(1, last + 1):
                own = sizes == end
                backward[end][own], whole[own] = 1, forward[end][own]
            shares = []
            for end, size, hit, piece in reversed(arcs):
                way = self.p[piece] * backward[end][hit]
                backward[end - size][hit] += way
                shares.append(forward[end - size][hit] * way / np.maximum(whole[hit], 1e-300) * weight[hit])
            pieces, shares = np.concatenate([a[3] for a in reversed(arcs)]), np.concatenate(shares)
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(pieces, shares[:, k], len(out))
        return out

    def fit(self, words: list[bytes], counts: np.ndarray, rounds: int = 3, smooth: float = 0.05) -> Model:
        for _ in range(rounds):
            seen = self.expected(words, counts) + smooth
            self.p = seen / seen.sum(0)
        return self


class Scorer:
    """A model and the distinct words it has scored so far, in about ``max_bytes``."""

    def __init__(self, model: Model, max_bytes: int = 32 << 20):
        self.model, self.max_words = model, max(1000, max_bytes // (240 + 16 * len(model.languages)))
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.log = np.zeros((1 << 12, len(self.model.languages) + 1))  # languages, number of words
        self.n = 0

    def rows(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if len(self.row) > self.max_words:
            self.clear()
        split = [split_words(t) for t in texts]
        new = [*{w for ws in split for w in ws if w not in self.row}]
        if new:
            words = [clean(w) for w in new]
            owner = np.repeat(np.arange(len(new)), [len(w) for w in words])
            log = np.zeros((len(new), self.log.shape[1]))
            if len(owner):
                np.add.at(log, owner, np.hstack([self.model.log_totals([x for w in words for x in w]), np.ones((len(owner), 1))]))
            while self.n + len(new) > len(self.log):
                self.log = np.vstack([self.log, np.zeros_like(self.log)])
            self.log[self.n : self.n + len(new)] = log
            self.row.update(zip(new, range(self.n, self.n + len(new)), strict=True))
            self.n += len(new)
        names, scores = [], np.zeros(len(texts))
        for k, ws in enumerate(split):
            total = self.log[[*map(self.row.__getitem__, ws)]].sum(0) if ws else np.zeros(self.log.shape[1])
            if not total[-1]:
                names.append("und")
                continue
            best = int(np.argmax(total[:-1]))
            names.append(self.model.languages[best])
            scores[k] = 1 / np.exp(np.minimum(total[:-1] - total[best], 0)).sum()
        return names, scores


def scorer_of(model: Model) -> Scorer:
    """The worker's scorer of this model: its table of distinct words outlives tasks."""
    key = hashlib.sha256(model.p.tobytes() + "\n".join(model.languages).encode()).digest()
    return held_by_worker(key, lambda: Scorer(model))


def learn(documents: DataFrame, per_language: int = 300, vocabulary_path: str | None = None) -> Model:
    """Piece probabilities from about ``per_language`` documents of each language, never held-out ones.

    The documents are those of smallest id hash, by a threshold on the hash that follows from the
    language's count, so one pass samples all languages; of rows with one id and language one is taken.
    Words are counted where the sample lies: only distinct words and their counts come to the driver.
    """
    spark = documents.sparkSession
    pieces = vocabulary(vocabulary_path or public_tokenizers.path("piece_bpe_32k.model"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = rows.groupBy("lang").count()
    languages = sorted(r["lang"] for r in counts.select("lang").collect())
    if not languages:
        return Model(pieces, [])
    drawn = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 31) - 1)) / F.lit(float(1 << 31))
    few = F.broadcast(counts) if len(languages) < 10_000 else counts  # a row for each language
    sample = rows.join(few, "lang").where(drawn < per_language / F.col("count"))
    sample = sample.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")

    def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            tally: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for candidate, n in Counter(split_words(text)).items():
                    for w in clean(candidate):
                        tally[lang, w] += n
            columns = [[k[0] for k in tally], [k[1] for k in tally], [*tally.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64()), strict=True)], ["lang", "word", "n"])

    found = sample.mapInArrow(tallies, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    if not found.num_rows:
        return Model(pieces, languages)
    kinds = [np.unique(np.array(found.column(c).to_pylist(), object), return_inverse=True) for c in ("word", "lang")]
    number = np.array([languages.index(x) for x in kinds[1][0]])
    tally = np.zeros((len(kinds[0][0]), len(languages)))
    tally[kinds[0][1], number[kinds[1][1]]] = np.asarray(found.column("n"))
    return Model(pieces, languages).fit(kinds[0][0].tolist(), np.sqrt(tally))


def identify(documents: DataFrame, model: Model) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a number for each piece and language

    def make():
        scorer = scorer_of(shared.value)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores = [], []
            for part in in_parts([x.as_py() or "" for x in batch.column(2)], 1 << 18):
                if not shared.value.languages:
                    names, scores = [*names, *["und"] * len(part)], [*scores, np.zeros(len(part))]
                    continue
                found = scorer.rows(part)
                names += found[0]
                scores.append(found[1])
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["doc_id", "held_out", "lang_pred", "score"])

        return one

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, make, SCHEMA)


def keep(documents: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The documents in a learned language, with all their columns: rejected are ``und`` and scores below ``least_score``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        if not shared.value.languages:
            return lambda texts: np.zeros(len(texts), bool)
        scorer = scorer_of(shared.value)

        def wanted(texts: list[str]) -> np.ndarray:
            out = [np.zeros(0, bool)]
            for part in in_parts(texts, 1 << 18):
                names, scores = scorer.rows(part)
                out.append((np.array(names) != "und") & (scores >= least_score))
            return np.concatenate(out)

        return wanted

    return keep_rows(documents, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return identify(documents, learn(documents))
