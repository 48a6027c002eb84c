"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary holds a whitespace marker after another character, so no merge crosses
the start of a run of markers: the text, marked, falls into chunks (a run of markers and what
follows it) whose segmentations are independent. Each distinct chunk is segmented once and the ids
are joined back by position; decoding joins the chunks' decoded texts in the same way. A model
without that property raises ``ValueError`` instead of giving other ids.

The table outlives tasks in a reused worker and is emptied when it holds ``max_chunks`` chunks, so
its memory is bounded; chunks over ``KEEP`` characters are never kept.

Nulls and empty texts: only the begin and end ids, decoded to the empty text. One row in, one row out.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, held_by_worker, table

MARK = "▁"
KEEP = 128
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ChunkCodec:
    """Encodes whole texts to little-endian unsigned 32-bit ids, and decodes them, chunk by chunk."""

    _runs = re.compile(f"{MARK}+[^{MARK}]*")

    def __init__(self, model: str, max_chunks: int = 200_000):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=model)
        crossing = [x for x in map(p.id_to_piece, range(p.vocab_size())) if re.search(f"[^{MARK}]{MARK}", x)]
        if crossing or p.encode(" a") == p.encode("a"):
            raise ValueError(f"pieces of this model can cross whitespace markers: {crossing[:3]}")
        self.max_chunks = max_chunks
        self.begin, self.end, self.mark = (array("I", [x]).tobytes() for x in (p.bos_id(), p.eos_id(), p.piece_to_id(MARK)))
        self.table: dict[str, bytes] = {}
        self.other: dict[str, str] = {}  # chunk -> what it decodes to, where that is not the chunk itself

    def chunks(self, text: str) -> list[str]:
        """The marked text's chunks, each without its first marker (which encoding adds again)."""
        if not text:
            return []
        parts = text.split(" ")
        if MARK in text or "" in parts:
            return [c[1:] for c in self._runs.findall(MARK + text.replace(" ", MARK))]
        return parts

    def rows(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids, with begin and end, and the text they decode to."""
        if len(self.table) > self.max_chunks:
            self.table, self.other = {}, {}
        split = [self.chunks(x) for x in texts]
        new = list({c for parts in split for c in parts if c not in self.table})
        found = self.processor.encode(new, num_threads=1)
        ids = {c: array("I", x).tobytes() for c, x in zip(new, found, strict=True)}
        texts = self._decoded(new, found)
        if "" in ids:  # one marker alone, which encode() does not give
            ids[""], texts[""] = self.mark, ""
        self.table.update(ids)
        self.other.update(texts)
        out = []
        for parts in split:
            row = b"".join([self.begin, *map(self.table.__getitem__, parts), self.end])
            if self.other and not self.other.keys().isdisjoint(parts):
                parts = [self.other.get(c, c) for c in parts]
            out.append((row, " ".join(parts)))
        for c in new:
            if len(c) > KEEP:
                del self.table[c]
                self.other.pop(c, None)
        return out

    def _decoded(self, chunks: list[str], found: list[list[int]]) -> dict[str, str]:
        """The chunks whose ids decode to something else than the chunk, with what they decode to.

        Chunks without markers or spaces are decoded in one call, with one space between each.
        """
        plain = [(c, x) for c, x in zip(chunks, found, strict=True) if c and " " not in c and MARK not in c]
        at_once = self.processor.decode([i for _, x in plain for i in x]).split(" ") if plain else []
        if len(at_once) == len(plain):
            rest = [(c, x) for c, x in zip(chunks, found, strict=True) if not c or " " in c or MARK in c]
            texts = {c: t for (c, _), t in zip(plain, at_once, strict=True) if c != t}
        else:
            rest, texts = zip(chunks, found, strict=True), {}
        return texts | {c: t for c, x in rest if (t := self.processor.decode(x)) != c}

    def batches(self, texts: pa.Array, limit: int = 1 << 18):
        """The rows of all texts, about ``limit`` characters at a time."""
        held, size = [], 0
        for x in texts:
            held.append(x.as_py() or "")
            size += len(held[-1])
            if size >= limit:
                yield from self.rows(held)
                held, size = [], 0
        yield from self.rows(held)


def codec(model: str, max_chunks: int) -> ChunkCodec:
    return held_by_worker(("chunks", model, max_chunks), lambda: ChunkCodec(model, max_chunks))


def encode_decode(documents: DataFrame, model: str | None = None, max_chunks: int = 200_000) -> DataFrame:
    """doc_id, ids (binary, little-endian uint32) and decoded text of each document: the operator itself."""
    model = model or public_tokenizers.path("piece_bpe_32k.model")

    def make():
        coder = codec(model, max_chunks)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [*coder.batches(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["doc_id", "ids", "decoded"])

        return one

    return arrow_map(documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), make, "doc_id long, ids binary, decoded string")


def digests(documents: DataFrame, model: str | None = None, max_chunks: int = 200_000) -> DataFrame:
    """One row per document: number of ids and digests of ids and of the decoded text, so that ids never leave the worker."""
    model = model or public_tokenizers.path("piece_bpe_32k.model")

    def make():
        coder = codec(model, max_chunks)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, ids_sha, text_sha = [], [], []
            for ids, text in coder.batches(batch.column(1)):
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(text.encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return one

    return arrow_map(documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), make, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
