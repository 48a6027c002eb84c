"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each document is cut into whole windows and a rest. Whole windows are sequences of their own; a
rest goes, online, to the fill level that keeps the sum of squared counts of partially filled
windows smallest. The counts are a level array ``count[h]`` = open windows filled to ``h``: moving
a window from ``h`` to ``h + size`` changes the sum by ``2 * (count[h + size] - count[h]) + 2``, one
less if that fills it or if it is new, so a placement is one
vectorised minimum over the array. Ties go to the fuller level.

Every task packs what it reads and shuffles nothing. When its input ends, or when ``max_open``
windows are open (all rests just over half a window would otherwise keep every window open), the
open windows are closed exactly: the emptiest are poured, cut where needed, into the fullest, and
what is left is cut into powers of two, lengths at which no padding is needed. This bound on a
task's memory is the one departure from sum-of-squares placement; it drops and pads nothing.

A document's ids are those of the tokenizer and one end id, so a null or empty text is one id.
Sequence ids are unique (task number and a counter), not dense. One id lies in exactly one piece.
Repeated rows are documents of their own, each with its pieces; equal fills are ties, which go to the
window opened last. A null ``doc_id`` is kept. An empty table gives no piece. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import held_by_worker, sliced, table

WINDOW, END_ID = 2048, 1
KEEP = 96
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Punctuation that never joins a letter or digit before it in one pre-token. No apostrophe: contractions hold it.
_TAIL = b".,!?:;*#$%&|"


class WordTable(dict):
    """Lower-cased chunk between spaces -> its ids as 16-bit integers, each distinct chunk tokenised once.

    The tokenizer drops white space and no pre-token holds any, so chunks are independent. ASCII is
    lowered first, as the tokenizer would do; text with ``<|`` keeps its case, because its special
    tokens are looked up before lower-casing. A chunk of Latin letters is one pre-token, and goes
    straight to the tokenizer's model. The table outlives tasks in a reused worker and is emptied
    when it holds ``max_words`` chunks.
    """

    def __init__(self, path: str, max_words: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        self.max_words = max_words
        self.tokenize = self.tokenizer.model.tokenize
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the public byte-to-character map of byte-level BPE
        others = [b for b in range(256) if b not in printable]
        self.visible = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}

    def __missing__(self, chunk: bytes) -> bytes:
        core = chunk.rstrip(_TAIL)
        if core and len(core) < len(chunk) and self._joins_nothing(core):
            value = self[core] + self[chunk[len(core) :]]
        else:
            value = self._encode(chunk)
        if len(chunk) <= KEEP:
            self[chunk] = value
        return value

    @staticmethod
    def _joins_nothing(core: bytes) -> bool:
        """Whether what follows starts a pre-token of its own: the core ends, lower-cased, in a letter or digit that
        normalising leaves whole (beyond Latin letters some fall apart into a letter and a mark, which joins punctuation)."""
        last = core.decode()[-1]
        return last < "\u0250" and (last.isdecimal() or (last.isalpha() and last.lower().isalpha()))

    def _encode(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if text.isalpha() and max(text) < "\u0250" and (low := text.lower()).isalpha():
            if not low.isascii():
                low = low.encode().decode("latin-1").translate(self.visible)
            return array("H", [x.id for x in self.tokenize(low)]).tobytes()
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if len(self) > self.max_words:
            self.clear()
        raw = text.encode()
        if b"<|" not in raw:
            raw = raw.lower()
        return np.frombuffer(b"".join(map(self.__getitem__, raw.replace(b"\n", b" ").split(b" "))), "<u2")


def word_table(path: str, max_words: int = 200_000) -> WordTable:
    return held_by_worker(("words", path, max_words), lambda: WordTable(path, max_words))


class Packer:
    """Online packer; ``emit(doc_id, start, ids, doc_tokens, sequence, offset)`` gets each final piece."""

    def __init__(self, emit: Callable, window: int = WINDOW, max_open: int = 2048, first_sequence: int = 0):
        self.emit, self.window, self.max_open, self.next = emit, window, max_open, first_sequence
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}  # fill -> windows, each a list of pieces
        self.n_open = 0

    def _sequence(self, pieces: Iterable[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, tokens in pieces:
            self.emit(doc_id, start, ids, tokens, self.next, offset)
            offset += len(ids)
        self.next += 1

    def level(self, size: int) -> int:
        """The fill level to put a rest of this size on; 0 opens a window."""
        top = self.window - size
        change = 2 * (self.count[size : self.window + 1] - self.count[: top + 1]) + 2  # the full level's count stays 0
        change[top] -= 1  # no square is added for a full window,
        change[0] -= 1  # and none goes for a new one
        change[1:][self.count[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        whole = n - n % w
        for start in range(0, whole, w):
            self._sequence([(doc_id, start, ids[start : start + w], n)])
        if not (size := n - whole):
            return
        piece = (doc_id, whole, ids[whole:].copy(), n)
        h = self.level(size)
        if h:
            own = self.open[h].pop()
            self.count[h] -= 1
            self.n_open -= 1
        else:
            own = []
        own.append(piece)
        if h + size == w:
            self._sequence(own)
            return
        self.open.setdefault(h + size, []).append(own)
        self.count[h + size] += 1
        self.n_open += 1
        if self.n_open >= self.max_open:
            self.close()

    def close(self) -> None:
        """Closes all open windows: the emptiest are poured into the fullest, the last is cut into powers of two."""
        queue = [own for h in sorted(self.open, reverse=True) for own in self.open[h]]
        self.open, self.n_open = {}, 0
        self.count[:] = 0
        low, high = 0, len(queue) - 1
        while low < high:
            own = queue[low]
            room = self.window - sum(len(p[2]) for p in own)
            while room and low < high:
                doc_id, start, ids, tokens = queue[high].pop()
                own.append((doc_id, start, ids[:room], tokens))
                if len(ids) > room:
                    queue[high].append((doc_id, start + room, ids[room:], tokens))
                room -= min(room, len(ids))
                if not queue[high]:
                    high -= 1
            if not room:
                self._sequence(own)
                low += 1
        if low == high:
            self._powers(queue[low])

    def _powers(self, own: list) -> None:
        left = sum(len(p[2]) for p in own)
        own = own[::-1]
        while left:
            room = min(1 << (left.bit_length() - 1), self.window)
            left -= room
            pieces = []
            while room:
                doc_id, start, ids, tokens = own.pop()
                pieces.append((doc_id, start, ids[:room], tokens))
                if len(ids) > room:
                    own.append((doc_id, start + room, ids[room:], tokens))
                room -= min(room, len(ids))
            self._sequence(pieces)


def pack(documents: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, max_open: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece: its place in its document and in its sequence; ``with_ids`` adds the ids themselves."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    schema = SCHEMA + (", ids binary" if with_ids else "")
    kinds = [pa.int64()] * 7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rows, end = word_table(path), [], np.array([end_id], "<u2")

        def emit(doc_id, start, ids, tokens, sequence, offset):
            raw = ids.astype("<u4").tobytes()
            row = (doc_id, start, len(ids), zlib.crc32(raw), tokens, sequence, offset)
            rows.append(row + ((raw,) if with_ids else ()))

        def out():
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(columns, [*kinds, pa.binary()], strict=False)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

        packer = Packer(emit, window, max_open, TaskContext.get().partitionId() << 40)
        for batch in sliced(batches):
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                packer.add(doc_id.as_py(), np.concatenate([words.encode(text.as_py() or ""), end]))
            if len(rows) > 5000:
                yield out()
        packer.close()
        if rows:
            yield out()

    return documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
