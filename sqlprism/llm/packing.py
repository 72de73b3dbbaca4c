"""Packing of tokenised documents into fixed windows by the sum-of-squares rule (``op1_sum_of_squares_packing``).

A document's ids are those of a public tokenizer file (special tokens not added) followed by an end id.
Documents are taken in the order in which a task reads them. What exceeds a window is cut into full
windows; the rest is placed online by the sum-of-squares rule: with N(h) partially filled windows at
fill level h, the item of s ids goes to the level h (0: a new window) that makes the sum of N(h)^2
least, full windows not counted. N is one array over the levels, and the change of the sum for every
h is a difference of two slices of it.

Windows still open when a task's rows end are closed by cutting: the fullest one is filled with ids cut
from the emptiest. So a task leaves at most one partial window; that one is written as sequences of
power-of-two lengths, which need no padding. Tasks pack on their own, without a shuffle: sequence
numbers carry the task's partition number in the high bits, and a task that runs again after a loss
packs the same rows in the same order.

Words between ASCII white space are told apart by hash within a block of texts, encoded once per worker and kept
(by their bytes) in a table of bounded size: white
space is dropped before words are split off, so a text's ids are its words' ids in a row (A-Z are
lower-cased first, as the tokenizer does, unless the text holds the opening of a special token).

Defined cases: null and empty texts hold the end id only; repeated rows are packed like any others; an
empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlprism.llm.blocks import find_words, text_blocks, word_hashes
from sqlprism.llm.common import table

WINDOW = 4096
END_ID = 2
TABLE_WORDS = 400_000
ENCODE_BYTES = 4 << 20

_MARK, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?*$%#&")] = True
_ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True


class WordTable:
    """Ids of words as little-endian 32-bit integers, each distinct word encoded once while the table is
    below ``TABLE_WORDS`` entries (it is emptied beyond that; words of over 64 bytes aren't kept)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word. Words of letters only end in exactly one word-end piece, so many of them are
        encoded as one text and told apart by those pieces."""
        texts = [w.decode() for w in words]
        letters = [w.isalpha() or (t.isalpha() and max(t) < "\u0250") for w, t in zip(words, texts, strict=True)]
        out: list[bytes | None] = [None] * len(words)
        plain = [i for i, x in enumerate(letters) if x]
        for at in range(0, len(plain), 1000):
            some = plain[at:at + 1000]
            ids = self._ids([" ".join([texts[i] for i in some])])[0]
            ends = (4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist()
            if len(ends) == len(some):
                raw, begin = ids.tobytes(), 0
                for i, end in zip(some, ends, strict=True):
                    out[i] = raw[begin:end]
                    begin = end
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._ids([texts[i] for i in rest]), strict=True):
            out[i] = ids.tobytes()
        return out

    def of(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of some distinct words."""
        known = self.known
        if len(known) > TABLE_WORDS:
            known.clear()
        new = [w for w in words if w not in known]
        ids = dict(zip(new, self._encode(new), strict=True))
        out = [ids[w] if w in ids else known[w] for w in words]
        known.update(ids if all(len(w) <= 64 for w in new) else {w: i for w, i in ids.items() if len(w) <= 64})
        return out


_TABLES: dict[str, WordTable] = {}


def encoded(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """Ids of each text of a column, without special tokens and without the end id."""
    if path not in _TABLES:
        _TABLES[path] = WordTable(path)
    for _, _, data, offsets in text_blocks(column, ENCODE_BYTES):
        # in front of ASCII marks behind an ASCII letter or digit there is always a split: fewer distinct words
        cuts = np.zeros(len(data), bool)
        cuts[1:] = _MARK[data[1:]] & _ALNUM[data[:-1]]
        plain = find_words(data, offsets, lower=True, cuts=cuts)
        raw = data.tobytes()
        if b"<|" in raw:  # these texts keep their case
            lowered = plain.data
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if b"<|" in raw[a:b]:
                    lowered[a:b] = data[a:b]
        raw = plain.data.tobytes()
        _, at, which = np.unique(word_hashes(plain), return_index=True, return_inverse=True)
        ids = _TABLES[path].of([raw[a:b] for a, b in zip(plain.starts[at].tolist(), plain.ends[at].tolist(), strict=True)])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        begin, count = (np.cumsum(size) - size)[which], size[which]
        place = np.cumsum(count) - count
        joined = flat[np.arange(int(count.sum())) + np.repeat(begin - place, count)]
        first = np.append(0, np.cumsum(count))[plain.first]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield joined[a:b]


class SumOfSquares:
    """Online packing of items of 1 to ``window`` - 1 ids; ``close`` empties the open windows."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.next = window, first_sequence
        self.level = np.zeros(window + 1, np.int64)  # partially filled windows by fill level; 0 and full stay 0
        self.open: dict[int, list[list]] = {}  # their contents: [(piece, length), ..] by fill level

    def sequence(self, pieces):
        """(piece, start in the piece, length, sequence, offset) for pieces put in a new sequence."""
        self.next += 1
        offset = 0
        for piece, start, length in pieces:
            yield piece, start, length, self.next - 1, offset
            offset += length

    def place(self, piece, start: int, size: int):
        n, w = self.level, self.window
        # sum of squares after moving one window from level h to h + size, less the sum before, less 2
        change = np.where(n[:w + 1 - size] > 0, 2 * (n[size:w + 1] - n[:w + 1 - size]), np.iinfo(np.int64).max)
        change[0] = 2 * n[size] - 1  # a new window leaves no level behind
        change[-1] -= 1 if n[w - size] else 0  # a full window isn't counted
        h = int(np.argmin(change))
        content = [] if h == 0 else self.open[h].pop()
        if h:
            n[h] -= 1
        content.append((piece, start, size))
        if h + size == w:
            return self.sequence(content)
        n[h + size] += 1
        self.open.setdefault(h + size, []).append(content)
        return ()

    def close(self):
        """Fills the fullest open window with ids cut from the emptiest, until one is left; that one goes
        into sequences of power-of-two lengths."""
        rest = [(fill, content) for fill in sorted(self.open) for content in self.open[fill]]
        self.open, self.level = {}, np.zeros_like(self.level)
        a, b = 0, len(rest) - 1
        fills = [f for f, _ in rest]
        while a < b:
            content = rest[b][1]
            room = self.window - fills[b]
            while room and a < b:
                source = rest[a][1]
                piece, start, length = source.pop()
                part = min(room, length)
                if part < length:
                    source.append((piece, start, length - part))
                content.append((piece, start + length - part, part))
                fills[a] -= part
                room -= part
                if not source:
                    a += 1
            if room:
                fills[b] = self.window - room
                break
            yield from self.sequence(content)
            b -= 1
        if a <= b and rest:
            left = rest[b][1]
            total = sum(x[2] for x in left)
            for bit in range(total.bit_length() - 1, -1, -1):
                if total >> bit & 1:
                    need, pieces = 1 << bit, []
                    while need:
                        piece, start, length = left.pop(0)
                        part = min(need, length)
                        if part < length:
                            left.insert(0, (piece, start + part, length - part))
                        pieces.append((piece, start, part))
                        need -= part
                    yield from self.sequence(pieces)


SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """One row per piece: its document, the piece's ids (little-endian 32-bit), and its sequence and offset there."""

    def run(batches):
        part = TaskContext.get().partitionId()
        packer = SumOfSquares(window, part << 40)
        end = np.array([end_id], "<u4").tobytes()

        def piece_rows(placed):
            for (doc_id, size, first, ids), start, length, sequence, offset in placed:  # ids: those from ``first`` on
                raw = ids[4 * (start - first):4 * (start - first + length)]
                yield doc_id, start, length, zlib.crc32(raw), size, sequence, offset, raw if keep_ids else None

        def rows():
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1), tokenizer), strict=True):
                    ids = ids.tobytes() + end
                    size = len(ids) // 4
                    whole = size - size % window
                    for start in range(0, whole, window):
                        yield from piece_rows(packer.sequence([((doc_id, size, 0, ids), start, window)]))
                    if size > whole:  # an open window keeps the last ids of a document, not all of them
                        yield from piece_rows(packer.place((doc_id, size, whole, ids[4 * whole:]), whole, size - whole))
            yield from piece_rows(packer.close())

        kinds = [pa.int64()] * 7 + [pa.binary()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for some in batched(rows(), 512):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)],
                                             names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False).drop("ids")
