"""SentencePiece encoding and decoding through a table of distinct chunks (``op2_sentencepiece_chunks``).

The library writes every space as a marker, puts one more in front of a text that isn't empty, and merges
pieces inside the marked text. If no piece of a model holds a marker behind another character
(``check_model`` makes sure), merging never crosses the place in front of a run of markers: the marked
text falls apart into chunks, each a run of markers and what follows up to the next marker, that are
segmented independently of one another. A worker keeps a table of the distinct chunks it has met: each
is segmented once by the library, and a text's ids are those of its chunks, looked up in order and
joined by position. Decoding takes the joined ids through the library's decoder.

The table has at most ``TABLE_CHUNKS`` entries (emptied beyond that; chunks of over 64 characters
aren't kept); its size never changes a result. Texts are read and written row by row without a shuffle.

Defined cases: null texts are empty; an empty text has the begin and end ids only and decodes to the empty
text; a marker character in a text counts as a space, as in the library. Every row is its own document.
"""

from __future__ import annotations

import hashlib
import re
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlprism.llm.common import map_arrow, table

MARK = "▁"
TABLE_CHUNKS = 400_000
_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")


def check_model(model) -> None:
    """Raises ValueError unless chunks of ``model`` are independent of one another."""
    for i in range(model.vocab_size()):
        if MARK in model.id_to_piece(i).lstrip(MARK):
            raise ValueError(f"piece {i} crosses a marker: encode whole texts instead")


class ChunkTable:
    """Chunk -> ids as little-endian 32-bit integers."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        check_model(self.model)
        self.known: dict[str, bytes] = {}

    def _segment(self, chunks: list[str]) -> list[bytes]:
        # the library adds one marker itself; a lone marker can't be asked for that way
        ids = self.model.encode([chunk[1:].replace(MARK, " ") for chunk in chunks], num_threads=1)
        lone = [self.model.piece_to_id(MARK)]
        ids = [i or lone for i in ids]
        raw = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        ends = [4 * e for e in accumulate(map(len, ids))]
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def of(self, texts: list[list[str]]) -> dict[str, bytes]:
        """A table that holds all chunks of ``texts``."""
        known = self.known
        if len(known) > TABLE_CHUNKS:
            known.clear()
        new = list(set().union(*texts).difference(known))
        found = dict(zip(new, self._segment(new), strict=True)) if new else {}
        if all(len(c) <= 64 for c in new):
            known.update(found)
            return known
        table = {**known, **found}
        known.update((c, i) for c, i in found.items() if len(c) <= 64)
        return table


_TABLES: dict[str, ChunkTable] = {}


def _table(path: str) -> ChunkTable:
    if path not in _TABLES:
        _TABLES[path] = ChunkTable(path)
    return _TABLES[path]


def chunks(text: str | None) -> list[str]:
    return _CHUNKS.findall(MARK + text.replace(" ", MARK)) if text else []


def decoded(model, ids: list[bytes]) -> list[str]:
    return model.decode([np.frombuffer(i, "<u4").tolist() for i in ids], num_threads=1) if ids else []


def encode(docs: DataFrame, model: str, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids with begin and end id as little-endian 32-bit integers, and the
    text that they decode to. ``keep_text`` false gives both as SHA-256 instead (ids_sha256, decoded_sha256)."""

    def run(batch: pa.RecordBatch):
        own = _table(model)
        begin, end = (np.array([i], "<u4").tobytes() for i in (own.model.bos_id(), own.model.eos_id()))
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            split = [chunks(t) for t in some.column("text").to_pylist()]
            ids_of = own.of(split)
            ids = [begin + b"".join([ids_of[c] for c in cs]) + end for cs in split]
            texts = [t.encode() for t in decoded(own.model, ids)]
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            if keep_text:
                out = [pa.array(ids, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string())]
            else:
                out = [pa.array([hashlib.sha256(x).hexdigest() for x in xs]) for xs in (ids, texts)]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), counts, *out], names=names)

    names = ["doc_id", "n_tokens", "ids", "decoded"] if keep_text else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    kinds = ["long", "long", "binary", "string"] if keep_text else ["long", "long", "string", "string"]
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run,
                     ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids), ids as little-endian 32-bit integers of any origin (null: empty)."""

    def run(batch: pa.RecordBatch):
        own = _table(model).model
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            texts = decoded(own, [i or b"" for i in some.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.select(F.col("doc_id").cast("long"), "ids"), run, "doc_id long, text string")


def op2_sentencepiece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_text=False)
