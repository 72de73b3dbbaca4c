"""Blocks of documents as rows, and exchanges of their sorted keys by hash range.

Shared by operators that count n-grams over everything: a block is written once (so that its number and its texts stay the same
however often a later stage is computed), asks the tasks of hash ranges about its distinct keys, and gets one answer per key
in the order asked. A key that is frequent everywhere costs one entry per block, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sqlprism.llm.blocks import U64
from sqlprism.llm.common import cut


def blocked(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Table (block, bytes, data): the rows of ``rows`` in blocks of about ``block_bytes`` bytes of their column ``text``, each
    packed and compressed (``rows_of``); a larger text is a block of its own. ``block`` is unique and fixed, as the table is
    written out."""
    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as writer:
                writer.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                              names=["block", "bytes", "data"])

        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy().astype(np.int64)
            at = 0
            while at < batch.num_rows:
                room = np.searchsorted(np.cumsum(sizes[at:]), block_bytes - size, side="right")
                if room == 0 and held:
                    yield block()
                    number, held, size = number + 1, [], 0
                    continue
                take = max(int(room), 1)
                held.append(batch.slice(at, take))
                size += int(sizes[at:at + take].sum())
                at += take
        if held:
            yield block()

    return cut(rows.mapInArrow(run, "block long, bytes long, data binary"))


def rows_of(data: pa.BinaryScalar) -> pa.RecordBatch:
    """The rows of a block."""
    table = pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)


def planes(values: np.ndarray) -> bytes:
    """Integers as byte planes, as many as the largest needs (their number goes first): equal high bytes lie together."""
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T[:width].tobytes() + len(values).to_bytes(4, "little")


def unplanes(raw: bytes) -> np.ndarray:
    out = np.zeros((int.from_bytes(raw[-4:], "little"), 8), np.uint8)
    out[:, :raw[0]] = np.frombuffer(raw, np.uint8, offset=1, count=len(raw) - 5).reshape(raw[0], -1).T if raw[0] else 0
    return out.view("<u8").reshape(-1).astype(U64)


def by_range(keys: np.ndarray, values: np.ndarray, ranges: int) -> Iterator[tuple[bytes, bytes]]:
    """Keys and values of every hash range of sorted distinct 64-bit keys, coded for the exchange."""
    starts = np.array([-(-(r << 64) // ranges) for r in range(ranges)], U64)
    cuts = np.searchsorted(keys, starts[1:])
    for start, k, v in zip(starts, np.split(keys, cuts), np.split(values, cuts), strict=True):
        yield planes(np.diff(k, prepend=start)), planes(v)


def keys_of(raw: bytes, part: int, ranges: int) -> np.ndarray:
    """Sorted keys that ``by_range`` coded for a range."""
    deltas = unplanes(raw)
    return np.cumsum(deltas, dtype=U64) + U64(-(-(part << 64) // ranges))
