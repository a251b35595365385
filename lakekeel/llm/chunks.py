"""Texts in compressed chunks of bounded size, and the integers that several chunks have in common.

A chunk is what a task works on with numpy: some rows as one compressed Arrow stream. Chunks are written once, in
buckets by number, so results that come back to a chunk meet its texts without moving them. ``shared`` tells every
chunk which of its numbers are frequent over all chunks: sorted numbers travel as differences, a byte or two each.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekeel.llm.common import stage_by

PART = 1 << 20  # numbers that one group compares, about
SPARE = 6  # bits of a number beyond those that tell all numbers apart: one in 2 ** SPARE meets another by chance

_MIX = np.uint64(0x9E3779B97F4A7C15)


def freeze(batches: list[pa.RecordBatch], level: int = 1) -> bytes:
    sink = pa.BufferOutputStream()
    how = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))
    with pa.ipc.new_stream(sink, batches[0].schema, options=how) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def thaw(data: pa.Scalar | bytes) -> pa.RecordBatch:
    buffer = data.as_buffer() if isinstance(data, pa.Scalar) else pa.py_buffer(data)
    table = pa.ipc.open_stream(buffer).read_all().combine_chunks()
    batches = table.to_batches()
    return batches[0] if batches else pa.RecordBatch.from_pylist([], table.schema)


def columns_of(**arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays.values()], names=list(arrays))


def pack(rows: DataFrame, text: str, size: int, label: str) -> DataFrame:
    """(chunk, n_bytes, data): ``rows`` in chunks of about ``size`` bytes of ``text``, staged in buckets by chunk.

    A longer text is a chunk of its own. Rows of a chunk keep their order, so a row is a chunk and a place in it.
    """
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([weight], pa.int64()), pa.array([freeze(held, 4)], pa.binary())], names=["n_bytes", "data"])

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
            upto, lo = np.cumsum(sizes), 0
            while lo < len(sizes):
                before = upto[lo - 1] if lo else 0
                hi = max(int(np.searchsorted(upto, before + size - weight, side="right")), lo if held else lo + 1)
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
                    weight += int(upto[hi - 1] - before)
                lo = hi
                if lo < len(sizes):
                    yield out()
                    held, weight = [], 0
        if held:
            yield out()

    chunks = rows.mapInArrow(run, "n_bytes bigint, data binary").select(F.monotonically_increasing_id().alias("chunk"), "*")
    return stage_by(chunks, "chunk", int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), label)


def sliced(rows: pa.RecordBatch, at: int, size: int) -> Iterator[pa.RecordBatch]:
    """``rows`` in order, in slices of about ``size`` bytes of column ``at``; a longer text is a slice of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(rows.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    lo = 0
    while lo < len(upto):
        hi = max(int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + size, side="right")), lo + 1)
        yield rows.slice(lo, hi - lo)
        lo = hi


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column one after the other, and where each row begins (and the last one ends)."""
    filled = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset:filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (whole[offsets[0]:offsets[-1]], offsets - offsets[0]) if len(filled) else (whole[:0], np.zeros(1, np.int64))


# ---- sorted numbers as bytes ------------------------------------------------------------------------------------


def _planes(values: np.ndarray) -> tuple[int, bytes]:
    """Numbers as the planes of their lowest bytes: planes of zeros cost next to nothing once compressed."""
    width = max((int(values.max()).bit_length() + 7) // 8, 1) if len(values) else 1
    return width, values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(planes: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def encode(values: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Sorted distinct numbers, with a count each (None: ones)."""
    wide, steps = _planes(np.diff(values, prepend=np.uint64(0)))
    thin, times = (0, b"") if counts is None else _planes(counts)
    return struct.pack("<IBB", len(values), wide, thin) + pa.compress(steps + times, codec="zstd", asbytes=True)


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, wide, thin = struct.unpack_from("<IBB", data)
    plain = pa.decompress(data[6:], decompressed_size=n * (wide + thin), codec="zstd", asbytes=True)
    values = np.cumsum(_numbers(plain[:n * wide], n, wide), dtype=np.uint64)
    return values, _numbers(plain[n * wide:], n, thin).astype(np.int64) if thin else np.ones(n, np.int64)


def mixed(state: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A 64-bit hash carried on by 64 more bits."""
    out = (state ^ more) * _MIX
    return out ^ (out >> np.uint64(29))


# ---- numbers in common ------------------------------------------------------------------------------------------


def shape(total: int) -> tuple[int, int]:
    """(bits, parts) for about ``total`` numbers: parts of ``PART`` numbers, few enough bits to travel light."""
    return min(max(max(total, 1).bit_length() + SPARE, 24), 62), max(-(-total // PART), 1)


def shared(
    chunks: DataFrame, values: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray | None]], bits: int, parts: int,
    least: int,
) -> DataFrame:
    """(chunk, part, data): the numbers of each chunk whose counts over all chunks come to ``least``, encoded.

    ``values`` gives a chunk's sorted distinct numbers below 2 ** bits and their counts. A number is one entry a
    chunk however often it occurs there, so none is a hot spot; a part is a range of numbers and is compared alone.
    """
    bounds = np.array([(p << bits) // parts for p in range(parts + 1)], np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, counts = values(thaw(data))
                cuts = np.searchsorted(found, bounds)
                some = np.flatnonzero(cuts[1:] > cuts[:-1])
                coded = [encode(found[cuts[p]:cuts[p + 1]], None if counts is None else counts[cuts[p]:cuts[p + 1]])
                         for p in some.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), chunk, np.int64)), pa.array(some.astype(np.int32)), pa.array(coded, pa.binary())],
                    names=["chunk", "part", "data"])

    def meet(group: pa.Table) -> pa.Table:
        each = [decode(d) for d in group.column("data").to_pylist()]
        every = np.concatenate([v for v, _ in each])
        order = np.argsort(every)
        every = every[order]
        first = np.flatnonzero(np.diff(every, prepend=every[:1] ^ np.uint64(1)))
        sums = np.add.reduceat(np.concatenate([c for _, c in each])[order], first)
        often = every[first[sums >= least]]
        back = [v[among(v, often)] for v, _ in each]
        keep = [k for k, v in enumerate(back) if len(v)]
        return pa.table({
            "chunk": group.column("chunk").take(pa.array(keep, pa.int64())),
            "part": group.column("part").take(pa.array(keep, pa.int64())),
            "data": pa.array([encode(back[k]) for k in keep], pa.binary()),
        })

    schema = "chunk bigint, part int, data binary"
    return chunks.select("chunk", "data").mapInArrow(send, schema).groupBy("part").applyInArrow(meet, schema)


def merged(parts: pa.Table) -> np.ndarray:
    """The numbers that came back to a chunk, sorted."""
    order = np.argsort(parts.column("part").to_numpy()) if len(parts) else []
    data = parts.column("data").to_pylist()
    return np.concatenate([np.zeros(0, np.uint64), *(decode(data[k])[0] for k in order)])


def among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_set, values)
    hit = at < len(sorted_set)
    hit[hit] = sorted_set[at[hit]] == values[hit]
    return hit
