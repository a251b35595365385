"""Repeated passages by a suffix array built in blocks, with a difference cover for long ties.

Every 50-byte string at i meets every other at j in a position of the cover: among 13 offsets there is one at which
both i and j, counted from the starts of their documents, fall on a residue of ``COVER``. So

1. the cover sample of all texts (windows of 38 bytes at those residues) tells which suffixes can have a partner:
   those with a sample within 13 bytes that some other document, or chunk, has too. All others are unique;
2. the suffixes that are left go to blocks by the least hash of 16 bytes within their 50: equal strings share it, and
   neighbours mostly do, so that a run of suffixes travels as one piece of text. A chunk sends each piece once;
3. each block is sorted alone: by 16 bytes, then by the ranks of the block's cover sample at the offset that two tied
   suffixes share, then by their last 13 bytes. Runs of equal strings give the least doc_id back to their pieces;
4. a chunk marks the bytes that strings of smaller ids cover.

Memory is bounded by the size of a chunk and of a block; both follow from parameters, not from the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekeel.llm.chunks import (
    among, columns_of, freeze, merged, mixed, pack, shape, shared, text_bytes, thaw,
)
from lakekeel.session import stage

LENGTH = 50  # bytes of a string that counts as repeated
PERIOD, COVER = 13, (0, 1, 3, 9)  # a difference cover: every difference mod 13 is one of two residues
SAMPLE = LENGTH - PERIOD + 1  # bytes of a sample window; at any of 13 offsets it lies within the string
SEED = 16  # bytes of the window that chooses the block
RUN = 256  # suffixes of a piece, at most
CHUNK = 4 << 20  # bytes of text of a chunk
BLOCK = 3 << 20  # bytes of text for each block; most suffixes have no partner and go to none
NONE = np.iinfo(np.int64).min  # stands for a null doc_id

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: the first offset at which two suffixes of given residues both fall on the cover
_MEET = np.array([[next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER)
                   for s in range(PERIOD)] for r in range(PERIOD)])


class Text:
    """The bytes of a chunk's rows."""

    def __init__(self, rows: pa.RecordBatch):
        self.data, self.offsets = text_bytes(rows.column(1))
        self.sizes = np.diff(self.offsets)
        self.ids = rows.column(0).fill_null(NONE).to_numpy(zero_copy_only=False)

    def rows_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, side="right") - 1

    def sample(self) -> np.ndarray:
        """Where the windows of the cover sample begin, in texts that are long enough for a string."""
        long = np.flatnonzero(self.sizes >= LENGTH)
        first, end = self.offsets[long], self.offsets[long] + self.sizes[long] - SAMPLE + 1
        periods = -(-(end - first) // PERIOD)
        at = np.repeat(first - PERIOD * (np.cumsum(periods) - periods), periods) + PERIOD * np.arange(periods.sum())
        every = (at[:, None] + np.array(COVER)).ravel()
        return every[every < np.repeat(end, periods * len(COVER))]


def _eights(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    padded = np.concatenate([data, np.zeros(72, np.uint8)])
    return np.ndarray((len(data) + 64,), f"{order}u8", padded, strides=(1,))


def _hashes(eights: np.ndarray, at: np.ndarray, length: int, bits: int) -> np.ndarray:
    state = np.full(len(at), length, np.uint64)
    for off in (*range(0, length - 7, 8), *([length - 8] if length % 8 else [])):
        state = mixed(state, eights[at + off])
    return mixed(state, np.uint64(0)) >> np.uint64(64 - bits)


def _sample_values(bits: int):
    """The sample windows of a chunk, with a count of two for those that occur twice or more."""
    def values(rows: pa.RecordBatch):
        text = Text(rows)
        found = np.sort(_hashes(_eights(text.data), text.sample(), SAMPLE, bits))
        first = np.flatnonzero(np.diff(found, prepend=found[:1] ^ np.uint64(1)))
        return found[first], np.minimum(np.diff(first, append=len(found)), 2)

    return values


def _candidates(text: Text, eights: np.ndarray, often: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of the stretches of suffixes with a repeated sample window within ``PERIOD`` bytes."""
    at = text.sample()
    values = _hashes(eights, at, SAMPLE, bits)
    near = np.zeros(1 << 22, bool)  # passes what may be among ``often``
    shift = np.uint64(max(bits - 22, 0))
    near[often >> shift] = True
    maybe = np.flatnonzero(near[values >> shift])
    at = at[maybe[among(values[maybe], often)]]
    row = text.rows_of(at)
    lo = np.maximum(at - PERIOD + 1, text.offsets[row])
    new = np.ones(len(at), bool)
    new[1:] = (lo[1:] > at[:-1] + 1) | (row[1:] != row[:-1])
    last = np.flatnonzero(np.concatenate([new[1:], np.ones(min(len(at), 1), bool)]))
    ends = np.minimum(at[last] + 1, text.offsets[row[last] + 1] - LENGTH + 1)
    begins = lo[new]
    some = ends > begins
    return begins[some], ends[some]


def _places(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _least_seeds(eights: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least hash of ``SEED`` bytes within the 50 bytes at each place of the stretches."""
    wanted = LENGTH - SEED + 1
    sizes = ends - begins
    at = _places(begins, sizes + wanted - 1)
    low = mixed(mixed(mixed(np.full(len(at), SEED, np.uint64), eights[at]), eights[at + 8]), np.uint64(0))
    width = 1
    while width < wanted:
        step = min(width, wanted - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    wide = np.cumsum(sizes + wanted - 1) - (sizes + wanted - 1)  # where a stretch begins among its seeds
    return low[_places(wide, sizes)] if len(at) else np.zeros(0, np.uint64)


def _pieces(text: Text, eights: np.ndarray, begins: np.ndarray, ends: np.ndarray, parts: int) -> tuple[dict, pa.RecordBatch]:
    """Per block the distinct pieces (text, suffixes, least id), and where each run of suffixes finds its piece."""
    seeds = _least_seeds(eights, begins, ends)
    at = _places(begins, ends - begins)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (seeds[1:] != seeds[:-1])
    started = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(started, np.diff(started, append=len(at)))
    new |= inside % RUN == 0
    started = np.flatnonzero(new)
    run, first = np.diff(started, append=len(at)), at[started]
    block = (seeds[started] % np.uint64(parts)).astype(np.int64)
    data = text.data.tobytes()
    numbers: dict[bytes, int] = {}
    no = np.fromiter((numbers.setdefault(data[a:b], len(numbers)) for a, b in zip(
        first.tolist(), (first + run + LENGTH - 1).tolist())), np.int64, len(first))
    m = len(numbers)
    low = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(low, no, text.ids[text.rows_of(first)])
    runs, home = np.zeros(m, np.int64), np.zeros(m, np.int64)
    runs[no], home[no] = run, block
    order = np.argsort(home, kind="stable")
    bodies = list(numbers)
    out = {}
    cuts = np.flatnonzero(np.diff(home[order], prepend=-1, append=-1)) if m else np.zeros(0, np.int64)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own = order[lo:hi]
        out[int(home[own[0]])] = pa.RecordBatch.from_arrays(
            [pa.array([bodies[k] for k in own.tolist()], pa.binary()), pa.array(runs[own]), pa.array(low[own])],
            names=["body", "run", "low"])
    place = np.empty(m, np.int64)  # of a piece's first suffix among all that the blocks answer for, in their order
    place[order] = np.cumsum(runs[order]) - runs[order]
    return out, columns_of(first=first, run=run, answer=place[no])


LAYOUT = -1


def _cut(parts: int, bits: int):
    def run(key: tuple, chunk: pa.Table, known: pa.Table) -> pa.Table:
        numbers, blocks, data, sizes = [], [], [], []
        for k, frozen in zip(chunk.column("chunk").to_pylist(), chunk.column("data").to_pylist()):
            text = Text(thaw(frozen))
            eights = _eights(text.data)
            begins, ends = _candidates(text, eights, merged(known), bits)
            pieces, layout = _pieces(text, eights, begins, ends, parts)
            numbers += [k] * (len(pieces) + 1)
            blocks += [LAYOUT, *pieces]
            sizes += [int(np.sum(ends - begins)), *(int(np.sum(p.column(1).to_numpy())) for p in pieces.values())]
            data += [freeze([layout]), *(freeze([p]) for p in pieces.values())]
        return pa.table({"chunk": pa.array(numbers, pa.int64()), "part": pa.array(blocks, pa.int64()),
                         "n": pa.array(sizes, pa.int64()), "data": pa.array(data, pa.binary())})

    return run


def sorted_groups(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, begins): the suffixes at ``starts`` sorted by their first 50 bytes; begins marks each new string.

    Groups tied in 16 bytes are parted around a pivot each, all at once: by the ranks of the cover sample at the offset
    that a suffix shares with the pivot and, if these are equal, by the last 13 bytes.
    """
    words = _eights(text, ">")
    marks = np.bincount(starts, minlength=len(text) + PERIOD) - np.bincount(starts + PERIOD, minlength=len(text) + PERIOD)[:len(text) + PERIOD]
    wanted = np.flatnonzero(np.cumsum(marks) > 0)
    cover = wanted[_IN_COVER[wanted % PERIOD]]
    windows = [words[cover + off].astype(np.uint64) for off in (0, 8, 16, 24, SAMPLE - 8)]
    by_text = np.lexsort(windows[::-1])
    step = np.zeros(len(cover), bool)
    for w in windows:
        step[1:] |= w[by_text[1:]] != w[by_text[:-1]]
    rank = np.zeros(len(text) + PERIOD, np.int32)
    rank[cover[by_text]] = np.cumsum(step)

    heads = [words[starts + off].astype(np.uint64) for off in (0, 8)]
    order = np.lexsort(heads[::-1])
    begins = np.ones(len(starts), bool)
    begins[1:] = (heads[0][order[1:]] != heads[0][order[:-1]]) | (heads[1][order[1:]] != heads[1][order[:-1]])

    def tied(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of whole groups of slots: those of groups of two or more, where these start, and the group of each."""
        group = np.cumsum(begins[slots]) - 1
        slots = slots[np.bincount(group)[group] > 1] if len(slots) else slots
        return slots, np.flatnonzero(begins[slots]), np.cumsum(begins[slots]) - 1

    slots, first, group = tied(np.arange(len(starts)))
    while len(slots):
        sizes = np.diff(first, append=len(slots))
        at = starts[order[slots]]
        pivot = at[first + sizes // 2][group]
        meet = _MEET[at % PERIOD, pivot % PERIOD]
        side = np.sign(rank[at + meet] - rank[pivot + meet]).astype(np.int64)
        for off in (LENGTH - PERIOD, LENGTH - 8):  # equal so far: 38 bytes at least
            open_ = np.flatnonzero(side == 0)
            mine, other = words[at[open_] + off], words[pivot[open_] + off]
            side[open_] = (mine > other).astype(np.int64) - (mine < other)
        side += group * 3 + 1
        by_side = np.argsort(side, kind="stable")
        order[slots] = order[slots[by_side]]
        side = side[by_side]
        begins[slots[1:]] |= side[1:] != side[:-1]
        slots, first, group = tied(slots[side % 3 != 1])
    return order, begins


def _sort_block(group: pa.Table) -> pa.Table:
    """For each chunk, the least doc_id of each of its suffixes of a block, as runs of equal ids."""
    each = [thaw(d) for d in group.column("data").to_pylist()]
    numbers: dict[bytes, int] = {}
    nos = [np.fromiter((numbers.setdefault(b, len(numbers)) for b in p.column(0).to_pylist()), np.int64, len(p)) for p in each]
    m = len(numbers)
    low, run = np.full(m, np.iinfo(np.int64).max), np.zeros(m, np.int64)
    for no, p in zip(nos, each):
        np.minimum.at(low, no, p.column(2).to_numpy())
        run[no] = p.column(1).to_numpy()
    text = np.frombuffer(b"".join(numbers), np.uint8)
    heads = np.cumsum(run + LENGTH - 1) - (run + LENGTH - 1)
    before = np.cumsum(run) - run
    inside = np.arange(run.sum()) - np.repeat(before, run)
    order, begins = sorted_groups(text, np.repeat(heads, run) + inside)
    least = np.minimum.reduceat(np.repeat(low, run)[order], np.flatnonzero(begins))
    answer = np.empty(len(order), np.int64)
    answer[order] = least[np.cumsum(begins) - 1]
    data = []
    for no, p in zip(nos, each):
        runs = run[no]
        asked = np.arange(runs.sum()) + np.repeat(before[no] - (np.cumsum(runs) - runs), runs)
        ids = answer[asked]
        cut = np.flatnonzero(np.diff(ids, prepend=ids[0])) if len(ids) else np.zeros(0, np.int64)
        cut = np.concatenate([[0], cut])
        data.append(freeze([columns_of(low=ids[cut], n=np.diff(cut, append=len(ids)))]))
    return pa.table({"chunk": group.column("chunk"), "part": group.column("part"), "data": pa.array(data, pa.binary())})


def _mark(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """The rows of a chunk with what is removed from them."""
    frozen = chunk.column("data").to_pylist()
    rows = thaw(frozen[0])
    text = Text(rows)
    n = len(text.data)
    covered = np.zeros(n, bool)
    parts = answers.column("part").to_numpy()
    data = answers.column("data").to_pylist()
    order = np.argsort(parts, kind="stable").tolist()
    if len(order):
        layout = thaw(data[order[0]])
        first, run, place = (layout.column(k).to_numpy() for k in range(3))
        told = [thaw(data[k]) for k in order[1:]]
        low = np.concatenate([np.zeros(0, np.int64), *(np.repeat(t.column(0).to_numpy(), t.column(1).to_numpy()) for t in told)])
        at = _places(first, run)
        at = at[low[_places(place, run)] < np.repeat(text.ids[text.rows_of(first)], run)]
        marks = np.zeros(n + 1, np.int8)
        marks[at] = 1
        marks[at + LENGTH] -= 1
        covered = np.cumsum(marks, dtype=np.int32)[:n] > 0
    upto = np.concatenate([[0], np.cumsum(~covered)])
    kept_at = upto[text.offsets]
    kept = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(rows), [None, pa.py_buffer(kept_at.astype(np.int64).tobytes()), pa.py_buffer(text.data[~covered].tobytes())])
    edges = np.zeros(n + 1, bool)  # of the rows
    edges[text.offsets] = True
    opens = covered & (edges[:n] | ~np.concatenate([[False], covered])[:n])
    closes = covered & (edges[1:] | ~np.concatenate([covered[1:], [False]])[:n])
    at = np.flatnonzero(opens)
    base = text.offsets[text.rows_of(at)]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(at, text.offsets).astype(np.int32)), pa.StructArray.from_arrays(
            [pa.array(at - base), pa.array(np.flatnonzero(closes) + 1 - base)], names=["start", "end"]))
    return pa.table({"doc_id": rows.column(0), "n_bytes": pa.array(text.sizes), "n_removed": pa.array(text.sizes - np.diff(kept_at)),
                     "removed": spans, "kept": kept.cast(pa.binary())})


SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, kept binary"


def without_repeats(documents: DataFrame, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept) per row of documents(doc_id, text).

    A byte is removed if it lies in a 50-byte string of its text that also starts in a row of a smaller doc_id;
    ``removed`` lists the maximal runs of such bytes (end exclusive), ``kept`` is the rest, which may end within a
    character. A null doc_id counts as smaller than all others. Rows of one id, equal or not, take nothing from each
    other. Null is an empty text. Other columns are not read; an empty table gives an empty table.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    chunks = pack(rows, "text", chunk, "suffix-texts")
    size = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]  # one number
    bits, parts = shape(size * len(COVER) // PERIOD)
    known = stage(shared(chunks, _sample_values(bits), bits, parts, 2), "cover-sample")
    slim = chunks.select("chunk", "data")
    blocks = max(size // block, 1)
    cut = stage(slim.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(
        _cut(blocks, bits), "chunk bigint, part bigint, n bigint, data binary"), "suffix-pieces")
    answers = cut.filter(F.col("part") != LAYOUT).select("chunk", "part", "data").groupBy("part").applyInArrow(
        _sort_block, "chunk bigint, part bigint, data binary")
    told = cut.filter(F.col("part") == LAYOUT).select("chunk", "part", "data").unionByName(answers)
    return slim.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_mark, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
