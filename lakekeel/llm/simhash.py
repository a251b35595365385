"""SimHash near-duplicates by anchor points: fingerprints meet at the code words of a covering code.

Two fingerprints that differ in at most 4 of 64 bits differ in at most 2 bits of some two of three blocks (23, 23
and 18 bits), for the block with the most differing bits has two or more of them, or all but two at most. Each
block has a perfect code as its covering code: the binary Golay code (23 bits, radius 3), and for the 18 bits a
Hamming code (15 bits, radius 1) with three bits as they are. An anchor is a pair of code words. Every fingerprint
goes to the anchors whose cell, the points nearest to them, it reaches by changing one bit at most: those lie
within the covering radius plus one. Of two fingerprints at distance two, the point half-way is one bit from both,
so they meet at its anchor: covering radius plus half of the threshold is enough, and none is lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekeel.llm.common import components, first_of, fresh
from lakekeel.session import stage

SHINGLE = 4  # words
SEED = 42
DISTANCE = 4  # bits; what the anchors are made for
GROUP = 20_000  # fingerprints of an anchor that are compared in one go; larger groups are compared block by block

_BITS = np.array([[(v >> k) & 1 for k in range(8)] for v in range(256)], np.int64)  # bit k of each byte


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits: each is 1 if set in over half of the shingles' hashes. No words: 0."""
    words = text.lower().split() if text else []  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    first, last = (ends - sizes)[:n].tolist(), (ends - 1)[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros((8, 256), np.int64)
    lanes = np.arange(8) * 256
    for lo in range(0, n, 65_536):  # long texts in slices
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(first[lo:lo + 65_536], last[lo:lo + 65_536])], "<u8")
        counts += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + lanes).ravel(), minlength=2048).reshape(8, 256)
    set_bits = (counts @ _BITS).ravel() * 2 > n
    return int.from_bytes(np.packbits(set_bits, bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp) per row of documents(doc_id, text); th is a hash of the text, fp the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "th", "fp"])

    slim = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, th bigint, fp bigint")


# ---- the covering code ------------------------------------------------------------------------------------------


def _remainder(values: np.ndarray, generator: int, bits: int) -> np.ndarray:
    """Remainders of polynomials of fewer than ``bits`` coefficients over GF(2)."""
    degree = generator.bit_length() - 1
    rest = values.copy()
    for k in range(bits - 1, degree - 1, -1):
        rest ^= np.where((rest >> np.uint64(k)) & np.uint64(1), np.uint64(generator << (k - degree)), np.uint64(0))
    return rest


class CyclicCode:
    """A perfect cyclic code: ``nearest`` gives the one code word within the radius of each point."""

    def __init__(self, bits: int, generator: int, radius: int):
        self.bits, self.generator = bits, generator
        flips = [sum(1 << k for k in ks) for r in range(radius + 1) for ks in itertools.combinations(range(bits), r)]
        errors = np.array(flips, np.uint64)
        self.error = np.zeros(1 << (generator.bit_length() - 1), np.uint64)
        self.error[_remainder(errors, generator, bits)] = errors

    def nearest(self, points: np.ndarray) -> np.ndarray:
        return points ^ self.error[_remainder(points, self.generator, self.bits)]


# fixed values: generator polynomials, as bits, of the binary Golay code and of the Hamming code of 15 bits
GOLAY = CyclicCode(23, 0b101011100011, 3)
HAMMING = CyclicCode(15, 0b10011, 1)

_BLOCKS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))


def _cell(block: int, points: np.ndarray) -> np.ndarray:
    """The code word whose cell holds each point of a block."""
    if block < 2:
        return GOLAY.nearest(points)
    low = points & np.uint64((1 << 15) - 1)
    return HAMMING.nearest(low) | (points & np.uint64(0b111 << 15))


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for each fingerprint and each anchor that it goes to, without repeats."""
    rows, keys = [], []
    each = np.arange(len(fps))
    parts = [(fps >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in _BLOCKS]
    reached = []  # per block: the cell of the point, then those of its neighbours where they are others
    for b, (_, n) in enumerate(_BLOCKS):
        home = _cell(b, parts[b])
        near = np.stack([_cell(b, parts[b] ^ np.uint64(1 << k)) for k in range(n)])
        near.sort(axis=0)
        new = near != home
        new[1:] &= near[1:] != near[:-1]
        at, who = np.nonzero(new)
        reached.append((home, who, near[at, who]))
    for table, (b, c) in enumerate(PAIRS):
        (home_b, who_b, near_b), (home_c, who_c, near_c) = reached[b], reached[c]
        shift, mark = np.uint64(_BLOCKS[c][1]), np.uint64(table << 60)
        rows += [each, who_b, who_c]
        keys += [mark | (home_b << shift) | home_c, mark | (near_b << shift) | home_c[who_b],
                 mark | (home_b[who_c] << shift) | near_c]
    return np.concatenate(rows), np.concatenate(keys)


def _deal(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(values), 4096):
                part = values[lo:lo + 4096]
                rows, keys = anchors(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(part[rows].view(np.int64))], names=["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor bigint, fp bigint")


# ---- comparison -------------------------------------------------------------------------------------------------


def _spanning(values: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links that join what links of at most ``distance`` bits join: at most one less than the values."""
    rest = np.ones(len(values), bool)
    for seed in range(len(values)):
        if not rest[seed]:
            continue
        rest[seed] = False
        queue = [seed]
        while queue:
            at = queue.pop()
            left = np.flatnonzero(rest)
            near = left[np.bitwise_count(values[left] ^ values[at]) <= distance]
            rest[near] = False
            queue += near.tolist()
            for k in near.tolist():
                yield at, k


def _links(keys: list[np.ndarray], values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of equal keys; rows are sorted by key."""
    change = np.zeros(len(values), bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    group = np.cumsum(change)
    sizes = np.bincount(group, minlength=1)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = sizes[group] <= 32
    for step in range(1, 32):  # pairs of small groups, by how far apart they are
        i = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
        if not len(i):
            break
        i = i[np.bitwise_count(values[i] ^ values[i + step]) <= distance]
        a.append(i)
        b.append(i + step)
    first = np.cumsum(sizes) - sizes
    for g in np.flatnonzero(sizes > 32):
        lo = first[g]
        pairs = np.array(list(_spanning(values[lo:lo + sizes[g]], distance)), np.int64).reshape(-1, 2) + lo
        a.append(pairs[:, 0])
        b.append(pairs[:, 1])
    return values[np.concatenate(a)], values[np.concatenate(b)]


def _compare(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3  # the group that the next batch may go on with
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                cols = [np.concatenate([h, batch.column(k).to_numpy().astype(np.int64)]) for k, h in enumerate(held)]
                if not len(cols[0]):
                    continue
                last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
                held = [c[last] for c in cols]
                cols = [c[~last] for c in cols]
            else:
                cols = held
            if len(cols[0]):
                x, y = _links(cols[:2], cols[2].view(np.uint64), distance)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    return run


def links(fps: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Links (a, b) between fingerprints of ``fps`` (fp, distinct) whose groups are those of all links.

    An anchor with over ``group`` fingerprints is cut into blocks, and every two blocks are compared in a group of
    their own, so no group grows with the data. Groups give out a spanning set of links, not all pairs.
    """
    if distance > DISTANCE:
        raise ValueError(f"the anchors are made for {DISTANCE} bits at most")
    dealt = _deal(fps)
    large = dealt.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > group).select(
        "anchor", F.ceil(F.col("n") * 2 / group).cast("int").alias("blocks"))
    joined = dealt.join(stage(large, "anchors"), "anchor", "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(  # block i with block j as i * blocks + j, i <= j; own block first
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.least(j, mine) * F.col("blocks") + F.greatest(j, mine))
    parts = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(pairs)
    cell = joined.select("anchor", F.explode(parts).alias("part"), "fp")
    met = cell.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return met.mapInArrow(_compare(distance), "a bigint, b bigint").distinct()


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """(doc_id, th, fp, component_id, root) per row of documents(doc_id, text).

    th is a hash of the text. component_id is the smallest doc_id reachable over links, root the smallest fingerprint. Null and empty texts
    have fingerprint zero, which links like any other. Equal fingerprints are one node, so copies cost a row each
    and no pairs. Repeated rows come out repeated. A null doc_id gets the smallest doc_id of its group, null if
    there is none. Other columns are not read; an empty table gives an empty table.
    """
    docs = stage(fingerprints(documents, shingle), "fingerprints")
    nodes = stage(docs.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    found = components(stage(links(nodes, distance, group), "near"), "near")
    member = nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "low")
    lowest = member.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = member.join(lowest, "root").select("fp", "component_id", "root")
    return docs.join(of_fp, "fp", "left").select("doc_id", "th", "fp", "component_id", "root")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_group(documents: DataFrame, **settings) -> DataFrame:
    """The documents that stay, with all their columns: of each group the one with the smallest doc_id.

    Of several texts of a group with that doc_id, or of a group without any doc_id, the one with the least hash stays,
    once. Groups whose smallest doc_id is the same keep a document each. ``documents`` is read twice and its texts
    move once, to meet the list of those that stay.
    """
    found = near_duplicates(documents, **settings)
    leads = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("th").alias("th"), F.first("component_id").alias("id"))
    th, key, want = (fresh(documents, c) for c in ("__th", "__key", "__want"))
    # an id or a text alone may stand for very many rows; a null id counts as one
    wanted = leads.select(F.xxhash64("id", F.col("id").isNull()).alias(key), F.col("th").alias(want)).distinct()
    ident = F.col("doc_id").cast("bigint")
    marked = documents.withColumns({key: F.xxhash64(ident, ident.isNull()), th: F.xxhash64("text")})
    kept = marked.join(wanted, (marked[key] == wanted[key]) & (marked[th] == wanted[want]), "left_semi")
    return first_of(kept, [key, th], F.lit(0)).select(*documents.columns)
