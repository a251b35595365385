"""Benchmark decontamination: Wu-Manber search for runs of benchmark words in documents."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10  # words
BLOCK_ITEMS = 5_000  # benchmark items per pass over the documents: bounds what a task holds
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8: the same words as [^\x00-\x2F\x3A-\x60\x7B-\x7F]+


def words_of(text: bytes | None) -> list[bytes]:
    return _WORD.findall(text.lower()) if text else []  # bytes.lower() changes A-Z only


class WuManber:
    """Search for many word sequences of ``m`` words or more, by blocks of two words (one if ``m`` is 1).

    ``shift`` tells for the block that ends at a position how far on the next possible end of a pattern's first
    ``m`` words is. At shift zero the patterns in the block's bucket are compared word for word.
    """

    def __init__(self, patterns: Iterable[tuple[bytes, ...]]):
        self.patterns = list(patterns)
        self.m = m = min(map(len, self.patterns))
        self.size = size = min(2, m)
        self.longest = m - size + 1
        self.vocabulary = {w for p in self.patterns for w in p[:m]}
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[int]] = {}
        for k, p in enumerate(self.patterns):
            for end in range(size, m + 1):
                block = p[end - size:end]
                self.shift[block] = min(self.shift.get(block, self.longest), m - end)
            self.bucket.setdefault(p[m - size:m], []).append(k)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(pattern number, first word) of all occurrences."""
        m, size, shift, longest, vocabulary = self.m, self.size, self.shift, self.longest, self.vocabulary
        at, n = m - 1, len(words)
        while at < n:
            if words[at] not in vocabulary:  # no pattern's first m words hold this word
                at += m
                continue
            block = tuple(words[at - size + 1:at + 1])
            step = shift.get(block, longest)
            if step:
                at += step
                continue
            start = at - m + 1
            for k in self.bucket[block]:
                p = self.patterns[k]
                if tuple(words[start:start + len(p)]) == p:
                    yield k, start
            at += 1


def windows_of(words: list[bytes], window: int) -> set[tuple[bytes, ...]]:
    """All runs of ``window`` words; a shorter sequence is one run, an empty one none."""
    if len(words) <= window:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + window]) for i in range(len(words) - window + 1)}


class Matcher:
    """The windows of some items. Windows of each length have a search of their own, so short ones cost no skips."""

    def __init__(self, items: Iterable[tuple[int | None, bytes | None]], window: int):
        owners: dict[tuple[bytes, ...], set[int | None]] = {}
        for item, text in items:
            for run in windows_of(words_of(text), window):
                owners.setdefault(run, set()).add(item)
        self.owners = owners
        lengths: dict[int, list[tuple[bytes, ...]]] = {}
        for run in owners:
            lengths.setdefault(len(run), []).append(run)
        self.searches = [WuManber(runs) for runs in lengths.values()]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int | None]]:
        """Covered word ranges, in order and apart, and the items that occur."""
        found: list[tuple[int, int]] = []
        items: set[int | None] = set()
        for search in self.searches:
            for k, start in search.search(words):
                run = search.patterns[k]
                found.append((start, start + len(run)))
                items |= self.owners[run]
        return join_ranges(found), items


SCHEMA = ("doc_id bigint, text binary, n_words bigint, spans array<struct<start:bigint,end:bigint>>, "
          "items array<bigint>")
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def join_ranges(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same positions as ranges in order that neither meet nor overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, block_items: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items with a text, so many at a time; at least one block, which may be empty."""
    rows = (
        benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("binary"))
        .filter(F.col("text").isNotNull()).toLocalIterator()
    )
    block: list[tuple[int | None, bytes]] = []
    for item, text in rows:
        if len(block) == block_items:
            yield block
            block = []
        block.append((item, bytes(text)))
    yield block


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """Per document row: doc_id, n_words, spans (word ranges that benchmark windows cover), items that occur.

    documents(doc_id, text), benchmark(item_id, text); other columns are not read. The benchmark comes in blocks
    of ``block_items`` items, each a step of the same stage, so a task holds blocks of bounded size and nothing
    is shuffled; one block is the usual case. Null or empty texts have no words and no hits. A null item_id marks
    words but is not listed. Repeated items count once; repeated documents give a row each. Whole texts are
    searched, one at a time.
    """
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    found = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"),
        F.lit(0).cast("bigint").alias("n_words"), none.alias("spans"), F.array().cast("array<bigint>").alias("items"),
    )
    for block in _blocks(benchmark, block_items):
        shared = documents.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, window)
            for batch in batches:
                n_words, spans, items = [], [], []
                for text, before, known in zip(batch.column(1), batch.column(3), batch.column(4)):
                    found_words = words_of(text.as_py())
                    ranges, owners = matcher.match(found_words)
                    if len(before):
                        ranges = join_ranges([*ranges, *((s["start"], s["end"]) for s in before.as_py())])
                    n_words.append(len(found_words))
                    spans.append([{"start": a, "end": b} for a, b in ranges])
                    items.append(sorted({*owners, *known.as_py()} - {None}))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, _SPANS),
                     pa.array(items, pa.list_(pa.int64()))], names=["doc_id", "text", "n_words", "spans", "items"])

        found = found.mapInArrow(search, SCHEMA)
    return found.drop("text")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from the rows of ``decontaminate``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, with all their columns, in one pass over whole rows.

    A row is judged by its own text, so repeated ids or null ids do no harm.
    """
    kept = documents
    for block in _blocks(benchmark, BLOCK_ITEMS):
        shared = documents.sparkSession.sparkContext.broadcast(block)
        at = documents.columns.index("text")

        def clean(batches, shared=shared, at=at):
            matcher = Matcher(shared.value, window)
            for batch in batches:
                ok = [not matcher.match(words_of(None if (v := t.as_py()) is None else v.encode()))[0]
                      for t in batch.column(at)]
                yield batch.filter(pa.array(ok, pa.bool_()))

        kept = kept.mapInArrow(clean, documents.schema)
    return kept
