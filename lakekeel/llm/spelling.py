"""Spelling variants: words one edit apart, found in the one-edit neighbourhoods of reduced words.

Letters are hashed to a few symbols. Two words one edit apart have reduced words that are equal or one edit apart, so
each word makes all one-edit neighbours of its reduced word, as hashes; those that are reduced words of the vocabulary
come back, meet the words that stand behind them, and Levenshtein on the words themselves decides. With few symbols a
word has a few dozen neighbours instead of thousands.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekeel.llm.chunks import among, merged, mixed, pack, shape, shared, thaw
from lakekeel.session import stage

SYMBOLS = 8  # of the reduced alphabet
LETTERS, SEEN = 5, 3  # code points and occurrences of a word, at least
CUT = 97  # a run whose checksum this divides loses a letter
TWICE = 2  # how many times as frequent a form is, at least
CHUNK = 1 << 20  # bytes of words of a chunk
HELD = 1 << 19  # distinct words that a task counts before it hands them on

_FORM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_SYMBOL = np.array([xxhash.xxh64_intdigest(bytes([c])) % SYMBOLS + 1 for c in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15  # of the polynomial hash; odd, so that it has an inverse
_UP, _DOWN = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))


def runs(text: str) -> list[bytes]:
    """The runs of letters of a text, A-Z lower-cased, in Latin-1: a byte a letter."""
    return text.encode("latin-1", "replace").translate(_FORM).split()


def cut_words(doc_id: int | None, words: list[bytes]) -> list[tuple[bytes, bytes]]:
    """(run, what is left of it) for the distinct runs of a document that lose a letter."""
    start = crc32(b"" if doc_id is None else b"%d" % doc_id)
    start = crc32(b":", start)
    out = []
    for w in set(words):
        h = crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
        if h % CUT == 0:
            k = h % len(w)
            out.append((w, w[:k] + w[k + 1:]))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        some = [(w.decode("latin-1"), n) for w, n in total.items() if n and len(w) >= LETTERS]
        return pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = runs(text.as_py() or "")
            total.update(words)
            for whole, rest in cut_words(doc_id, words):
                n = words.count(whole)
                total[whole] -= n
                total[rest] += n
            if len(total) > HELD:
                yield out()
                total.clear()
    yield out()


def vocabulary(documents: DataFrame) -> DataFrame:
    """(word, n) for the words of documents(doc_id, text) that are long and frequent enough."""
    slim = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts = slim.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= SEEN)


def _codes(words: list[bytes], bits: int, neighbours: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, codes): the code of each reduced word, or one line of codes of all its one-edit neighbours and itself."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    shift = np.uint64(64 - bits)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        power = np.full(size + 1, _UP, np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        step = max((1 << 22) // (size + 1) // (2 * SYMBOLS), 1)  # words at a time
        for lo in range(0, len(rows), step):
            some = rows[lo:lo + step]
            letters = np.frombuffer(b"".join(words[k] for k in some.tolist()), np.uint8).reshape(len(some), size)
            symbols = _SYMBOL[letters]
            upto = np.zeros((len(some), size + 1), np.uint64)
            np.cumsum(symbols * power[:-1], axis=1, dtype=np.uint64, out=upto[:, 1:])
            whole = upto[:, -1:]

            def code(values: np.ndarray, length: int) -> np.ndarray:
                return mixed(mixed(values, np.uint64(length)), np.uint64(0)) >> shift

            if not neighbours:
                yield some, code(whole, size)
                continue
            edits = [code(whole, size)]
            edits.append(code(upto[:, :-1] + (whole - upto[:, 1:]) * _DOWN, size - 1))
            for symbol in range(1, SYMBOLS + 1):
                edits.append(code(whole + (np.uint64(symbol) - symbols) * power[:-1], size))
                edits.append(code(upto + np.uint64(symbol) * power + (whole - upto) * _UP, size + 1))
            yield some, np.concatenate(edits, axis=1)


def _spelt(rows: pa.RecordBatch) -> list[bytes]:
    return [w.encode("latin-1") for w in rows.column(0).to_pylist()]


def _neighbour_values(bits: int):
    """All neighbours of a chunk's reduced words, and its reduced words with a count: only these exist."""
    def values(rows: pa.RecordBatch):
        words = _spelt(rows)
        own = np.unique(np.concatenate([np.zeros(0, np.uint64), *(c.ravel() for _, c in _codes(words, bits, False))]))
        every = np.unique(np.concatenate([own, *(np.unique(c) for _, c in _codes(words, bits, True))]))
        return every, among(every, own).astype(np.int64)

    return values


def _near(bits: int):
    def run(key: tuple, chunk: pa.Table, known: pa.Table) -> pa.Table:
        there, at, codes = merged(known), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        rows = thaw(chunk.column("data").to_pylist()[0])
        for some, edits in _codes(_spelt(rows), bits, True):
            edits.sort(axis=1)
            new = np.ones(edits.shape, bool)
            new[:, 1:] = edits[:, 1:] != edits[:, :-1]
            new[new] = among(edits[new], there)
            line, _ = np.nonzero(new)
            at.append(some[line])
            codes.append(edits[new])
        found = rows.take(pa.array(np.concatenate(at)))
        return pa.table({"word": found.column(0), "n": found.column(1), "code": pa.array(np.concatenate(codes).astype(np.int64))})

    return run


def _own(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(len(batch), np.int64)
            for some, codes in _codes(_spelt(batch), bits, False):
                out[some] = codes[:, 0].astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["near", "near_n", "code"])

    return run


def near_words(vocab: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(word, n, near, near_n) for every two words of ``vocab`` (word, n) that are one edit apart, in both directions."""
    spread = vocab.repartition(int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    chunks = pack(spread.select("word", "n"), "word", chunk, "vocabulary")
    size, = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()  # one number; a word has 16 bytes besides its own
    bits, parts = shape(size // 24 * 18 * SYMBOLS)
    known = stage(shared(chunks, _neighbour_values(bits), bits, parts, 1), "neighbours")
    asked = chunks.select("chunk", "data").groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(
        _near(bits), "word string, n bigint, code bigint")
    behind = vocab.select("word", "n").mapInArrow(_own(bits), "near string, near_n bigint, code bigint")
    return asked.join(behind, "code").filter(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the last word that following the forms leads to.

    Pointers double their reach in each round, whose table is written to the shared folder; the driver sees a count.
    """
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stage(now.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not now.filter("moved").count():
            return now.select("word", "root")
        now = now.drop("moved")


def variants(documents: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of documents(doc_id, text).

    Words are the runs of letters A-Z and U+00C0 to U+00FF, A-Z lower-cased, of ``LETTERS`` code points and ``SEEN``
    occurrences at least. A run loses the letter that its checksum with the doc_id names if 97 divides that; a null doc_id is
    written as nothing. A word's form is the most frequent word one edit away (ties: the first in order of code
    points) if that is at least twice as frequent; root is where following the forms ends. Null and empty texts
    have no words; repeated rows count each. Other columns are not read; an empty table gives an empty table.
    """
    vocab = stage(vocabulary(documents), "words")
    near = near_words(vocab, chunk)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    judged = stage(vocab.join(near.groupBy("word").agg(F.count("*").alias("n_near"), best), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(-F.col("best.less") >= TWICE * F.col("n"), F.col("best")).alias("best")), "judged")
    judged = judged.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    return judged.join(roots(judged.filter("form is not null")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
