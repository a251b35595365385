"""Language identification: the nearest of several centroids per language, by cosine of TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakekeel.llm.common import arrow_batches

SIZE = 4096  # buckets of the n-gram vectors
GRAMS = (1, 2, 3)  # bytes
SAMPLE = 300  # labelled documents per language that are learned from, at most
SAMPLE_ROWS = 4000  # labelled documents that are learned from, at most
LANGUAGES = 200  # languages that are learned, the most frequent ones
CENTROIDS = 4  # per language
REJECT = 0.02  # share of a language's own sample that lies beyond its distance limit
SLICE = 1 << 20  # bytes of a text that are counted at a time

# one odd multiplier per place in an n-gram: a bucket is the top bits of the sum of byte times multiplier
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_BITS = SIZE.bit_length() - 1
UNDETERMINED = "und"


def gram_counts(text: str | None) -> np.ndarray:
    """Counts of the hashed byte n-grams of the whole text: lower case, runs of other characters as one space."""
    counts = np.zeros(SIZE, np.int64)
    if not text:
        return counts
    carry = b" "
    for lo in range(0, len(text), SLICE):
        data = text[lo:lo + SLICE].lower().encode("utf-8", "replace")
        if lo + SLICE >= len(text):
            data += b" "
        raw = np.frombuffer(carry + data, np.uint8)
        letter = _LETTER[raw]
        keep = letter | np.concatenate([[True], letter[:-1]])  # of a run without letters the first byte stays
        line = np.where(letter, raw, 32)[keep].astype(np.uint32)
        for n in GRAMS:
            if len(line) < n:
                continue
            code = np.full(len(line) - n + 1, n, np.uint32) * np.uint32(0x27D4EB2F)
            for k in range(n):
                code += line[k:len(line) - n + 1 + k] * _MULTIPLIERS[k]
            counts += np.bincount(code >> np.uint32(32 - _BITS), minlength=SIZE)
        carry = line[-1:].astype(np.uint8).tobytes()
    return counts


_LETTER = np.zeros(256, bool)
_LETTER[list(range(97, 123)) + list(range(128, 256))] = True


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of damped counts times idf, scaled to length one (zero rows stay zero)."""
    x = np.log1p(counts) * idf
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x, dtype=np.float64), where=norm > 0).astype(np.float32)


@dataclass
class Model:
    """Centroids of length one, the language of each, and the least cosine that each accepts."""

    languages: list[str]
    centroids: np.ndarray
    least: np.ndarray
    idf: np.ndarray

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row: number of the nearest centroid, its cosine within 0 and 1, and whether it is too far."""
        cosine = unit(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        return best, score, score < self.least[best]


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by cosine; the first starts are the rows that are farthest from those chosen before."""
    chosen = [0]
    for _ in range(1, min(k, len(x))):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    centres = x[chosen]
    for _ in range(rounds):
        of = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[of == c].sum(axis=0) if (of == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres.astype(np.float32)


def fit_rows(languages: list[str], counts: np.ndarray, centroids: int = CENTROIDS, reject: float = REJECT) -> Model:
    """The model of labelled count vectors."""
    seen = (counts > 0).sum(axis=0) if len(counts) else np.zeros(SIZE)
    idf = np.log((1 + len(counts)) / (1 + seen)) + 1
    x = unit(counts, idf) if len(counts) else np.zeros((0, SIZE), np.float32)
    names, found, least = [], [], []
    for name in sorted(set(languages)):
        own = x[[i for i, v in enumerate(languages) if v == name]]
        own = own[own.any(axis=1)]
        if not len(own):
            continue
        centres = _cluster(own, centroids)
        near = (own @ centres.T).max(axis=1)
        names += [name] * len(centres)
        found.append(centres)
        least += [float(np.quantile(near, reject))] * len(centres)
    return Model(names, np.concatenate(found) if found else np.zeros((0, SIZE), np.float32), np.array(least), idf)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(
    documents: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, languages: int = LANGUAGES
) -> Model:
    """A model of documents(doc_id, text, lang); rows without a language or a letter teach nothing.

    Learned from at most ``sample`` rows per language and ``SAMPLE_ROWS`` in all, those with the smallest hash, of
    the ``languages`` most frequent languages. The counts of rows per language, over all rows, say how small a hash
    must be to come into question, so the pick is a bounded one at every size. Whole texts are counted in tasks;
    the driver gets the count vectors of the sample. Without any such row the model has no languages.
    """
    spark = documents.sparkSession
    rows = documents.filter(F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not sizes:
        return fit_rows([], np.zeros((0, SIZE)), centroids)
    each = min(sample, max(1, SAMPLE_ROWS // len(sizes)))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32))
    limit = F.lit(None).cast("bigint")
    for lang, n in ((r["lang"], r["n"]) for r in sizes):
        limit = F.when(F.col("lang") == lang, F.lit(min(1 << 32, 4 * each * (1 << 32) // n))).otherwise(limit)
    few = rows.filter(draw < limit).filter(has_letter(F.col("text")))
    ranked = few.withColumn("__rn", F.row_number().over(Window.partitionBy("lang").orderBy(draw, "doc_id")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [gram_counts(t.as_py()).astype("<u4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], names=["lang", "counts"])

    with arrow_batches(spark, 256):
        got = ranked.filter(F.col("__rn") <= each).select("lang", "text").mapInArrow(count, "lang string, counts binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["counts"])))  # the order of arrival must not matter
    vectors = [np.frombuffer(bytes(r["counts"]), "<u4") for r in got]
    return fit_rows([r["lang"] for r in got], np.stack(vectors) if vectors else np.zeros((0, SIZE)), centroids)


PREDICTED = "doc_id bigint, lang_pred string, score double, too_far boolean"


def predict(documents: DataFrame, model: Model, reject: bool = True) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id, lang_pred, score (cosine of the nearest centroid), too_far.

    ``too_far`` is set where the text is farther from the nearest centroid than nearly all of the sample was; with
    ``reject`` its language is then ``und``. Null texts, texts without a letter, and all texts under a model
    without languages are ``und`` with score 0. Whole texts are read; only the text goes into a prediction.
    Repeated rows and null ids give a row each. One pass, no shuffle; the model is small and of fixed size.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                letters = part.column(2).to_numpy(zero_copy_only=False)
                langs, scores, far = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
                at = np.flatnonzero(letters)
                if len(at) and known.languages:
                    counts = np.stack([gram_counts(part.column(1)[int(i)].as_py()) for i in at])
                    best, score, beyond = known.nearest(counts)
                    scores[at], far[at] = score, beyond
                    for i, b, out in zip(at, best, beyond):
                        langs[i] = UNDETERMINED if out and reject else known.languages[b]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(far)],
                    names=["doc_id", "lang_pred", "score", "too_far"])

    text = F.col("text")
    slim = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text, has_letter(text).alias("letters"))
    return slim.mapInArrow(run, PREDICTED)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3 (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3
