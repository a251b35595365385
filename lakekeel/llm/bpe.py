"""Byte-level BPE through a table of distinct words, and decoding through an id-to-piece table.

Documents are cut into chunks of bounded size. A chunk carries the list of its distinct words and, per document,
the places of its words in that list. Only the distinct words are dealt out, by a hash of the word, so equal words
of all chunks meet in one task, which encodes each of them once. The ids then come back to the chunk, and the
positions turn them into the ids of each document.
"""

from __future__ import annotations

import codecs
import hashlib
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekeel.llm.common import arrow_batches, stage_by
from lakekeel.session import stage

CHUNK_CHARS = 16_000_000  # characters of text in a chunk, unless a single document is longer
CACHED_WORDS = 500_000  # words a task remembers; beyond that it starts over and may encode a word again

# fixed value: the pattern that splits text before the merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(PATTERN)
# characters on whose class all versions of Unicode and all pattern libraries agree
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*")


_LOADED: dict[int, object] = {}


def load(spec: str):
    """The tokenizer of a file's text, once per Python process, without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if hash(spec) not in _LOADED:
        tok = Tokenizer.from_str(spec)
        tok.no_truncation()
        tok.no_padding()
        _LOADED[hash(spec)] = tok
    return _LOADED[hash(spec)]


def _spec(path: str) -> str:
    """The tokenizer file, read by the driver; tasks get its text and need no such file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Splitter:
    """Cuts text into the words that the merges never cross; special tokens are words of their own."""

    def __init__(self, spec: str):
        tok = load(spec)
        self.pre = tok.pre_tokenizer
        special = [t.content for t in tok.get_added_tokens_decoder().values()]
        special.sort(key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def __call__(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self._part(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else self._part(part)
        return out

    def _part(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _SPLIT.findall(text)
        # elsewhere the library itself says where words begin
        return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]


def _pack(codes: np.ndarray) -> bytes:
    """Numbers as four byte planes, low bytes first, compressed: small and frequent numbers take little room."""
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes.T).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _pack_words(words: list[str]) -> bytes:
    """How many words, the length of each in bytes, and the words, compressed."""
    encoded = [w.encode() for w in words]
    sizes = np.fromiter(map(len, encoded), "<u4", len(encoded))
    head = np.array([len(encoded)], "<u4").tobytes() + sizes.tobytes()
    return zstandard.ZstdCompressor(level=6).compress(head + b"".join(encoded))


def _unpack_words(blob: bytes) -> list[str]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = (np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [data[a:b].decode() for a, b in zip([4 + 4 * n, *ends], ends)]


# per chunk: its documents, their lengths in words, the places of the words, and by bucket the words with their numbers
CHUNKS = "chunk string, doc_ids array<bigint>, lengths array<int>, places binary, words array<binary>, slots array<binary>"


def _chunks_of(spec: Broadcast, buckets: int, chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split = Splitter(spec.value)
        part_id, number = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        lengths: list[int] = []
        codes: list[np.ndarray] = []
        chars = 0

        def fresh() -> defaultdict:
            d: defaultdict = defaultdict()
            d.default_factory = d.__len__
            return d

        known = fresh()

        def flush() -> pa.RecordBatch:
            every = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            order = np.argsort(-np.bincount(every, minlength=len(known)), kind="stable")
            rank = np.empty(len(known), np.int32)
            rank[order] = np.arange(len(known), dtype=np.int32)
            parts: list[list[tuple[str, int]]] = [[] for _ in range(buckets)]
            for w, r in zip(known, rank.tolist()):
                parts[zlib.crc32(w.encode()) % buckets].append((w, r))
            words, slots = [], []
            for part in parts:
                part.sort()
                words.append(_pack_words([w for w, _ in part]) if part else None)
                slots.append(_pack(np.array([r for _, r in part])) if part else None)
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{part_id}-{number}"]), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([lengths], pa.list_(pa.int32())), pa.array([_pack(rank[every])], pa.binary()),
                 pa.array([words], pa.list_(pa.binary())), pa.array([slots], pa.list_(pa.binary()))],
                names=["chunk", "doc_ids", "lengths", "places", "words", "slots"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                if ids and chars + len(text) > chunk_chars:
                    yield flush()
                    number += 1
                    ids, lengths, codes, chars, known = [], [], [], 0, fresh()
                found = split(text)
                ids.append(doc_id.as_py())
                lengths.append(len(found))
                codes.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                chars += len(text)
        if ids:
            yield flush()

    return run


ENCODED = "chunk string, bucket int, n binary, ids binary"


def _encode_words(spec: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(spec.value)
        known: dict[str, list[int]] = {}
        for batch in batches:
            n, ids = [], []
            for blob in batch.column(2):
                words = _unpack_words(blob.as_py())
                new = [w for w in words if w not in known]
                if len(known) + len(new) > CACHED_WORDS:
                    known, new = {}, words
                known.update(zip(new, (e.ids for e in tok.encode_batch(new, add_special_tokens=False))))
                mine = [known[w] for w in words]
                n.append(_pack(np.fromiter(map(len, mine), np.int64, len(mine))))
                ids.append(_pack(np.array([i for x in mine for i in x], np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.binary()), pa.array(ids, pa.binary())],
                names=["chunk", "bucket", "n", "ids"])

    return run


def take_ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The value runs of ``rows``, one after the other."""
    n = lengths[rows]
    ends = np.cumsum(n)
    shift = np.repeat(starts[rows] - (ends - n), n)
    return values[shift + np.arange(ends[-1] if len(ends) else 0)]


def pieces_of(path: str) -> list[bytes]:
    """The bytes of each id. In the vocabulary every byte is written as one printable character."""
    tok = load(_spec(path))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in plain}
    spelled.update({chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))})
    special = tok.get_added_tokens_decoder()
    size = max([*tok.get_vocab(with_added_tokens=True).values()], default=-1) + 1
    return [special[i].content.encode() if i in special else bytes(spelled[c] for c in tok.id_to_token(i) or "")
            for i in range(size)]


def piece_table(spark, path: str) -> DataFrame:
    """(id, piece): the vocabulary, whose size the tokenizer file bounds."""
    return spark.createDataFrame(
        [(i, bytearray(p)) for i, p in enumerate(pieces_of(path))], "id int, piece binary")


TOKENS = "doc_id bigint, ids array<int>"
DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _document_ids(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    """Ids of each document of the chunks of a batch."""
    for row in range(batch.num_rows):
        doc_ids, lengths, places, slots, parts = (batch.column(k)[row].as_py() for k in range(1, 6))
        own = [_unpack(b) for b in slots if b is not None]
        parts.sort(key=lambda p: p["bucket"])
        none = np.zeros(0, np.int64)
        order = np.concatenate([*own, none])
        n_in = np.concatenate([*(_unpack(p["n"]) for p in parts), none])
        values = np.concatenate([*(_unpack(p["ids"]) for p in parts), none]).astype(np.int32)
        starts, n = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        starts[order] = np.cumsum(n_in) - n_in
        n[order] = n_in
        codes = _unpack(places)
        at = 0
        for doc_id, length in zip(doc_ids, lengths):
            yield doc_id, take_ragged(values, starts, n, codes[at:at + length])
            at += length


def _chunk_table(documents: DataFrame, path: str, buckets: int | None, chunk_chars: int) -> DataFrame:
    """(chunk, doc_ids, lengths, places, slots, parts): each chunk with the ids of its words."""
    spark = documents.sparkSession
    spec = spark.sparkContext.broadcast(_spec(path))
    buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slim = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with arrow_batches(spark, 1000):  # the positions stay where they are written: only words and ids move
        chunks = stage_by(slim.mapInArrow(_chunks_of(spec, buckets, chunk_chars), CHUNKS), "chunk", buckets, "bpe")
    words = (
        chunks.select("chunk", F.posexplode("words").alias("bucket", "words"))
        .filter(F.col("words").isNotNull()).repartition("bucket").select("chunk", "bucket", "words")
    )
    encoded = words.mapInArrow(_encode_words(spec), ENCODED)
    # at most one row per chunk and bucket, so a group is as large as the word list of a chunk
    parts = encoded.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "ids")).alias("parts"))
    none = F.array().cast("array<struct<bucket:int,n:binary,ids:binary>>")
    return chunks.select("chunk", "doc_ids", "lengths", "places", "slots").join(parts, "chunk", "left").withColumn(
        "parts", F.coalesce("parts", none))


def encode(documents: DataFrame, path: str, buckets: int | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, ids) for each row of documents(doc_id, text), as the tokenizer of ``path`` encodes whole texts.

    Special tokens in a text are matched and none are added. Null texts are empty and give no ids; repeated rows
    and null ids give a row each; other columns are not read. ``buckets`` is how many parts the distinct words are
    dealt into; it follows the shuffle partitions, so that the words per task stay the same as data grows.
    """

    def run(batches):
        for batch in batches:
            pairs = list(_document_ids(batch))
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in pairs], pa.int64()), pa.array([i for _, i in pairs], pa.list_(pa.int32()))],
                names=["doc_id", "ids"])

    return _chunk_table(documents, path, buckets, chunk_chars).mapInArrow(run, TOKENS)


def decode(tokens: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids): every id is joined to its piece and the pieces are put back in order.

    Rows are numbered first, so repeated and null keys give a text per row. The piece table is bounded by the
    vocabulary. No ids give the empty text, and so do null ids. Bytes that are not UTF-8 become U+FFFD.
    """
    pieces = F.broadcast(piece_table(tokens.sparkSession, path))
    rows = stage(tokens.select(F.monotonically_increasing_id().alias("__row"), key, "ids"), "tokens")
    each = rows.select("__row", F.posexplode("ids").alias("pos", "id")).join(pieces, "id")
    text = F.concat_ws("", F.transform(F.array_sort("parts"), lambda p: F.hex(p["piece"])))
    texts = each.groupBy("__row").agg(F.collect_list(F.struct("pos", "piece")).alias("parts")).select(
        "__row", F.decode(F.unhex(text), "UTF-8").alias("text"))
    return rows.select("__row", key).join(texts, "__row", "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def digests(documents: DataFrame, path: str, buckets: int | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per document row: doc_id, n_tokens and the SHA-256 of its ids and of the text decoded from them.

    The piece table is a broadcast variable here, and an id finds its piece by place: the same join, without
    moving tokens out of the task that holds their document.
    """
    spark = documents.sparkSession
    pieces = pieces_of(path)
    shared = spark.sparkContext.broadcast(
        (np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces))))

    def run(batches):
        data, n = shared.value
        starts = np.cumsum(n) - n
        for batch in batches:
            rows = []
            for doc_id, ids in _document_ids(batch):
                sha, text = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
                for lo in range(0, len(ids), 1 << 18):  # a piece may end inside a character
                    sha.update(text.decode(take_ragged(data, starts, n, ids[lo:lo + (1 << 18)]).tobytes()).encode())
                sha.update(text.decode(b"", True).encode())
                rows.append((doc_id, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), sha.hexdigest()))
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                 pa.array(cols[3], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _chunk_table(documents, path, buckets, chunk_chars).mapInArrow(run, DIGEST)
