"""Collocations: phrases of two and three words that occur together more often than apart.

Candidates are found from below: hashes of all phrases are counted over the chunks, a phrase whose hash class is too
rare is rare itself, and three words are only a candidate if both pairs are. The candidates of a chunk and its words
become double-array tries of bounded size, in the task that holds the chunk: all its word starts go through a trie
together, a byte at a time, and what stands on an accepting state at the end of a word is counted with bincount. So a
chunk meets its own phrases only, and the work for a chunk does not grow with the number of chunks.
The counts are exact: a phrase is a candidate in every chunk that holds it, or in none. They are summed by ranges of hashes.
"""

from __future__ import annotations

import functools
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakekeel.llm.chunks import (
    among, merged, mixed, pack, shape, shared, sliced, text_bytes, thaw,
)
from lakekeel.session import stage

LEAST = 10  # occurrences of a candidate
TOP = 2000  # phrases of a language
COVERED = 50  # per cent of a phrase's occurrences within a longer candidate from which on it is dropped
CHUNK = 16 << 20  # bytes of text of a chunk
SLICE = 2 << 20  # bytes of text of a chunk that are taken apart at once: words take twenty times their text
TRIE = 4 << 20  # bytes of phrases of a trie, about
SENT = 48 << 20  # bytes of tries that a task holds at once
UNITED = 4 << 20  # phrases of the texts, repeats included, whose counts are summed together
UNKNOWN = "und"  # the language of rows without one

PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"  # fixed values
_FORM = np.arange(256, dtype=np.uint8)
_FORM[65:91] += 32
_FORM[list(PIECE_ENDS)] = 10
_FORM[list(BLANKS)] = 32
_WORD = (_FORM != 10) & (_FORM != 32)


class Words:
    """The words of rows (lang, text): numbers, language, and whether a word goes on in its piece."""

    def __init__(self, rows: pa.RecordBatch):
        data, offsets = text_bytes(rows.column(1))
        n, form = len(data), _FORM[data]
        inside = _WORD[form]
        opens = np.zeros(n + 1, bool)
        opens[offsets] = True  # of rows, and the end
        starts = np.flatnonzero(inside & (opens[:n] | ~np.concatenate([[True], inside[:-1]])[:n]))
        ends = np.flatnonzero(inside & (opens[1:] | ~np.concatenate([inside[1:], [True]])[:n])) + 1
        row = np.searchsorted(offsets, starts, side="right") - 1
        breaks = np.searchsorted(np.flatnonzero(form == 10), starts)  # line ends and the like before a word
        self.goes_on = np.zeros(len(starts), bool)  # with the word after it
        self.goes_on[:-1] = (row[1:] == row[:-1]) & (breaks[1:] == breaks[:-1])
        self.sizes = ends - starts
        self.body = form[inside]
        langs = pc.fill_null(rows.column(0), UNKNOWN).dictionary_encode()
        self.langs: list[str] = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]

    @functools.cached_property
    def coded(self) -> pa.DictionaryArray:
        upto = np.concatenate([[0], np.cumsum(self.sizes)])
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self.sizes), [None, pa.py_buffer(upto.tobytes()), pa.py_buffer(self.body.tobytes())]).dictionary_encode()

    @functools.cached_property
    def ids(self) -> np.ndarray:
        return self.coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    @functools.cached_property
    def distinct(self) -> pa.LargeBinaryArray:
        return self.coded.dictionary

    def hashes(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the words, and of the phrases of two and of three words that begin at each place where there is one."""
        word = np.fromiter(map(xxhash.xxh64_intdigest, self.distinct.to_pylist()), np.uint64, len(self.distinct))
        lang = np.fromiter((xxhash.xxh64_intdigest(x, 1) for x in self.langs), np.uint64, len(self.langs))
        two, three = self.places()
        h = word[self.ids]
        first = mixed(lang[self.lang], h)
        pair = mixed(first[two], h[two + 1])
        triple = mixed(mixed(first[three], h[three + 1]), h[three + 2])
        end = np.uint64(0xD6E8FEB86659FD93)  # tells lengths apart
        rest = np.uint64(64 - bits)
        return mixed(first, np.uint64(1)) >> rest, mixed(pair, np.uint64(2)) >> rest, mixed(triple, end) >> rest

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        two = np.flatnonzero(self.goes_on)
        return two, two[self.goes_on[two + 1]]

    @functools.cached_property
    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """The words with a space after each that goes on, a line end after others; and where words start."""
        m = len(self.sizes)
        out = np.full(len(self.body) + m + 8, 10, np.uint8)
        after = np.cumsum(self.sizes + 1) - 1
        letters = np.ones(len(self.body) + m, bool)
        letters[after] = False
        out[:len(letters)][letters] = self.body
        out[after[self.goes_on]] = 32
        return out, after - self.sizes


def _phrase_values(bits: int):
    def values(rows: pa.RecordBatch):
        every = np.concatenate([np.zeros(0, np.uint64), *(h for some in sliced(rows, 1, SLICE) for h in Words(some).hashes(bits)[1:])])
        pa.default_memory_pool().release_unused()  # a worker lives on and would keep it
        every.sort()
        first = np.flatnonzero(np.concatenate([np.ones(min(len(every), 1), bool), every[1:] != every[:-1]]))
        return every[first], np.diff(first, append=len(every))

    return values


def _likely(words: Words, bits: int, often: np.ndarray) -> pa.Table:
    """The distinct (lang, phrase) of which the hash h, and of three words both pairs, are among the frequent ones; all words."""
    h1, pairs, triples = words.hashes(bits)
    two, three = words.places()
    ids = words.ids
    h2, h3 = (np.zeros(len(ids) + 1, np.uint64) for _ in range(2))
    h2[two], h3[three] = pairs, triples
    likely = np.zeros(len(ids) + 1, bool)
    likely[two] = among(pairs, often)
    three = three[among(triples, often) & likely[three] & likely[three + 1]]
    two = two[likely[two]]
    size = max(len(words.distinct), 1)
    _, at1 = np.unique(words.lang * size + ids, return_index=True)
    own, at, no = np.unique((words.lang[two] * size + ids[two]) * size + ids[two + 1], return_index=True, return_inverse=True)
    number = np.zeros(len(ids), np.int64)
    number[two] = no
    _, at3 = np.unique(number[three] * size + ids[three + 2], return_index=True)
    langs, found = pa.array(words.langs, pa.string()), []
    for places, length, h in ((at1, 1, h1), (two[at], 2, h2), (three[at3], 3, h3)):
        spelled = (words.distinct.take(pa.array(ids[places + j])) for j in range(length))
        phrases = pc.binary_join_element_wise(*spelled, pa.scalar(b" ", pa.large_binary()))
        found.append(pa.table({"lang": langs.take(pa.array(words.lang[places])), "phrase": phrases, "h": pa.array(h[places])}))
    return pa.concat_tables(found)


def _candidates(bits: int):
    """Words of a chunk and phrases that may be frequent, with their hash; with a null phrase, the number of words of each language."""

    def run(key: tuple, chunk: pa.Table, known: pa.Table) -> pa.Table:
        often = merged(known)
        totals: Counter[str] = Counter()
        found = [pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.large_binary()), "h": pa.array([], pa.uint64())})]
        for some in _slices(chunk):
            words = Words(some)
            totals.update(dict(zip(words.langs, np.bincount(words.lang, minlength=len(words.langs)).tolist())))
            found.append(_likely(words, bits, often))
            del words
        once = pa.concat_tables(found).group_by(["lang", "phrase", "h"]).aggregate([]).select(["lang", "phrase", "h"])
        del found
        sums = pa.table({"lang": pa.array([*totals], pa.string()), "n": pa.array([*totals.values()], pa.int64())})
        return pa.concat_tables([once, sums], promote_options="default")

    return run


def _slices(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
    for frozen in chunk.column("data").to_pylist():
        yield from sliced(thaw(frozen), 1, SLICE)


def _occurrences(keys: pa.LargeBinaryArray, chunk: pa.Table, trie: int, sent: int) -> np.ndarray:
    """How often each of the sorted distinct keys, a language, a line end and a phrase, occurs in a chunk.

    The keys become tries of about ``trie`` bytes of keys; the chunk is read once for every ``sent`` bytes of tries.
    """
    weights = np.cumsum(pc.binary_length(keys).to_numpy(zero_copy_only=False).astype(np.int64))
    total, held, weight, lo = np.zeros(len(keys), np.int64), [], 0, 0
    while lo < len(keys):
        hi = max(int(np.searchsorted(weights, (weights[lo - 1] if lo else 0) + trie, side="right")), lo + 1)
        columns = [c.to_numpy() for c in build_trie(keys.slice(lo, hi - lo).to_pylist()).columns]
        held.append((lo, hi, columns))
        weight += sum(c.nbytes for c in columns)
        if weight >= sent or hi == len(keys):
            for some in _slices(chunk):
                words = Words(some)
                for a, b, (base, check, accept) in held:
                    total[a:b] += count_phrases(words, base, check, accept, b - a)
                del words
            held, weight = [], 0
        lo = hi
    return total


def _packed(bits: int, parts: int, trie: int = TRIE, sent: int = SENT):
    """``_candidates`` and how often each occurs in the chunk, as a row of compressed entries for each part.

    In part -1 are the words of each language. An entry is the language in hex, a colon, the phrase and a line end,
    none of which a phrase holds; the counts follow the entries. Equal phrases have an equal hash, of which the part
    is a range.
    """
    candidates = _candidates(bits)

    def joined(lang: pa.DictionaryArray, codes: list[bytes], phrases: pa.Array, *ends: bytes) -> pa.LargeBinaryArray:
        each = pa.array(codes, pa.large_binary()).take(lang.indices)
        return pc.binary_join_element_wise(each, phrases, *(pa.scalar(x, pa.large_binary()) for x in ends))

    def run(key: tuple, chunk: pa.Table, known: pa.Table) -> pa.Table:
        every = candidates(key, chunk, known)
        totals, found = every.filter(pc.is_null(every["phrase"])), every.filter(pc.is_valid(every["phrase"]))
        lang, phrases = found["lang"].combine_chunks().dictionary_encode(), found["phrase"].combine_chunks()
        names = [x.encode() for x in lang.dictionary.to_pylist()]
        keys = joined(lang, [x + b"\n" for x in names], phrases, b"")
        by_key = pc.sort_indices(keys)
        keys, lang, phrases, h = keys.take(by_key), lang.take(by_key), phrases.take(by_key), found["h"].to_numpy()[by_key.to_numpy()]
        del every, found
        pa.default_memory_pool().release_unused()
        times = _occurrences(keys, chunk, trie, sent)
        entries = joined(lang, [x.hex().encode() + b":" for x in names], phrases, b"\n", b"")
        del keys, phrases
        fine = min(bits, 24)  # bits of the hash that choose the part
        part = (h >> np.uint64(bits - fine)).astype(np.int64) * parts >> fine
        order = np.argsort(part, kind="stable")
        data, upto = text_bytes(entries.take(pa.array(order)))
        times = times[order].astype("<u4")  # texts are below 2 GB
        at, first = np.unique(part[order], return_index=True)
        coded = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
            planes = times[a:b].view(np.uint8).reshape(-1, 4).T  # planes of zeros cost next to nothing once compressed
            plain = data[upto[a]:upto[b]].tobytes() + planes.tobytes()
            coded.append(struct.pack("<II", len(plain), b - a) + pa.compress(plain, codec="zstd", asbytes=True))
        del entries, data
        pa.default_memory_pool().release_unused()  # a worker lives on and would keep it
        return pa.table({
            "part": pa.array([*([-1] * len(totals)), *at.tolist()], pa.int32()),
            "lang": pa.array([*totals["lang"].to_pylist(), *([None] * len(coded))], pa.string()),
            "data": pa.array([*([None] * len(totals)), *coded], pa.binary()),
            "n": pa.array([*totals["n"].to_pylist(), *([0] * len(coded))], pa.int64())})

    return run


def _unpacked(data: bytes) -> pa.Table:
    size, n = struct.unpack_from("<II", data)
    plain = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd"), np.uint8)
    text, planes = plain[:size - 4 * n], plain[size - 4 * n:]
    upto = np.concatenate([[0], np.flatnonzero(text == 10) + 1])
    entries = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(upto.tobytes()), pa.py_buffer(text.tobytes())])
    times = np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()
    return pa.table({"entry": entries, "n": pa.array(times.astype(np.int64))})


def _united(key: tuple, group: pa.Table, least: int = 1) -> pa.Table:
    """(lang, phrase, n) of a part: how often each phrase occurs in all chunks, if ``least`` times; with a null phrase,
    the number of words of each language."""
    totals: Counter[str] = Counter()
    each = [pa.table({"entry": pa.array([], pa.large_binary()), "n": pa.array([], pa.int64())})]
    for lang, data, n in zip(*(group.column(c).to_pylist() for c in ("lang", "data", "n"))):
        if data is None:
            totals[lang] += n
        else:
            each.append(_unpacked(data))
    sums = pa.concat_tables(each).group_by("entry").aggregate([("n", "sum")])
    del each
    sums = sums.filter(pc.greater_equal(sums["n_sum"], least))
    split = [x[:-1].partition(b":") for x in sums["entry"].to_pylist()]
    names = {x: bytes.fromhex(x.decode()).decode() for x in {lang for lang, _, _ in split}}
    out = pa.table({
        "lang": pa.array([*totals, *(names[lang] for lang, _, _ in split)], pa.string()),
        "phrase": pa.array([*([None] * len(totals)), *(phrase for _, _, phrase in split)], pa.binary()).cast(pa.string()),
        "n": pa.array([*totals.values(), *sums["n_sum"].to_pylist()], pa.int64())})
    del sums, split
    pa.default_memory_pool().release_unused()
    return out


# ---- double-array tries -----------------------------------------------------------------------------------------

PAD = 256  # slots that no state uses, before and after the others


def build_trie(keys: list[bytes]) -> pa.RecordBatch:
    """(base, check, accept) of the slots for sorted distinct keys; accept is the number of the key, or -1.

    The state after byte c of state s is base[s] + c if check there is s. States with several successors get slots of
    their own from the least byte to the greatest; those with one fill the gaps.
    """
    text = np.frombuffer(b"".join(keys), np.uint8)
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    at = np.cumsum(sizes) - sizes
    parents, symbols, n = [np.zeros(1, np.int32)], [np.full(1, -1, np.int16)], 1
    state = np.zeros(len(keys), np.int64)
    accepted = [np.full(1, -1, np.int32)]
    alive, depth = np.flatnonzero(sizes > 0), 0
    while len(alive):
        before, byte = state[alive], text[at[alive] + depth]
        new = np.ones(len(alive), bool)
        new[1:] = (before[1:] != before[:-1]) | (byte[1:] != byte[:-1])
        own = np.cumsum(new) - 1
        parents.append(before[new].astype(np.int32))
        symbols.append(byte[new].astype(np.int16))
        state[alive] = n + own
        depth += 1
        ends = sizes[alive] == depth
        mark = np.full(int(new.sum()), -1, np.int32)
        mark[own[ends]] = alive[ends]
        accepted.append(mark)
        n += len(mark)
        alive = alive[~ends]
    parent, symbol, accept = (np.concatenate(x) for x in (parents, symbols, accepted))
    del parents, symbols, accepted, text, state

    slot = np.full(n, PAD, np.int64)  # of the root
    base = np.zeros(n, np.int64)  # without successors: all lead to unused slots
    order = np.lexsort((symbol[1:], parent[1:])) + 1
    owner = parent[order]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    children = np.diff(first, append=len(order))
    least, most = symbol[order][first], symbol[order][first + children - 1]
    wide = children > 1
    span = np.where(wide, most - least + 1, 0).astype(np.int64)
    begin = PAD + 1 + np.cumsum(span) - span
    base[owner[first[wide]]] = (begin - least)[wide]
    of_wide = np.repeat(wide, children)
    slot[order[of_wide]] = base[owner[of_wide]] + symbol[order[of_wide]]
    end = PAD + 1 + int(span.sum())
    used = np.zeros(end, bool)
    used[:PAD + 1] = True
    used[slot[order[of_wide]]] = True
    single = order[~of_wide]
    free = np.flatnonzero(~used)[:len(single)]
    slot[single] = np.concatenate([free, np.arange(end, end + len(single) - len(free))])
    base[parent[single]] = slot[single] - symbol[single]
    total = int(slot.max()) + PAD + 1
    columns = {}
    for name, value in (("base", base), ("check", slot[parent]), ("accept", accept)):
        out = np.full(total, 0 if name == "base" else -1, np.int32)
        out[slot] = value
        columns[name] = out
    columns["check"][PAD] = -1
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def count_phrases(words: Words, base: np.ndarray, check: np.ndarray, accept: np.ndarray, n: int) -> np.ndarray:
    """How often each of a trie's ``n`` phrases occurs."""
    text, at = words.spaced
    ends = ~_WORD[text]

    def walk(key: bytes) -> int:
        state = PAD
        for c in key:
            after = int(base[state]) + c
            if check[after] != state:
                return -1
            state = after
        return state

    root = np.array([walk(f"{x}\n".encode()) for x in words.langs], np.int32)
    state = root[words.lang] if len(root) else np.zeros(0, np.int32)
    live = np.flatnonzero(state >= 0)
    at, state, hits = at[live].astype(np.int32), state[live], [np.zeros(0, np.int32)]
    while len(at):
        after = base[state] + text[at]
        good = np.flatnonzero(check[after] == state)
        at, state = at[good] + 1, after[good]
        found = accept[state[ends[at]]]
        hits.append(found[found >= 0])
    return np.bincount(np.concatenate(hits), minlength=n)


def collocations(
    documents: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED, chunk: int = CHUNK, trie: int = TRIE,
    sent: int = SENT,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of each lang in documents(lang, text).

    Texts are lower-cased in A-Z and split into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and
    tabs. a, l and r count the phrase, its part before and its part after the cut with the lowest score, n all words.
    The score is floor(1000000 * a * a / (l * r)). A phrase goes if ``covered`` per cent of its occurrences lie in
    one longer candidate. Rows without lang are ``und``; a null text is empty; equal rows count each. Other columns are
    not read; an empty table gives an empty table. A task makes tries of ``trie`` bytes of phrases from what its chunk
    of ``chunk`` bytes holds and reads the chunk once for every ``sent`` bytes of tries.
    """
    rows = documents.select("lang", F.col("text").cast("binary").alias("text"))
    chunks = pack(rows, "text", chunk, "phrase-texts")
    size = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]  # one number
    bits, parts = shape(size // 3)  # two phrases a word, and six bytes a word or so
    slim = chunks.select("chunk", "data")
    known = stage(shared(chunks, _phrase_values(bits), bits, parts, least), "likely")
    found = slim.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(
        _packed(bits, max(size // 3 // UNITED, 1), trie, sent), "part int, lang string, data binary, n bigint")
    found = stage(found.groupBy("part").applyInArrow(
        lambda key, group: _united(key, group, least), "lang string, phrase string, n bigint"), "phrase-counts")
    total = found.filter("phrase is null").select("lang", "n")
    f = found.filter("phrase is not null").select("lang", "phrase", F.col("n").alias("f"))  # parts of a phrase are as frequent at least

    w = F.split("phrase", " ")
    often = f.withColumn("w", w).withColumn("a", F.col("f"))
    two = often.filter(F.size("w") == 2).select("lang", "phrase", "a", F.col("w")[0].alias("l1"), F.col("w")[1].alias("r1"))
    three = often.filter(F.size("w") == 3).select(
        "lang", "phrase", "a", F.col("w")[0].alias("l1"), F.concat_ws(" ", F.col("w")[1], F.col("w")[2]).alias("r1"),
        F.concat_ws(" ", F.col("w")[0], F.col("w")[1]).alias("l2"), F.col("w")[2].alias("r2"))
    inner = three.select("lang", F.explode(F.array("l2", "r1")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    two = two.join(inner, ["lang", "phrase"], "left").filter(
        ~F.coalesce(100 * F.col("within") >= covered * F.col("a"), F.lit(False))).drop("within")
    every = two.unionByName(three, allowMissingColumns=True)
    for part in ("l1", "r1", "l2", "r2"):
        counts = f.select("lang", F.col("phrase").alias(part), F.col("f").alias(f"f_{part}"))
        every = every.join(counts, ["lang", part], "left" if part.endswith("2") else "inner")

    def score(k: int):
        return F.expr(f"(1000000BD * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(f_l{k} as decimal(15,0)) * cast(f_r{k} as decimal(15,0)))")

    best = every.withColumns({"s1": score(1), "s2": score(2)})
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    best = best.select(
        "lang", "phrase", "a", *[F.when(second, F.col(f"f_{x}2")).otherwise(F.col(f"f_{x}1")).alias(x) for x in "lr"],
        F.when(second, F.col("s2")).otherwise(F.col("s1")).alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
