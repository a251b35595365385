"""Spelling variants, phrases and repeated passages against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lakekeel.llm import chunks, phrases, spelling, suffixes
from tests.llm.brute import ASCII_LOWER

DOCS = "doc_id bigint, text string, lang string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, v) for v in r))


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is not None, v) for v in r))


# ---- chunks ------------------------------------------------------------------------------------------------------


def test_numbers_travel(spark):
    rnd = np.random.default_rng(1)
    for n in (0, 1, 1000):
        values = np.unique(rnd.integers(0, 1 << 62, n, dtype=np.uint64))
        counts = rnd.integers(0, 70_000, len(values))
        back, times = chunks.decode(chunks.encode(values, counts))
        assert (back == values).all() and (times == counts).all()
        assert (chunks.decode(chunks.encode(values))[1] == 1).all()


def test_chunks_hold_every_row_once(spark):
    rows = [(i, "é" * (i * 37 % 500) if i % 7 else None) for i in range(300)] + [(1000, "z" * 100_000)]
    kept = chunks.pack(spark.createDataFrame(rows, "i int, text string").repartition(3), "text", 2000, "t").collect()
    got = [(r["i"], r["text"]) for c in kept for r in chunks.thaw(bytes(c.data)).to_pylist()]
    assert sorted(got, key=lambda r: r[0]) == rows and len({c.chunk for c in kept}) == len(kept) > 20


# ---- spelling ----------------------------------------------------------------------------------------------------


def spelled(documents):
    count = collections.Counter()
    for doc_id, text in documents:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    form, found = {}, {}
    for w, n in words.items():
        found[w] = [x for x in words if near(w, x)]
        best = min(found[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(found[w]), words[form[w]] if form[w] else None))
    return in_order(out)


def spelling_rows():
    rnd = random.Random(5)
    base = ["maison", "straße", "lettre", "über", "colour", "aaaaaa", "überall", "x" * 300]
    rows = []
    for i in range(400):
        words = []
        for _ in range(12):
            w = rnd.choice(base[: 1 + rnd.randrange(len(base))])
            while rnd.random() < 0.3:
                k = rnd.randrange(len(w))
                w = rnd.choice((w[:k] + w[k + 1:], w[:k] + rnd.choice("aeéÿ") + w[k:], w[:k] + rnd.choice("aeéÿ") + w[k + 1:]))
            words.append(w.capitalize() if rnd.random() < 0.2 else w)
        rows.append((i, rnd.choice((" ", "-", "4 ", "Ā")).join(words), None))
    return rows


def test_spelling(spark):
    rows = spelling_rows()
    want = spelled([r[:2] for r in rows])
    got = rows_of(spelling.variants(spark.createDataFrame(rows, DOCS).repartition(3), chunk=500))
    assert got == want and sum(r[4] for r in want) > 500 and any(r[1] and r[2] != r[1] for r in want)


def test_spelling_of_odd_tables(spark, odd, odd_wide, nothing):
    want = spelled([(r.doc_id, r.text) for r in odd.collect()])
    assert rows_of(spelling.variants(odd)) == rows_of(spelling.variants(odd_wide)) == want
    assert rows_of(spelling.variants(nothing)) == []


# ---- phrases -----------------------------------------------------------------------------------------------------


def collocated(documents, least=10, top=2000):
    f = collections.Counter()
    n = collections.Counter()
    for lang, text in documents:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(ASCII_LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    often = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inner = collections.Counter()
    for p, a in often.items():
        if len(p) == 4:
            for q in (p[:3], (p[0], *p[2:])):
                inner[q] = max(inner[q], a)
    scored = collections.defaultdict(list)
    for p, a in often.items():
        if p in inner and 100 * inner[p] >= 50 * a:
            continue
        cuts = [(10**6 * a * a // (f[p[:k]] * f[(p[0], *p[k:])]), k) for k in range(2, len(p))]
        score, k = min(cuts)
        scored[p[0]].append((-score, -a, " ".join(p[1:]).encode(), f[p[:k]], f[(p[0], *p[k:])]))
    return in_order(
        (lang, rank, phrase.decode(), -a, l, r, n[lang], -score)
        for lang, found in scored.items() for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1))


def phrase_rows():
    rnd = random.Random(9)
    words = ["the", "The", "cat", "sat", "ça", "über", "a", "b" * 200, "co-op", "x/y", "中文", "mat"]
    rows = []
    for i in range(300):
        text = "".join(rnd.choice(words[: 3 + i % 10]) + rnd.choice((" ", " ", " ", "\t ", ".", ", ", "\n", "?!")) for _ in range(i % 60))
        rows.append((i, text, (None, "en", "en", "und", "e", "")[i % 6]))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"chunk": 2000, "trie": 300, "sent": 20_000}])
def test_phrases(spark, sizes):
    rows = phrase_rows()
    want = collocated([(r[2], r[1]) for r in rows], top=40)
    got = rows_of(phrases.collocations(spark.createDataFrame(rows, DOCS).repartition(3), top=40, **sizes))
    assert got == want and len(want) > 100


def test_phrases_of_odd_tables(spark, odd, odd_wide, nothing):
    want = collocated([(r.lang, r.text) for r in odd.collect()], least=2)
    assert rows_of(phrases.collocations(odd, least=2)) == rows_of(phrases.collocations(odd_wide, least=2)) == want
    assert rows_of(phrases.collocations(nothing)) == []


def test_chunks_are_taken_apart_in_slices(monkeypatch):
    """Words of a chunk exist for a slice of its rows at a time; what is found is the same."""
    rows = pa.RecordBatch.from_pylist([{"lang": lang, "text": text.encode()} for _, text, lang in phrase_rows()])
    seen = []

    class Counted(phrases.Words):
        def __init__(self, some):
            seen.append(sum(len(x) + 16 for x in some.column(1).to_pylist()))
            super().__init__(some)

    monkeypatch.setattr(phrases, "Words", Counted)
    found = []
    for size in (1 << 30, 20_000):
        monkeypatch.setattr(phrases, "SLICE", size)
        seen.clear()
        values, counts = phrases._phrase_values(40)(rows)
        chunk = pa.table({"data": pa.array([chunks.freeze([rows])], pa.binary())})
        known = pa.table({"part": pa.array([0], pa.int32()), "data": pa.array([chunks.encode(values[counts > 9])], pa.binary())})
        got = phrases._candidates(40)(None, chunk, known).to_pylist()
        found.append((values.tolist(), counts.tolist(), sorted(map(repr, got))))
        assert max(seen) <= size
    assert found[0] == found[1] and len(seen) > 4 and len(found[0][2]) > 100


def test_candidates_of_chunks_are_packed_and_united():
    """Candidates of two chunks take less than half their text and are distinct once united; counting makes no dictionary of words."""
    rows = pa.RecordBatch.from_pylist([{"lang": lang, "text": text.encode()} for _, text, lang in phrase_rows()])
    values, counts = phrases._phrase_values(40)(rows)
    chunk = pa.table({"data": pa.array([chunks.freeze([rows])], pa.binary())})
    known = pa.table({"part": pa.array([0], pa.int32()), "data": pa.array([chunks.encode(values[counts > 9])], pa.binary())})
    plain = phrases._candidates(40)(None, chunk, known).to_pylist()
    want = {(r["lang"], r["phrase"].decode()) for r in plain if r["phrase"] is not None}
    sent = [phrases._packed(40, 5)(None, chunk, known) for _ in range(2)]
    data = [x for x in sent[0].column("data").to_pylist() if x is not None]
    assert len(data) == 5 and sum(map(len, data)) < 0.5 * sum(len(p) + len(lang) for lang, p in want)
    both, found = pa.concat_tables(sent), []
    for part in range(-1, 5):
        found += phrases._united((part,), both.filter(pa.compute.equal(both["part"], part))).to_pylist()
    got = [(r["lang"], r["phrase"]) for r in found if r["phrase"] is not None]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    totals = {r["lang"]: r["n"] for r in found if r["phrase"] is None}
    assert totals == {r["lang"]: 2 * r["n"] for r in plain if r["phrase"] is None}

    words = phrases.Words(rows)
    trie = phrases.build_trie(sorted(f"{lang}\n{p}".encode() for lang, p in want))
    assert phrases.count_phrases(words, *(c.to_numpy() for c in trie.columns), len(want)).sum() > 0
    assert "coded" not in vars(words)


def test_chunks_count_what_they_hold(monkeypatch):
    """The tries of a chunk hold its own phrases only, whatever is frequent elsewhere; the sums over the chunks are exact."""
    rnd, built, build = random.Random(3), [], phrases.build_trie
    monkeypatch.setattr(phrases, "build_trie", lambda keys: (built.extend(keys), build(keys))[1])
    other = [(i, " ".join(rnd.choice(("the", "cat", f"w{rnd.randrange(20)}")) for _ in range(30)), "en") for i in range(60)]
    texts = [[(lang, text) for _, text, lang in rows] for rows in (phrase_rows(), other)]
    every = [pa.RecordBatch.from_pylist([{"lang": lang, "text": text.encode()} for lang, text in some]) for some in texts]
    counts = collections.Counter()
    for rows in every:
        counts.update(dict(zip(*(x.tolist() for x in phrases._phrase_values(40)(rows)))))
    often = np.array(sorted(v for v, c in counts.items() if c >= 10), np.uint64)
    known = pa.table({"part": pa.array([0], pa.int32()), "data": pa.array([chunks.encode(often)], pa.binary())})
    f, sent = collections.Counter(), []
    for rows, some in zip(every, texts):
        own = set()
        for lang, text in some:
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text.translate(ASCII_LOWER)):
                words = [w for w in re.split("[ \t]+", piece) if w]
                found = [("und" if lang is None else lang, " ".join(words[i:i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
                f.update(found)
                own.update(f"{x}\n{p}".encode() for x, p in found)
        built.clear()
        chunk = pa.table({"data": pa.array([chunks.freeze([rows])], pa.binary())})
        sent.append(phrases._packed(40, 3, trie=300, sent=20_000)(None, chunk, known))
        assert len(built) > 30 and set(built) <= own
    both, got = pa.concat_tables(sent), {}
    for part in range(3):
        for r in phrases._united((part,), both.filter(pa.compute.equal(both["part"], part)), least=10).to_pylist():
            got[r["lang"], r["phrase"]] = r["n"]
    assert got == {p: n for p, n in f.items() if n >= 10} and len(got) > 100


def test_trie_accepts_its_keys_only():
    rnd = random.Random(2)
    keys = sorted({bytes(rnd.choice(b"ab\xffz ") for _ in range(rnd.randrange(1, 12))) for _ in range(500)})
    base, check, accept = (c.to_numpy() for c in phrases.build_trie(keys).columns)

    def number(key):
        state = phrases.PAD
        for c in key:
            if check[base[state] + c] != state:
                return -1
            state = base[state] + c
        return accept[state]

    assert [number(k) for k in keys] == list(range(len(keys)))
    others = {bytes(rnd.choice(b"ab\xffz q") for _ in range(rnd.randrange(1, 12))) for _ in range(3000)} - set(keys)
    assert all(number(k) == -1 for k in others)


# ---- repeated passages -------------------------------------------------------------------------------------------


def removed(documents):
    def rank(d):
        return -(1 << 63) if d is None else d

    low = {}
    for d, t in documents:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            low[b[i:i + 50]] = min(low.get(b[i:i + 50], rank(d)), rank(d))
    out = []
    for d, t in documents:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if low[b[i:i + 50]] < rank(d):
                gone[i:i + 50] = b"\1" * 50
        spans = sum(c and not (i and gone[i - 1]) for i, c in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, c in zip(b, gone) if not c)).hexdigest()))
    return in_order(out)


def passage_rows():
    rnd = random.Random(1)
    base = ["".join(rnd.choice("abé ") for _ in range(200)) for _ in range(6)]
    rows = []
    for i in range(120):
        text = ""
        for _ in range(rnd.randint(0, 5)):
            b, a = rnd.choice(base), rnd.randrange(150)
            text += b[a:a + rnd.randint(20, 120)]
            if rnd.random() < 0.5:
                text += "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 60)))
        rows.append((i if rnd.random() < 0.95 else rnd.choice((None, 7)), text))
    rows += [(500, "x" * 3000), (501, "x" * 2000), (502, "ab" * 700), (503, "ab" * 30), (504, None), (505, ""),
             (3, rows[3][1]), (600, rows[5][1]), (601, "y" * 49), (602, "y" * 49), (603, "q" * 50), (604, "q" * 50)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"chunk": 2000, "block": 500}])
def test_passages(spark, sizes):
    rows = passage_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = suffixes.without_repeats(df, **sizes)
    assert rows_of(suffixes.digest(found)) == removed(rows)
    texts = {d: (t or "").encode() for d, t in rows if d not in (None, 3, 7)}
    for r in found.collect():
        if r.doc_id in texts:
            rest = bytearray(texts[r.doc_id])
            for span in reversed(r.removed):
                del rest[span.start:span.end]
            assert rest == r.kept


def test_passages_of_odd_tables(spark, odd, odd_wide, nothing):
    want = removed([(r.doc_id, r.text) for r in odd.collect()])
    assert rows_of(suffixes.digest(suffixes.without_repeats(odd))) == want
    assert rows_of(suffixes.digest(suffixes.without_repeats(odd_wide))) == want
    assert rows_of(suffixes.without_repeats(nothing)) == []


def test_suffixes_are_sorted():
    rnd = random.Random(3)
    text = bytes(rnd.choice(b"ab") for _ in range(400)) * 3 + b"a" * 300 + bytes(range(256)) * 2
    starts = np.array(sorted(rnd.sample(range(len(text) - 49), 900)))
    order, begins = suffixes.sorted_groups(np.frombuffer(text, np.uint8), starts)
    strings = [text[i:i + 50] for i in starts[order].tolist()]
    assert strings == sorted(strings)
    assert begins.tolist() == [k == 0 or strings[k] != strings[k - 1] for k in range(len(strings))]
