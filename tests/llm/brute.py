"""Plain Python versions of the operators, for small inputs."""

import functools
import hashlib
import itertools
import re
import struct
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen, hit = defaultdict(list), set()
    for i in range(len(words) - 4):
        seen[tuple(words[i:i + 5])].append(i)
    for at in seen.values():
        if len(at) > 1:
            hit.update(k for i in at for k in range(i, i + 5))
    lines = [s for s in text.split("\n") if WORD.search(s)]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


KINDS = (
    ("assign", re.compile(
        r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
        r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
)


def secrets(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        found += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    found.sort()
    return found


def fingerprint(text):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    if not words:
        return 0
    runs = [" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    """Smallest reachable node of each node."""
    nodes = list(nodes)
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


@functools.cache
def windows_of(items):
    """{length: {window: items}}"""
    out = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        own = benchmark_words(text)
        n = min(len(own), 10)
        for i in range(len(own) - n + 1 if n else 0):
            out[n][tuple(own[i:i + n])].add(item)
    return out


def contamination(text, items):
    words, hit, found = benchmark_words(text), set(), set()
    for n, runs in windows_of(tuple(items)).items():
        for i in range(len(words) - n + 1):
            owners = runs.get(tuple(words[i:i + n]))
            if owners:
                hit.update(range(i, i + n))
                found |= owners
    found.discard(None)
    return len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_words(line):
    return [w for w in re.split("[ \t\x0b\x0c\r]", line.lower()) if w]


def xx(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def chained(block, values):
    h = xx(struct.pack("<i", block))
    for v in values:
        h = xx(struct.pack("<q", v), h)
    return h


def line_blocks(words):
    """({block: key}, SimHash in blocks) of a line."""
    some = [w for w in words if len(w) >= 5] or words
    hashes = sorted(xx(w.encode()) % (1 << 40) for w in some)
    keys, sim = {}, 0
    for b in range(10):
        own = [h for h in hashes if (b << 40) // 10 <= h < ((b + 1) << 40) // 10]
        if own:
            after = hashes[(hashes.index(own[0]) + 1) % len(hashes)]
            keys[b] = chained(b, own if len(own) > 1 else [own[0], after])
            sim |= own[0] % 64 << 6 * b
    return keys, sim


def similar(x, y, similarity=0.8):
    may = int(max(len(x), len(y)) * (1 - similarity) + 1e-9)
    u, v = x.split(" "), y.split(" ")
    if min(len(x), len(y)) < 20:
        return False
    if levenshtein(u, v) > int(max(len(u), len(v)) * 0.6 + 1e-9):
        return False
    return abs(len(x) - len(y)) <= may and levenshtein(x, y) <= may


def dropped_lines(documents, similarity=0.8, crowd=1000):
    """{(doc_id, text): positions that go}"""
    docs = sorted({(d, t) for d, t in documents if t is not None},
                  key=lambda r: (r[0] is not None, r[0] or 0, xx_signed(r[1])))
    places = [(d, t, p, " ".join(line_words(s))) for d, t in docs for p, s in enumerate(t.split("\n"))]
    blocks = {n: line_blocks(n.split(" ")) for n in dict.fromkeys(n for *_, n in places if n)}
    held = defaultdict(set)
    for n, (keys, _) in blocks.items():
        for k in keys.values():
            held[k].add(n)
    longer = defaultdict(set)
    for n, (keys, _) in blocks.items():
        for b, k in keys.items():
            if len(held[k]) > crowd:
                parts = [keys.get(x % 10) for x in (b, b + 1, b + 2)]
                h = 42
                for part in parts:
                    h = h if part is None else xx(struct.pack("<Q", part), h)
                longer[h].add(n)
    groups_of = [g for g in held.values() if len(g) <= crowd] + list(longer.values())
    linked = set()
    for g in groups_of:
        for a, b in itertools.combinations(sorted(g), 2):
            if (a, b) not in linked and (blocks[a][1] ^ blocks[b][1]).bit_count() <= 20 and similar(a, b, similarity):
                linked.add((a, b))
    root = {n: n for n in blocks}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        root[find(a)] = find(b)
    first, out = {}, defaultdict(list)
    for d, t, p, n in places:
        if n and first.setdefault(find(n), (d, t, p)) != (d, t, p):
            out[d, t].append(p)
    return dict(out)


def xx_signed(text):
    v = xxhash.xxh64_intdigest(text.encode(), 42)
    return v - (1 << 64) if v >> 63 else v
