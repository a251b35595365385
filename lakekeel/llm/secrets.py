"""Secret scans: fixed patterns, and a battery of randomness tests for other long tokens, all in SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekeel.llm.common import let

# fixed values: kinds in their order, pattern, group whose length counts, least length. Runs of hex digits and of
# access-key characters are matched whole or not at all, so their least length is part of the pattern.
_KEYWORDS = "password|passwd|secret|token|api_?key"
KINDS = (
    ("assign", rf"""(?i:({_KEYWORDS}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
LEAST = 20  # characters of a token that is tested
TOKEN = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"
BLOCK = 128  # matches whose places are summed together
DISCOVERY_RATE = 0.01  # share of false findings among those of a document
UNIFORM_P = 0.001  # a token that a test of uniformity rejects at this level is not random

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# encodings, the narrowest first: pattern of a token, alphabet, and by how much per character the chi-squared
# statistic of ordinary text grows beyond that of uniform text (alphabet size times index of coincidence, less 1)
ENCODINGS = (
    ("[0-9]+", _DIGITS, 1.0),
    ("[0-9a-f]+", _DIGITS + "abcdef", 2.2),
    ("[0-9]+(?:-[0-9]+)+", _DIGITS, 1.0),
    ("[0-9a-fA-F]+(?:-[0-9a-fA-F]+)*", _DIGITS + "abcdef", 2.2),
    ("[A-Z2-7]+", _UPPER + "234567", 1.1),
    ("[a-z]+", _LOWER, 0.7),
    ("[a-z0-9]+", _LOWER + _DIGITS, 1.4),
    ("[A-Z0-9]+", _UPPER + _DIGITS, 1.4),
    ("[A-Za-z0-9]+", _LOWER + _UPPER + _DIGITS, 3.1),
    (".+", _LOWER + _UPPER + _DIGITS + "+/-_", 3.3),
)
FOLDED = "^[0-9a-fA-F]+(-[0-9a-fA-F]+)*$"  # hex is tested in lower case and without its dashes
# base36 is close to text: short tokens show themselves more often among the letters of base62, long ones only among
# their own, so these tokens have both tests
BASE62 = "[A-Za-z0-9]+"
CASED = _DIGITS + "abcdefABCDEF"  # hex of both cases, where each case of a letter is as likely as a digit
SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def matches_at(text: Column, pattern: str, group: int) -> Column:
    """(start, end, own) of the leftmost matches that do not overlap; own is the text of the group.

    The pieces between the matches and the matches take turns, so running sums of their lengths are positions, in
    code points. Sums run within blocks of ``BLOCK`` matches and then over the blocks, so that texts with very many
    matches stay cheap. The pattern must not match the empty text.
    """
    empty = F.array().cast("array<struct<start:bigint,end:bigint,own:string>>")

    def in_block(rows: Column) -> Column:
        """Places from the beginning of the block on, and the length of the block."""
        def step(acc: Column, r: Column) -> Column:
            start = acc["at"] + r["gap"]
            return F.struct((start + r["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(
                start.alias("start"), (start + r["n"]).alias("end"), r["own"].alias("own")))).alias("out"))

        return F.aggregate(rows, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")), step)

    def places(found: Column, own: Column) -> Column:
        sizes = F.zip_with(found, own, lambda m, o: F.struct(F.length(m).cast("bigint").alias("n"), o.alias("own")))
        gaps = F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap).cast("bigint"))
        rows = F.filter(F.zip_with(gaps, sizes, lambda gap, m: F.struct(
            gap.alias("gap"), m["n"].alias("n"), m["own"].alias("own"))), lambda r: r["n"].isNotNull())
        starts = F.sequence(F.lit(1), F.size(found), F.lit(BLOCK))
        blocks = let(rows, lambda every: F.transform(starts, lambda i: in_block(F.slice(every, i, BLOCK))))
        zero = F.array(F.lit(0).cast("bigint"))

        def shifted(bs: Column) -> Column:
            before = F.aggregate(bs, zero, lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
            return let(before, lambda at: F.flatten(F.transform(bs, lambda b, k: F.transform(b["out"], lambda m: F.struct(
                (m["start"] + F.get(at, k)).alias("start"), (m["end"] + F.get(at, k)).alias("end"), m["own"].alias("own"))))))

        return let(blocks, shifted)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else None
    return let(found, lambda f: F.when(F.size(f) == 0, empty).otherwise(places(f, f if own is None else own)))


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by a logistic curve that is within 0.0002 of it."""
    c = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(1.5976 * c + 0.07056 * c * c * c))


def _battery(token: Column, alphabet: Column, excess: Column) -> Column:
    """(uniform_p, text_p, bits): does the token look uniform over the alphabet; could text be as even as it is.

    uniform_p is the least p-value of three tests, times three: chi-squared of the counts, runs above and below the
    middle of the alphabet, and the correlation of neighbours. text_p is how likely text of that length has so small
    a chi-squared value; the longer the token, the further apart the two are. bits is the token's information.
    """

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def tested(s: Column, v: Column, k: Column) -> Column:
        n, df = F.size(v).cast("double"), k - 1
        squares = total(F.transform(
            F.split(alphabet, ""), lambda c: F.pow(n - F.length(F.replace(s, c, F.lit(""))), F.lit(2.0))))
        high = F.transform(v, lambda x: (x >= k / 2).cast("double"))
        runs = let(high, lambda h: F.struct(
            total(h).alias("n1"),
            (1 + total(F.transform(h, lambda x, i: F.when(x != F.get(h, i - 1), 1.0).otherwise(0.0)))).alias("runs")))
        around = let(total(v) / n, lambda m: F.transform(v, lambda x: x - m))
        serial = let(around, lambda d: F.struct(
            total(F.transform(d, lambda x, i: x * F.coalesce(F.get(d, i + 1), F.lit(0.0)))).alias("xy"),
            total(F.transform(d, lambda x: x * x)).alias("xx")))

        def p_values(chi: Column, r: Column, c: Column) -> Column:
            z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
            mean = 2 * r["n1"] * (n - r["n1"]) / n + 1
            var = (mean - 1) * (mean - 2) / (n - 1)
            z_runs = F.when(var > 0, F.abs(r["runs"] - mean) / F.sqrt(var)).otherwise(F.lit(8.0))
            z_serial = F.when(c["xx"] > 0, F.abs(c["xy"] / c["xx"]) * F.sqrt(n)).otherwise(F.lit(8.0))
            uniform = F.least(F.lit(1.0), 3 * tail(z_chi), 6 * tail(z_runs), 6 * tail(z_serial))
            as_text = (df + (n - 1) * excess - chi) / F.sqrt(2 * (df + 2 * n * excess))
            return F.struct(uniform.alias("uniform_p"), tail(as_text).alias("text_p"), (n * F.log2(k)).alias("bits"))

        return let(squares * k / n - n, lambda chi: let(runs, lambda r: let(serial, lambda c: p_values(chi, r, c))))

    values = F.transform(F.split(token, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    return let(values, lambda v: let(F.length(alphabet).cast("double"), lambda k: tested(token, v, k)))


def _tests(token: Column) -> Column:
    """The battery under the narrowest encoding that the token fits; for base36 the better of that and base62, and
    for hex of both cases the better of that without and with the case.

    Of two tests that find the token uniform, the one with the smaller text_p counts; the first is doubled before.
    """
    alphabet = excess = None
    for pattern, letters, more in reversed(ENCODINGS):
        fits = token.rlike(f"^{pattern}$")
        alphabet = F.lit(letters) if alphabet is None else F.when(fits, F.lit(letters)).otherwise(alphabet)
        excess = F.lit(more) if excess is None else F.when(fits, F.lit(more)).otherwise(excess)
    own = F.when(token.rlike(FOLDED), F.lower(F.replace(token, F.lit("-"), F.lit("")))).otherwise(token)
    letters, more = next((x, y) for pattern, x, y in ENCODINGS if pattern == BASE62)

    def trial(s: Column, a: Column, e: Column) -> Column:
        return F.struct(s.alias("s"), a.alias("a"), e.alias("e"))

    narrow, wide = trial(own, alphabet, excess), trial(token, F.lit(letters), F.lit(more))
    both = alphabet.isin([x for _, x, _ in ENCODINGS if len(x) == 36])
    cased = token.rlike("^[0-9a-fA-F]+$") & token.rlike("[a-f]") & token.rlike("[A-F]")
    trials = F.when(both, F.array(narrow, wide)).when(
        cased, F.array(narrow, trial(token, F.lit(CASED), F.lit(3.4)))).otherwise(F.array(narrow))
    results = F.transform(trials, lambda t: _battery(t["s"], t["a"], t["e"]))

    def best(rs: Column) -> Column:
        ranked = F.array_sort(F.transform(rs, lambda r, i: F.struct(
            (r["uniform_p"] < UNIFORM_P).alias("rejected"), (r["text_p"] * (F.size(rs) - i)).alias("text_p"),
            r["uniform_p"].alias("uniform_p"), r["bits"].alias("bits"))))
        return F.get(ranked, F.lit(0))

    return let(results, best)


def random_tokens(text: Column) -> Column:
    """(start, end) of the tokens that are random and not text, under false-discovery control in the document.

    Each token's text_p is divided by its weight, its information in bits over the mean of the document's tokens,
    so longer tokens need less evidence and shorter ones more; the Benjamini-Hochberg step then chooses how many of
    the smallest are findings. A finding must also pass the tests of uniformity.
    """
    tokens = F.filter(matches_at(text, TOKEN, 0),
                      lambda t: F.length(F.rtrim(t["own"], F.lit("="))) >= LEAST)
    tested = F.transform(tokens, lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), let(F.rtrim(t["own"], F.lit("=")), _tests).alias("p")))

    def weighted(ts: Column) -> Column:
        mean = F.aggregate(ts, F.lit(0.0), lambda a, t: a + t["p"]["bits"]) / F.greatest(F.size(ts), F.lit(1))
        return let(mean, lambda m: F.transform(ts, lambda t: F.struct(
            t["start"].alias("start"), t["end"].alias("end"), t["p"]["uniform_p"].alias("uniform_p"),
            (t["p"]["text_p"] * m / t["p"]["bits"]).alias("q"))))

    def chosen(ts: Column) -> Column:
        ranked = F.sort_array(F.transform(ts, lambda t: t["q"]))
        limit = F.array_max(F.transform(ranked, lambda q, i: F.when(q <= DISCOVERY_RATE * (i + 1) / F.size(ts), q)))
        return let(limit, lambda x: F.filter(ts, lambda t: (t["q"] <= x) & (t["uniform_p"] >= UNIFORM_P)))

    return let(let(tested, weighted), chosen)


def find_secrets(documents: DataFrame) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id and spans (start, rank, end, kind), in order of start and kind.

    Kinds are those of ``KINDS`` and ``random``, rank is their order; positions are code points, the end exclusive.
    A random token is added where it overlaps no span of a pattern. Null and empty texts have no spans. Each row
    stands for itself: nothing is shuffled, repeated rows and null ids give a row each, other columns are not read.
    """
    def as_span(rank: int, kind: str):
        return lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"),
                                  F.lit(kind).alias("kind"))

    def long_enough(least: int):
        return lambda m: F.length(m["own"]) >= least

    def found(text: Column) -> Column:
        base = F.concat(*[
            F.transform(F.filter(matches_at(text, pattern, group), long_enough(least)),
                        as_span(rank, kind))
            for rank, (kind, pattern, group, least) in enumerate(KINDS)])
        more = F.when(
            text.rlike(TOKEN), F.transform(random_tokens(text), as_span(len(KINDS), "random"))
        ).otherwise(F.array().cast(SPANS))
        return let(base, lambda b: F.array_sort(F.concat(b, F.filter(
            more, lambda r: ~F.exists(b, lambda x: (x["start"] < r["end"]) & (r["start"] < x["end"]))))))

    return documents.select("doc_id", let(F.coalesce(F.col("text"), F.lit("")), found).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from the rows of ``find_secrets``."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind, *_ in KINDS], F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), count("random").alias("n_random"))
