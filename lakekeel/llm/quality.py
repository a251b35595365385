"""Quality rules: counts per document, failure rates per host, and host verdicts for the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekeel.llm.common import fresh, let, small_side, words
from lakekeel.session import stage

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT = 20  # per cent of the words that may lie in repeated windows
WINDOW = 5  # words
HOST_LIMIT = 0.5  # shrunk failure rate from which a host is rejected
MIN_PRIOR, MAX_PRIOR = 1.0, 1000.0  # documents that the prior may weigh


def repeated_words(ws: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in a window found twice or more in the list; the first finding counts too.

    A text whose windows all have different hashes costs one pass. Otherwise windows are sorted by hash, neighbours
    with equal hashes and equal words are the repeats, and their starts, in order, give the cover.
    """

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (window - 1))
        return F.transform(starts, lambda i: F.xxhash64(*[F.element_at(w, (i + k).cast("int")) for k in range(window)]))

    def covered(w: Column, h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def same(x: Column, y: Column) -> Column:
            return (x["h"] == y["h"]) & (F.slice(w, x["i"] + 1, window) == F.slice(w, y["i"] + 1, window))

        def twice(s: Column) -> Column:
            return F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False))
                            | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)))

        starts = F.sort_array(F.transform(let(pairs, lambda s: twice(s)), lambda x: x["i"]))
        # each start covers up to the next start, the last one its whole window
        return let(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))),
            F.lit(0).cast("bigint"), lambda n, x: n + x))

    none = F.lit(0).cast("bigint")
    return let(ws, lambda w: F.when(F.size(w) < window + 1, none).otherwise(let(
        hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(w, h)))))


def document_stats(documents: DataFrame) -> DataFrame:
    """All columns of ``documents`` and the five counts of its text, and base_failed.

    Null and empty texts have no words. All counts are over the whole text, inside the row: nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    counts = {
        "n_words": let(words(F.col("text")), lambda w: F.struct(
            F.size(w).cast("bigint").alias("n"), repeated_words(w).alias("r"))),
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("bigint"),
        "n_dup_lines": let(lines, lambda s: (F.size(s) - F.size(F.array_distinct(s))).cast("bigint")),
    }
    counted = documents.withColumns(counts)
    counted = counted.withColumns({"n_words": F.col("n_words.n"), "n_repeat_words": F.col("n_words.r")})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def host_verdicts(stats: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n_docs, n_failed, rate, host_rejected) of stats(host, base_failed).

    The failure rate of a host is shrunk towards the mean of all: a beta prior whose mean and weight are fitted to
    the hosts' rates by moments, with the spread that the sizes of the hosts explain taken off. The prior is one
    row and is read as scalar subqueries. Rows without a host take no part.
    """
    hosts = stats.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    own = F.col("n_failed") / F.col("n_docs")
    sums = hosts.agg(
        F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("hosts"),
        F.sum(own).alias("r"), F.sum(own * own).alias("rr"), F.sum(1 / F.col("n_docs")).alias("inv"))
    m = (F.col("f") + 0.5) / (F.col("n") + 1.0)
    mean = F.col("r") / F.col("hosts")
    spread = F.col("rr") / F.col("hosts") - mean * mean - m * (1 - m) * F.col("inv") / F.col("hosts")
    weight = F.when(spread > 0, m * (1 - m) / spread - 1).otherwise(F.lit(MAX_PRIOR))
    prior = sums.select(m.alias("m"), F.least(F.greatest(weight, F.lit(MIN_PRIOR)), F.lit(MAX_PRIOR)).alias("w"))
    m0, w0 = prior.select("m").scalar(), prior.select("w").scalar()
    rate = (F.col("n_failed") + m0 * w0) / (F.col("n_docs") + w0)
    return hosts.withColumn("rate", rate).withColumn("host_rejected", F.col("rate") > limit)


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge_quality(documents: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Per row of documents(doc_id, text, host): doc_id, host, the counts, base_failed, host_rate, kept.

    A document is kept if it passes the base rules and its host is not rejected; without a host the base rules
    decide. Texts are read once: the counts are staged, grouped by host with partial sums, and the few rejected or
    rated hosts are joined back. Repeated rows and null ids give a row each; other columns are not read.
    """
    slim = documents.select("doc_id", "text", F.col(host).alias("host"))
    stats = stage(document_stats(slim).drop("text"), "quality")
    verdicts = small_side(
        host_verdicts(stats, "host", limit).select("host", F.col("rate").alias("host_rate"), "host_rejected"), "hosts")
    kept = ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))
    return stats.join(verdicts, "host", "left").select(
        "doc_id", "host", *STATS, "base_failed", "host_rate", kept.alias("kept"))


def keep_good(documents: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that pass, with all their columns.

    Rows are judged again by their own text while they are read for output, so no text is moved; the host verdicts
    come from the counts of all rows.
    """
    slim = documents.select("text", F.col(host).alias("host"))
    failed = stage(document_stats(slim).select("host", "base_failed"), "quality")
    name = fresh(documents, "__host")
    bad = small_side(
        host_verdicts(failed, "host", limit).filter("host_rejected").select(F.col("host").alias(name)), "hosts")
    good = document_stats(documents.select(*[F.col(c).alias(f"__{c}") for c in documents.columns], "text"))
    good = good.filter(~F.col("base_failed")).select(*[F.col(f"__{c}").alias(c) for c in documents.columns])
    return good.join(bad, F.col(host) == F.col(name), "left_anti")
