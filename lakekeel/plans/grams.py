"""Which texts contain which of many needles, found by a rare part of each needle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekeel.plans.skew import will_broadcast
from lakekeel.session import stage

Q = 4  # characters of a part; shorter needles are looked up whole
MANY = 1000  # needles of 2 Q characters or more from which on these are filed by parts of 2 Q
KNOWN = 4_000_000  # hashes of parts that are broadcast, at most
SAMPLE = 64  # one text of so many tells how common a part is; this orders parts, and changes no result


def parts_of(text: Column | str, q: int) -> Column:
    """The distinct runs of ``q`` characters of a text, overlapping."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)))


def _index(texts: DataFrame, needles: DataFrame, q: int) -> DataFrame:
    """(part, needle): each needle under its part that the fewest needles and sampled texts share."""
    each = needles.select("needle", F.explode(parts_of("needle", q)).alias("part"))
    sample = texts.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select(F.explode(parts_of("text", q)).alias("part"))
    held = each.groupBy("part").agg(F.count("*").alias("n"))
    seen = sample.groupBy("part").agg(F.count("*").alias("m"))
    weight = held.join(seen, "part", "left").select("part", (F.col("n") * (F.coalesce("m", F.lit(0)) + 1)).alias("weight"))
    rarest = each.join(weight, "part").groupBy("needle").agg(F.min(F.struct("weight", "part")).alias("best"))
    return rarest.select(F.col("best.part").alias("part"), "needle")


def found_in(texts: DataFrame, needles: DataFrame, q: int = Q) -> DataFrame:
    """(id, needle) for every text of ``texts`` (id, text; staged, ids distinct, no nulls) and needle in it.

    A text is taken apart once and meets only the needles whose rarest part it has; ``contains`` decides. Of over
    ``MANY`` needles the longer ones have parts of twice the length: numbers soon share all runs of four digits, and
    would meet in every text that has one of them. If the index of needles is small enough for Spark to broadcast, it
    is; otherwise hashes of its parts are, up to ``KNOWN`` of them, so that only parts which some needle has move.
    Texts move once, by their id. Work follows the length of the texts and the candidates, not texts times needles.
    """
    wanted = stage(needles.filter("needle is not null").select("needle").distinct(), "needles")
    held = wanted.groupBy(F.least(F.length("needle"), F.lit(2 * q)).alias("n")).agg(F.count("*").alias("c"))
    counts = {r[0]: r[1] for r in held.collect()}  # 2 q + 1 at most
    top = 2 * q if counts.get(2 * q, 0) > MANY else q
    met = [texts.select("id", F.lit("").alias("needle"))] if 0 in counts else []  # in every text
    for size in sorted({min(n, q) if n < 2 * q else top for n in counts} - {0}):
        up_to = F.length("needle") < top if size == q < top else F.lit(True)
        own = wanted.filter((F.length("needle") >= size) & up_to) if size >= q else wanted.filter(F.length("needle") == size)
        index = stage(_index(texts, own, size) if size >= q else own.select(F.col("needle").alias("part"), "needle"), "needle-index")
        apart = texts.select("id", F.explode(parts_of("text", size)).alias("part"))
        if not will_broadcast(index):
            hashes = stage(index.select(F.xxhash64("part").alias("h")).distinct(), "parts")
            if hashes.count() <= KNOWN:
                apart = apart.withColumn("h", F.xxhash64("part")).join(F.broadcast(hashes), "h", "left_semi").drop("h")
        met.append(apart.join(index, "part").select("id", "needle"))
    if not met:
        return texts.select("id", F.col("text").alias("needle")).limit(0)
    return reduce(DataFrame.unionByName, met).join(texts, "id").filter(F.contains("text", "needle")).select("id", "needle")


def containing(texts: DataFrame, needles: DataFrame, q: int = Q) -> DataFrame:
    """(text, needle) for every text of ``texts`` (text, distinct, not null) and needle of ``needles`` (needle) in it."""
    numbered = stage(texts.select(F.monotonically_increasing_id().alias("id"), "text"), "texts")
    return found_in(numbered, needles, q).join(numbered, "id").select("text", "needle")
