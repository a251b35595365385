"""Helpers shared by the text operators: words, fixed patterns, and connected groups of a link table."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakekeel.session import stage, staged_path

SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once per row however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The runs of characters other than space and the ASCII white-space controls; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def long_id(df: DataFrame, name: str = "doc_id") -> Column:
    """The column as a long; one that is a long already stays bare, so that equal plans look equal to Spark."""
    return F.col(name) if dict(df.dtypes)[name] == "bigint" else F.col(name).cast("bigint").alias(name)


def first_of(df: DataFrame, key: str | list[str], order: Column) -> DataFrame:
    """The first whole row per key; each map task sends on one row per key at most."""
    at = fresh(df, "__rn")
    return df.withColumn(at, F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col(at) == 1).drop(at)


def small_side(df: DataFrame, label: str, limit: int = 16 << 20) -> DataFrame:
    """``df``, staged, as the small side of a join: with a broadcast hint if its files have at most ``limit`` bytes.

    Beyond that Spark joins by shuffle; the rows of the join are the same.
    """
    kept = stage(df, label)
    size = int(str(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(kept) if size <= limit else kept


def stage_by(df: DataFrame, key: str, parts: int, label: str) -> DataFrame:
    """``df``, staged in ``parts`` buckets by ``key``: a join by that key need not move it.

    Only a table of the catalog can tell Spark its buckets. It is known under a name of its own for as long as it
    takes to plan a read of it, and forgotten at once; the files are those of ``stage`` and go with them.
    """
    spark = df.sparkSession
    path = staged_path(spark, label)
    name = "lakekeel_" + path.rsplit("-", 1)[1]
    df.write.bucketBy(parts, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    kept = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return kept


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0L)")).first()
    return row[0], row[1]


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that it reaches.

    Alternating large-star and small-star steps. Every step hands out at most one row per link, the links of a node
    with very many are spread over tasks, each round is written to the shared folder, and the driver sees one count
    and one checksum per round. Loops and repeated
    links do no harm; null ends are dropped. An empty table gives an empty table.
    """
    now = stage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct(), label,
    )
    seen = _state(now)
    while seen[0]:
        # each side of a join is a table, so Spark can split the links of a node that has very many
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), label)
        large = stage(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), label)
        low = stage(large.groupBy("a").agg(F.min("b").alias("m")), label)
        small = large.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(small.unionByName(low.withColumnRenamed("m", "b")).distinct(), label)
        after = _state(now)
        if after == seen:
            break
        seen = after
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


@contextlib.contextmanager
def arrow_batches(spark, rows: int):
    """Arrow batches of at most ``rows`` rows for the plans that are built and run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
