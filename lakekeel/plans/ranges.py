"""Running sums and order statistics over ranges: no task sees more than its range, however large a group is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakekeel.session import stage

RANGE = "__range"


def in_ranges(df: DataFrame, columns: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` sorted into ranges of ``columns``, staged, with the number of the range: an order on all rows."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
    return stage(sorted_.withColumn(RANGE, F.spark_partition_id()), "ranges")


def sums_before(ranged: DataFrame, group: Sequence[str], weight: str) -> DataFrame:
    """(group, range, before, own): per group and range the weights in its earlier ranges, and in this one.

    One row per group and range that has rows of it: ranges and groups together, at most, not rows.
    """
    own = ranged.groupBy(*group, RANGE).agg(F.sum(weight).alias("own"))
    earlier = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("before", F.coalesce(F.sum("own").over(earlier), F.lit(0)))


def ranked_values(
    df: DataFrame, group: Sequence[str], value: str, weight: str, shares: Sequence[float], ranges: int | None = None
) -> DataFrame:
    """(group, share, value): the least value of a group up to which that share of its weights lies.

    Rows are range-partitioned by group and value. Sums of the ranges tell in which one the wanted rank lies; only
    rows of that range are counted through. A group of a third of all rows spreads over a third of the ranges.
    """
    names = list(group)
    ranged = in_ranges(df.select(*names, value, weight), [*names, value], ranges)
    parts = sums_before(ranged, names, weight)
    total = Window.partitionBy(*names)
    wanted = parts.withColumn("all", F.sum("own").over(total)).withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    rank = F.greatest(F.col("all") * F.col("share"), F.lit(0))
    hit = stage(wanted.filter((F.col("before") < rank) & (F.col("before") + F.col("own") >= rank)).select(
        *[F.col(c).alias(f"__{c}") for c in names], F.col(RANGE).alias("__hit"), "share", "before", rank.alias("rank")), "ranks")
    same = F.col(RANGE) == F.col("__hit")
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    through = Window.partitionBy(*names, RANGE, "share").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = ranged.join(hit, same).withColumn("upto", F.col("before") + F.sum(weight).over(through))
    return counted.filter(F.col("upto") >= F.col("rank")).groupBy(*names, "share").agg(F.min(value).alias(value))
