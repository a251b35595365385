"""Joins and row picks that hold up when one key has a third of all rows.

``lookup_join`` joins a large frame to one row per key. A right side that Spark will broadcast needs no more than
that. Otherwise the keys with many rows are counted first, with partial sums in the map tasks, and the short list of
them is staged: both sides read the same list, so every left row meets its one right row whatever is in it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekeel.session import stage

ROWS_PER_SALT = 1_000_000  # a key is hot from so many rows on, and gets a salt for each so many

_HASH, _SALT, _SALTS, _RN = "__key_hash", "__salt", "__salts", "__rn"


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def key_hash(df: DataFrame, keys: Sequence[str]) -> Column:
    """Hash of the key, the same for every width of whole numbers."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return F.xxhash64(
        *[F.col(k).cast("bigint") if isinstance(df.schema[k].dataType, whole) else F.col(k) for k in keys]
    )


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> bool:
    def kind(df: DataFrame, k: str):
        t = df.schema[k].dataType
        return "whole" if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else t.simpleString()

    return all(kind(left, k) == kind(right, k) for k in keys)


def will_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own estimate of the size of ``df`` is within its limit for broadcasts."""
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", limit.lower()).groups()
    size = int(number) * 1024 ** " kmgtp".index(unit[0]) if unit not in ("", "b") else int(number)
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= size


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_salt: int | None = None) -> DataFrame:
    """(key hash, salts) of the keys with over ``rows_per_salt`` rows, by the share of each."""
    per_salt = rows_per_salt or ROWS_PER_SALT
    counts = df.select(key_hash(df, keys).alias(_HASH)).groupBy(_HASH).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") > per_salt).select(_HASH, F.ceil(F.col("n") / per_salt).cast("int").alias(_SALTS))


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    keys_of: DataFrame | None = None,
    rows_per_salt: int | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``, which holds at most one row per key (inner, left, left_semi or left_anti).

    Rows of hot left keys are spread by the id of the task that read them, over as many salts as the key has
    shares of ``rows_per_salt`` rows; the one right row of such a key is repeated once per salt. The id is the same
    when a lost task is run again, and copies of one row in different tasks get different salts. ``keys_of`` is a
    cheaper frame with the keys of ``left``, for a ``left`` that is itself the result of a join.
    """
    on = as_list(on)
    if not _same_keys(left, right, on):
        raise ValueError(f"cast the join keys {on} to the same types first")
    if will_broadcast(right):
        return left.join(right, on, how)
    hot = stage(hot_keys(left if keys_of is None else keys_of, on, rows_per_salt), "hot")

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn(_HASH, key_hash(df, on)).join(hot, _HASH, "left").drop(_HASH)

    copies = F.sequence(F.lit(0), F.coalesce(_SALTS, F.lit(1)) - 1)
    own = left.withColumn(_SALT, F.spark_partition_id())  # before any shuffle
    salted_left = marked(own).withColumn(
        _SALT, F.coalesce(F.pmod(F.xxhash64(_SALT), F.col(_SALTS)).cast("int"), F.lit(0))).drop(_SALTS)
    salted_right = marked(right).withColumn(_SALT, F.explode(copies)).drop(_SALTS)
    return salted_left.join(salted_right, [*on, _SALT], how).drop(_SALT)


def order_cols(ord: str | Sequence[str], desc: bool = False) -> list[Column]:
    return [F.col(c).desc() if desc else F.col(c).asc() for c in as_list(ord)]


def first_per_key(
    df: DataFrame, keys: str | Sequence[str], ord: str | Sequence[str | Column], last: bool = False
) -> DataFrame:
    """The first (or last) whole row per key.

    The ``== 1`` filter lets Spark cut every key to one row per map task (WindowGroupLimit) before the
    shuffle, so a hot key costs as much as any other.
    """
    cols = [c if isinstance(c, Column) else (F.col(c).desc() if last else F.col(c).asc())
            for c in (ord if isinstance(ord, (list, tuple)) else [ord])]
    w = Window.partitionBy(*as_list(keys)).orderBy(*cols)
    return df.withColumn(_RN, F.row_number().over(w)).filter(F.col(_RN) == 1).drop(_RN)


def distinct_keys(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """One row per key; the duplicates are dropped in the map tasks."""
    return df.select(*as_list(keys)).distinct()
