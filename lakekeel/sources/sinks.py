"""Writers: canonical JSON and gap-free keys, also over several loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekeel.plans.skew import as_list, distinct_keys, lookup_join, order_cols
from lakekeel.session import stage


def _sorted_value(c: Column, t: T.DataType) -> Column:
    """The value with the fields of structs and the keys of maps in order, at every level."""
    if isinstance(t, T.StructType):
        fields = sorted(t.fields, key=lambda f: f.name)
        return F.when(
            c.isNotNull(), F.struct(*[_sorted_value(c[f.name], f.dataType).alias(f.name) for f in fields])
        )
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _sorted_value(x, t.elementType))
    if isinstance(t, T.MapType):
        entries = F.array_sort(F.map_keys(c))
        return F.map_from_arrays(
            entries, F.transform(entries, lambda k: _sorted_value(F.element_at(c, k), t.valueType))
        )
    return c


def canonical_json(df: DataFrame) -> Column:
    """The whole row as one JSON text: keys sorted at every level, nulls kept."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    row = F.struct(*[_sorted_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields])
    return F.to_json(row, {"ignoreNullFields": "false"})


def write_canonical_json(df: DataFrame, path: str | None = None) -> DataFrame:
    """Each row as one JSON text: keys sorted at every level, nulls kept. Written to ``path`` if given."""
    out = df.select(canonical_json(df).alias("json"))
    if path:
        out.write.text(path)
    return out


def checked_names(df: DataFrame, col: str, max_length: int = 250) -> tuple[DataFrame, DataFrame]:
    """Rows whose name is set and short enough, and the others."""
    ok = F.coalesce(F.length(col) <= max_length, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def assign_identity(
    df: DataFrame,
    order_by: str | Sequence[str],
    name: str = "id",
    start: int = 1,
    partitions: int | None = None,
) -> DataFrame:
    """Gap-free numbers in the order of ``order_by``, which must be a total order.

    Rows are range-partitioned and sorted, so no task sees more than its range. The sorted rows are staged,
    since both the counts and the numbering must see the same ranges, also after a lost executor.
    """
    spark = df.sparkSession
    ord = order_cols(order_by)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the built-in id is (partition << 33) + place in the partition
    ranged = (
        df.repartitionByRange(n, *ord).sortWithinPartitions(*ord)
        .withColumn("__mid", F.monotonically_increasing_id())
    )
    rows = stage(ranged, "identity")
    part = F.shiftright("__mid", 33)
    place = F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # n rows at most
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return (
        rows.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")  # one row per range: n rows at most
        .select((F.col("__before") + place + F.lit(start)).alias(name), *[f"`{c}`" for c in df.columns])
    )


LOAD = "load_no"


def identity_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The keys that have a number, with it and with the load that gave it; none before the first load."""
    full = T.StructType([*schema.fields, T.StructField(LOAD, T.LongType())])
    try:
        return spark.read.schema(full).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def extend_identity(
    df: DataFrame, key: str | Sequence[str], path: str, load: int, name: str = "id", start: int = 1
) -> DataFrame:
    """``df`` with the number of its key: old keys keep theirs, new ones continue without gaps in the order of the key.

    The numbers live in the table at ``path``, a folder a load. Where a load begins is the high-water mark of the
    loads with smaller numbers, so a load that is run again gives the same numbers and overwrites its own folder; loads
    run one after the other. Null keys get no number and take none.
    """
    spark, keys = df.sparkSession, as_list(key)
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(name, T.LongType())])
    known = identity_table(spark, path, schema).filter(F.col(LOAD) < load)
    named = df
    for k in keys:
        named = named.filter(F.col(k).isNotNull())
    new = lookup_join(distinct_keys(named, keys), known.select(*keys), keys, "left_anti")
    top = known.agg(F.coalesce(F.max(name), F.lit(start - 1)).alias("__top"))  # one row
    numbered = assign_identity(new, keys, name="__no", start=1).crossJoin(F.broadcast(top))
    numbered.select(*keys, (F.col("__no") + F.col("__top")).cast("bigint").alias(name)).write.mode("overwrite").parquet(f"{path}/{LOAD}={load}")
    every = identity_table(spark, path, schema).filter(F.col(LOAD) <= load)
    return lookup_join(df, every.select(*keys, name), keys, "left")
