"""Layered tables: landing, base and curated zones, and a log summary."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekeel.plans.ranges import ranked_values
from lakekeel.session import stage

MONEY = "decimal(12,2)"
RATE = "decimal(4,2)"


LOADED, SOURCE, PLACE = "_loaded_at", "_source", "_place"


def land(df: DataFrame, path: str, source: str) -> DataFrame:
    """Append a raw copy as a load of its own, with load columns; returns the rows of this load.

    ``_place`` is the order of a row within all loads: the time of the load, the file and the place in the file.
    """
    load = f"{path}/load={uuid.uuid4().hex[:12]}"
    df.withColumns({SOURCE: F.lit(source), LOADED: F.current_timestamp()}).write.parquet(load)
    extra = [T.StructField(SOURCE, T.StringType()), T.StructField(LOADED, T.TimestampType())]
    rows = df.sparkSession.read.schema(T.StructType([*df.schema.fields, *extra])).parquet(load)
    return rows.withColumn(PLACE, F.struct(LOADED, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")))


PARTS = 64  # of a Base table, by hash of its key
PART = "_part"


def upsert_base(rows: DataFrame, path: str, keys: Sequence[str], seq: str, parts: int = PARTS) -> DataFrame:
    """Upsert ``rows`` into the Base table at ``path``, which is made by the first load; returns the table.

    Rows of an old key replace it whole; of several rows of one key the last by ``seq`` counts. The table is
    partitioned by hash of the key. Only the parts that hold keys of the load are read, staged and overwritten; all
    others stay as they are. A load that is run again gives the same table. ``parts`` is fixed by the first load.
    """
    spark = rows.sparkSession
    plain = T.StructType([f for f in rows.schema.fields if f.name != seq])
    schema = T.StructType([*plain.fields, T.StructField(PART, T.IntegerType())])
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    marked = rows.withColumn(PART, part)
    payload = [f.name for f in plain.fields if f.name not in keys]

    def last(some: DataFrame) -> DataFrame:
        """The last row per key; rows of a part are in one task already, so they move once and are written there."""
        found = some.repartition(PART).groupBy(PART, *keys).agg(F.max_by(F.struct(*payload), "__order").alias("__row"))
        return found.select(*keys, "__row.*", PART).select(*schema.names)

    ordered = marked.withColumn("__order", F.struct(F.lit(True), F.col(seq).isNotNull(), F.col(seq).alias("seq")))
    try:
        table = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        merged = last(ordered)
    else:
        touched = [r[0] for r in marked.select(PART).distinct().collect()]  # ``parts`` numbers at most
        old = F.struct(F.lit(False), F.lit(False), F.lit(None).cast(rows.schema[seq].dataType).alias("seq"))
        known = table.filter(F.col(PART).isin(touched)).withColumn("__order", old)
        merged = stage(last(ordered.drop(seq).unionByName(known)), "base")  # reads what it replaces
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    return spark.read.schema(schema).parquet(path).drop(PART)


def split_rejects(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check, and the others with the names of the failed checks."""
    passed = {name: F.coalesce(ok, F.lit(False)) for name, ok in checks.items()}
    every = reduce(lambda a, b: a & b, passed.values())
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in passed.items()]))
    return df.filter(every), df.filter(~every).withColumn("_failed", failed)


def line_checks() -> dict[str, Column]:
    return {
        "quantity_positive": F.col("l_quantity") > 0,
        "discount_in_range": F.col("l_discount").between(0, 0.08),
        "shipped": F.col("l_shipdate").isNotNull(),
    }


def revenue_by_nation_month(lines: DataFrame, orders: DataFrame, customers: DataFrame, nations: DataFrame) -> DataFrame:
    """Exact decimal revenue per nation and month.

    Lines are summed per order, then per customer and month, so the joins above carry sums, not lines, and
    a customer with very many orders is one row per month when it is joined.
    """
    amount = F.col("l_extendedprice") * (F.lit(1).cast(RATE) - F.col("l_discount"))
    per_order = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(amount).alias("revenue"))
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    per_customer = (
        orders.select("o_orderkey", "o_custkey", month)
        .join(per_order, "o_orderkey")
        .groupBy("o_custkey", "month")
        .agg(F.sum("revenue").alias("revenue"), F.count("*").alias("n_orders"))
    )
    nation = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return (
        per_customer.join(nation, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("n_name", "month")
        .agg(F.sum("revenue").alias("revenue"), F.sum("n_orders").alias("n_orders"))
    )


LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def zone_pipeline(sources: Mapping[str, DataFrame], out_dir: str) -> dict[str, DataFrame]:
    """One load. Landing: raw copies, load after load. Base: typed lines, upserted, rejects apart. Curated: revenue.

    ``sources`` holds lineitem, orders, customer and nation; what earlier loads have left in ``out_dir`` is the Base
    that this one adds to. Lines are checked in one pass over the landing, which is written once, by result.
    """
    landing = {name: land(df, f"{out_dir}/landing/{name}", name) for name, df in sources.items()}
    lines = landing["lineitem"]
    spark = lines.sparkSession
    passed = {name: F.coalesce(ok, F.lit(False)) for name, ok in line_checks().items()}
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in passed.items()]))
    checked = f"{out_dir}/checked/{uuid.uuid4().hex[:12]}"
    judged = lines.withColumn("_failed", failed).withColumn(
        "_result", F.when(F.size("_failed") == 0, "passed").otherwise("failed"))
    judged.write.partitionBy("_result").parquet(checked)
    known = spark.read.schema(judged.schema).parquet(checked)
    good = known.filter("_result = 'passed'").drop("_result", "_failed")
    typed = good.withColumns(
        {
            "l_extendedprice": F.col("l_extendedprice").cast(MONEY),
            "l_discount": F.col("l_discount").cast(RATE),
            "l_tax": F.col("l_tax").cast(RATE),
            "l_shipdate": F.col("l_shipdate").cast("date"),
        }
    ).drop(SOURCE, LOADED)
    now = upsert_base(typed, f"{out_dir}/base/lineitem", LINE_KEY, PLACE)
    revenue = revenue_by_nation_month(now, landing["orders"], landing["customer"], landing["nation"])
    curated = f"{out_dir}/curated/revenue"
    revenue.write.mode("overwrite").parquet(curated)
    return {
        "landing": lines,
        "base": now,
        "rejects": known.filter("_result = 'failed'").drop("_result"),
        "curated": spark.read.schema(revenue.schema).parquet(curated),
    }


def deploy_log_metrics(events: DataFrame) -> DataFrame:
    """Per event type and day: events, share of the day's events, median and 95th percentile of the value.

    Percentiles are exact: the least value up to which that share of the values lies. Equal values are counted in
    the map tasks first; ``ranked_values`` then picks the values by their ranks, without all values of a group in one task.
    """
    kind = ["day", "event_type"]
    values = stage(events.groupBy(F.to_date("ts").alias("day"), "event_type", "value").agg(F.count("*").alias("c")), "values")
    counts = values.groupBy(*kind).agg(
        F.sum("c").alias("n"),
        F.sum(F.when(F.col("value") > 100, F.col("c")).otherwise(0)).alias("n_slow"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )
    shares = {"p50": 0.5, "p95": 0.95}
    found = ranked_values(values.filter("value is not null"), kind, "value", "c", list(shares.values()))
    picked = found.groupBy(*kind).agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(p) for p, s in shares.items()])
    same = [counts[c].eqNullSafe(picked[c]) for c in kind]
    counts = counts.join(picked, same[0] & same[1], "left").select(*[counts[c] for c in counts.columns], *shares)
    day = Window.partitionBy("day")  # one row per event type by now
    days = counts.withColumns(
        {
            "n_day": F.sum("n").over(day),
            "n_error": F.sum(F.when(F.col("event_type") == "error", F.col("n")).otherwise(0)).over(day),
        }
    )
    return days.select(
        "day", "event_type", "n", "n_slow", (F.col("n_error") / F.col("n_day")).alias("error_share"), "p50", "p95",
        "min_value", "max_value",
    )
