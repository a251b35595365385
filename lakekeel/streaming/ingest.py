"""Append a stream of events to the landing zone, once per id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakekeel.plans.skew import first_per_key

BATCH, PART, DAY = "batch_id", "key_part", "event_date"
PARTS = 64  # parts of the keys by hash; a batch looks into those that its keys belong to


def ingest_stream(
    stream: DataFrame,
    target_path: str,
    key: str,
    ts: str,
    checkpoint: str,
    available_now: bool = True,
    parts: int = PARTS,
) -> StreamingQuery:
    """Append each row once, however often and however late the source delivers it again.

    A batch is cut to one row per key: the earliest by ``ts``, of several the one with the least hash of the row.
    Rows whose key an earlier batch has landed are left out, whatever their date. The landing is partitioned by hash
    of the key, so a batch reads the keys of its own parts only. Rows without a key cannot be told apart and land
    each. A batch owns the folder of its number and overwrites it when it is run again. There is no state to grow and no
    window to outlive.
    """
    schema = landing_schema(stream.schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        rows = batch.withColumns({PART: part, DAY: F.to_date(ts)})
        order = [F.col(ts).asc_nulls_last(), F.xxhash64(*[c for c, t in batch.dtypes if "map<" not in t]).asc()]
        once = first_per_key(rows.filter(F.col(key).isNotNull()), key, order)
        if batch_id > 0:
            own = [r[0] for r in batch.filter(F.col(key).isNotNull()).select(part).distinct().collect()]  # ``parts`` numbers at most
            known = landed(spark, target_path, schema).filter((F.col(BATCH) < batch_id) & F.col(PART).isin(own))
            once = once.join(known.select(PART, key), [PART, key], "left_anti").select(*rows.columns)
        every = once.unionByName(rows.filter(F.col(key).isNull()))
        # a file per part and batch; dates are in order within it, so that readers of some dates skip row groups
        every.repartition(PART).sortWithinPartitions(PART, DAY).write.mode("overwrite").partitionBy(PART).parquet(
            f"{target_path}/{BATCH}={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def landing_schema(events: T.StructType) -> T.StructType:
    own = [T.StructField(DAY, T.DateType()), T.StructField(BATCH, T.LongType()), T.StructField(PART, T.IntegerType())]
    return T.StructType([*events.fields, *own])


def landed(spark: SparkSession, target_path: str, schema: T.StructType) -> DataFrame:
    """All landed rows, with the number of their batch, the part of their key and their date; none before the first batch."""
    return spark.read.schema(schema).option("basePath", target_path).parquet(target_path)
