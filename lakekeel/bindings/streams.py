from pyspark.sql import Window
from pyspark.sql import functions as F

from lakekeel.bindings.registry import query, table
from lakekeel.plans import zones
from lakekeel.session import stage, work_path
from lakekeel.streaming.ingest import ingest_stream, landed, landing_schema
from lakekeel.streaming.sync import current_rows, sync_stream, target_schema


def _finish(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def _replayed(spark, sf, out):
    """The events as a stream of several files in several batches: some come again, one file later or much later."""
    events = table(spark, sf, "events")
    part = F.pmod(F.xxhash64("event_id"), F.lit(4)).cast("int")
    again = events.filter("event_type IN ('click', 'error')").withColumn("file", part + 1)
    late = events.filter("event_type = 'signup'").withColumn("file", F.lit(5))
    files = events.withColumn("file", part).unionByName(again).unionByName(late)
    files.repartition("file").sortWithinPartitions("file").write.partitionBy("file").parquet(f"{out}/files")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).option(
        "recursiveFileLookup", True).parquet(f"{out}/files")


@query(
    "sync_stream",
    """
    SELECT user_id, event_id, ts, event_type, value, props,
           CAST(sum(CASE WHEN event_type IN ('click', 'error', 'signup') THEN 2 ELSE 1 END) OVER (PARTITION BY user_id) AS BIGINT) AS n_changes
    FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
    """,
)
def sync_stream_events(spark, sf):
    out = work_path(spark, "sync")
    stream = _replayed(spark, sf, out)
    _finish(sync_stream(stream, f"{out}/target", "user_id", ["ts", "event_id"], f"{out}/checkpoint",
                        head="event_id", compact_every=2))
    return current_rows(spark, f"{out}/target", target_schema(stream, "user_id"), "user_id")


@query("ingest_stream", "SELECT * FROM events")
def ingest_stream_events(spark, sf):
    out = work_path(spark, "ingest")
    stream = _replayed(spark, sf, out)
    _finish(ingest_stream(stream, f"{out}/landing", "event_id", "ts", f"{out}/checkpoint"))
    return landed(spark, f"{out}/landing", landing_schema(stream.schema)).drop("batch_id", "key_part", "event_date")


CHECKED = """
    l AS (SELECT *, l_quantity > 0 AND l_discount BETWEEN 0 AND 0.08 AND l_shipdate IS NOT NULL AS ok FROM lineitem)
"""


ONCE = """
    once AS (SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1)
"""


def _sources(spark, sf):
    """The tables; of lines only those whose key is there once, since tables have no order that tells the later one."""
    sources = {t: table(spark, sf, t) for t in ("lineitem", "orders", "customer", "nation")}
    of_key = Window.partitionBy(*zones.LINE_KEY)
    once = sources["lineitem"].withColumn("n", F.count("*").over(of_key)).filter("n = 1").drop("n")
    return {**sources, "lineitem": stage(once, "once")}


@query(
    "zone_pipeline",
    f"""
    WITH {ONCE}, {CHECKED.replace("FROM lineitem", "FROM once")}
    SELECT n_name, strftime(o_orderdate, '%Y-%m') AS month,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue,
           count(DISTINCT o_orderkey) AS n_orders
    FROM l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey
    WHERE ok GROUP BY 1, 2
    """,
)
def zone_pipeline(spark, sf):
    curated = zones.zone_pipeline(_sources(spark, sf), work_path(spark, "zones"))["curated"]
    return curated.withColumn("revenue", F.col("revenue").cast("double"))


@query(
    "zone_two_loads",
    f"""
    WITH {ONCE}, second AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * 2 AS price, l_discount / 2 AS discount
                    FROM once WHERE l_linenumber = 1 OR l_quantity > 45),
    l AS (SELECT l_orderkey, coalesce(s.price, l_extendedprice) AS price, coalesce(s.discount, l_discount) AS discount,
                 (l_discount <= 0.08 OR s.price IS NOT NULL) AND l_quantity > 0 AND l_shipdate IS NOT NULL AS ok
          FROM once LEFT JOIN second s USING (l_orderkey, l_linenumber, l_partkey, l_suppkey))
    SELECT n_name, strftime(o_orderdate, '%Y-%m') AS month,
           CAST(sum(CAST(price AS DECIMAL(12,2)) * (1 - CAST(discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue,
           count(DISTINCT o_orderkey) AS n_orders
    FROM l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey
    WHERE ok GROUP BY 1, 2
    """,
)
def zone_two_loads(spark, sf):
    """A second load brings some lines twice with another price and ship date: the later row of the load stays."""
    sources = _sources(spark, sf)
    out = work_path(spark, "zones")
    zones.zone_pipeline(sources, out)
    some = sources["lineitem"].filter("l_linenumber = 1 OR l_quantity > 45").withColumn("l_shipdate", F.expr("l_shipdate + interval 1 day"))
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    first = some.withColumns({"l_extendedprice": price * 3, "l_discount": F.lit(0.01)})
    last = some.withColumns({"l_extendedprice": price * 2, "l_discount": discount / 2})
    curated = zones.zone_pipeline({**sources, "lineitem": first.unionByName(last)}, out)["curated"]
    return curated.withColumn("revenue", F.col("revenue").cast("double"))


@query(
    "zone_rejects",
    f"WITH {CHECKED} SELECT l_orderkey, l_partkey, l_linenumber, 'discount_in_range' AS failed FROM l WHERE NOT ok",
)
def zone_rejects(spark, sf):
    _, rejects = zones.split_rejects(table(spark, sf, "lineitem"), zones.line_checks())
    return rejects.select("l_orderkey", "l_partkey", "l_linenumber", F.array_join("_failed", ",").alias("failed"))


@query(
    "deploy_log_metrics",
    """
    WITH t AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(count_if(value > 100) AS BIGINT) AS n_slow,
                      quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95,
                      min(value) AS min_value, max(value) AS max_value FROM events GROUP BY 1, 2),
    d AS (SELECT CAST(ts AS DATE) AS day, count_if(event_type = 'error') / count(*) AS error_share FROM events GROUP BY 1)
    SELECT t.*, d.error_share FROM t JOIN d USING (day)
    """,
)
def deploy_log_metrics(spark, sf):
    return zones.deploy_log_metrics(table(spark, sf, "events"))
