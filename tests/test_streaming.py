import datetime
import math

from pyspark.sql import functions as F

from lakekeel.plans import zones
from lakekeel.plans.ranges import ranked_values
from lakekeel.streaming.ingest import ingest_stream, landed, landing_schema
from lakekeel.streaming.sync import compact, current_rows, sync_stream, target_schema

SF = "/root/testdata/sf0.001"


def replay(spark, tmp_path, files=6):
    """The events as several files in no order of time, with some of them delivered twice."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    src = str(tmp_path / "src")
    events.unionByName(events.filter("event_type = 'click'")).repartition(files).write.parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(src)
    return events, stream


def finish(q):
    q.awaitTermination()
    assert q.exception() is None
    return q


def test_sync_equals_batch_over_several_batches_and_a_restart(spark, tmp_path, rows):
    events, stream = replay(spark, tmp_path)
    target, ck = str(tmp_path / "target"), str(tmp_path / "ck")
    q = finish(sync_stream(stream, target, "user_id", ["ts", "event_id"], ck))
    assert len(q.recentProgress) >= 3
    schema = target_schema(stream, "user_id")
    got = current_rows(spark, target, schema, "user_id")
    want = events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    assert rows(got.select("user_id", "event_id")) == rows(want)
    # nothing new: a restart from the checkpoint changes nothing
    finish(sync_stream(stream, target, "user_id", ["ts", "event_id"], ck))
    assert rows(current_rows(spark, target, schema, "user_id").select("user_id", "event_id")) == rows(want)
    compact(spark, target, schema, "user_id", 2)
    assert spark.read.parquet(f"{target}-upto=2").count() == want.count()
    assert rows(current_rows(spark, target, schema, "user_id").select("user_id", "event_id")) == rows(want)


def test_equal_heads_are_not_written_again_and_bases_are_used(spark, tmp_path, rows):
    events, stream = replay(spark, tmp_path)
    target = str(tmp_path / "target")
    q = finish(sync_stream(stream, target, "user_id", ["ts", "event_id"], str(tmp_path / "ck"), head="event_id", compact_every=2))
    batches = len({p.batchId for p in map(_progress, q.recentProgress)})
    log = spark.read.parquet(target).filter("kind = 'row'")
    assert log.count() == log.select("user_id", "event_id").distinct().count()  # each version once
    assert batches >= 3 and spark.read.parquet(f"{target}-upto=1").count() > 0
    got = current_rows(spark, target, target_schema(stream, "user_id"), "user_id")
    want = events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    assert rows(got.select("user_id", "event_id")) == rows(want)
    delivered = spark.read.parquet(str(tmp_path / "src")).groupBy("user_id").agg(F.count("*").alias("n_changes"))
    assert rows(got.select("user_id", "n_changes")) == rows(delivered)


def test_sync_runs_in_a_session_with_the_default_store(spark, tmp_path, rows):
    """The state needs a store of its own kind, whatever the session is set to; the session keeps its setting."""
    plain, store = spark.newSession(), "spark.sql.streaming.stateStore.providerClass"
    default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    plain.conf.set(store, default)
    events, stream = replay(plain, tmp_path)
    target = str(tmp_path / "target")
    finish(sync_stream(stream, target, "user_id", ["ts", "event_id"], str(tmp_path / "ck")))
    assert plain.conf.get(store) == default
    got = current_rows(plain, target, target_schema(stream, "user_id"), "user_id")
    want = events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    assert rows(got.select("user_id", "event_id")) == rows(want)


def test_sync_of_null_keys_late_rows_and_ties(spark, tmp_path, rows):
    """File by file: an older row and an equal head change the count only, a null key is a key."""
    schema = "k string, at int, head string, x int"
    steps = [[("a", 5, "h1", 1), (None, 1, "n1", 2), ("b", None, "b0", 3)], [("a", 3, "h0", 4), (None, 2, "n2", 5)],
             [("a", 7, "h1", 6), ("b", None, "b1", 7), ("a", 6, "h9", 8)], [("a", 8, "h2", 9)]]
    src, target, ck = (str(tmp_path / x) for x in ("src", "target", "ck"))
    for step in steps:
        spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        finish(sync_stream(stream, target, "k", "at", ck, head="head", compact_every=3))
    got = current_rows(spark, target, target_schema(stream, "k"), "k")
    assert rows(got) == rows(spark.createDataFrame(
        [("a", 8, "h2", 9, 5), (None, 2, "n2", 5, 2), ("b", None, "b1", 7, 2)], schema + ", n_changes bigint"))
    written = spark.read.parquet(target).filter("kind = 'row'").select("k", "head")
    assert rows(written) == rows(spark.createDataFrame([("a", "h1"), (None, "n1"), ("b", "b0"), (None, "n2"), ("b", "b1"), ("a", "h2")], "k string, head string"))


class _progress:
    def __init__(self, p):
        self.batchId = p["batchId"]


def test_ingest_keeps_each_event_once_and_drops_no_old_one(spark, tmp_path, rows):
    events, stream = replay(spark, tmp_path)
    landing = str(tmp_path / "landing")
    finish(ingest_stream(stream, landing, "event_id", "ts", str(tmp_path / "ck")))
    schema = landing_schema(events.schema)
    assert rows(landed(spark, landing, schema).drop("batch_id", "key_part", "event_date")) == rows(events)
    # all of them once more, in a new source file after a restart
    events.repartition(1).write.mode("append").parquet(str(tmp_path / "src"))
    finish(ingest_stream(stream, landing, "event_id", "ts", str(tmp_path / "ck")))
    assert landed(spark, landing, schema).count() == events.count()


def test_ingest_of_null_keys_and_changed_dates(spark, tmp_path, rows):
    """Rows without a key land each; a repeat under another date does not; the earliest of a batch stays."""
    schema = "id bigint, ts timestamp_ntz, v int"
    day = lambda d: datetime.datetime(2024, 1, d)
    src, landing, ck = (str(tmp_path / x) for x in ("src", "landing", "ck"))
    for step in ([(1, day(2), 1), (1, day(1), 2), (None, day(1), 3), (None, day(1), 3), (None, day(2), 4)],
                 [(1, day(9), 5), (2, day(1), 6), (None, None, 7), (3, None, 8)], [(2, day(3), 9), (3, day(1), 10)]):
        spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(src)
        finish(ingest_stream(spark.readStream.schema(schema).parquet(src), landing, "id", "ts", ck, parts=3))
    got = landed(spark, landing, landing_schema(spark.createDataFrame([], schema).schema))
    assert sorted(r.v for r in got.collect()) == [2, 3, 3, 4, 6, 7, 8]


def test_base_is_upserted_and_landing_grows(spark, tmp_path):
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "orders", "customer", "nation")}
    first = zones.zone_pipeline(tables, str(tmp_path))
    n = first["base"].count()
    changed = tables["lineitem"].limit(50).withColumn("l_tax", F.lit(0.01))
    parts = lambda: {p.name: {f.name for f in p.glob("*.parquet")} for p in (tmp_path / "base" / "lineitem").glob("_part=*")}
    before, own = parts(), changed.select(F.pmod(F.xxhash64(*zones.LINE_KEY), F.lit(zones.PARTS))).distinct().count()
    second = zones.zone_pipeline({**tables, "lineitem": changed}, str(tmp_path))
    after = parts()
    assert len(before) == zones.PARTS > own >= sum(before[p] != after[p] for p in before) > 0  # others are not rewritten
    assert second["base"].count() == n
    assert spark.read.parquet(str(tmp_path / "landing" / "lineitem")).count() == tables["lineitem"].count() + 50
    ok = changed.filter("l_quantity > 0 and l_discount between 0 and 0.08").count()
    assert second["base"].filter("l_tax = 0.01").count() >= ok > 0


def test_rejects_name_every_failed_check(spark):
    df = spark.createDataFrame([(1.0, 0.01, None), (-1.0, 0.5, None)], "l_quantity double, l_discount double, l_shipdate date")
    good, bad = zones.split_rejects(df, zones.line_checks())
    assert good.count() == 0
    assert sorted(r._failed for r in bad.collect()) == [["quantity_positive", "discount_in_range", "shipped"], ["shipped"]]


def test_error_share(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 01:00:00' as ts, t as event_type, v as value from values ('error', 1d), ('view', 2d), ('view', 3d), ('view', 200d) as x(t, v)")
    got = {r.event_type: (r.n, r.n_slow, r.error_share, r.p50) for r in zones.deploy_log_metrics(df).collect()}
    assert got == {"error": (1, 0, 0.25, 1.0), "view": (3, 1, 0.25, 3.0)}


def test_percentiles_are_exact(spark):
    df = spark.range(0, 100_001).select(
        F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.lit("view").alias("event_type"), (F.col("id") / 7).alias("value"))
    r = zones.deploy_log_metrics(df).first()
    assert (r.p50, r.p95) == (50_000 / 7, 95_000 / 7)


def test_percentiles_of_a_group_of_a_third_of_all_rows(spark):
    rows = spark.range(0, 30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 50)).alias("g"),
        F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id"), F.lit(5000)).cast("double")).alias("v"), (F.col("id") % 4).alias("c"))
    once = rows.filter("v is not null and c > 0").groupBy("g", "v").agg(F.sum("c").alias("c"))
    got = {(r.g, r.share): r.v for r in ranked_values(once, ["g"], "v", "c", [0.5, 0.95, 1.0], ranges=16).collect()}
    lists = {}
    for r in once.collect():
        lists.setdefault(r.g, []).extend([r.v] * r.c)
    want = {(g, s): sorted(vs)[max(math.ceil(len(vs) * s) - 1, 0)] for g, vs in lists.items() for s in (0.5, 0.95, 1.0)}
    assert got == want


def test_a_first_load_moves_its_rows_once(spark, tmp_path, monkeypatch):
    """Nothing is replaced by the first load, so nothing is staged; a second one gives the last row of each key."""
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 3), (2, "d", None)], "k int, v string, at int")
    with monkeypatch.context() as m:
        m.setattr(zones, "stage", None)
        first = zones.upsert_base(df, str(tmp_path / "base"), ["k"], "at")
    assert sorted((tuple(r) for r in first.collect()), key=repr) == [(1, "b"), (2, "d"), (None, "c")]
    more = spark.createDataFrame([(None, "x", None), (1, "y", None), (3, "z", 1)], "k int, v string, at int")
    second = zones.upsert_base(more, str(tmp_path / "base"), ["k"], "at")
    assert sorted((tuple(r) for r in second.collect()), key=repr) == [(1, "y"), (2, "d"), (3, "z"), (None, "x")]
