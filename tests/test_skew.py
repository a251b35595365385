"""A key with more than a third of all rows: same rows, and the work is spread."""

import pytest
from pyspark.sql import functions as F

from lakekeel.operators import joins as J
from lakekeel.plans import skew


@pytest.fixture
def low_threshold(spark, monkeypatch):
    """Few rows make a key hot, and no side is small enough for a broadcast."""
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def facts(spark, null_share=False):
    # 40 % of the rows have key 7 (or null), read by 16 tasks
    hot = F.lit(None).cast("long") if null_share else F.lit(7).cast("long")
    key = F.when(F.col("id") % 5 < 2, hot).otherwise(F.col("id") % 997)
    return spark.range(0, 5000, 1, 16).select("id", key.alias("k"))


@pytest.mark.parametrize("null_share", [False, True])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, rows, low_threshold, how, null_share):
    left = facts(spark, null_share)
    right = spark.range(0, 600).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert rows(skew.lookup_join(left, right, "k", how)) == rows(left.join(right, "k", how))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_both_sides_share_one_list_without_subquery_reuse(spark, rows, low_threshold, how):
    left = facts(spark)
    right = spark.range(0, 600).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    spark.conf.set("spark.sql.execution.reuseSubquery", "false")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        joined = skew.lookup_join(left, right, "k", how)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "Subquery" not in plan
        assert rows(joined) == rows(left.join(right, "k", how))
    finally:
        spark.conf.unset("spark.sql.execution.reuseSubquery")
        spark.conf.unset("spark.sql.exchange.reuse")


def test_hot_key_is_found_and_spread_by_its_share(spark, low_threshold):
    left = facts(spark)
    hot = skew.hot_keys(left, ["k"]).collect()
    assert [tuple(r) for r in hot] == [(left.filter("k = 7").select(F.xxhash64("k")).first()[0], 41)]
    right = spark.range(0, 1000).select(F.col("id").alias("k"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = skew.lookup_join(left, right, "k").filter("k = 7").groupBy(F.spark_partition_id().alias("p")).count()
        # the copies of the hot key are in more than one task
        assert placed.count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_hot_key_without_enough_rows(spark):
    assert skew.hot_keys(facts(spark), ["k"]).count() == 0


def test_a_small_right_side_needs_no_list(spark):
    plan = skew.lookup_join(facts(spark), spark.range(0, 600).select(F.col("id").alias("k")), "k")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and text.count("Range") == 2


def test_first_per_key_is_cut_before_the_shuffle(spark):
    df = skew.first_per_key(facts(spark), "k", ["id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    assert {(r.k, r.id) for r in df.collect() if r.k == 7} == {(7, 0)}


def test_identical_rows_of_a_hot_key_all_stay(spark, rows, low_threshold):
    left = spark.range(0, 2000, 1, 8).select(F.lit(1).alias("k"), F.lit("copy").alias("t"))
    right = spark.createDataFrame([(1, "v")], "k int, v string")
    assert skew.lookup_join(left, right, "k").count() == 2000
    assert J.rows_present(left, right, "k").count() == 2000
    assert J.rows_absent(left, right, "k").count() == 0
