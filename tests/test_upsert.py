import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from lakekeel.operators import upsert as U

BASE = "k string, a string, b string, pos int"


def test_last_write_replaces_the_whole_row_and_keeps_its_place(spark, rows):
    base = spark.createDataFrame([("x", "1", "1", 0), ("y", "2", "2", 1)], BASE)
    changes = spark.createDataFrame(
        [("x", "new", "b", 1), ("x", "last", None, 5), ("n", "n1", None, 3), ("m", "m", "m", 2), ("n", "n2", "q", 9)],
        "k string, a string, b string, seq int")
    got = U.keyed_upsert(base, changes, "k", "seq")
    assert rows(got) == [("m", "m", "m", 2, True), ("n", "n2", "q", 3, True), ("x", "last", None, 0, False),
                         ("y", "2", "2", 1, False)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.text("xyz", max_size=3)), min_size=1, max_size=20))
def test_upsert_equals_a_loop(spark, writes):
    base = {"a": "A", "b": "B"}
    want = dict(base)
    for k, v in writes:
        want[k] = v
    order = list(enumerate(writes))
    random.Random(1).shuffle(order)
    b = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(base.items())], "k string, v string, pos int")
    c = spark.createDataFrame([(k, v, i) for i, (k, v) in order], "k string, v string, seq int").repartition(3)
    once = U.keyed_upsert(b, c, "k", "seq")
    got = [(r.k, r.v) for r in sorted(once.collect(), key=lambda r: (r.is_new, r.pos))]
    assert got == list(want.items())
    again = U.keyed_upsert(once.drop("is_new"), c, "k", "seq")
    assert sorted((r.k, r.v) for r in again.collect()) == sorted(want.items())


def test_delete_of_an_unknown_key_is_no_change(spark, rows):
    base = spark.createDataFrame([("x",), ("y",)], "k string")
    gone = spark.createDataFrame([("y",), ("nope",)], "k string")
    assert rows(U.keyed_delete(base, gone, "k")) == [("x",)]


ROW = "k string, a string, b string, tags array<string>"


def frames(spark):
    base = spark.createDataFrame(
        [("x", "1", "1", ["p"]), ("y", "2", None, ["p", "q"]), (None, "loose", None, None)], ROW)
    over = spark.createDataFrame(
        [("y", None, "o", ["q", "r", "r"]), ("z", "3", "3", ["s"]), (None, "loose", None, None), (None, "more", None, None)], ROW)
    return base, over


def keyed(df):
    return {r.k: (r.a, r.b, r.tags) for r in df.collect() if r.k}


def test_policy_0_keeps_the_base_and_nulls_new_keys(spark):
    assert keyed(U.overlay_merge(*frames(spark), "k", 0)) == {
        "x": ("1", "1", ["p"]), "y": ("2", None, ["p", "q"]), "z": (None, None, None)}


def test_policy_1_replaces_lists_whole(spark):
    assert keyed(U.overlay_merge(*frames(spark), "k", 1)) == {
        "x": ("1", "1", ["p"]), "y": ("2", "o", ["q", "r", "r"]), "z": ("3", "3", ["s"])}


def test_policy_2_merges_lists_and_keeps_rows_without_key_once(spark):
    got = U.overlay_merge(*frames(spark), "k", 2)
    assert keyed(got) == {"x": ("1", "1", ["p"]), "y": ("2", "o", ["p", "q", "r"]), "z": ("3", "3", ["s"])}
    assert sorted((r.a, r.slot) for r in got.collect() if r.k is None) == [("loose", 0), ("more", 0)]


def test_present_null_replaces(spark):
    base = spark.createDataFrame([("x", "1", "1")], "k string, a string, b string")
    over = spark.createDataFrame([("x", None, None, ["a"])], "k string, a string, b string, has array<string>")
    r = U.overlay_merge(base, over, "k", 1, present="has").first()
    assert (r.a, r.b) == (None, "1")


def test_a_row_can_bring_its_own_policy(spark):
    base = spark.createDataFrame([("x", "1"), ("y", "1")], "k string, a string")
    over = spark.createDataFrame([("x", "2", 0), ("y", "2", None), ("z", "3", 0)], "k string, a string, merge_type int")
    got = {r.k: r.a for r in U.overlay_merge(base, over, "k", 1, policy_col="merge_type").collect()}
    assert got == {"x": "1", "y": "2", "z": "3"}


def test_items_in_a_list_merge_by_name(spark):
    item = "array<struct<item_name:string,x:int,y:int>>"
    df = spark.createDataFrame(
        [([(None, 0, 0), ("a", 1, 1), ("b", 2, 2)], [("b", None, 9), ("c", 3, 3), (None, 0, 0), (None, 5, 5)])],
        f"l {item}, r {item}")
    elem = df.schema["l"].dataType.elementType
    assert isinstance(elem, T.StructType)
    got = df.select(U.merge_items(df.l, df.r, elem).alias("m")).first().m
    assert [tuple(x) for x in got] == [(None, 0, 0), (None, 5, 5), ("a", 1, 1), ("b", 2, 9), ("c", 3, 3)]


def test_generic_duplicates_stay_and_null_ids_are_equal(spark):
    s = "role string, id string, ord int"
    generic = spark.createDataFrame([("Admin", "g", 1), ("Admin", "g", 2), ("Admin", None, 3)], s)
    layer = spark.createDataFrame([("Admin", "g", 1), ("Admin", None, 2), ("Admin", "n", 3), ("Admin", "n", 4), ("Viewer", None, 5), ("Viewer", None, 6)], s)
    got = sorted((r.role, r.id or "", r.ord, r.src) for r in U.union_dedupe_priority(generic, layer, ["role", "id"], "ord").collect())
    assert got == [("Admin", "", 3, 0), ("Admin", "g", 1, 0), ("Admin", "g", 2, 0), ("Admin", "n", 3, 1), ("Viewer", "", 5, 1)]


def test_reconcile_swaps(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    ab = dict(U.reconcile(a, b, "k").collect())
    ba = dict(U.reconcile(b, a, "k").collect())
    assert ab == {1: "create", 2: "skip", 3: "delete"}
    swap = {"create": "delete", "delete": "create", "skip": "skip"}
    assert ba == {k: swap[v] for k, v in ab.items()}
    assert dict(U.reconcile(a, b, "k", remove_orphans=False).collect()) == {1: "create", 2: "skip"}


def test_later_items_of_a_name_update_earlier_ones(spark):
    item = "array<struct<item_name:string,x:int,y:int,present:array<string>>>"
    has = ["item_name", "x", "y"]
    df = spark.createDataFrame(
        [([("a", 1, 1, None), ("a", 2, None, None), ("b", 2, 2, None)], [("b", None, 9, None), ("c", 3, 3, has), ("c", 4, None, has)])],
        f"l {item}, r {item}")
    got = df.select(U.merge_items(df.l, df.r, df.schema["l"].dataType.elementType).alias("m")).first().m
    assert [tuple(x)[:3] for x in got] == [("a", 2, None), ("b", 2, 9), ("c", 4, None)]


def test_structs_and_maps_merge_at_every_level(spark):
    kind = "k string, s struct<a:int,b:int,deep:struct<x:int,merge_type:int,l:array<string>>>, m map<string,string>"
    base = spark.createDataFrame([("x", (1, 2, (3, None, ["p"])), {"a": "1", "b": "2"}), ("y", None, None)], kind)
    over = spark.createDataFrame([("x", (9, None, (8, 0, ["q"])), {"b": None, "c": "3"}), ("y", (1, None, None), {"z": "1"})], kind)
    got = {r.k: r for r in U.overlay_merge(base, over, "k", 1).collect()}
    assert (got["x"].s.a, got["x"].s.b) == (9, 2)
    assert tuple(got["x"].s.deep) == (3, None, ["p"])  # the level says 0
    assert got["x"].m == {"a": "1", "b": None, "c": "3"} and got["y"].m == {"z": "1"} and got["y"].s.a == 1
    kept = {r.k: r for r in U.overlay_merge(base, over, "k", 0).collect()}
    assert kept["x"].s.a == 1 and kept["x"].m == {"a": "1", "b": "2", "c": None}
    marked = spark.createDataFrame([("x", None, {"merge_type": "0", "a": "7"})], kind)
    assert U.overlay_merge(base, marked, "k", 2).filter("k = 'x'").first().m == {"a": "1", "b": "2"}


def test_null_keys_are_one_key(spark, rows):
    base = spark.createDataFrame([(None, "1", "1", 0), ("y", "2", "2", 1)], BASE)
    changes = spark.createDataFrame([(None, "n", "n", 1), ("z", "z", "z", 2)], "k string, a string, b string, seq int")
    upserted = U.keyed_upsert(base, changes, "k", "seq")
    assert rows(upserted) == sorted([(None, "n", "n", 0, False), ("y", "2", "2", 1, False), ("z", "z", "z", 2, True)], key=repr)
    assert rows(U.reconcile(base, changes, "k")) == sorted([(None, "skip"), ("y", "create"), ("z", "delete")], key=repr)
    assert U.keyed_delete(base, changes, "k").count() == 2


def test_upsert_reads_the_base_once(spark, tmp_path):
    spark.createDataFrame([("x", "1", "1", 0)], BASE).write.parquet(str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    changes = spark.createDataFrame([("x", "n", "n", 1)], "k string, a string, b string, seq int")
    plan = U.keyed_upsert(base, changes, "k", "seq")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_unknown_policy(spark):
    with pytest.raises(ValueError):
        U.overlay_merge(*frames(spark), "k", 3)


def test_changes_without_a_sequence_come_first(spark, rows):
    base = spark.createDataFrame([("a", 1, 0), ("b", 1, 1)], "k string, v int, pos int")
    changes = spark.createDataFrame([("a", 2, None), ("b", 2, None), ("b", 3, 5), ("c", 4, None)], "k string, v int, seq int")
    got = U.keyed_upsert(base, changes, "k", "seq").select("k", "v", "pos", "is_new")
    assert rows(got) == rows(spark.createDataFrame(
        [("a", 2, 0, False), ("b", 3, 1, False), ("c", 4, None, True)], "k string, v int, pos int, is_new boolean"))
