from lakekeel.operators import joins as J


def test_only_the_first_left_row_and_the_last_right_row(spark, rows):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "name string, lo int")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("z", 3, "q")], "name string, ro int, v string")
    got = J.attach_first_match(left, right, "name", "v", "lo", "ro").select("name", "lo", "v")
    assert rows(got) == [("a", 1, "y"), ("a", 2, None), ("b", 3, None)]


def test_mapping_skips_empty_items_but_keeps_workspaces(spark):
    inv = spark.createDataFrame(
        [("dev", "Core", "db", "i1", None, 1), ("tst", "Core", "db", "i2", "e2", 1), ("prd", "Core", "db", "", None, 1),
         ("dev", "Core", "only", "i9", "e9", 2), ("tst", "Store", "db", "i7", "e7", 3)],
        "env string, layer string, item string, id string, endpoint string, ord int")
    args = (inv, "env", "dev", ["layer", "item"], ["id", "endpoint"], "ord", ["tst", "prd"])
    got = {(r.item, r.prop): (r.find_value, r.replace_value) for r in J.cross_env_mapping(*args).collect()}
    assert got == {("db", "id"): ("i1", {"tst": "i2"})}
    kept = {(r.item, r.prop): r.replace_value for r in J.cross_env_mapping(*args, keep_empty=True).collect()}
    assert kept == {("db", "id"): {"tst": "i2"}, ("only", "id"): {}, ("only", "endpoint"): {}}


def test_mapping_without_the_primary_env_is_empty(spark):
    inv = spark.createDataFrame([("tst", "Core", "db", "i2", 1)], "env string, layer string, item string, id string, ord int")
    assert J.cross_env_mapping(inv, "env", "dev", ["layer", "item"], ["id"], "ord", ["tst"]).count() == 0


def test_bindings_and_reasons(spark):
    bindings = spark.createDataFrame(
        [("Curated", "Store", ["M1", "M2"]), ("Base", "Store", ["M1"]), ("Gone", "Store", ["M1"])],
        "lakehouse_name string, lakehouse_ws_layer string, semantic_models array<string>")
    templates = spark.createDataFrame(
        [("Store", " Curated ", "c [{environment}]", 1), ("Store", "Curated", "other", 2), ("Store", "Base", "b", 3)],
        "lakehouse_ws_layer string, lakehouse_name string, connection_name string, ord int")
    connections = spark.createDataFrame(
        [("c [tst]", "id1", "host;db", 1), ("b", "id2", "host;", 1)],
        "connection_name string, connection_id string, path string, ord int")
    models = spark.createDataFrame([("M1", "m1")], "semantic_model string, model_id string")
    ok, bad = J.resolve_bindings(bindings, templates, connections, models, "tst")
    assert [(r.lakehouse_name, r.semantic_model, r.connection_id, r.database_name, r.model_id) for r in ok.collect()] == [
        ("Curated", "M1", "id1", "db", "m1")]
    assert sorted((r.lakehouse_name, r.semantic_model, r.reason) for r in bad.collect()) == [
        ("Base", "M1", "incomplete_connection"), ("Curated", "M2", "model_not_found"), ("Gone", "M1", "no_template")]


def test_only_earlier_mappings_count(spark, rows):
    mapping = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("z", 5, "q")], "k string, mo int, v string")
    targets = spark.createDataFrame([("k", 1), ("k", 2), ("k", 9), ("z", 5), ("n", 1)], "k string, o int")
    got = J.resolve_from_earlier(targets, mapping, "k", "o", "mo", "v").select("k", "o", "v")
    assert rows(got) == [("k", 1, None), ("k", 2, "a"), ("k", 9, "a"), ("n", 1, None), ("z", 5, None)]


def test_acl_takes_the_last_match(spark):
    df = spark.createDataFrame(
        [(1, {"a:Build:p": "x", "b:Build:p": "y"}), (2, {"c:Build:q": "z"})], "ord int, aces map<string,string>")
    r = J.explode_acl_suffix(df, "aces", ":Build:p", "ord").first()
    assert (r.acl_key, r.descriptor) == ("b:Build:p", "y")


def test_grid_over_the_bound_is_the_same(spark, rows):
    left = spark.createDataFrame([(i,) for i in range(5)], "l int")
    right = spark.createDataFrame([(f"e{i}", i) for i in range(7)], "e string, o int")
    assert rows(J.expected_grid(left, right)) == rows(J.expected_grid(left, right, rows=3))
    assert J.expected_grid(left, right).count() == 35


def test_lookup_ci(spark):
    df = spark.createDataFrame([("Repo",), ("gone",)], "n string")
    ref = spark.createDataFrame([("REPO", 2), ("repo", 1)], "r string, o int")
    hits, misses = J.lookup_ci(df, ref, "n", "r", "o")
    assert [tuple(r) for r in hits.select("n", "r").collect()] == [("Repo", "repo")]
    assert [r.n for r in misses.collect()] == ["gone"]
