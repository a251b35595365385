import json
import random

from pyspark.sql import functions as F

from lakekeel.functions import text as tx
from lakekeel.operators import project as P
from lakekeel.plans.grams import containing
from lakekeel.sources import scans, sinks


def one(spark, column, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(column).first()[0]


def test_is_guid_only_canonical(spark):
    g = "0f8fad5b-d9cb-469f-a165-70867728950e"
    for value, want in [(g, True), (g.upper(), True), ("{" + g + "}", False), (g.replace("-", ""), False),
                        ("urn:uuid:" + g, False), (None, False), ("", False), (g + "\n", False)]:
        assert one(spark, tx.is_guid("x"), value) is want, value


def test_split_endpoint_parts(spark):
    for value, want in [("h;d", ("h", "d")), (" h ; d ", ("h", "d")), ("h", (None, None)), ("a;b;c", (None, None)),
                        ("", (None, None)), (None, (None, None)), ("h;", ("h", ""))]:
        assert tuple(one(spark, tx.split_endpoint("x"), value)) == want


def test_branch_modes(spark):
    r = one(spark, tx.branch_parts("x"), "feature/model/new/feature")
    assert tuple(r) == ("model/new", "new")
    r = one(spark, tx.branch_parts("x", "delete"), "refs/heads/feature/model/feature/x")
    assert tuple(r) == ("model/feature/x", "x")


def test_template_is_literal_and_null_stays_null(spark):
    df = spark.createDataFrame([("a{b}$1", None)], "n string, m string")
    assert df.select(tx.expand_template("{n}/{n}", {"n": "n"})).first()[0] == "a{b}$1/a{b}$1"
    assert df.select(tx.expand_template("{m}", {"m": "m"})).first()[0] is None
    assert df.select(tx.unique_name("n", "m")).first()[0] is None


def test_kv_string_round_trip(spark):
    df = spark.createDataFrame([("w", "m")], "w string, m string")
    s = df.select(tx.build_kv_string([("Data Source", "w"), ("initial catalog", "m")], ["Data Source"]).alias("s"))
    assert s.first()[0] == 'Data Source="w";initial catalog=m;'
    assert s.select(tx.parse_kv_string("s")).first()[0] == {"Data Source": '"w"', "initial catalog": "m"}


def test_strip_noise_lines(spark):
    text = "  \n!debug\n  &#x27 warn\r\nkeep ! this\n\n!x"
    assert one(spark, tx.strip_noise("x", ["!", "&#x27"]), text) == "keep ! this\n"


def test_retarget_without_marker_still_gives_a_row_per_env(spark, rows):
    df = spark.createDataFrame([("A [dev]",), ("B",)], "n string")
    assert rows(P.retarget_env(df, "n", ["tst", "prd"]).select("env", "value")) == [
        ("prd", "A [prd]"), ("prd", "B"), ("tst", "A [tst]"), ("tst", "B")]


LABELS = [("ring", "default"), ("red", ""), ("bolt", "Bolt"), ("old", "default")]


def test_label_rules(spark):
    names = ["Ring", "old RING", "ring bolt", "red bolt", "bolt red", "ring red", "none"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = dict(P.match_labels(df, "n", P.rule_frame(spark, LABELS)).select("n", "label").collect())
    assert got == {"Ring": "default", "old RING": "default", "ring bolt": "Bolt", "red bolt": None,
                   "bolt red": None, "ring red": None, "none": None}


def test_first_match_of_a_table_and_a_list(spark, rows):
    rng = random.Random(3)
    texts = ["ring", "red ring", "credo", "a red a", "", None, "anvil", "ring", "ünïcödé ä", "line\nfeed x"]
    texts += ["".join(rng.choice("abcé") for _ in range(rng.randrange(40))) for _ in range(300)]
    rules = [("ring", "R"), ("red", "D"), ("a\tb", "T"), ("red", "late"), ("il", "I"), ("cödé", "U"), ("\nfe", "N"), (None, "null")]
    rules += [("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))), f"r{i}") for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for own in (rules, [*rules, ("", "every")]):
        want = {i: next((x for n, x in own if n is not None and t is not None and n in t), None) for i, t in enumerate(texts)}
        listed = P.classify_first_match(df, "t", own).select("i", "label")
        looked_up = P.classify_first_match(df, "t", P.rule_frame(spark, own)).select("i", "label")
        assert dict(listed.collect()) == dict(looked_up.collect()) == want


def test_needles_are_found_without_a_broadcast(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(200)]
    needles = {"".join(rng.choice("abcd") for _ in range(rng.randrange(0, 9))) for _ in range(150)}
    df, many = (spark.createDataFrame([(x,) for x in sorted(set(v))], f"{c} string") for v, c in ((texts, "text"), (needles, "needle")))
    want = {(t, n) for t in texts for n in needles if n in t}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for value in (limit, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", value)
            got = [tuple(r) for r in containing(df, many).collect()]
            assert set(got) == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_private_link_rules_are_case_sensitive_and_ordered(spark):
    df = spark.createDataFrame([("x/Microsoft.Sql/Microsoft.KeyVault",), ("microsoft.sql",)], "r string")
    got = [r.label for r in P.classify_first_match(df, "r", P.rule_frame(spark, P.RESOURCE_TYPES)).collect()]
    assert got == ["vault", None]


def test_branch_filter_falls_back_to_all(spark):
    df = spark.createDataFrame([("Model", None), ("Core", True), ("Store", False)], "k string, always boolean")
    count = lambda b: sorted(r.k for r in P.filter_by_prefix_or_all(df, "k", "always", b).collect())
    assert count("model/x") == ["Core", "Model"]
    assert count("nosuch/x") == ["Core", "Model", "Store"]
    assert count("model") == ["Core", "Model", "Store"]


def test_layer_filter_trims_only_the_list(spark):
    df = spark.createDataFrame([("Model",), (" Model",)], "k string")
    assert [r.k for r in P.filter_layers(df, "k", " MODEL ,x").collect()] == ["Model"]


def test_status_order(spark):
    df = spark.createDataFrame([(None, None, None), ("a", "a", 0), ("a", "b", 0), ("a", "b", 2)], "h string, r string, n int")
    status = lambda c: [r.status for r in P.sync_status(df, "h", "r", c).collect()]
    assert status("n") == ["not_possible", "up_to_date", "no_changes", "update"]
    assert status(None) == ["not_possible", "up_to_date", "update", "update"]


def test_tagged_json_with_comments_duplicates_and_missing_files(spark, tmp_path):
    (tmp_path / "infra.dev.json").write_text('{// note\n"name": "d", "g": {"a": 1}, "g": {"a": 2}}')
    (tmp_path / "infra.tst.json").write_text('{"name": "t"}')
    paths = [str(tmp_path / f"infra.{e}.json") for e in ("dev", "tst", "prd")]
    df = scans.scan_tagged_json(spark, paths, "name string, g struct<a:int>", r"infra\.(\w+)\.json")
    assert sorted((r.env, r.name, r.g.a if r.g else None) for r in df.collect()) == [("dev", "d", 2), ("tst", "t", None)]
    none = scans.scan_tagged_json(spark, paths[2:], "name string", r"infra\.(\w+)\.json")
    assert none.columns == ["name", "env"] and none.count() == 0


def test_scan_named_text(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "Model.BIM").write_text("one\ntwo")
    (tmp_path / "a" / "model.bim.bak").write_text("no")
    got = scans.scan_named_text(spark, str(tmp_path), ["model.bim"]).collect()
    assert [(r.name, r.text) for r in got] == [("Model.BIM", "one\ntwo")]


def test_pages_need_a_guid(spark):
    item = "array<struct<id:int>>"
    df = spark.createDataFrame(
        [("0f8fad5b-d9cb-469f-a165-70867728950e", 1, [(1,), (2,)]), ("nope", 1, [(3,)]),
         ("0f8fad5b-d9cb-469f-a165-70867728950e", 2, [])], f"ws string, page int, value {item}")
    got = scans.explode_pages(df, "value", ["page"], guid_col="ws").collect()
    assert [(r.page, r.pos, r.id) for r in got] == [(1, 0, 1), (1, 1, 2)]


def test_canonical_json_sorts_every_level(spark):
    df = spark.sql("select 1 as b, named_struct('z', cast(null as int), 'a', map('y', 1, 'x', 2)) as a, 'é' as c")
    text = sinks.write_canonical_json(df).first()[0]
    assert text == '{"a":{"a":{"x":2,"y":1},"z":null},"b":1,"c":"é"}'
    assert json.loads(text)["a"]["z"] is None


def test_identity_is_dense_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(7)
    got = sinks.assign_identity(df, "x", start=5, partitions=6).collect()
    assert sorted((r.id, r.x) for r in got) == [(i + 5, i) for i in range(1000)]


def test_names_are_checked(spark):
    df = spark.createDataFrame([("a" * 250,), ("a" * 251,), (None,)], "n string")
    good, bad = sinks.checked_names(df, "n")
    assert (good.count(), bad.count()) == (1, 2)
