import json
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakekeel.operators import nested as N
from lakekeel.plans import grams


def flat(spark, tree):
    df = spark.createDataFrame([(1, json.dumps(tree))], "id int, t string")
    return {r.path: r.value for r in N.flatten_paths(df, "t", "id").collect()}


def test_flatten_rules(spark):
    tree = {"a": {"b": 1, "c": {"d": "x", "e": [1, {"z": None}], "f": {}}}, "g": None, "h": {}, "j": 1.50, "k": True}
    assert flat(spark, tree) == {
        "a.b": "1", "a.c.d": "x", "a.c.e": '[1,{"z":null}]', "g": None, "j": "1.5", "k": "true"}


def test_flatten_any_depth(spark):
    tree = {"leaf": 1}
    for _ in range(60):
        tree = {"n": tree}
    assert flat(spark, tree) == {".".join(["n"] * 60 + ["leaf"]): "1"}


TREES = st.recursive(st.text("ab", max_size=2), lambda t: st.dictionaries(st.text("xyz", min_size=1, max_size=2), t, min_size=1, max_size=3), max_leaves=8)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.text("xyz", min_size=1, max_size=2), TREES, min_size=1, max_size=3))
def test_flatten_and_rebuild(spark, tree):
    built = {}
    for path, value in flat(spark, tree).items():
        node = built
        *parents, leaf = path.split(".")
        for p in parents:
            node = node.setdefault(p, {})
        node[leaf] = value
    assert built == tree


def test_replacements_are_literal_and_in_order(spark):
    mapping = spark.createDataFrame(
        [("b", {"tst": "c$1\\"}, 2), ("a", {"tst": "b"}, 1), ("z", {"prd": "never"}, 3), ("q", {"tst": ""}, 4)],
        "find_value string, replace_value map<string,string>, ord int")
    df = spark.createDataFrame([("aab",), ("zqz",)], "t string")
    got = sorted(r.t for r in N.apply_find_replace(df, "t", mapping, "tst").collect())
    assert got == ["c$1\\c$1\\c$1\\", "zz"]


def test_replacements_that_follow_from_others(spark):
    """Values that hold, complete or join into other find values, against plain replacement one after the other."""
    rng = random.Random(6)
    word = lambda lo, hi: "".join(rng.choice("abc-") for _ in range(rng.randrange(lo, hi)))
    entries = [(word(1, 6), word(0, 5), i, rng.choice((None, None, "x", "y"))) for i in range(60)]
    rng.shuffle(entries)
    rows = [(word(0, 30), s) for s in ("x", "y", None) for _ in range(60)] + [(None, "x"), ("", "y")]

    def by_hand(text, scope):
        for find, value, _, where in sorted(entries, key=lambda e: e[2]):
            text = text.replace(find, value) if text is not None and where in (None, scope) else text
        return text

    mapping = spark.createDataFrame(
        [(f, {"tst": v}, o, s) for f, v, o, s in entries], "find_value string, replace_value map<string,string>, ord int, s string")
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "i int, t string, s string")
    got = dict(N.apply_find_replace(df, "t", mapping, "tst", scope="s").select("i", "t").collect())
    assert got == {i: by_hand(t, s) for i, (t, s) in enumerate(rows)}


def test_quoted_head(spark):
    df = spark.createDataFrame(
        [("S", '"old"  meta [x]'), ("S", 'x "old" meta [x]'), ("S", '"old" nometa'), ("T", '"old" meta [x]')], "n string, e string")
    got = [r.e for r in N.rewrite_quoted_head(df, "n", "e", "S", "n$1\\w").collect()]
    assert got == ['"n$1\\w"  meta [x]', 'x "old" meta [x]', '"old" nometa', '"old" meta [x]']


def test_named_expression_counts_and_errors(spark):
    text = 'expression A.b = "1" meta [x]\nother\nexpression  A.b="2" meta [IsQ=true, y]'
    df = spark.createDataFrame([(1, text), (2, 'expression Axb = "1" meta [x]')], "i int, t string")
    done, missing = N.rewrite_named_expression(df, "t", "A.b", "v$2")
    r = done.first()
    assert r.n_replaced == 2
    assert r.t == 'expression A.b = "v$2" meta [x]\nother\nexpression  A.b="v$2" meta [IsQ=true, y]'
    assert [m.i for m in missing.collect()] == [2]


def test_bindings_are_normalised(spark):
    df = spark.createDataFrame(
        [("L", " model ", ["a", "", None, "b"]), ("L", "Other", ["c"]), ("", "Model", ["d"]), ("L", "Model", [])],
        "lake string, layer string, models array<string>")
    got = N.valid_bindings(df, ["lake", "layer", "models"], "layer", "MODEL", "models").collect()
    assert [r.models for r in got] == ["a", "b"]


def test_roles(spark):
    principal = "map<string,array<struct<type:string,id:string>>>"
    df = spark.createDataFrame([(1, {"Admin": [("Group", "g"), ("WorkspaceIdentity", "w")], "Viewer": [("User", "u")]})], f"i int, r {principal}")
    direct, deferred = N.role_assignments(df, "r", "i")
    assert sorted((r.element.id, r.access) for r in direct.collect()) == [("g", "Owner"), ("u", "User")]
    assert [r.element.id for r in deferred.collect()] == ["w"]


def test_long_mappings_give_what_replacing_one_after_the_other_gives(spark, monkeypatch):
    """The look-up of long mappings, with find values that come about far from, next to and across earlier ones."""
    monkeypatch.setattr(N, "FEW", 0)
    rng = random.Random(8)
    word = lambda lo, hi: "".join(rng.choice("abc-\x01") for _ in range(rng.randrange(lo, hi)))
    entries = [(word(1, 7), word(0, 5), i, rng.choice((None, None, "x"))) for i in range(50)]
    rows = [(word(0, 80).replace("\x01", "" if i % 4 else "\x01"), ("x", None)[i % 2]) for i in range(150)] + [(None, "x"), ("", None)]

    def by_hand(text, scope):
        for find, value, _, where in entries:
            text = text.replace(find, value) if text is not None and where in (None, scope) else text
        return text

    mapping = spark.createDataFrame(
        [(f, {"tst": v}, o, s) for f, v, o, s in entries], "find_value string, replace_value map<string,string>, ord int, s string")
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "i int, t string, s string")
    got = dict(N.apply_find_replace(df, "t", mapping, "tst", scope="s").select("i", "t").collect())
    assert got == {i: by_hand(t, s) for i, (t, s) in enumerate(rows)}


def test_few_entries_move_no_texts(spark):
    mapping = spark.createDataFrame([("a", {"tst": "b"}, 1)], "find_value string, replace_value map<string,string>, ord int")
    df = spark.range(10).select(F.concat(F.lit("a"), "id").alias("t"))
    plan = N.apply_find_replace(df, "t", mapping, "tst")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_numbers_as_needles_meet_few_texts(spark, monkeypatch):
    """Ids share all short runs of digits: what meets by a part is about what is found."""
    kept = []
    monkeypatch.setattr(grams, "stage", lambda df, label="x", real=grams.stage: kept.append((label, real(df, label))) or kept[-1][1])
    ids = spark.range(100_000, 103_000)
    texts = ids.select(F.concat(F.lit("see id-"), "id", F.lit("- there")).alias("text"))
    found = grams.containing(texts, ids.select(F.concat(F.lit("id-"), "id", F.lit("-")).alias("needle")))
    assert found.count() == 3000
    size = 2 * grams.Q if hasattr(grams, "MANY") else grams.Q
    parts = texts.select(F.explode(grams.parts_of("text", size)).alias("part"))
    met = sum(parts.join(df, "part").count() for label, df in kept if label == "needle-index")
    assert met < 6000
