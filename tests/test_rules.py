import pytest
from pyspark.sql import functions as F

from lakekeel.operators import rules as R
from lakekeel.session import stage as session_stage

OBJ = ("object_id string, object_type string, parent_id string, name string, data_type string, is_visible boolean, "
       "is_available_in_mdx boolean, format_string string, summarize_by string, display_folder string, "
       "description string, expression string, connection_string string")
FIELDS = [f.split()[0] for f in OBJ.split(", ")]


def objects(spark, *dicts):
    base = {"is_visible": True, "is_available_in_mdx": False, "name": "A b", "format_string": "0", "summarize_by": "None"}
    rows = [tuple((base | {"object_id": f"o{i}"} | d).get(f) for f in FIELDS) for i, d in enumerate(dicts)]
    return spark.createDataFrame(rows, OBJ)


def hits(df):
    return sorted((r.rule_id, r.object_id) for r in df.collect())


def words(spark, *rows):
    return spark.createDataFrame(list(rows), "culture string, object_id string, t_name string, t_description string, t_folder string")


def cultures(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "culture string")


def test_the_rule_table():
    assert len(R.RULES) == 29
    assert [sum(r.severity == s for r in R.RULES) for s in (1, 2, 3)] == [14, 15, 0]
    assert sum(r.has_fix for r in R.RULES) == 7
    done = set(R.PREDICATES) | {"RELATIONSHIP_COLUMN_NAMES"}
    assert done == set(R.BY_ID)


def test_scope_splits_on_comma(spark):
    got = R.rules_in_scope(R.rules_frame(spark), objects(spark, {"object_type": "Hierarchy"}, {"object_type": "DataColumn"}), 1300)
    found = hits(got)
    assert ("TRANSLATE_HIDEABLE_OBJECT_NAMES", "o0") in found
    assert ("DISABLE_ATTRIBUTE_HIERACHIES", "o1") not in found  # needs level 1400


def test_blank_format_and_whitespace_folder(spark):
    objs = objects(
        spark,
        {"object_type": "DataColumn", "data_type": "Int64", "format_string": " \t"},
        {"object_type": "DataColumn", "data_type": "Int64", "format_string": None, "is_visible": False},
        {"object_type": "DataColumn", "data_type": "String", "format_string": None},
        {"object_type": "DataColumn", "data_type": "Double", "summarize_by": None},
    )
    assert hits(R.check_predicates(objs)) == [
        ("APPLY_FORMAT_STRING_COLUMNS", "o0"), ("META_AVOID_FLOAT", "o3"), ("META_SUMMARIZE_NONE", "o3")]


def test_names_and_translations(spark):
    objs = objects(
        spark,
        {"object_type": "DataColumn", "name": "OrderDate"},
        {"object_type": "DataColumn", "name": "Order Date X"},
        {"object_type": "DataColumn", "name": "lower"},
        {"object_type": "Hierarchy", "name": "lowerCase"},
        {"object_type": "DataColumn", "name": "Order"},
    )
    none = R.check_names(objs, words(spark), cultures(spark))
    assert hits(none) == [("NO_CAMELCASE_COLUMNS_HIERARCHIES", "o0"), ("UPPERCASE_FIRST_LETTER_COLUMNS_HIERARCHIES", "o2")]
    real = words(spark, ("de", "o0", "Datum", None, None), ("de", "o2", "", None, None))
    assert hits(R.check_names(objs, real, cultures(spark, "de"))) == [("UPPERCASE_FIRST_LETTER_COLUMNS_HIERARCHIES", "o2")]


def test_coverage_counts_cultures(spark):
    objs = objects(
        spark,
        {"object_type": "Table", "description": "d"},
        {"object_type": "Hierarchy", "is_visible": False},
        {"object_type": "Level", "parent_id": "o1"},
        {"object_type": "Level", "parent_id": "o4"},
        {"object_type": "Hierarchy"},
    )
    w = words(spark, ("de", "o0", "T", "", None), ("en", "o0", "T", "x", None), ("de", "o4", "H", None, None))
    assert hits(R.check_coverage(objs, w, cultures(spark, "de", "en"))) == [
        ("TRANSLATE_DESCRIPTIONS", "o0"), ("TRANSLATE_HIDEABLE_OBJECT_NAMES", "o4"), ("TRANSLATE_HIERARCHY_LEVEL_NAMES", "o3")]
    assert hits(R.check_coverage(objs, w, cultures(spark))) == []


def test_references_and_division(spark):
    expressions = ["SUM([Qty])", "SUM(Sales[Qty])", "Sales[Total]", "[Total]", "a / 2", "a / [Qty] // x / y",
                   "\"a / b\" & 'x/y'[Qty] -- 1 / z", "/* a / b */ 1 / .5", "DIVIDE('My [odd] Table'[Total], 1)", "[Unknown] / x"]
    objs = objects(
        spark, *[{"object_type": "Measure", "expression": e, "name": f"m{i}"} for i, e in enumerate(expressions)],
        {"object_type": "Measure", "name": "Total"}, {"object_type": "DataColumn", "name": "Qty"})
    assert hits(R.check_references(objs)) == [
        ("DAX_COLUMNS_FULLY_QUALIFIED", "o0"), ("DAX_COLUMNS_FULLY_QUALIFIED", "o5"),
        ("DAX_DIVISION_COLUMNS", "o5"), ("DAX_DIVISION_COLUMNS", "o9"),
        ("DAX_MEASURES_UNQUALIFIED", "o2"), ("DAX_MEASURES_UNQUALIFIED", "o8")]


def test_siblings(spark):
    objs = objects(
        spark,
        {"object_type": "Table", "name": "T"}, {"object_type": "Table", "name": "U"}, {"object_type": "CalculationGroupTable", "name": "G"},
        {"object_type": "Partition", "name": "T", "parent_id": "o0"},
        {"object_type": "Partition", "name": "U 1", "parent_id": "o1"}, {"object_type": "Partition", "name": "X", "parent_id": "o1"},
        {"object_type": "Partition", "name": "zz", "parent_id": "o2"},
    )
    rel = spark.createDataFrame(
        [("r1", "F", "Key", "D", "Key", "c"), ("r2", "F", "ShipKey", "E", "Key", "c"), ("r3", "F", "OrderKey", "E", "Key", "c"),
         ("r4", "G", "OtherKey", "D", "Key", "c"), ("r5", "F", "KeyX", "E", "Key", "c")],
        "rel_id string, from_table string, from_column string, to_table string, to_column string, from_column_id string")
    assert hits(R.check_siblings(objs, rel)) == [
        ("PARTITION_NAMES_SHOULD_MATCH_TABLE_NAMES", "o5"), ("RELATIONSHIP_COLUMN_NAMES", "r4"), ("RELATIONSHIP_COLUMN_NAMES", "r5")]


def test_unused_needs_no_perspective_at_all(spark):
    objs = objects(spark, {"object_type": "DataColumn", "is_visible": False}, {"object_type": "Measure"})
    use = lambda *r: spark.createDataFrame(list(r), "object_id string, kind string")
    assert hits(R.check_unused(objs, use())) == [("PERF_UNUSED_COLUMNS", "o0")]
    assert hits(R.check_unused(objs, use(("o0", "variation"), ("zz", "perspective")))) == [("LAYOUT_ADD_TO_PERSPECTIVES", "o1")]


def test_single_attribute_tables(spark):
    objs = objects(spark, {"object_type": "Table"}, {"object_type": "Table"}, {"object_type": "DataColumn", "parent_id": "o0"},
                   {"object_type": "DataColumn", "parent_id": "o0"}, {"object_type": "DataColumn", "parent_id": "o1"})
    rel = spark.createDataFrame([("r1", "F", "k", "o0", "k", "c"), ("r2", "F", "k", "o1", "k", "c"), ("r3", "G", "k", "o1", "k", "c")],
                                "rel_id string, from_table string, from_column string, to_table string, to_column string, from_column_id string")
    usage = spark.createDataFrame([("o2", "relationship")], "object_id string, kind string")
    assert hits(R.check_single_use(objs, usage, rel)) == [("AVOID_SINGLE_ATTRIBUTE_DIMENSIONS", "o0")]


def test_fixes(spark):
    objs = objects(spark, {"object_type": "DataColumn", "data_type": "Double", "summarize_by": "Sum"},
                   {"object_type": "DataColumn", "is_visible": False})
    found = R.check_predicates(objs).unionByName(R.check_unused(objs, spark.createDataFrame([], "object_id string, kind string")))
    fixed = R.apply_fixes(objs, found)
    assert [(r.object_id, r.data_type, r.summarize_by) for r in fixed.collect()] == [("o0", "Decimal", "None")]
    assert hits(R.check_predicates(fixed)) == []


@pytest.mark.parametrize("threshold, blocked", [(2, True), (3, False)])
def test_gate(spark, threshold, blocked):
    found = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("b", 2, "z")], "rule_id string, severity int, object_id string")
    assert sorted(map(tuple, R.severity_gate(found, threshold).collect())) == [(1, 1, blocked), (2, 2, blocked)]


def test_run_rules_equals_the_single_checks(spark):
    from lakekeel.bindings import metadata as M

    sf = "/root/testdata/sf0.001"
    o, u, t, c, r = (f(spark, sf) for f in (M.objects, M.usage, M.translations, M.cultures, M.relationships))
    single = [R.check_predicates(o), R.check_names(o, t, c), R.check_group_counts(o, 2), R.check_unused(o, u),
              R.check_key_columns(o, r), R.check_coverage(o, t, c), R.check_siblings(o, r), R.check_single_use(o, u, r),
              R.check_references(o)]
    want = sorted(h for s in single for h in hits(s))
    assert hits(R.run_rules(o, u, t, c, r, limit=2)) == want


def test_reset_folders_finds_the_violations_once(spark, monkeypatch):
    """However many frames the objects are a union of, their violations are computed in one plan, once."""
    plans = []

    def recorded(df, label="stage"):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return session_stage(df, label)

    monkeypatch.setattr(R, "stage", recorded)
    frames = [spark.createDataFrame([(f"{k}{i}", f"folder {k}") for i in range(3)], "object_id string, display_folder string") for k in "abcd"]
    objects = frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])
    found = spark.createDataFrame([("a0",), ("a0",), ("c2",), ("x",), (None,)], "object_id string").select(
        F.when(F.col("object_id") == "marker", "other").otherwise("LAYOUT_LOCALIZE_DF").alias("rule_id"), F.lit(1).alias("severity"), "object_id")
    words = spark.createDataFrame(
        [("de", "a0", "old"), ("en", "a0", None), ("de", "b0", "old"), ("de", "c2", ""), ("de", None, "kept")],
        "culture string, object_id string, t_folder string")
    rows = {tuple(r) for r in R.reset_folders(words, found, objects).collect()}
    assert rows == {("de", "a0", "folder a"), ("en", "a0", "folder a"), ("de", "b0", "old"), ("de", "c2", "folder c"), ("de", None, "kept")}
    assert sum(p.count("marker") for p in plans) == 1
