"""The three flows on small literal definitions, from JSON files to actions."""

from pyspark.sql import functions as F

from lakekeel.operators.nested import explode_map_of_lists, role_assignments
from lakekeel.plans import flows
from lakekeel.sources.scans import scan_tagged_json

ITEM = "struct<item_name:string,connection_name:string,skip_item_creation:boolean>"
PRINCIPAL = "struct<type:string,id:string,name:string>"
LAYER = f"struct<items:map<string,array<{ITEM}>>,permissions:map<string,array<{PRINCIPAL}>>>"
SCHEMA = f"name string, generic struct<permissions:map<string,array<{PRINCIPAL}>>>, layers map<string,{LAYER}>"

MAIN = """{
  "name": "Harbour {layer} ({environment})",
  "generic": {"permissions": {"Admin": [{"type": "Group", "id": "g1"}, {"type": "Group", "id": "g1"}]}},
  "layers": {
    "Quay": {"items": {"Ledger": [{"item_name": "Tides", "connection_name": "Tides ({environment})"}]}},
    "Depot": {"items": {"Crate": [{"item_name": "Sorted"}, {"item_name": "Raw"}]},
              "permissions": {"Admin": [{"type": "Group", "id": "g1"}, {"type": "WorkspaceIdentity", "name": "Run"}]}}
  }
}"""
OVER = """{
  // only what differs
  "layers": {
    "Quay": {"items": {"Ledger": [{"item_name": "Tides", "skip_item_creation": true}]}},
    "Depot": {"items": {"Crate": [{"item_name": "Spare"}]}}
  }
}"""


def definitions(spark, tmp_path):
    (tmp_path / "infra.main.json").write_text(MAIN)
    (tmp_path / "infra.dev.json").write_text(OVER)
    paths = [str(tmp_path / f"infra.{e}.json") for e in ("main", "dev", "prd")]
    return scan_tagged_json(spark, paths, SCHEMA, r"infra\.(\w+)\.json")


def items(df):
    layers = df.select("env", F.explode("layers").alias("layer", "body"))
    rows = explode_map_of_lists(layers.select("env", "layer", "body.items"), "items", ["env", "layer"])
    return rows.select("env", "layer", F.col("key").alias("item_type"), "element.*")


def test_provision_from_files(spark, tmp_path):
    df = definitions(spark, tmp_path)
    rows = items(df)
    layers = df.filter("env = 'main'").select(F.explode("layers").alias("layer", "body"), "generic")
    generic = explode_map_of_lists(layers.select("layer", "generic.permissions"), "permissions", "layer")
    own = explode_map_of_lists(layers.select("layer", "body.permissions"), "permissions", "layer")
    shape = ["layer", F.col("key").alias("role"), F.col("element.id").alias("principal_id"), F.col("pos").cast("long").alias("ord")]
    actual = spark.createDataFrame([("Harbour Depot (dev)", "Crate", "Raw")], "workspace string, item_type string, item_name string")
    got = flows.provision(
        rows.filter("env = 'main'").drop("env"), rows.filter("env = 'dev'").drop("env"),
        generic.select(*shape), own.select(*shape), actual, "Harbour {layer} ({environment})", "dev",
    )
    assert sorted((r.workspace, r.item_name, r.connection_name, r.skip_item_creation) for r in got["items"].collect()) == [
        ("Harbour Depot (dev)", "Raw", None, None),
        ("Harbour Depot (dev)", "Sorted", None, None),
        ("Harbour Depot (dev)", "Spare", None, None),
        ("Harbour Quay (dev)", "Tides", "Tides ({environment})", True),
    ]
    assert sorted((r.item_name, r.action) for r in got["actions"].collect()) == [
        ("Raw", "skip"), ("Sorted", "create"), ("Spare", "create")]
    # generic duplicates stay, the layer's g1 is there already, its identity without id is new
    assert sorted((r.layer, r.principal_id or "", r.src) for r in got["permissions"].collect()) == [
        ("Depot", "", 1), ("Depot", "g1", 0), ("Depot", "g1", 0), ("Quay", "g1", 0), ("Quay", "g1", 0)]


def test_identities_are_deferred(spark, tmp_path):
    df = definitions(spark, tmp_path).filter("env = 'main'")
    layers = df.select(F.explode("layers").alias("layer", "body")).select("layer", "body.permissions")
    direct, deferred = role_assignments(layers, "permissions", "layer")
    assert [(r.element.id, r.access) for r in direct.collect()] == [("g1", "Owner")]
    assert [r.element.name for r in deferred.collect()] == ["Run"]


def test_mapping_keeps_the_place_of_old_entries(spark):
    inventory = spark.createDataFrame(
        [("dev", "Core", "db.SQL", 1, "i1", "h1"), ("tst", "Core", "db.SQL", 1, "i2", None), ("dev", "Core", "nb.Notebook", 2, "i3", None),
         ("tst", "Core", "nb.Notebook", 2, "i4", None), ("dev", "Core", "solo.Notebook", 3, "i5", None)],
        "env string, layer string, item string, ord int, id string, fqdn string")
    workspaces = spark.createDataFrame([("dev", "Core", "w1"), ("tst", "Core", "w2"), ("dev", "Store", "w3")], "env string, layer string, workspace_id string")
    base = spark.createDataFrame([("old", {"tst": "o"}, 0), ("i3", {"prd": "p"}, 1)], "find_value string, replace_value map<string,string>, pos bigint")
    got = flows.parameter_mapping(inventory, workspaces, base, "dev", ["tst", "prd"], ["id", "fqdn"])
    entries = [(r.find_value, r.replace_value) for r in sorted(got.collect(), key=lambda r: (r.is_new, r.pos))]
    assert entries == [("old", {"tst": "o"}), ("i3", {"tst": "i4"}), ("w1", {"tst": "w2"}), ("i1", {"tst": "i2"}), ("w3", {})]


def test_release_sees_only_layers_released_before(spark):
    content = spark.createDataFrame(
        [("Core", "a", "x L1 L2"), ("Store", "b", "x L1 L2"), ("Model", "c", "x L1 L2"), ("Other", "d", "x")], "layer string, item string, text string")
    mapping = spark.createDataFrame([("x", {"tst": "y"}, 1)], "find_value string, replace_value map<string,string>, ord int")
    published = spark.createDataFrame([("Core", "L1", "G1", 1), ("Store", "L2", "G2", 2)], "layer string, logical_id string, guid string, ord int")
    actual = spark.createDataFrame([("Core", "a"), ("Core", "gone"), ("Other", "q")], "layer string, item string")
    texts, actions = flows.release(content, mapping, published, "tst", ["core", " store", "MODEL"], actual)
    assert {r.item: r.text for r in texts.collect()} == {"a": "y L1 L2", "b": "y G1 L2", "c": "y G1 G2"}
    assert {(r.item, r.action) for r in actions.collect()} == {("a", "skip"), ("b", "create"), ("c", "create"), ("gone", "delete")}


def test_models_are_bound_after_a_release(spark):
    definition = spark.createDataFrame(
        [("Crate", "Depot", "Charts", ["Tide", "", "Moon"]), ("Crate", "Depot", "Other", ["Sun"]), ("", "Depot", "Charts", ["Star"])],
        "lakehouse_name string, lakehouse_ws_layer string, layer string, semantic_models array<string>")
    templates = spark.createDataFrame([("Depot", " Crate ", "c-{environment}", 1)], "lakehouse_ws_layer string, lakehouse_name string, connection_name string, ord int")
    connections = spark.createDataFrame([("c-tst", "id1", "host;db", 1)], "connection_name string, connection_id string, path string, ord int")
    models = spark.createDataFrame([("Tide", "m1")], "semantic_model string, model_id string")
    bound, rejected = flows.bind_models(definition, " charts", templates, connections, models, "tst")
    assert [(r.semantic_model, r.connection_id, r.database_name, r.model_id) for r in bound.collect()] == [("Tide", "id1", "db", "m1")]
    assert [(r.semantic_model, r.reason) for r in rejected.collect()] == [("Moon", "model_not_found")]
