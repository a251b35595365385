from pyspark.sql import functions as F

from lakekeel.bindings.joins import INVENTORY, _inventory
from lakekeel.bindings.registry import query, table
from lakekeel.plans import flows


@query(
    "parameter_mapping",
    f"""
    WITH {INVENTORY},
    writes AS (SELECT find_value, replace_value, row_number() OVER (ORDER BY layer, kind, ord, prop_ord) AS seq FROM (
        SELECT layer, 1 AS kind, ord, prop_ord, find_value, replace_value FROM mapped WHERE replace_value <> '{{}}'
        UNION ALL SELECT DISTINCT layer, 0, 0, 0, 'ws-F-' || layer,
               '{{"O":"ws-O-' || layer || '","P":"ws-P-' || layer || '"}}' FROM inv)),
    base AS (SELECT 'id-' || c_custkey AS find_value, '{{"O":"' || c_name || '"}}' AS replace_value, c_custkey AS pos FROM customer),
    last AS (SELECT find_value, arg_max(replace_value, seq) AS replace_value, min(seq) AS first FROM writes GROUP BY 1)
    SELECT find_value, coalesce(l.replace_value, b.replace_value) AS replace_value, pos, false AS is_new
    FROM base b LEFT JOIN last l USING (find_value)
    UNION ALL SELECT find_value, replace_value, first, true FROM last WHERE find_value NOT IN (SELECT find_value FROM base)
    """,
)
def parameter_mapping(spark, sf):
    inventory = _inventory(spark, sf)
    workspace = F.concat_ws("-", F.lit("ws"), "env", "layer").alias("workspace_id")
    workspaces = inventory.select("env", "layer").distinct().select("env", "layer", workspace)
    base = table(spark, sf, "customer").select(
        F.concat(F.lit("id-"), "c_custkey").alias("find_value"),
        F.create_map(F.lit("O"), F.col("c_name")).alias("replace_value"),
        F.col("c_custkey").alias("pos"),
    )
    rows = flows.parameter_mapping(inventory, workspaces, base, "F", ["O", "P"], ["id", "endpoint"])
    return rows.withColumn("replace_value", F.to_json("replace_value"))


CONTENT = """
    content AS (SELECT d.lang AS layer, d.doc_id AS item, d.text || ' core-1 core-2 ' || d.source || ' id-' || (d.doc_id + 1) || '-' AS text,
                       'id-' || (d.doc_id + 1) || '-' AS ref, list_position(['en', 'de', 'fr'], n.lang) < list_position(['en', 'de', 'fr'], d.lang) AS known
                FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1)
"""


def _release(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("lang").alias("layer"),
        F.col("doc_id").alias("item"),
        F.concat("text", F.lit(" core-1 core-2 "), "source", F.lit(" id-"), F.col("doc_id") + 1, F.lit("-")).alias("text"),
    )
    mapping = spark.createDataFrame(
        [("the", {"tst": "THE"}, 1), ("core-1", {"prd": "never"}, 2), ("src1", {"tst": "$1"}, 3)],
        "find_value string, replace_value map<string,string>, ord bigint")
    published = spark.createDataFrame(
        [("en", "core-1", "guid-en", 1), ("de", "core-2", "guid-de", 2), ("fr", "THE", "late", 3)],
        "layer string, logical_id string, guid string, ord bigint")
    published = published.unionByName(docs.select(  # every document has a logical id, to which the one before it refers
        "layer", F.concat(F.lit("id-"), "item", F.lit("-")).alias("logical_id"), F.concat(F.lit("g"), "item").alias("guid"),
        (F.col("item") + 10).alias("ord")))
    actual = table(spark, sf, "labels").join(docs, F.col("doc_id") == F.col("item")).select("layer", "item")
    gone = table(spark, sf, "conversations").filter("turn = 0").select(F.lit("en").alias("layer"), (-F.col("conv_id") - 1).alias("item"))
    return flows.release(docs, mapping, published, "tst", ["EN", "de", " fr"], actual.unionByName(gone))


@query(
    "release_content",
    f"""
    WITH {CONTENT}, m AS (
        SELECT layer, item, CASE WHEN known THEN replace(text, ref, 'g' || (item + 1)) ELSE text END AS text
        FROM (SELECT * REPLACE (replace(replace(text, 'the', 'THE'), 'src1', '$1') AS text) FROM content))
    SELECT layer, item, CASE layer WHEN 'en' THEN text WHEN 'de' THEN replace(text, 'core-1', 'guid-en')
           ELSE replace(replace(text, 'core-1', 'guid-en'), 'core-2', 'guid-de') END AS text
    FROM m WHERE layer IN ('en', 'de', 'fr')
    """,
)
def release_content(spark, sf):
    return _release(spark, sf)[0]


@query(
    "release_actions",
    """
    WITH want AS (SELECT lang AS layer, doc_id AS item FROM documents WHERE lang IN ('en', 'de', 'fr')),
    have AS (SELECT lang AS layer, doc_id AS item FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'de', 'fr')
             UNION ALL SELECT 'en', -conv_id - 1 FROM conversations WHERE turn = 0)
    SELECT layer, item, CASE WHEN h IS NULL THEN 'create' WHEN w IS NULL THEN 'delete' ELSE 'skip' END AS action
    FROM (SELECT *, 1 AS w FROM want) FULL JOIN (SELECT *, 1 AS h FROM have) USING (layer, item)
    """,
)
def release_actions(spark, sf):
    return _release(spark, sf)[1]


ITEMS = """
    items AS (SELECT p_brand AS layer, p_type AS item_type, 'item' || p_partkey AS item_name, p_name AS connection_name,
                     p_size > 40 AS skip_item_creation FROM part),
    overs AS (SELECT p_brand AS layer, p_type AS item_type, 'item' || (p_partkey + l_n) AS item_name,
                     CASE WHEN p_size < 10 THEN 'own' END AS connection_name, CASE WHEN p_size > 30 THEN true END AS skip_item_creation
              FROM part JOIN (SELECT l_partkey, CASE WHEN max(l_quantity) = 50 THEN 0 ELSE 10000000 END AS l_n
                              FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
    merged AS (SELECT layer, item_type, item_name, coalesce(o.connection_name, i.connection_name) AS connection_name,
                      coalesce(o.skip_item_creation, i.skip_item_creation) AS skip_item_creation,
                      'Sol - ' || layer || ' [tst]' AS workspace
               FROM items i FULL JOIN overs o USING (layer, item_type, item_name))
"""


def _provision(spark, sf):
    part = table(spark, sf, "part")
    place = [F.col("p_brand").alias("layer"), F.col("p_type").alias("item_type")]
    items = part.select(
        *place,
        F.concat(F.lit("item"), "p_partkey").alias("item_name"),
        F.col("p_name").alias("connection_name"),
        (F.col("p_size") > 40).alias("skip_item_creation"),
    )
    busy = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").alias("q"))
    shift = F.when(F.col("q") == 50, 0).otherwise(10_000_000)
    overs = part.join(busy, F.col("l_partkey") == F.col("p_partkey")).select(
        *place,
        F.concat(F.lit("item"), F.col("p_partkey") + shift).alias("item_name"),
        F.when(F.col("p_size") < 10, "own").alias("connection_name"),
        F.when(F.col("p_size") > 30, F.lit(True)).alias("skip_item_creation"),
    )
    principals = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("layer"),
        F.when(F.col("c_acctbal") > 5000, "Admin").otherwise("Viewer").alias("role"),
        F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("principal_id"),
        F.col("c_custkey").alias("ord"),
    )
    generic, own = principals.filter("role = 'Admin'"), principals.withColumn("role", F.lit("Admin"))
    actual = part.filter("p_size < 20").select(
        F.concat(F.lit("Sol - "), "p_brand", F.lit(" [tst]")).alias("workspace"),
        F.col("p_type").alias("item_type"),
        F.concat(F.lit("item"), "p_partkey").alias("item_name"),
    )
    return flows.provision(items, overs, generic, own, actual, "Sol - {layer} [{environment}]", "tst")


@query("provision_items", f"WITH {ITEMS} SELECT * FROM merged")
def provision_items(spark, sf):
    return _provision(spark, sf)["items"]


@query(
    "provision_actions",
    f"""
    WITH {ITEMS}
    SELECT workspace, item_type, item_name,
           CASE WHEN EXISTS (SELECT 1 FROM part WHERE p_size < 20 AND p_brand = layer AND p_type = item_type
                             AND 'item' || p_partkey = item_name) THEN 'skip' ELSE 'create' END AS action
    FROM merged WHERE NOT coalesce(skip_item_creation, false)
    """,
)
def provision_actions(spark, sf):
    return _provision(spark, sf)["actions"]


@query(
    "provision_permissions",
    """
    WITH p AS (SELECT c_mktsegment AS layer, CASE WHEN c_acctbal > 5000 THEN 'Admin' ELSE 'Viewer' END AS role,
                      CASE WHEN c_nationkey > 3 THEN c_nationkey END AS principal_id, c_custkey AS ord FROM customer),
    g AS (SELECT * FROM p WHERE role = 'Admin')
    SELECT *, 0 AS src FROM g
    UNION ALL
    SELECT layer, 'Admin', principal_id, min(ord), 1 FROM p
    WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.layer = p.layer AND g.principal_id IS NOT DISTINCT FROM p.principal_id)
    GROUP BY layer, principal_id
    """,
)
def provision_permissions(spark, sf):
    return _provision(spark, sf)["permissions"]
