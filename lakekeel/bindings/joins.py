from pyspark.sql import functions as F

from lakekeel.bindings.registry import query, table
from lakekeel.operators import joins as J


@query(
    "expected_grid",
    "SELECT c_custkey, c_name, lang FROM customer, (SELECT DISTINCT lang FROM documents)",
)
def expected_grid(spark, sf):
    layers = table(spark, sf, "customer").select("c_custkey", "c_name")
    return J.expected_grid(layers, table(spark, sf, "documents").select("lang").distinct())


@query(
    "attach_first_match",
    """
    WITH l AS (SELECT c_custkey, c_mktsegment || '.' || c_nationkey AS unique_name FROM customer),
    r AS (SELECT unique_name, arg_max(o_orderkey, o_orderkey) AS connection_id FROM (
            SELECT o_orderkey, CASE WHEN o_totalprice > 450000 THEN c_mktsegment ELSE 'none' END || '.' || c_nationkey AS unique_name
            FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1),
    f AS (SELECT unique_name, min(c_custkey) AS c_custkey FROM l GROUP BY 1)
    SELECT l.c_custkey, l.unique_name, r.connection_id
    FROM l LEFT JOIN f USING (unique_name, c_custkey) LEFT JOIN r ON r.unique_name = f.unique_name
    """,
)
def attach_first_match(spark, sf):
    name = F.concat("c_mktsegment", F.lit("."), "c_nationkey").alias("unique_name")
    customer = table(spark, sf, "customer").select("c_custkey", name)
    orders = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    segment = F.when(F.col("o_totalprice") > 450000, F.col("c_mktsegment")).otherwise("none")
    right = orders.select(
        F.concat(segment, F.lit("."), "c_nationkey").alias("unique_name"), "o_orderkey",
        F.col("o_orderkey").alias("connection_id"))
    return J.attach_first_match(customer, right, "unique_name", "connection_id", "c_custkey", "o_orderkey")


@query(
    "find_in_layer",
    """
    WITH f AS (SELECT o_orderpriority, o_custkey, o_orderkey AS item_id, o_totalprice AS item_price FROM orders
        WHERE o_orderstatus = 'F'
        QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) = 1)
    SELECT o_orderkey, o_orderpriority, o_custkey, item_id, item_price
    FROM orders LEFT JOIN f USING (o_orderpriority, o_custkey)
    """,
)
def find_in_layer(spark, sf):
    orders = table(spark, sf, "orders")
    lookup = orders.filter("o_orderstatus = 'F'").select(
        "o_orderpriority",
        "o_custkey",
        F.col("o_orderkey").alias("ord"),
        F.col("o_orderkey").alias("item_id"),
        F.col("o_totalprice").alias("item_price"),
    )
    keys = ["o_orderpriority", "o_custkey"]
    return J.find_in_layer(orders.select("o_orderkey", *keys), keys, lookup, "ord")


INVENTORY = """
    inv AS (SELECT o_orderstatus AS env, o_orderpriority AS layer, o_custkey AS item, o_orderkey AS ord,
                   'id-' || o_orderkey AS id,
                   CASE WHEN o_totalprice < 50000 THEN NULL WHEN o_totalprice < 90000 THEN ''
                        ELSE strftime(o_orderdate, '%Y-%m-%d') END AS endpoint
            FROM orders),
    firsts AS (SELECT env, layer, item, arg_min({'id': id, 'endpoint': endpoint}, ord) AS v FROM inv GROUP BY ALL),
    prim AS (SELECT p.layer, p.item, p.ord, p.id, p.endpoint, o.v AS o, q.v AS p FROM inv p
             LEFT JOIN firsts o ON o.env = 'O' AND o.layer = p.layer AND o.item = p.item
             LEFT JOIN firsts q ON q.env = 'P' AND q.layer = p.layer AND q.item = p.item
             WHERE p.env = 'F'),
    long AS (SELECT layer, item, ord, 'id' AS prop, 0 AS prop_ord, id AS find_value, o.id AS o, p.id AS p FROM prim
             UNION ALL SELECT layer, item, ord, 'endpoint', 1, endpoint, o.endpoint, p.endpoint FROM prim),
    mapped AS (SELECT layer, item, ord, prop, prop_ord, find_value,
               '{' || concat_ws(',', CASE WHEN o <> '' THEN '"O":"' || o || '"' END,
                                     CASE WHEN p <> '' THEN '"P":"' || p || '"' END) || '}' AS replace_value
               FROM long WHERE find_value IS NOT NULL)
"""


def _inventory(spark, sf):
    endpoint = F.when(F.col("o_totalprice") < 50000, F.lit(None)).when(F.col("o_totalprice") < 90000, "").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("env"),
        F.col("o_orderpriority").alias("layer"),
        F.col("o_custkey").alias("item"),
        F.col("o_orderkey").alias("ord"),
        F.concat(F.lit("id-"), "o_orderkey").alias("id"),
        endpoint.alias("endpoint"),
    )


def _mapping(spark, sf, keep_empty):
    rows = J.cross_env_mapping(
        _inventory(spark, sf), "env", "F", ["layer", "item"], ["id", "endpoint"], "ord", ["O", "P"], keep_empty
    )
    return rows.withColumn("replace_value", F.to_json("replace_value"))


@query("cross_env_mapping", f"WITH {INVENTORY} SELECT * FROM mapped WHERE replace_value <> '{{}}'")
def cross_env_mapping(spark, sf):
    return _mapping(spark, sf, keep_empty=False)


@query("cross_env_mapping_workspace", f"WITH {INVENTORY} SELECT * FROM mapped")
def cross_env_mapping_workspace(spark, sf):
    return _mapping(spark, sf, keep_empty=True)


BINDINGS = """
    templates AS (SELECT 'L' || s_nationkey AS layer, s_name AS lakehouse,
            CASE WHEN s_acctbal < 500 THEN NULL ELSE 'conn-' || s_suppkey || ' [tst]' END AS connection_name FROM supplier),
    connections AS (SELECT 'conn-' || s_suppkey || ' [tst]' AS connection_name,
            CASE WHEN s_acctbal < 1500 THEN NULL ELSE 'id-' || s_suppkey END AS connection_id,
            CASE WHEN s_nationkey < 5 THEN s_name ELSE 'host' || s_nationkey || ';' || s_name END AS path FROM supplier),
    source AS (SELECT layer, lakehouse, connection_name, connection_id,
            CASE WHEN len(string_split(path, ';')) = 2 THEN split_part(path, ';', 1) END AS sqlendpoint,
            CASE WHEN len(string_split(path, ';')) = 2 THEN split_part(path, ';', 2) END AS database_name
            FROM templates LEFT JOIN connections USING (connection_name)),
    b AS (SELECT l_orderkey, l_linenumber, s_name AS lakehouse, 'L' || s_nationkey AS layer,
            unnest(['Model' || l_partkey, 'Extra' || l_partkey]) AS semantic_model
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    m AS (SELECT 'Model' || p_partkey AS semantic_model, p_brand || p_partkey AS model_id FROM part WHERE p_size > 10),
    resolved AS (SELECT l_orderkey, l_linenumber, lakehouse AS lakehouse_name, semantic_model, connection_id, sqlendpoint,
            database_name, model_id,
            CASE WHEN connection_name IS NULL THEN 'no_template'
                 WHEN connection_id IS NULL OR sqlendpoint IS NULL OR database_name IS NULL THEN 'incomplete_connection'
                 WHEN model_id IS NULL THEN 'model_not_found' END AS reason
            FROM b LEFT JOIN source USING (layer, lakehouse) LEFT JOIN m USING (semantic_model))
"""


def _resolved(spark, sf):
    supplier = table(spark, sf, "supplier")
    layer = F.concat(F.lit("L"), "s_nationkey").alias("lakehouse_ws_layer")
    templates = supplier.select(
        layer,
        F.concat(F.lit(" "), "s_name", F.lit(" ")).alias("lakehouse_name"),
        F.when(F.col("s_acctbal") >= 500, F.concat(F.lit("conn-"), "s_suppkey", F.lit(" [{environment}]"))).alias(
            "connection_name"
        ),
        F.col("s_suppkey").alias("ord"),
    )
    path = F.when(F.col("s_nationkey") < 5, F.col("s_name")).otherwise(
        F.concat(F.lit("host"), "s_nationkey", F.lit(" ; "), "s_name")
    )
    connections = supplier.select(
        F.concat(F.lit("conn-"), "s_suppkey", F.lit(" [tst]")).alias("connection_name"),
        F.when(F.col("s_acctbal") >= 1500, F.concat(F.lit("id-"), "s_suppkey")).alias("connection_id"),
        path.alias("path"),
        F.col("s_suppkey").alias("ord"),
    )
    models = table(spark, sf, "part").filter("p_size > 10").select(
        F.concat(F.lit("Model"), "p_partkey").alias("semantic_model"),
        F.concat("p_brand", "p_partkey").alias("model_id"),
    )
    lineitem = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    names = F.array(F.concat(F.lit("Model"), "l_partkey"), F.concat(F.lit("Extra"), "l_partkey"))
    bindings = lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "l_orderkey", "l_linenumber", F.col("s_name").alias("lakehouse_name"), layer, names.alias("semantic_models")
    )
    return J.resolve_bindings(bindings, templates, connections, models, "tst")


RESOLVED = ["l_orderkey", "l_linenumber", "lakehouse_name", "semantic_model", "connection_id", "sqlendpoint",
            "database_name", "model_id"]


@query(
    "resolve_bindings",
    f"WITH {BINDINGS} SELECT * EXCLUDE (reason) FROM resolved WHERE reason IS NULL",
)
def resolve_bindings(spark, sf):
    return _resolved(spark, sf)[0].select(*RESOLVED)


@query(
    "resolve_bindings_rejected",
    f"WITH {BINDINGS} SELECT l_orderkey, l_linenumber, lakehouse_name, semantic_model, reason FROM resolved WHERE reason IS NOT NULL",
)
def resolve_bindings_rejected(spark, sf):
    return _resolved(spark, sf)[1].select("l_orderkey", "l_linenumber", "lakehouse_name", "semantic_model", "reason")


@query(
    "resolve_from_earlier",
    """
    SELECT t.o_orderkey, t.o_custkey,
           (SELECT arg_min(m.o_totalprice, m.o_orderkey) FROM orders m
            WHERE m.o_orderstatus = 'F' AND m.o_custkey = t.o_custkey AND m.o_orderkey < t.o_orderkey) AS value
    FROM orders t WHERE t.o_orderstatus <> 'F'
    """,
)
def resolve_from_earlier(spark, sf):
    orders = table(spark, sf, "orders")
    mapping = orders.filter("o_orderstatus = 'F'").select(
        "o_custkey", F.col("o_orderkey").alias("layer_ord"), F.col("o_totalprice").alias("value")
    )
    targets = orders.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey")
    return J.resolve_from_earlier(targets, mapping, "o_custkey", "o_orderkey", "layer_ord", "value")


CI = """
    ref AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'customer#' ELSE 'other#' END
                   || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS k, min(o_orderkey) AS order_id FROM orders GROUP BY 1)
"""


def _lookup_ci(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_name")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "CUSTOMER#").otherwise("Other#")
    ref = table(spark, sf, "orders").select(
        F.concat(kind, F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("ref_name"),
        F.col("o_orderkey").alias("order_id"),
    )
    return J.lookup_ci(customer, ref, "c_name", "ref_name", "order_id")


@query(
    "lookup_ci",
    f"WITH {CI} SELECT c_custkey, c_name, upper(c_name) AS ref_name, order_id FROM customer JOIN ref ON k = lower(c_name)",
)
def lookup_ci(spark, sf):
    return _lookup_ci(spark, sf)[0]


@query(
    "lookup_ci_missing",
    f"WITH {CI} SELECT c_custkey, c_name FROM customer WHERE lower(c_name) NOT IN (SELECT k FROM ref)",
)
def lookup_ci_missing(spark, sf):
    return _lookup_ci(spark, sf)[1]


def _orders_lines(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders"), lines


@query("rows_present", "SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def rows_present(spark, sf):
    return J.rows_present(*_orders_lines(spark, sf), "o_orderkey")


@query("rows_absent", "SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def rows_absent(spark, sf):
    return J.rows_absent(*_orders_lines(spark, sf), "o_orderkey")


@query(
    "explode_acl_suffix",
    """
    WITH e AS (
        SELECT user_id, event_id, 1 AS pos, 'svc' || user_id || ':Build:' || event_type AS k,
               CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events
        UNION ALL SELECT user_id, event_id, 2, 'ext' || user_id || ':Build:' || event_type, event_id FROM events
        UNION ALL SELECT user_id, event_id, 3, 'svc' || user_id || ':Read:' || event_type, 0 FROM events)
    SELECT user_id, arg_max(k, (event_id, pos)) AS acl_key, arg_max(v, (event_id, pos)) AS descriptor
    FROM e WHERE ends_with(k, ':Build:purchase') GROUP BY user_id
    """,
)
def explode_acl_suffix(spark, sf):
    k = F.element_at(F.from_json("props", "map<string,bigint>"), "k")
    key = lambda who, what: F.concat(F.lit(who), "user_id", F.lit(f":{what}:"), "event_type")
    acl = F.create_map(key("svc", "Build"), k, key("ext", "Build"), F.col("event_id"), key("svc", "Read"), F.lit(0))
    events = table(spark, sf, "events").select("user_id", "event_id", acl.alias("acl"))
    return J.explode_acl_suffix(events, "acl", ":Build:purchase", "event_id", ["user_id"])
