from pyspark.sql import functions as F

from lakekeel.bindings.registry import query, table
from lakekeel.functions import text as tx
from lakekeel.operators import project as P


@query(
    "expand_name_template",
    """
    SELECT c_custkey,
           c_name || ' - ' || c_mktsegment || ' [' || c_nationkey || '] ' || c_mktsegment AS workspace,
           c_name || '.' || c_mktsegment AS unique_name
    FROM customer
    """,
)
def expand_name_template(spark, sf):
    rows = P.expand_name_template(
        table(spark, sf, "customer"),
        "{name} - {layer} [{environment}] {layer}",
        {"name": "c_name", "layer": "c_mktsegment", "environment": "c_nationkey"},
        "workspace",
    )
    return rows.select("c_custkey", "workspace", tx.unique_name("c_name", "c_mktsegment").alias("unique_name"))


def _dev_names(spark, sf):
    name = F.when(F.col("p_size") > 25, F.concat("p_name", F.lit(" [dev]"))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").withColumn("ws", name)


DEV_NAMES = """
    part_ws AS (SELECT *, CASE WHEN p_size > 25 THEN p_name || ' [dev]' ELSE p_name END AS ws FROM part),
    envs AS (SELECT unnest(['tst', 'prd']) AS env)
"""


@query(
    "retarget_env",
    f"""
    WITH {DEV_NAMES}
    SELECT p_partkey, env, replace(ws, '[dev]', '[' || env || ']') AS value FROM part_ws, envs
    """,
)
def retarget_env(spark, sf):
    return P.retarget_env(_dev_names(spark, sf), "ws", ["tst", "prd"]).select("p_partkey", "env", "value")


@query(
    "workspace_reference",
    f"""
    WITH {DEV_NAMES}
    SELECT p_partkey, env, '$workspace.' || replace(ws, '[dev]', '[' || env || ']') AS value FROM part_ws, envs
    """,
)
def workspace_reference(spark, sf):
    return P.workspace_reference(_dev_names(spark, sf), "ws", ["tst", "prd"]).select("p_partkey", "env", "value")


@query(
    "dynamic_reference",
    f"""
    WITH {DEV_NAMES}, items AS (
        SELECT *, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'Lakehouse' ELSE p_type END AS kind,
               CASE WHEN p_size <= 10 THEN '' ELSE 'host' || p_partkey END AS endpoint,
               CASE WHEN p_size <= 40 THEN 'ep-' || p_brand END AS endpoint_id
        FROM part_ws
    ), props AS (
        SELECT *, 'id' AS prop, CAST(p_partkey AS VARCHAR) AS find_value FROM items
        UNION ALL SELECT *, 'sqlendpoint', endpoint FROM items WHERE kind = 'Lakehouse' AND endpoint <> ''
        UNION ALL SELECT *, 'sqlendpointid', endpoint_id FROM items WHERE kind = 'Lakehouse' AND endpoint_id <> ''
    )
    SELECT p_partkey, prop, find_value, env,
           '$workspace.' || replace(ws, '[dev]', '[' || env || ']') || '.$items.' || kind || '.' || p_name
           || '.$' || prop AS value
    FROM props, envs
    """,
)
def dynamic_reference(spark, sf):
    items = _dev_names(spark, sf).withColumns(
        {
            "kind": F.when(F.col("p_type").isin("PROMO", "SMALL"), "Lakehouse").otherwise(F.col("p_type")),
            "endpoint": F.when(F.col("p_size") > 10, F.concat(F.lit("host"), "p_partkey")).otherwise(""),
            "endpoint_id": F.when(F.col("p_size") <= 40, F.concat(F.lit("ep-"), "p_brand")),
        }
    )
    props = {
        "id": ("p_partkey", None),
        "sqlendpoint": ("endpoint", ["Lakehouse"]),
        "sqlendpointid": ("endpoint_id", ["Lakehouse"]),
    }
    rows = P.dynamic_reference(items, "ws", "kind", "p_name", props, ["tst", "prd"])
    return rows.select("p_partkey", "prop", "find_value", "env", "value")


@query(
    "is_guid",
    """
    WITH h AS (SELECT doc_id, lang, md5(text) AS h FROM documents), v AS (
        SELECT doc_id, CASE lang
            WHEN 'en' THEN substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21)
            WHEN 'de' THEN upper(substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21))
            WHEN 'fr' THEN '{' || substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21) || '}'
            ELSE h END AS value
        FROM h)
    SELECT doc_id, value,
           length(value) = 36 AND regexp_full_match(lower(value), '[0-9a-f-]+') AS is_guid
    FROM v
    """,
)
def is_guid(spark, sf):
    h = F.md5("text")
    guid = F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)
    )
    value = (
        F.when(F.col("lang") == "en", guid)
        .when(F.col("lang") == "de", F.upper(guid))
        .when(F.col("lang") == "fr", F.concat(F.lit("{"), guid, F.lit("}")))
        .otherwise(h)
    )
    rows = table(spark, sf, "documents").select("doc_id", value.alias("value"))
    return rows.withColumn("is_guid", tx.is_guid("value"))


@query(
    "split_endpoint",
    """
    WITH p AS (
        SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN c_name
                               WHEN c_nationkey < 8 THEN c_name || ';' || c_mktsegment || ';x'
                               WHEN c_nationkey < 10 THEN ''
                               WHEN c_nationkey < 12 THEN NULL
                               ELSE ' ' || c_name || ' ; ' || c_mktsegment END AS path
        FROM customer)
    SELECT c_custkey,
           CASE WHEN len(string_split(path, ';')) = 2 THEN trim(split_part(path, ';', 1)) END AS sqlendpoint,
           CASE WHEN len(string_split(path, ';')) = 2 THEN trim(split_part(path, ';', 2)) END AS database_name
    FROM p
    """,
)
def split_endpoint(spark, sf):
    nation = F.col("c_nationkey")
    path = (
        F.when(nation < 5, F.col("c_name"))
        .when(nation < 8, F.concat("c_name", F.lit(";"), "c_mktsegment", F.lit(";x")))
        .when(nation < 10, "")
        .when(nation >= 12, F.concat(F.lit(" "), "c_name", F.lit(" ; "), "c_mktsegment"))
    )
    return table(spark, sf, "customer").select("c_custkey", tx.split_endpoint(path).alias("e")).select(
        "c_custkey", "e.*"
    )


TEXT_RULES = [("license", "license"), ("Copyright", "rights"), ("the ", "english"), ("der ", "german"), ("que", "latin")]


@query(
    "classify_first_match",
    """
    SELECT doc_id, CASE WHEN contains(text, 'license') THEN 'license' WHEN contains(text, 'Copyright') THEN 'rights'
        WHEN contains(text, 'the ') THEN 'english' WHEN contains(text, 'der ') THEN 'german'
        WHEN contains(text, 'que') THEN 'latin' END AS label
    FROM documents
    """,
)
def classify_first_match(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return P.classify_first_match(docs, "text", TEXT_RULES).select("doc_id", "label")


def _order_rules(spark, sf, n):
    """The first orders by number as rules: the padded customer number is the needle."""
    first = table(spark, sf, "orders").orderBy("o_orderkey").limit(n)
    return first.select(
        F.col("o_orderkey").alias("ord"), F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("needle"),
        F.concat("o_orderstatus", "o_orderkey").alias("label"))


def _many_rules(n):
    @query(
        f"classify_rules_{n}",
        f"""
        WITH r AS (SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS needle, o_orderstatus || o_orderkey AS label
                   FROM orders ORDER BY o_orderkey LIMIT {n}),
        f AS (SELECT needle, arg_min(label, o_orderkey) AS label FROM r GROUP BY 1)
        SELECT c_custkey, label FROM customer LEFT JOIN f ON needle = c_name[-9:]
        """,
    )
    def classify(spark, sf):
        customer = table(spark, sf, "customer").select("c_custkey", "c_name")
        return P.classify_first_match(customer, "c_name", _order_rules(spark, sf, n)).select("c_custkey", "label")


for _n in (257, 1000, 10_000, 100_000):
    _many_rules(_n)


@query(
    "classify_resource",
    """
    WITH r AS (SELECT l_orderkey, l_partkey, '/subscriptions/' || l_orderkey || '/providers/' || CASE l_linenumber
            WHEN 1 THEN 'Microsoft.Sql/servers' WHEN 2 THEN 'Microsoft.Storage/storageAccounts'
            WHEN 3 THEN 'microsoft.keyvault' WHEN 4 THEN 'Microsoft.KeyVault/Microsoft.Sql'
            WHEN 5 THEN 'Microsoft.Web/sites' WHEN 6 THEN 'Microsoft.Synapse/workspaces' ELSE 'Microsoft.Storage' END
            || '/' || l_partkey AS resource_id FROM lineitem)
    SELECT l_orderkey, l_partkey, CASE WHEN resource_id LIKE '%Microsoft.KeyVault%' THEN 'vault'
        WHEN resource_id LIKE '%Microsoft.Sql%' THEN 'sqlServer'
        WHEN resource_id LIKE '%Microsoft.Storage/storageAccounts%' THEN 'blob'
        WHEN resource_id LIKE '%Microsoft.Synapse/workspaces%' THEN 'Sql'
        WHEN resource_id LIKE '%Microsoft.Web/sites%' THEN 'sites' END AS resource_type
    FROM r
    """,
)
def classify_resource(spark, sf):
    kinds = ["Microsoft.Sql/servers", "Microsoft.Storage/storageAccounts", "microsoft.keyvault",
             "Microsoft.KeyVault/Microsoft.Sql", "Microsoft.Web/sites", "Microsoft.Synapse/workspaces"]
    kind = F.coalesce(
        *[F.when(F.col("l_linenumber") == i, k) for i, k in enumerate(kinds, 1)], F.lit("Microsoft.Storage")
    )
    resource = F.concat(F.lit("/subscriptions/"), "l_orderkey", F.lit("/providers/"), kind, F.lit("/"), "l_partkey")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", resource.alias("resource_id"))
    return P.classify_first_match(rows, "resource_id", P.RESOURCE_TYPES, "resource_type").drop("resource_id")


LABELS = [("ring", "default"), ("red", ""), ("bolt", "Bolt"), ("blue", "Blue"), ("old", "default")]
OVERLAYS = [("brand#1", "first"), ("large", "big"), ("brand#2", "second")]


@query(
    "match_labels",
    """
    WITH n AS (SELECT p_partkey, lower(p_name || ' ' || p_brand) AS n FROM part), l AS (
        SELECT *, CASE WHEN contains(n, 'red') THEN '' WHEN contains(n, 'bolt') THEN 'Bolt'
                       WHEN contains(n, 'blue') THEN 'Blue' END AS stop FROM n)
    SELECT p_partkey,
           CASE WHEN stop = '' THEN NULL WHEN stop IS NOT NULL THEN stop
                WHEN contains(n, 'ring') OR contains(n, 'old') THEN 'default' END AS label,
           CASE WHEN stop <> '' THEN CASE WHEN contains(n, 'brand#1') THEN 'first'
                WHEN contains(n, 'large') THEN 'big' WHEN contains(n, 'brand#2') THEN 'second' END END AS overlay
    FROM l
    """,
)
def match_labels(spark, sf):
    names = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return P.match_labels(names, "name", LABELS, OVERLAYS).select("p_partkey", "label", "overlay")


SIGNS = [("license", "scroll"), ("token", "key"), ("heit", "tower"), ("ment", "leaf"), ("ción", "wave"), ("er", "")]
TINTS = [("ing", "teal"), ("ou", "amber"), ("und", "slate")]


@query(
    "match_icons",
    """
    WITH n AS (SELECT doc_id, lower(text) AS n FROM documents)
    SELECT doc_id, nullif(icon, '') AS label, CASE WHEN icon <> '' THEN
        CASE WHEN contains(n, 'ing') THEN 'teal' WHEN contains(n, 'ou') THEN 'amber'
             WHEN contains(n, 'und') THEN 'slate' END END AS overlay
    FROM (SELECT *, CASE WHEN contains(n, 'license') THEN 'scroll' WHEN contains(n, 'token') THEN 'key'
            WHEN contains(n, 'heit') THEN 'tower' WHEN contains(n, 'ment') THEN 'leaf'
            WHEN contains(n, 'ción') THEN 'wave' WHEN contains(n, 'er') THEN '' END AS icon FROM n)
    """,
)
def match_icons(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = P.match_labels(docs, "text", P.rule_frame(spark, SIGNS), P.rule_frame(spark, TINTS))
    return rows.select("doc_id", "label", "overlay")


@query(
    "filter_must_either",
    "SELECT doc_id, text FROM documents WHERE contains(text, 'the') AND (contains(text, 'license') OR contains(text, 'ing '))",
)
def filter_must_either(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return P.filter_must_either(docs, "text", "the", ["license", "ing "])


@query(
    "filter_layers",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '2-high', 'nosuch')",
)
def filter_layers(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return P.filter_layers(orders, "o_orderpriority", " 1-Urgent, 2-HIGH ,nosuch")


def _by_branch(spark, sf, branch):
    parts = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    return P.filter_by_prefix_or_all(parts, "p_type", F.col("p_size") > 45, branch)


@query(
    "filter_by_prefix_or_all",
    "SELECT p_partkey, p_type, p_size FROM part WHERE p_type = 'PROMO' OR p_size > 45",
)
def filter_by_prefix_or_all(spark, sf):
    return _by_branch(spark, sf, "promo/new-feature")


@query("filter_by_prefix_or_all_unknown", "SELECT p_partkey, p_type, p_size FROM part")
def filter_by_prefix_or_all_unknown(spark, sf):
    return _by_branch(spark, sf, "nosuch/new-feature")


@query(
    "branch_parts",
    """
    WITH b AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS p FROM pages), c AS (
        SELECT page_id, 'feature/' || p || '/feature' AS a, 'refs/heads/feature/' || p || '/feature/x' AS d FROM b)
    SELECT page_id,
           replace(replace(a, 'feature/', ''), '/feature', '') AS branch,
           split_part(replace(replace(a, 'feature/', ''), '/feature', ''), '/', -1) AS short_name,
           substr(d, length('refs/heads/feature/') + 1) AS delete_branch,
           split_part(d, '/', -1) AS delete_short_name
    FROM c
    """,
)
def branch_parts(spark, sf):
    path = F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1)
    create = tx.branch_parts(F.concat(F.lit("feature/"), path, F.lit("/feature")))
    delete = tx.branch_parts(F.concat(F.lit("refs/heads/feature/"), path, F.lit("/feature/x")), "delete")
    rows = table(spark, sf, "pages").select("page_id", create.alias("c"), delete.alias("d"))
    return rows.select(
        "page_id",
        "c.branch",
        "c.short_name",
        F.col("d.branch").alias("delete_branch"),
        F.col("d.short_name").alias("delete_short_name"),
    )


@query(
    "project_by_type",
    """
    SELECT p_partkey,
           CASE p_type WHEN 'PROMO' THEN p_name WHEN 'SMALL' THEN p_brand END AS database_name,
           CASE p_type WHEN 'PROMO' THEN p_brand || '.host' END AS server_fqdn,
           CASE p_type WHEN 'LARGE' THEN 'ep' || p_partkey END AS endpoint_id
    FROM part
    """,
)
def project_by_type(spark, sf):
    cases = {
        "PROMO": {"database_name": "p_name", "server_fqdn": F.concat("p_brand", F.lit(".host"))},
        "SMALL": {"database_name": "p_brand"},
        "LARGE": {"endpoint_id": F.concat(F.lit("ep"), "p_partkey")},
    }
    rows = P.project_by_type(table(spark, sf, "part"), "p_type", cases)
    return rows.select("p_partkey", "database_name", "server_fqdn", "endpoint_id")


@query(
    "strip_noise_lines",
    r"""
    WITH l AS (SELECT doc_id, regexp_split_to_array(trim(text, E' \t\n\r\x0b\x0c'), '\r\n|[\n\r]') AS lines FROM documents)
    SELECT doc_id, array_to_string(list_filter(lines,
        lambda x: NOT starts_with(trim(x, E' \t\n\r\x0b\x0c'), 'A') AND NOT starts_with(trim(x, E' \t\n\r\x0b\x0c'), 'Th')), chr(10)) AS text
    FROM l
    """,
)
def strip_noise_lines(spark, sf):
    return P.strip_noise_lines(table(spark, sf, "documents").select("doc_id", "text"), "text", ["A", "Th"])


@query(
    "build_kv_string",
    """
    SELECT c_custkey,
           'Data Source="' || c_name || '";initial catalog=' || c_mktsegment || ';access mode=readonly;nation='
           || c_nationkey || ';' AS connection,
           c_mktsegment AS catalog_read_back
    FROM customer
    """,
)
def build_kv_string(spark, sf):
    pairs = [
        ("Data Source", "c_name"),
        ("initial catalog", "c_mktsegment"),
        ("access mode", F.lit("readonly")),
        ("nation", "c_nationkey"),
    ]
    rows = table(spark, sf, "customer").withColumn("connection", tx.build_kv_string(pairs, quoted=["Data Source"]))
    back = F.element_at(tx.parse_kv_string("connection"), "initial catalog")
    return rows.select("c_custkey", "connection", back.alias("catalog_read_back"))
