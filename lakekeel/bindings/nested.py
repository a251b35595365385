from pyspark.sql import functions as F

from lakekeel.bindings.registry import query, table
from lakekeel.operators import nested as N


@query(
    "flatten_paths",
    """
    WITH e AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
    SELECT event_id, 'a.k' AS path, k AS value FROM e
    UNION ALL SELECT event_id, 'u.id', CAST(user_id AS VARCHAR) FROM e
    UNION ALL SELECT event_id, 'u.more.' || event_type || '.deep.x', event_type FROM e
    UNION ALL SELECT event_id, 'n', NULL FROM e
    UNION ALL SELECT event_id, 'l', '[1,{"z":' || event_id || '}]' FROM e
    """,
)
def flatten_paths(spark, sf):
    tree = F.concat(
        F.lit('{"a":'), "props", F.lit(',"u":{"id":'), "user_id", F.lit(',"more":{"'), "event_type",
        F.lit('":{"deep":{"x":"'), "event_type", F.lit('","gone":{}}}}},"n":null,"l":[1,{"z":'), "event_id",
        F.lit('}],"none":{}}'),
    )
    return N.flatten_paths(table(spark, sf, "events").select("event_id", tree.alias("tree")), "tree", "event_id")


@query(
    "flatten_paths_struct",
    """
    SELECT c_custkey, 'name' AS path, c_name AS value FROM customer
    UNION ALL SELECT c_custkey, 'place.nation.key', CAST(c_nationkey AS VARCHAR) FROM customer
    UNION ALL SELECT c_custkey, 'place.segment', CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END FROM customer
    UNION ALL SELECT c_custkey, 'place.tags', '["' || c_mktsegment || '","t"]' FROM customer
    """,
)
def flatten_paths_struct(spark, sf):
    place = F.struct(
        F.struct(F.col("c_nationkey").alias("key")).alias("nation"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"),
        F.array("c_mktsegment", F.lit("t")).alias("tags"),
    )
    tree = F.struct(F.col("c_name").alias("name"), place.alias("place"))
    return N.flatten_paths(table(spark, sf, "customer").select("c_custkey", tree.alias("tree")), "tree", "c_custkey")


@query(
    "explode_map_of_lists",
    """
    WITH l AS (SELECT doc_id, lang AS key, string_split(text, chr(10)) AS xs FROM documents
               UNION ALL SELECT doc_id, source, string_split(text, '. ') FROM documents)
    SELECT doc_id, key, CAST(i - 1 AS INTEGER) AS pos, xs[i] AS element
    FROM (SELECT *, unnest(generate_series(1, len(xs))) AS i FROM l)
    """,
)
def explode_map_of_lists(spark, sf):
    lists = F.create_map("lang", F.split("text", "\n", -1), "source", F.split("text", "\\. ", -1))
    docs = table(spark, sf, "documents").select("doc_id", lists.alias("lists"))
    return N.explode_map_of_lists(docs, "lists", "doc_id")


ROLES = """
    r AS (SELECT c_custkey, 'Admin' AS key, 0 AS pos, 'Group' AS type, c_name AS id, 'Owner' AS access FROM customer
          UNION ALL SELECT c_custkey, 'Admin', 1, CASE WHEN c_acctbal < 2000 THEN 'workspaceIdentity' ELSE 'User' END,
                           c_mktsegment, 'Owner' FROM customer
          UNION ALL SELECT c_custkey, 'Viewer', 0, 'ServicePrincipal', c_mktsegment, 'User' FROM customer)
"""


def _roles(spark, sf):
    person = lambda kind, who: F.struct(kind.alias("type"), F.col(who).alias("id"))
    second = F.when(F.col("c_acctbal") < 2000, "workspaceIdentity").otherwise("User")
    roles = F.create_map(
        F.lit("Admin"), F.array(person(F.lit("Group"), "c_name"), person(second, "c_mktsegment")),
        F.lit("Viewer"), F.array(person(F.lit("ServicePrincipal"), "c_mktsegment")),
    )
    customer = table(spark, sf, "customer").select("c_custkey", roles.alias("roles"))
    return [
        rows.select("c_custkey", "key", "pos", "element.type", "element.id", "access")
        for rows in N.role_assignments(customer, "roles", "c_custkey")
    ]


@query("role_assignments", f"WITH {ROLES} SELECT * FROM r WHERE lower(type) <> 'workspaceidentity'")
def role_assignments(spark, sf):
    return _roles(spark, sf)[0]


@query("role_assignments_deferred", f"WITH {ROLES} SELECT * FROM r WHERE lower(type) = 'workspaceidentity'")
def role_assignments_deferred(spark, sf):
    return _roles(spark, sf)[1]


@query(
    "valid_bindings",
    """
    SELECT doc_id, source, unnest(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS model
    FROM documents WHERE lang <> 'es' AND n_chars > 500
    """,
)
def valid_bindings(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id",
        "source",
        F.when(F.col("lang") != "es", F.col("lang")).otherwise("").alias("ws_layer"),
        F.when(F.col("n_chars") > 500, " Model ").otherwise("store").alias("layer"),
        F.split("text", "\n", -1).alias("model"),
    )
    rows = N.valid_bindings(docs, ["source", "ws_layer", "layer"], "layer", "MODEL", "model")
    return rows.select("doc_id", "source", "model")


@query(
    "valid_bindings_scalar",
    "SELECT c_custkey, c_name AS model FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0",
)
def valid_bindings_scalar(spark, sf):
    name = F.when(F.col("c_acctbal") >= 0, F.col("c_name")).otherwise("")
    customer = table(spark, sf, "customer").select("c_custkey", F.lower("c_mktsegment").alias("layer"), name.alias("model"))
    return N.valid_bindings(customer, ["layer"], "layer", " Building ", "model").select("c_custkey", "model")


MAPPING = [
    ("license", {"tst": "$workspace.Core [tst]", "prd": "x"}),
    ("the", {"tst": "a.b"}),
    ("que", {"prd": "never"}),
    ("a.b", {"tst": "\\1 the"}),
    ("der", {"tst": ""}),
]


@query(
    "apply_find_replace",
    r"""
    SELECT doc_id, replace(replace(replace(replace(text, 'license', '$workspace.Core [tst]'), 'the', 'a.b'),
                   'a.b', '\1 the'), 'der', '') AS text
    FROM documents
    """,
)
def apply_find_replace(spark, sf):
    rows = [(i, f, r) for i, (f, r) in enumerate(MAPPING, 1)]
    mapping = spark.createDataFrame(rows, "ord bigint, find_value string, replace_value map<string,string>")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return N.apply_find_replace(docs, "text", mapping, "tst")


@query(
    "apply_replacements_10257",
    """
    WITH r AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS f, min(o_orderkey) AS k
               FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10257) GROUP BY 1)
    SELECT c_custkey, CASE WHEN k IS NULL THEN c_name ELSE replace(c_name, f, 'K' || k) END AS text
    FROM customer LEFT JOIN r ON f = c_name[-9:]
    """,
)
def apply_replacements_10257(spark, sf):
    """The first orders as entries, more than one block of them; the first that fits leaves nothing for the others."""
    mapping = table(spark, sf, "orders").orderBy("o_orderkey").limit(10257).select(
        F.col("o_orderkey").alias("ord"), F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("find_value"),
        F.create_map(F.lit("tst"), F.concat(F.lit("K"), "o_orderkey")).alias("replace_value"))
    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("text"))
    return N.apply_find_replace(customer, "text", mapping, "tst")


@query(
    "malformed",
    "SELECT event_id FROM events WHERE event_type = 'click' OR event_type = 'error'",
)
def malformed(spark, sf):
    """Some texts lose their last character, others get one more value."""
    events = table(spark, sf, "events")
    text = F.when(F.col("event_type") == "click", F.expr("left(props, length(props) - 1)")).when(
        F.col("event_type") == "error", F.concat("props", F.lit(" 1"))).otherwise(F.col("props"))
    return N.malformed(events.select("event_id", text.alias("t")), "t").select("event_id")


@query(
    "rewrite_quoted_head",
    r"""
    WITH x AS (SELECT doc_id, lang, CASE WHEN source = 'src1' THEN 'let ' ELSE '' END || '"' || source || '"  meta ['
                      || text || ']' AS expression FROM documents)
    SELECT doc_id, lang, CASE WHEN lang = 'en' THEN regexp_replace(expression, '^"[^"]+"(\s+meta\s+\[)', '"$new"\1')
                         ELSE expression END AS expression
    FROM x
    """,
)
def rewrite_quoted_head(spark, sf):
    start = F.when(F.col("source") == "src1", "let ").otherwise("")
    expression = F.concat(start, F.lit('"'), "source", F.lit('"  meta ['), "text", F.lit("]"))
    docs = table(spark, sf, "documents").select("doc_id", "lang", expression.alias("expression"))
    return N.rewrite_quoted_head(docs, "lang", "expression", "en", "$new")


NAMED = """
    x AS (SELECT doc_id, CASE WHEN lang = 'es' THEN 'expression Database = "' ELSE 'expression Sql.Endpoint  = "' END
                 || source || '" meta [IsQuery=true]' || chr(10) || text || chr(10)
                 || 'expression Sql.Endpoint = "b" meta [x]' || CASE WHEN lang = 'en' THEN '' ELSE chr(10) || '-' END AS content,
                 lang FROM documents),
    y AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN text ELSE content END AS content, lang
          FROM x JOIN documents USING (doc_id, lang))
"""
PATTERN = r"""(expression\s+Sql\.Endpoint\s*=\s*")[^"]+("[^\n]*meta\s*\[[^\n]*\])"""


def _named(spark, sf):
    lang = F.col("lang")
    head = F.when(lang == "es", 'expression Database = "').otherwise('expression Sql.Endpoint  = "')
    tail = F.when(lang == "en", "").otherwise("\n-")
    content = F.concat(
        head, "source", F.lit('" meta [IsQuery=true]\n'), "text", F.lit('\nexpression Sql.Endpoint = "b" meta [x]'), tail
    )
    content = F.when(lang == "fr", F.col("text")).otherwise(content)
    docs = table(spark, sf, "documents").select("doc_id", content.alias("content"))
    return N.rewrite_named_expression(docs, "content", "Sql.Endpoint", "new$1.host")


@query(
    "rewrite_named_expression",
    f"""
    WITH {NAMED}
    SELECT doc_id, regexp_replace(content, '{PATTERN}', '\\1new$1.host\\2', 'g') AS content,
           CAST(len(regexp_extract_all(content, '{PATTERN}')) AS INTEGER) AS n_replaced
    FROM y WHERE regexp_matches(content, '{PATTERN}')
    """,
)
def rewrite_named_expression(spark, sf):
    return _named(spark, sf)[0]


@query(
    "rewrite_named_expression_errors",
    f"WITH {NAMED} SELECT doc_id, content FROM y WHERE NOT regexp_matches(content, '{PATTERN}')",
)
def rewrite_named_expression_errors(spark, sf):
    return _named(spark, sf)[1]
