"""Metadata frames derived from the test tables, and the same derivation as SQL."""

from pyspark.sql import functions as F

from lakekeel.bindings.registry import table

COLUMNS = ["object_id", "object_type", "parent_id", "name", "data_type", "is_visible", "is_available_in_mdx",
           "format_string", "summarize_by", "display_folder", "description", "expression", "connection_string"]


def _frame(df, **cols):
    text = F.lit(None).cast("string")
    defaults = {c: text for c in COLUMNS} | {"is_available_in_mdx": F.lit(True), "is_visible": F.lit(True)}
    return df.select(*[(cols.get(c, defaults[c])).alias(c) for c in COLUMNS])


def _cases(*pairs, otherwise=None):
    out = F
    for cond, value in pairs:
        out = out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise)


def objects(spark, sf):
    col, lit = F.col, F.lit
    supplier, part = table(spark, sf, "supplier"), table(spark, sf, "part")
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    events, docs, nation = (table(spark, sf, t) for t in ("events", "documents", "nation"))

    tables = _frame(
        supplier,
        object_id=F.concat(lit("T"), "s_suppkey"),
        object_type=_cases((col("s_acctbal") < 500, "CalculationGroupTable"), otherwise="Table"),
        name=_cases((col("s_nationkey") < 4, F.lower("s_name")), (col("s_nationkey") < 10, F.concat(lit("Order"), "s_name")), otherwise=col("s_name")),
        is_visible=col("s_acctbal") > 0,
        description=_cases((col("s_nationkey") > 12, "a supplier")),
    )
    size, price, brand = col("p_size"), col("p_retailprice"), col("p_brand")
    columns = _frame(
        part,
        object_id=F.concat(lit("C"), "p_partkey"),
        object_type=_cases(
            (col("p_type") == "SMALL", "CalculatedColumn"), (col("p_type") == "LARGE", "CalculatedTableColumn"),
            (col("p_type") == "MEDIUM", "Hierarchy"), otherwise="DataColumn"),
        parent_id=F.concat(lit("T"), "p_size"),
        name=_cases((size <= 10, col("p_name")), (size <= 20, F.replace(col("p_name"), lit(" "), lit(""))),
                    (size <= 35, F.concat(lit("Order"), brand)), otherwise=brand),
        data_type=_cases((price < 920, "Int64"), (price < 940, "Double"), (price < 960, "Decimal"), (price < 980, "DateTime"), otherwise="String"),
        is_visible=brand > "Brand#15",
        is_available_in_mdx=price > 930,
        format_string=_cases((size < 15, "0.00"), (size < 30, "  ")),
        summarize_by=_cases((size < 25, "None"), (size < 45, "Sum")),
        display_folder=_cases((size < 12, ""), (size < 24, " "), (size < 36, brand)),
        description=_cases((price < 950, col("p_type")), (price < 960, "")),
        expression=_cases(
            (size < 10, F.concat(lit("DIVIDE(Sales["), "p_name", lit("], 2) // a/b"))),
            (size < 20, F.concat(lit("SUM(["), brand, lit("]) / 100"))),
            (size < 30, F.concat(lit("[x] / ["), brand, lit("] /* c/d */"))),
            (size < 40, F.concat(lit('"a / [x]" & Fact[Total '), brand, lit("]"))),
            (size < 45, lit("-- ToDo: [x] / y\n1 + 'My Fact'[Total Brand#3] /2"))),
    )
    measures = _frame(
        customer,
        object_id=F.concat(lit("M"), "c_custkey"),
        object_type=_cases((col("c_mktsegment") == "BUILDING", "KPI"), otherwise="Measure"),
        parent_id=F.concat(lit("T"), "c_nationkey"),
        name=_cases((col("c_mktsegment") == "HOUSEHOLD", F.concat(lit("Total Brand#"), "c_nationkey")),
                    (col("c_mktsegment") == "FURNITURE", F.lower("c_name")),
                    (col("c_mktsegment") == "MACHINERY", F.concat(lit("Order"), "c_name")), otherwise=col("c_name")),
        data_type=_cases((col("c_acctbal") < 4000, "Decimal"), otherwise="String"),
        is_visible=col("c_acctbal") >= 1000,
        format_string=_cases((col("c_nationkey") >= 12, "#,0")),
        display_folder=_cases((col("c_nationkey") < 6, "Totals")),
        description=_cases((col("c_acctbal") > 3000, col("c_mktsegment"))),
        expression=_cases((col("c_nationkey") < 8, F.concat(lit("SUM([Brand#"), "c_nationkey", lit("])"))),
                          otherwise=F.concat(lit("[Total Brand#"), "c_nationkey", lit("] + 1"))),
    )
    texts = _frame(
        docs,
        object_id=F.concat(lit("D"), "doc_id"),
        object_type=_cases((col("lang") == "en", "CalculatedTable"), otherwise="Measure"),
        name=col("source"),
        description=col("text"),
        expression=col("text"),
        data_type=lit("String"),
    )
    partitions = _frame(
        orders,
        object_id=F.concat(lit("P"), "o_orderkey"),
        object_type=lit("Partition"),
        parent_id=F.concat(lit("T"), "o_custkey"),
        name=F.concat(lit("Supplier#"), F.lpad(col("o_custkey").cast("string"), 9, "0"),
                      _cases((col("o_orderstatus") == "O", " 2020"), otherwise="")),
        expression=_cases((col("o_orderpriority") == "5-LOW", "TODO check"), otherwise="SELECT 1"),
    )
    levels = _frame(
        events,
        object_id=F.concat(lit("L"), "event_id"),
        object_type=lit("Level"),
        parent_id=F.concat(lit("C"), "user_id"),
        name=col("event_type"),
    )
    perspectives = _frame(
        nation, object_id=F.concat(lit("V"), "n_nationkey"), object_type=lit("Perspective"), name=col("n_name")
    )
    provider = _cases(
        (col("s_nationkey") < 6, "SQLNCLI11"), (col("s_nationkey") < 12, "sqloledb"),
        (col("s_nationkey") < 18, "MSOLEDBSQL.1"), otherwise="Other")
    sources = _frame(
        supplier,
        object_id=F.concat(lit("S"), "s_suppkey"),
        object_type=lit("ProviderDataSource"),
        name=col("s_name"),
        connection_string=F.concat(
            lit("Provider="), provider, lit(";"), _cases((col("s_acctbal") > 5000, "application NAME=x;"), otherwise="")),
    )
    out = tables
    for frame in (columns, measures, texts, partitions, levels, perspectives, sources):
        out = out.unionByName(frame)
    return out


OBJECTS = r"""
    objects AS (
        SELECT 'T' || s_suppkey AS object_id,
               CASE WHEN s_acctbal < 500 THEN 'CalculationGroupTable' ELSE 'Table' END AS object_type,
               CAST(NULL AS VARCHAR) AS parent_id,
               CASE WHEN s_nationkey < 4 THEN lower(s_name) WHEN s_nationkey < 10 THEN 'Order' || s_name ELSE s_name END AS name,
               CAST(NULL AS VARCHAR) AS data_type, s_acctbal > 0 AS is_visible, true AS is_available_in_mdx,
               CAST(NULL AS VARCHAR) AS format_string, CAST(NULL AS VARCHAR) AS summarize_by,
               CAST(NULL AS VARCHAR) AS display_folder,
               CASE WHEN s_nationkey > 12 THEN 'a supplier' END AS description,
               CAST(NULL AS VARCHAR) AS expression, CAST(NULL AS VARCHAR) AS connection_string
        FROM supplier
        UNION ALL
        SELECT 'C' || p_partkey,
               CASE p_type WHEN 'SMALL' THEN 'CalculatedColumn' WHEN 'LARGE' THEN 'CalculatedTableColumn'
                           WHEN 'MEDIUM' THEN 'Hierarchy' ELSE 'DataColumn' END,
               'T' || p_size,
               CASE WHEN p_size <= 10 THEN p_name WHEN p_size <= 20 THEN replace(p_name, ' ', '')
                    WHEN p_size <= 35 THEN 'Order' || p_brand ELSE p_brand END,
               CASE WHEN p_retailprice < 920 THEN 'Int64' WHEN p_retailprice < 940 THEN 'Double'
                    WHEN p_retailprice < 960 THEN 'Decimal' WHEN p_retailprice < 980 THEN 'DateTime' ELSE 'String' END,
               p_brand > 'Brand#15', p_retailprice > 930,
               CASE WHEN p_size < 15 THEN '0.00' WHEN p_size < 30 THEN '  ' END,
               CASE WHEN p_size < 25 THEN 'None' WHEN p_size < 45 THEN 'Sum' END,
               CASE WHEN p_size < 12 THEN '' WHEN p_size < 24 THEN ' ' WHEN p_size < 36 THEN p_brand END,
               CASE WHEN p_retailprice < 950 THEN p_type WHEN p_retailprice < 960 THEN '' END,
               CASE WHEN p_size < 10 THEN 'DIVIDE(Sales[' || p_name || '], 2) // a/b'
                    WHEN p_size < 20 THEN 'SUM([' || p_brand || ']) / 100'
                    WHEN p_size < 30 THEN '[x] / [' || p_brand || '] /* c/d */'
                    WHEN p_size < 40 THEN '"a / [x]" & Fact[Total ' || p_brand || ']'
                    WHEN p_size < 45 THEN '-- ToDo: [x] / y' || chr(10) || '1 + ''My Fact''[Total Brand#3] /2' END,
               NULL
        FROM part
        UNION ALL
        SELECT 'M' || c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'KPI' ELSE 'Measure' END, 'T' || c_nationkey,
               CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Total Brand#' || c_nationkey WHEN 'FURNITURE' THEN lower(c_name)
                    WHEN 'MACHINERY' THEN 'Order' || c_name ELSE c_name END,
               CASE WHEN c_acctbal < 4000 THEN 'Decimal' ELSE 'String' END, c_acctbal >= 1000, true,
               CASE WHEN c_nationkey >= 12 THEN '#,0' END, NULL, CASE WHEN c_nationkey < 6 THEN 'Totals' END,
               CASE WHEN c_acctbal > 3000 THEN c_mktsegment END,
               CASE WHEN c_nationkey < 8 THEN 'SUM([Brand#' || c_nationkey || '])' ELSE '[Total Brand#' || c_nationkey || '] + 1' END,
               NULL
        FROM customer
        UNION ALL
        SELECT 'D' || doc_id, CASE WHEN lang = 'en' THEN 'CalculatedTable' ELSE 'Measure' END, NULL, source, 'String', true, true,
               NULL, NULL, NULL, text, text, NULL
        FROM documents
        UNION ALL
        SELECT 'P' || o_orderkey, 'Partition', 'T' || o_custkey,
               'Supplier#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || CASE WHEN o_orderstatus = 'O' THEN ' 2020' ELSE '' END,
               NULL, true, true, NULL, NULL, NULL, NULL,
               CASE WHEN o_orderpriority = '5-LOW' THEN 'TODO check' ELSE 'SELECT 1' END, NULL
        FROM orders
        UNION ALL
        SELECT 'L' || event_id, 'Level', 'C' || user_id, event_type, NULL, true, true, NULL, NULL, NULL, NULL, NULL, NULL FROM events
        UNION ALL
        SELECT 'V' || n_nationkey, 'Perspective', NULL, n_name, NULL, true, true, NULL, NULL, NULL, NULL, NULL, NULL FROM nation
        UNION ALL
        SELECT 'S' || s_suppkey, 'ProviderDataSource', NULL, s_name, NULL, true, true, NULL, NULL, NULL, NULL, NULL,
               'Provider=' || CASE WHEN s_nationkey < 6 THEN 'SQLNCLI11' WHEN s_nationkey < 12 THEN 'sqloledb'
                                   WHEN s_nationkey < 18 THEN 'MSOLEDBSQL.1' ELSE 'Other' END || ';'
               || CASE WHEN s_acctbal > 5000 THEN 'application NAME=x;' ELSE '' END
        FROM supplier)
"""


def usage(spark, sf):
    lines, events, orders = (table(spark, sf, t) for t in ("lineitem", "events", "orders"))
    column = F.concat(F.lit("C"), "l_partkey").alias("object_id")
    from_lines = lines.select(
        column,
        F.explode(F.array_compact(F.array(
            F.when(F.col("l_quantity") > 49, "reference"),
            F.when((F.col("l_discount") > 0.09) & (F.col("l_quantity") < 5), "relationship"),
            F.when((F.col("l_tax") > 0.07) & (F.col("l_quantity") > 40), "perspective"),
        ))).alias("kind"),
    )
    # uses of kinds that no rule asks for keep every row in play
    from_events = events.select(
        F.concat(F.lit("C"), "user_id").alias("object_id"),
        _cases((F.coalesce(F.col("value"), F.lit(0.0)) <= 40, "seen"), (F.col("event_type") == "signup", "sort_by"),
               (F.col("event_type") == "purchase", "hierarchy"), otherwise="variation").alias("kind"),
    )
    from_orders = orders.select(
        F.concat(F.lit("M"), "o_custkey").alias("object_id"),
        _cases((F.col("o_totalprice") <= 400000, "seen"), (F.col("o_orderstatus") == "P", "perspective"),
               otherwise="reference").alias("kind"),
    )
    return from_lines.unionByName(from_events).unionByName(from_orders)


USAGE = """
    usage AS (
        SELECT 'C' || l_partkey AS object_id, 'reference' AS kind FROM lineitem WHERE l_quantity > 49
        UNION ALL SELECT 'C' || l_partkey, 'relationship' FROM lineitem WHERE l_discount > 0.09 AND l_quantity < 5
        UNION ALL SELECT 'C' || l_partkey, 'perspective' FROM lineitem WHERE l_tax > 0.07 AND l_quantity > 40
        UNION ALL SELECT 'C' || user_id, CASE WHEN coalesce(value, 0) <= 40 THEN 'seen' WHEN event_type = 'signup' THEN 'sort_by'
                  WHEN event_type = 'purchase' THEN 'hierarchy' ELSE 'variation' END FROM events
        UNION ALL SELECT 'M' || o_custkey, CASE WHEN o_totalprice <= 400000 THEN 'seen' WHEN o_orderstatus = 'P'
                  THEN 'perspective' ELSE 'reference' END FROM orders)
"""


def cultures(spark, sf):
    return table(spark, sf, "documents").select(F.col("lang").alias("culture")).distinct()


def translations(spark, sf):
    """Translations of parts by their lines: repeated rows of an object and culture, and cultures not listed."""
    line, few = F.col("l_linenumber"), F.col("l_quantity") <= 35
    culture = _cases((few, "xx"), (line == 1, "de"), (line == 2, "en"), (line == 3, "es"), (line == 4, "fr"), otherwise="yy")
    lines = table(spark, sf, "lineitem").select(
        culture.alias("culture"),
        F.concat(F.lit("C"), "l_partkey").alias("object_id"),
        _cases((F.col("l_tax") < 0.02, ""), (F.col("l_returnflag") == "R", F.concat(F.lit("Brand#"), (F.col("l_quantity") - 30).cast("int"))),
               otherwise="translated").alias("t_name"),
        _cases((F.col("l_tax") < 0.05, "text")).alias("t_description"),
        _cases((F.col("l_discount") < 0.06, "folder"), otherwise="").alias("t_folder"),
    )
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        _cases((F.col("quality") == 1, F.col("lang")), otherwise="zz").alias("culture"),
        F.concat(F.lit("D"), "doc_id").alias("object_id"),
        F.col("source").alias("t_name"),
        F.lit("x").alias("t_description"),
        F.lit(None).cast("string").alias("t_folder"),
    )
    return lines.unionByName(docs)


TRANSLATIONS = """
    cultures AS (SELECT DISTINCT lang AS culture FROM documents),
    translations AS (
        SELECT CASE WHEN l_quantity <= 35 THEN 'xx' WHEN l_linenumber = 1 THEN 'de' WHEN l_linenumber = 2 THEN 'en'
                    WHEN l_linenumber = 3 THEN 'es' WHEN l_linenumber = 4 THEN 'fr' ELSE 'yy' END AS culture,
               'C' || l_partkey AS object_id,
               CASE WHEN l_tax < 0.02 THEN '' WHEN l_returnflag = 'R'
                    THEN 'Brand#' || CAST(l_quantity - 30 AS INTEGER) ELSE 'translated' END AS t_name,
               CASE WHEN l_tax < 0.05 THEN 'text' END AS t_description,
               CASE WHEN l_discount < 0.06 THEN 'folder' ELSE '' END AS t_folder
        FROM lineitem
        UNION ALL
        SELECT CASE WHEN quality = 1 THEN lang ELSE 'zz' END, 'D' || doc_id, source, 'x', NULL
        FROM documents JOIN labels USING (doc_id))
"""


def relationships(spark, sf):
    """Every order; the urgent ones tie known columns and tables, the others ones that no object has."""
    status, urgent = F.col("o_orderstatus"), F.col("o_orderpriority") == "1-URGENT"
    return table(spark, sf, "orders").select(
        F.concat(F.lit("R"), "o_orderkey").alias("rel_id"),
        F.concat(F.when(urgent, "Fact").otherwise("Log"), F.year("o_orderdate")).alias("from_table"),
        _cases((status == "F", "Key"), (status == "O", "OrderKey"), otherwise="KeyOrder").alias("from_column"),
        F.concat(F.when(urgent, "T").otherwise("L"), "o_custkey").alias("to_table"),
        F.lit("Key").alias("to_column"),
        F.concat(F.when(urgent, "C").otherwise("X"), "o_custkey").alias("from_column_id"),
    )


RELATIONSHIPS = """
    relationships AS (
        SELECT 'R' || o_orderkey AS rel_id, CASE WHEN urgent THEN 'Fact' ELSE 'Log' END || year(o_orderdate) AS from_table,
               CASE o_orderstatus WHEN 'F' THEN 'Key' WHEN 'O' THEN 'OrderKey' ELSE 'KeyOrder' END AS from_column,
               CASE WHEN urgent THEN 'T' ELSE 'L' END || o_custkey AS to_table, 'Key' AS to_column,
               CASE WHEN urgent THEN 'C' ELSE 'X' END || o_custkey AS from_column_id
        FROM (SELECT *, o_orderpriority = '1-URGENT' AS urgent FROM orders))
"""
