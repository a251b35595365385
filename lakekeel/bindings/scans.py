from pyspark.sql import Window
from pyspark.sql import functions as F

from lakekeel.bindings.registry import query, table
from lakekeel.session import work_path
from lakekeel.sources import scans, sinks


@query("scan_tagged_json", "SELECT *, c_mktsegment AS env FROM customer")
def scan_tagged_json(spark, sf):
    customer = table(spark, sf, "customer")
    path = work_path(spark, "tagged")
    customer.withColumn("tag", F.col("c_mktsegment")).write.partitionBy("tag").json(path)
    return scans.scan_tagged_json(
        spark, [path, f"{path}-missing"], customer.schema, "/tag=([^/]+)/",
        multi_line=False, recursiveFileLookup=True,
    )


@query(
    "explode_pages",
    """
    SELECT conv_id, turn // 4 AS page_no,
           CAST(row_number() OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn) - 1 AS INTEGER) AS pos,
           turn, role, text
    FROM conversations
    """,
)
def explode_pages(spark, sf):
    # (conv_id, turn) is a key, so a page has at most four turns
    page = F.floor(F.col("turn") / 4).alias("page_no")
    pages = table(spark, sf, "conversations").groupBy("conv_id", page).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("value")
    )
    return scans.explode_pages(pages, "value", ["conv_id", "page_no"])


PAGED = """
    t AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn // 2) - 1 AS page_no FROM conversations),
    p AS (SELECT *, conv_id % 3 = 0 AND max(page_no) OVER (PARTITION BY conv_id) > 0 AS broken FROM t)
"""


def _saved_pages(spark, sf):
    """Pages of two turns in no order, each with its token and that of the next; some chains lack their second page."""
    page = F.floor(F.col("turn") / 2).alias("at")
    pages = table(spark, sf, "conversations").groupBy("conv_id", page).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("value"))
    of = Window.partitionBy("conv_id").orderBy("at")  # the pages of one listing
    token = lambda no: F.md5(F.concat_ws("/", "conv_id", no))
    rows = pages.withColumns({"no": F.row_number().over(of), "more": F.lead("at").over(of).isNotNull()}).withColumns({
        "token": F.when(F.col("no") > 1, token("no")), "next_token": F.when(F.col("more"), token(F.col("no") + 1))})
    kept = rows.filter("NOT (conv_id % 3 = 0 AND no = 2)").drop("at", "no", "more")
    return scans.ordered_pages(kept.repartition("token"), "conv_id", "token", "next_token")


@query(
    "explode_continued_pages",
    f"""
    WITH {PAGED}
    SELECT conv_id, CAST(page_no AS BIGINT) AS page_no,
           CAST(row_number() OVER (PARTITION BY conv_id, page_no ORDER BY turn) - 1 AS INTEGER) AS pos, turn, role, text
    FROM p WHERE NOT broken OR page_no = 0
    """,
)
def explode_continued_pages(spark, sf):
    return scans.explode_pages(_saved_pages(spark, sf)[0], "value", ["conv_id", "page_no"])


@query(
    "unreached_pages",
    f"WITH {PAGED} SELECT conv_id, min(turn) AS first_turn, count(*) AS n FROM p WHERE broken AND page_no > 1 GROUP BY conv_id, page_no",
)
def unreached_pages(spark, sf):
    lost = _saved_pages(spark, sf)[1]
    return lost.select("conv_id", F.col("value")[0]["turn"].alias("first_turn"), F.size("value").cast("bigint").alias("n"))


@query(
    "explode_pages_guid",
    """
    WITH p AS (
        SELECT page_id, url, md5(url) AS h, string_split(html, '<p>') AS parts FROM pages
    ), g AS (
        SELECT page_id, parts,
               CASE WHEN length(url) > 40 THEN h ELSE
               substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21) END AS ws
        FROM p
    )
    SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, parts[i] AS part, CAST(length(parts[i]) AS INTEGER) AS n
    FROM (SELECT page_id, parts, unnest(generate_series(1, len(parts))) AS i FROM g WHERE ws LIKE '%-%')
    """,
)
def explode_pages_guid(spark, sf):
    h = F.md5("url")
    guid = F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)
    )
    parts = F.split("html", "<p>", -1)
    items = F.transform(parts, lambda x: F.struct(x.alias("part"), F.length(x).alias("n")))
    # bare hashes are no GUIDs, so their pages give nothing
    ws = F.when(F.length("url") > 40, h).otherwise(guid)
    pages = table(spark, sf, "pages").select("page_id", ws.alias("ws"), items.alias("value"))
    return scans.explode_pages(pages, "value", ["page_id"], guid_col="ws")


NAMES = ["474.HTML", "148.html", "65.html", "471", "685", "Index.html"]


@query(
    "named_text",
    """
    SELECT path, regexp_extract(path, '[^/]*$') AS name, html AS text
    FROM (SELECT regexp_replace(url, '[?#].*$', '') AS path, html FROM pages)
    WHERE lower(regexp_extract(path, '[^/]*$')) IN ('474.html', '148.html', '65.html', '471', '685', 'index.html')
    """,
)
def named_text(spark, sf):
    path = F.regexp_replace("url", "[?#].*$", "")
    return scans.named_text(table(spark, sf, "pages"), path, "html", NAMES)


@query(
    "scan_named_text",
    """
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Notes.TXT' ELSE 'notes.txt' END AS name, html || chr(10) AS text
    FROM pages WHERE page_id % 3 < 2
    """,
)
def scan_named_text(spark, sf):
    """Every page is written as a text file of its own, with its id in the first line; folders carry the names that tell
    which are read. A folder holds many files, and the tasks that write them put them in place themselves.
    """
    out = work_path(spark, "texts")
    kinds = F.array(F.lit("Notes.TXT"), F.lit("notes.txt"), F.lit("other.txt"))
    name = F.get(kinds, (F.col("page_id") % 3).cast("int")).alias("name")
    # rows of one id are one page
    pages = table(spark, sf, "pages").groupBy(F.col("page_id")).agg(
        F.array_join(F.collect_list(F.coalesce("html", F.lit(""))), "\n").alias("html"))
    texts = pages.select(name, F.pmod("page_id", F.lit(64)).alias("part"), F.concat_ws("\n", "page_id", "html").alias("value"))
    texts.write.partitionBy("name", "part").option("maxRecordsPerFile", 1).option(
        "mapreduce.fileoutputcommitter.algorithm.version", 2).text(out)
    found = scans.scan_named_text(spark, out, ["NOTES.txt"], r"/name=([^/]+)/")
    page = F.substring_index("text", "\n", 1)
    return found.select(page.cast("bigint").alias("page_id"), "name", F.expr("substring(text, instr(text, '\n') + 1)").alias("text"))


@query(
    "pick_source_by_priority",
    """
    SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus FROM orders
    WHERE o_orderpriority IN ('2-HIGH', '1-URGENT')
    QUALIFY row_number() OVER (PARTITION BY o_custkey
        ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey) = 1
    """,
)
def pick_source_by_priority(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    return scans.pick_source_by_priority(
        orders, "o_custkey", "o_orderpriority", ["2-HIGH", "1-URGENT"], "o_orderkey"
    )


@query(
    "write_canonical_json",
    """
    SELECT CAST(json_object(
        'acctbal', c_acctbal,
        'id', c_custkey,
        'place', json_object('nation', c_nationkey,
                             'segment', CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END),
        'tags', json_array(json_object('a', c_nationkey, 'z', c_name))) AS VARCHAR) AS json
    FROM customer
    """,
)
def write_canonical_json(spark, sf):
    segment = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment")
    rows = table(spark, sf, "customer").select(
        F.array(F.struct(F.col("c_name").alias("z"), F.col("c_nationkey").alias("a"))).alias("tags"),
        F.struct(segment, F.col("c_nationkey").alias("nation")).alias("place"),
        F.col("c_custkey").alias("id"),
        F.col("c_acctbal").alias("acctbal"),
    )
    path = work_path(spark, "canonical")
    sinks.write_canonical_json(rows, path)
    return spark.read.text(path).withColumnRenamed("value", "json")  # what is in the files


@query(
    "assign_identity",
    """
    SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, o_orderkey, o_orderdate, o_orderpriority
    FROM orders
    """,
)
def assign_identity(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return sinks.assign_identity(orders, ["o_orderdate", "o_orderkey"])


@query(
    "extend_identity",
    """
    WITH c AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS early FROM orders GROUP BY 1),
    n AS (SELECT o_custkey, row_number() OVER (ORDER BY early DESC, o_custkey) AS id FROM c)
    SELECT o_orderkey, o_custkey, id FROM orders JOIN n USING (o_custkey)
    """,
)
def extend_identity(spark, sf):
    """Two loads, the second one twice: the customers of finished orders, then those of all."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    path = work_path(spark, "customer-ids")
    sinks.extend_identity(orders.filter("o_orderstatus = 'F'").select("o_custkey"), "o_custkey", path, 1)
    every = orders.select("o_orderkey", "o_custkey")
    sinks.extend_identity(every, "o_custkey", path, 2)
    return sinks.extend_identity(every, "o_custkey", path, 2)


@query(
    "checked_names",
    """
    SELECT doc_id, coalesce(length(CASE WHEN source = 'src1' THEN NULL ELSE text END) <= 250, false) AS valid
    FROM documents
    """,
)
def checked_names(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("source") != "src1", F.col("text")).alias("name"))
    good, bad = sinks.checked_names(docs, "name")
    return good.select("doc_id", F.lit(True).alias("valid")).unionByName(
        bad.select("doc_id", F.lit(False).alias("valid"))
    )
