from pyspark.sql import functions as F

from lakekeel.bindings.registry import query, table
from lakekeel.operators import project as P
from lakekeel.operators import upsert as U


@query(
    "env_value_map",
    """
    WITH v AS (SELECT o_custkey, o_orderstatus AS e, arg_min(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY 1, 2)
    SELECT o_custkey, '{' || string_agg('"' || e || '":"' || v || '"', ',' ORDER BY e) || '}' AS values
    FROM v GROUP BY 1
    """,
)
def env_value_map(spark, sf):
    rows = U.env_value_map(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey")
    return rows.withColumn("values", F.to_json("values"))


@query("distinct_sorted", "SELECT DISTINCT source FROM documents WHERE source <> '' ORDER BY source")
def distinct_sorted(spark, sf):
    return U.distinct_sorted(table(spark, sf, "documents"), "source")


@query(
    "any_flag",
    "SELECT l_partkey, bool_or(l_discount > 0.09 AND l_quantity > 40) AS flag FROM lineitem GROUP BY 1",
)
def any_flag(spark, sf):
    return U.any_flag(
        table(spark, sf, "lineitem"), "l_partkey", (F.col("l_discount") > 0.09) & (F.col("l_quantity") > 40)
    )


# (price, part, line) orders the lines of an order totally
SEQ = "CAST(round(l_extendedprice * 100) AS BIGINT) * 100000000 + l_partkey * 10 + l_linenumber"


@query(
    "keyed_upsert",
    f"""
    WITH base AS (SELECT nullif(o_orderkey, first) AS k, o_orderstatus AS a, o_orderpriority AS b, o_orderkey AS pos
                  FROM orders, (SELECT min(o_orderkey) AS first FROM orders WHERE o_orderstatus <> 'F')
                  WHERE o_orderstatus <> 'F'),
    c AS (SELECT CASE WHEN l_linenumber < 7 THEN l_orderkey END AS k, l_linestatus AS a, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS b,
                 {SEQ} AS seq FROM lineitem),
    last AS (SELECT k, arg_max({{'a': a, 'b': b}}, seq) AS v, min(seq) AS first FROM c GROUP BY 1)
    SELECT k, CASE WHEN v IS NULL THEN a ELSE v.a END AS a, CASE WHEN v IS NULL THEN b ELSE v.b END AS b, pos, false AS is_new
    FROM base LEFT JOIN (SELECT k AS lk, v, first FROM last) ON k IS NOT DISTINCT FROM lk
    UNION ALL SELECT k, v.a, v.b, first, true FROM last
              WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.k IS NOT DISTINCT FROM last.k)
    """,
)
def keyed_upsert(spark, sf):
    open_orders = table(spark, sf, "orders").filter("o_orderstatus <> 'F'")
    # one base row and many changes have a null key
    first = open_orders.agg(F.min("o_orderkey")).scalar()
    base = open_orders.select(
        F.nullif(F.col("o_orderkey"), first).alias("k"),
        F.col("o_orderstatus").alias("a"),
        F.col("o_orderpriority").alias("b"),
        F.col("o_orderkey").alias("pos"),
    )
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    changes = table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") < 7, F.col("l_orderkey")).alias("k"), F.col("l_linestatus").alias("a"),
        flag.alias("b"), F.expr(SEQ).alias("seq"),
    )
    return U.keyed_upsert(base, changes, "k", "seq")


@query(
    "keyed_delete",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)",
)
def keyed_delete(spark, sf):
    gone = table(spark, sf, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return U.keyed_delete(table(spark, sf, "customer").select("c_custkey", "c_name"), gone, "c_custkey")


OVERLAY = """
    base AS (SELECT CASE WHEN o_totalprice > 450000 THEN NULL ELSE o_orderkey END AS k, o_custkey AS who,
                    o_orderstatus AS a, CASE WHEN o_totalprice < 100000 THEN NULL ELSE o_orderpriority END AS b,
                    [o_orderstatus, 'Z'] AS tags FROM orders WHERE o_orderstatus <> 'F'),
    lines AS (SELECT l_orderkey, count(*) AS n, max(l_linestatus) AS st, min(l_returnflag) AS lo, max(l_returnflag) AS hi
              FROM lineitem GROUP BY 1),
    over AS (SELECT CASE WHEN n >= 10 THEN NULL ELSE l_orderkey END AS k, n AS who,
                    CASE WHEN n < 3 THEN NULL ELSE st END AS a, CASE WHEN n > 6 THEN NULL ELSE lo END AS b,
                    CASE WHEN n = 5 THEN NULL ELSE [lo, hi, 'Z'] END AS tags FROM lines),
    kb AS (SELECT * FROM base WHERE k IS NOT NULL), ko AS (SELECT * FROM over WHERE k IS NOT NULL)
"""


def _overlay(spark, sf, policy):
    base = table(spark, sf, "orders").filter("o_orderstatus <> 'F'").select(
        F.when(F.col("o_totalprice") <= 450000, F.col("o_orderkey")).alias("k"),
        F.col("o_custkey").alias("who"),
        F.col("o_orderstatus").alias("a"),
        F.when(F.col("o_totalprice") >= 100000, F.col("o_orderpriority")).alias("b"),
        F.array("o_orderstatus", F.lit("Z")).alias("tags"),
    )
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"),
        F.max("l_linestatus").alias("st"),
        F.min("l_returnflag").alias("lo"),
        F.max("l_returnflag").alias("hi"),
    )
    over = lines.select(
        F.when(F.col("n") < 10, F.col("l_orderkey")).alias("k"),
        F.col("n").alias("who"),
        F.when(F.col("n") >= 3, F.col("st")).alias("a"),
        F.when(F.col("n") <= 6, F.col("lo")).alias("b"),
        F.when(F.col("n") != 5, F.array("lo", "hi", F.lit("Z"))).alias("tags"),
    )
    rows = U.overlay_merge(base, over, "k", policy)
    return rows.withColumn("tags", F.array_join("tags", ","))


@query(
    "overlay_merge_0",
    f"""
    WITH {OVERLAY}
    SELECT k, kb.who, kb.a, kb.b, array_to_string(kb.tags, ',') AS tags,
           CASE WHEN kb.who IS NOT NULL THEN 1 ELSE 2 END AS slot
    FROM kb FULL JOIN ko USING (k)
    """,
)
def overlay_merge_0(spark, sf):
    return _overlay(spark, sf, 0)


@query(
    "overlay_merge_1",
    f"""
    WITH {OVERLAY}
    SELECT k, coalesce(ko.who, kb.who) AS who, coalesce(ko.a, kb.a) AS a, coalesce(ko.b, kb.b) AS b,
           array_to_string(coalesce(ko.tags, kb.tags), ',') AS tags,
           CASE WHEN kb.who IS NOT NULL THEN 1 ELSE 2 END AS slot
    FROM kb FULL JOIN ko USING (k)
    """,
)
def overlay_merge_1(spark, sf):
    return _overlay(spark, sf, 1)


@query(
    "overlay_merge_2",
    f"""
    WITH {OVERLAY}
    SELECT k, coalesce(ko.who, kb.who) AS who, coalesce(ko.a, kb.a) AS a, coalesce(ko.b, kb.b) AS b,
           CASE WHEN kb.who IS NULL OR kb.tags IS NULL OR ko.tags IS NULL
                THEN array_to_string(coalesce(ko.tags, kb.tags), ',')
                ELSE array_to_string(kb.tags, ',')
                     || CASE WHEN list_contains(kb.tags, ko.tags[1]) THEN '' ELSE ',' || ko.tags[1] END
                     || CASE WHEN list_contains(kb.tags, ko.tags[2]) OR ko.tags[1] = ko.tags[2] THEN '' ELSE ',' || ko.tags[2] END
                END AS tags,
           CASE WHEN kb.who IS NOT NULL THEN 1 ELSE 2 END AS slot
    FROM kb FULL JOIN ko USING (k)
    UNION ALL
    SELECT k, who, a, b, array_to_string(tags, ','), 0 FROM base WHERE k IS NULL
    UNION ALL
    SELECT k, who, a, b, array_to_string(tags, ','), 0 FROM (
        SELECT DISTINCT o.* FROM over o WHERE o.k IS NULL AND NOT EXISTS (
            SELECT 1 FROM base x WHERE x.k IS NULL AND x.who = o.who AND x.a IS NOT DISTINCT FROM o.a
            AND x.b IS NOT DISTINCT FROM o.b AND x.tags IS NOT DISTINCT FROM o.tags))
    """,
)
def overlay_merge_2(spark, sf):
    return _overlay(spark, sf, 2)


ITEM = "array<struct<item_name:string,x:bigint,y:bigint,present:array<string>>>"


def _item(name, x, y, present=None):
    return F.struct(F.lit(name).alias("item_name"), x.cast("bigint").alias("x"), y.cast("bigint").alias("y"),
                    (F.lit(None) if present is None else present).cast("array<string>").alias("present"))


def _shape(a, b, x, level):
    deep = F.struct(x.cast("bigint").alias("x")).alias("deep")
    return F.struct(a.alias("a"), b.alias("b"), deep, level.cast("int").alias("merge_type")).alias("s")


def _nested(spark, sf, policy):
    none, c = F.lit(None), F.col
    base = table(spark, sf, "orders").filter("o_orderstatus <> 'F'").select(
        c("o_orderkey").alias("k"),
        _shape(c("o_orderstatus"), F.when(c("o_totalprice") >= 100000, c("o_orderpriority")), c("o_custkey"), none),
        F.create_map(F.lit("k1"), "o_orderstatus", F.lit("k2"), "o_orderpriority").alias("m"),
        F.array(_item("p", c("o_custkey"), c("o_orderkey")), _item("q", c("o_custkey") + 1, none),
                _item("p", c("o_custkey") + 2, none)).cast(ITEM).alias("items"),
    )
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.max("l_linestatus").alias("st"), F.min("l_returnflag").alias("lo"),
        F.max("l_returnflag").alias("hi"))
    n = c("n")
    every = F.when(n % 2 == 0, F.array(F.lit("item_name"), F.lit("x"), F.lit("y")))
    over = lines.select(
        c("l_orderkey").alias("k"),
        _shape(F.when(n >= 3, c("st")), c("lo"), F.when(n > 3, n), F.when(n % 7 < 2, n % 7)),
        F.create_map(F.lit("k2"), F.when(n <= 4, c("lo")), F.lit("k3"), "hi").alias("m"),
        F.array(_item("q", none, n, every), _item("r", n + 1, n + 2, every), _item("r", n + 3, none, every)).cast(ITEM).alias("items"),
    )
    shown = F.array_join(F.transform("items", lambda i: F.concat_ws(
        ":", i["item_name"], F.coalesce(i["x"].cast("string"), F.lit("-")), F.coalesce(i["y"].cast("string"), F.lit("-")))), ";")
    pairs = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(
        e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-")))), ";")
    return U.overlay_merge(base, over, "k", policy).select(
        "k", F.col("s.a").alias("a"), F.col("s.b").alias("b"), F.col("s.deep.x").alias("x"), pairs.alias("m"), shown.alias("items"))


def _nested_sql(policy):
    over_items = "'q:-:' || n || ';r:' || (n + 1) || ':' || (n + 2) || ';r:' || (n + 3) || ':-'"
    base_items = "'p:' || c || ':' || k || ';q:' || (c + 1) || ':-;p:' || (c + 2) || ':-'"
    both_items = {
        0: base_items,
        1: over_items,
        2: """'p:' || (c + 2) || ':-;q:' || CASE WHEN n % 2 = 0 THEN '-' ELSE CAST(c + 1 AS VARCHAR) END || ':' || n
              || ';r:' || (n + 3) || ':' || CASE WHEN n % 2 = 0 THEN '-' ELSE CAST(n + 2 AS VARCHAR) END""",
    }[policy]
    base_map, over_map = "'k1=' || st0 || ';k2=' || pr", "'k2=' || CASE WHEN n <= 4 THEN lo ELSE '-' END || ';k3=' || hi"
    both_map = f"{base_map} || ';k3=-'" if policy == 0 else f"'k1=' || st0 || ';' || {over_map}"
    level = f"CASE WHEN n % 7 < 2 THEN n % 7 ELSE {policy} END"

    def field(old, new):
        alone = new if policy else "NULL"
        return (f"CASE WHEN c IS NULL THEN {alone} WHEN n IS NULL OR {level} = 0 THEN {old} ELSE coalesce({new}, {old}) END")

    def whole(both, old, new):
        return f"CASE WHEN c IS NULL THEN {new if policy else 'NULL'} WHEN n IS NULL THEN {old} ELSE {both} END"

    return f"""
    WITH b AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st0, o_orderpriority AS pr,
                      CASE WHEN o_totalprice >= 100000 THEN o_orderpriority END AS b0 FROM orders WHERE o_orderstatus <> 'F'),
    o AS (SELECT l_orderkey AS k, count(*) AS n, max(l_linestatus) AS st, min(l_returnflag) AS lo, max(l_returnflag) AS hi
          FROM lineitem GROUP BY 1)
    SELECT k, {field('st0', 'CASE WHEN n >= 3 THEN st END')} AS a, {field('b0', 'lo')} AS b,
           {field('c', 'CASE WHEN n > 3 THEN n END')} AS x, {whole(both_map, base_map, over_map)} AS m,
           {whole(both_items, base_items, over_items)} AS items
    FROM b FULL JOIN o USING (k)
    """


for _policy in (0, 1, 2):
    query(f"overlay_nested_{_policy}", _nested_sql(_policy))(lambda spark, sf, p=_policy: _nested(spark, sf, p))


PRINCIPALS = """
    p AS (SELECT o_orderpriority AS role, CASE WHEN o_totalprice < 20000 THEN NULL ELSE o_custkey END AS id,
                 o_orderkey AS ord, o_orderstatus FROM orders)
"""


@query(
    "union_dedupe_priority",
    f"""
    WITH {PRINCIPALS}, f AS (SELECT role, id, ord FROM p WHERE o_orderstatus = 'F')
    SELECT role, id, ord, 0 AS src FROM f
    UNION ALL
    SELECT role, id, min(ord), 1 FROM p WHERE o_orderstatus <> 'F'
      AND NOT EXISTS (SELECT 1 FROM f WHERE f.role = p.role AND f.id IS NOT DISTINCT FROM p.id)
    GROUP BY role, id
    """,
)
def union_dedupe_priority(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("role"),
        F.when(F.col("o_totalprice") >= 20000, F.col("o_custkey")).alias("id"),
        F.col("o_orderkey").alias("ord"),
        "o_orderstatus",
    )
    generic = rows.filter("o_orderstatus = 'F'").drop("o_orderstatus")
    layer = rows.filter("o_orderstatus <> 'F'").drop("o_orderstatus")
    return U.union_dedupe_priority(generic, layer, ["role", "id"], "ord")


RECONCILE = """
    want AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F'),
    have AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
"""


def _reconcile(spark, sf, remove_orphans=True):
    want = table(spark, sf, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("k"))
    have = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    return U.reconcile(want, have, "k", remove_orphans)


@query(
    "reconcile",
    f"""
    WITH {RECONCILE}
    SELECT coalesce(want.k, have.k) AS k,
           CASE WHEN have.k IS NULL THEN 'create' WHEN want.k IS NULL THEN 'delete' ELSE 'skip' END AS action
    FROM want FULL JOIN have ON want.k = have.k
    """,
)
def reconcile(spark, sf):
    return _reconcile(spark, sf)


@query(
    "reconcile_keep_orphans",
    f"""
    WITH {RECONCILE}
    SELECT want.k, CASE WHEN have.k IS NULL THEN 'create' ELSE 'skip' END AS action
    FROM want LEFT JOIN have ON want.k = have.k
    """,
)
def reconcile_keep_orphans(spark, sf):
    return _reconcile(spark, sf, remove_orphans=False)


SYNC = """
    l AS (SELECT l_orderkey, max(l_linestatus) AS remote, CAST(count_if(l_returnflag = 'R') AS BIGINT) AS n FROM lineitem GROUP BY 1),
    s AS (SELECT o_orderkey, CASE WHEN remote IS NULL THEN NULL ELSE o_orderstatus END AS head, remote, n,
                 CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '2-HIGH' THEN false ELSE true END AS flag,
                 o_totalprice > 400000 AS disconnected
          FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
"""


def _sync(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_linestatus").alias("remote"), F.count_if(F.col("l_returnflag") == "R").alias("n")
    )
    rows = table(spark, sf, "orders").join(lines, "o_orderkey", "left")
    priority = F.col("o_orderpriority")
    return rows.select(
        "o_orderkey",
        F.when(F.col("remote").isNotNull(), F.col("o_orderstatus")).alias("head"),
        "remote",
        "n",
        F.when(priority != "5-LOW", priority != "2-HIGH").alias("flag"),
        (F.col("o_totalprice") > 400000).alias("disconnected"),
    )


@query(
    "sync_status",
    f"""
    WITH {SYNC}
    SELECT o_orderkey, head, remote, n, CASE WHEN remote IS NULL THEN 'not_possible' WHEN head = remote THEN 'up_to_date'
           WHEN n = 0 THEN 'no_changes' ELSE 'update' END AS status
    FROM s WHERE coalesce(flag, true) AND NOT disconnected
    """,
)
def sync_status(spark, sf):
    rows = P.sync_enabled(_sync(spark, sf), "flag", "disconnected", default=True)
    return P.sync_status(rows, "head", "remote", "n").drop("flag", "disconnected")


@query(
    "sync_status_feature",
    f"""
    WITH {SYNC}
    SELECT o_orderkey, head, remote, n, CASE WHEN remote IS NULL THEN 'not_possible' WHEN head = remote THEN 'up_to_date'
           ELSE 'update' END AS status
    FROM s WHERE coalesce(flag, false) AND NOT disconnected
    """,
)
def sync_status_feature(spark, sf):
    rows = P.sync_enabled(_sync(spark, sf), "flag", "disconnected", default=False)
    return P.sync_status(rows, "head", "remote").drop("flag", "disconnected")
