"""Joins between inventories, bindings and lookups.

Every lookup side is first cut to one row per key, so no join can multiply rows; the large side is spread
by ``lookup_join`` where a key may be hot. Whether a side is broadcast is left to Spark, which checks its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekeel.functions import text as tx
from lakekeel.plans.skew import as_list, distinct_keys, first_per_key, lookup_join
from lakekeel.session import stage


GRID_ROWS = 1000  # right rows that a left row meets in one array


def expected_grid(left: DataFrame, right: DataFrame, rows: int = GRID_ROWS) -> DataFrame:
    """Each left row with each right row, as layers with environments.

    The right side is packed into arrays of at most about ``rows`` rows, numbered as they are staged; every left row
    names all the numbers and reaches the arrays through an equi-join. The same plan for any size.
    """
    numbered = stage(right.withColumn("__at", F.monotonically_increasing_id()), "grid")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    arrays = numbered.groupBy(part.alias("__part"), F.floor(place / rows).alias("__nth")).agg(
        F.collect_list(F.struct(*right.columns)).alias("__rows"))
    arrays = arrays.withColumn("__cut", F.concat_ws("-", "__part", "__nth")).select("__cut", "__rows")
    cuts = numbered.agg(F.collect_set(F.concat_ws("-", part, F.floor(place / rows)))).scalar()
    met = left.withColumn("__cuts", cuts).withColumn("__cut", F.explode("__cuts")).drop("__cuts")
    grid = met.join(arrays, "__cut").withColumn("__r", F.explode("__rows"))
    return grid.select(*left.columns, *[F.col("__r")[c].alias(c) for c in right.columns])


def attach_first_match(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], value: str, left_ord: str, right_ord: str
) -> DataFrame:
    """Add ``value`` to the first left row of each name; of several right rows the last one wins.

    The other left rows of the name, and names without a right row, get null.
    """
    on = as_list(on)
    firsts = left.groupBy(*on).agg(F.min(left_ord).alias(left_ord))
    lasts = right.groupBy(*on).agg(F.max_by(value, right_ord).alias(value))
    hits = firsts.join(lasts, on).select(*on, left_ord, value)
    # (name, order) is unique on both sides, so a frequent name is no hot key here
    return left.join(hits, [*on, left_ord], "left")


def find_in_layer(df: DataFrame, keys: str | Sequence[str], lookup: DataFrame, ord: str) -> DataFrame:
    """Left lookup of the first row per key; an unknown key gives null."""
    keys = as_list(keys)
    return lookup_join(df, first_per_key(lookup, keys, [ord]).drop(ord), keys)


def cross_env_mapping(
    inventory: DataFrame,
    env: str,
    primary: str,
    keys: Sequence[str],
    props: Sequence[str],
    ord: str | Sequence[str],
    targets: Sequence[str],
    keep_empty: bool = False,
) -> DataFrame:
    """Per primary row and property: its value and the map of the values in the target environments.

    The first row per key and environment counts; null and empty target values are skipped. Without
    ``keep_empty`` a property with an empty map gives no row. A primary property that is null gives no row.
    """
    keys, props, order = as_list(keys), as_list(props), F.struct(*as_list(ord))
    packed = F.struct(*props)
    per_env = [
        F.min_by(F.when(F.col(env) == t, packed), F.when(F.col(env) == t, order)).alias(f"__t{i}")
        for i, t in enumerate(targets)
    ]
    others = inventory.filter(F.col(env).isin(list(targets))).groupBy(*keys).agg(*per_env)
    rows = lookup_join(inventory.filter(F.col(env) == primary), others, keys)

    def entry(p: str) -> Column:
        pairs = [
            F.when(~tx.is_empty(F.col(f"__t{i}")[p].cast("string")), F.struct(F.lit(t).alias("env"), F.col(f"__t{i}")[p].cast("string").alias("value")))
            for i, t in enumerate(targets)
        ]
        return F.struct(
            F.lit(p).alias("prop"),
            F.lit(props.index(p)).alias("prop_ord"),
            F.col(p).cast("string").alias("find_value"),
            F.map_from_entries(F.array_compact(F.array(*pairs))).alias("replace_value"),
        )

    out = rows.select(*keys, *as_list(ord), F.explode(F.array(*[entry(p) for p in props])).alias("__e"))
    out = out.select(*keys, *as_list(ord), "__e.*").filter(F.col("find_value").isNotNull())
    return out if keep_empty else out.filter(F.size("replace_value") > 0)


def resolve_bindings(
    bindings: DataFrame,
    templates: DataFrame,
    connections: DataFrame,
    models: DataFrame,
    environment: str,
) -> tuple[DataFrame, DataFrame]:
    """Resolve model bindings to connections; returns accepted and rejected rows, the latter with a reason.

    bindings(lakehouse_name, lakehouse_ws_layer, semantic_models, ..), templates(lakehouse_ws_layer,
    lakehouse_name, connection_name, ord), connections(connection_name, connection_id, path, ord),
    models(semantic_model, model_id). Connection id, endpoint and database must all be set, else every model
    of the lakehouse is rejected; a missing model only rejects itself.
    """
    where = ["lakehouse_ws_layer", "lakehouse_name"]
    named = templates.withColumn("lakehouse_name", tx.strip("lakehouse_name"))
    template = first_per_key(named, where, ["ord"]).select(*where, "connection_name")
    details = first_per_key(connections, "connection_name", ["ord"]).select(
        "connection_name", "connection_id", tx.split_endpoint("path").alias("__p")
    )
    # resolve each lakehouse once, then carry the result to its bindings
    connection_name = tx.expand_template(F.col("connection_name"), {"environment": F.lit(environment)})
    source = lookup_join(template.withColumn("connection_name", connection_name), details, "connection_name").select(
        *where, "connection_name", "connection_id", "__p.sqlendpoint", "__p.database_name"
    )
    rows = lookup_join(bindings, source, where)
    rows = rows.withColumn("semantic_model", F.explode("semantic_models")).drop("semantic_models")
    named_models = bindings.select(F.explode("semantic_models").alias("semantic_model"))
    model = first_per_key(models, "semantic_model", ["model_id"])
    rows = lookup_join(rows, model, "semantic_model", keys_of=named_models)
    incomplete = (
        tx.is_empty("connection_id") | tx.is_empty("sqlendpoint") | tx.is_empty("database_name")
    )
    reason = (
        F.when(tx.is_empty("connection_name"), "no_template")
        .when(incomplete, "incomplete_connection")
        .when(tx.is_empty("model_id"), "model_not_found")
    )
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL")


def resolve_from_earlier(
    targets: DataFrame,
    mapping: DataFrame,
    on: str | Sequence[str],
    target_ord: str,
    mapping_ord: str,
    value: str,
) -> DataFrame:
    """The value published for the key by the earliest mapping row that lies before the target.

    If any mapping row of the key is earlier than the target, the first one of all is. So one row per key
    is enough, and no pairs of targets and mapping rows are built.
    """
    on = as_list(on)
    earliest = mapping.groupBy(*on).agg(
        F.min(mapping_ord).alias("__ord"), F.min_by(value, mapping_ord).alias("__value")
    )
    rows = lookup_join(targets, earliest, on)
    seen = F.col("__ord") < F.col(target_ord)
    return rows.withColumn(value, F.when(seen, F.col("__value"))).drop("__ord", "__value")


def lookup_ci(
    df: DataFrame, ref: DataFrame, left: str, right: str, ord: str
) -> tuple[DataFrame, DataFrame]:
    """Lookup by name whatever the case, first reference row by ``ord``; returns hits and misses."""
    first = first_per_key(ref.withColumn("__k", F.lower(right)), "__k", [ord]).withColumn("__hit", F.lit(True))
    rows = lookup_join(df.withColumn("__k", F.lower(left)), first, "__k").drop("__k")
    hits = rows.filter(F.col("__hit")).drop("__hit")
    misses = rows.filter(F.col("__hit").isNull()).select(*df.columns)
    return hits, misses


def rows_present(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return lookup_join(df, distinct_keys(other, on), on, "left_semi")


def rows_absent(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return lookup_join(df, distinct_keys(other, on), on, "left_anti")


def explode_acl_suffix(
    df: DataFrame, map_col: str, suffix: Column | str, ord: str, group: Sequence[str] = ()
) -> DataFrame:
    """The value of the last map key that ends in ``suffix``, over all rows (or per ``group``)."""
    suffix = F.lit(suffix) if isinstance(suffix, str) else suffix
    rows = df.select("*", F.posexplode(map_col).alias("__pos", "__key", "__value"))
    hits = rows.filter(F.endswith(F.col("__key"), suffix))
    last = F.struct(F.col(ord), F.col("__pos"))
    return hits.groupBy(*group).agg(
        F.max_by("__key", last).alias("acl_key"), F.max_by("__value", last).alias("descriptor")
    )
