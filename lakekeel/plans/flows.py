"""The three jobs the operators are made for, each as one plan over DataFrames.

``parameter_mapping`` builds the cross-environment mapping, ``release`` rewrites and reconciles content,
``provision`` merges a definition with its overrides and finds what to create or remove.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekeel.operators.joins import cross_env_mapping, resolve_bindings, resolve_from_earlier
from lakekeel.operators.nested import apply_find_replace, valid_bindings
from lakekeel.operators.project import expand_name_template, filter_layers
from lakekeel.operators.upsert import keyed_upsert, overlay_merge, reconcile, union_dedupe_priority
from lakekeel.session import stage
from lakekeel.sources.sinks import assign_identity


def parameter_mapping(
    inventory: DataFrame,
    workspaces: DataFrame,
    base: DataFrame,
    primary: str,
    targets: Sequence[str],
    props: Sequence[str],
) -> DataFrame:
    """Upsert the values that differ between environments into the mapping ``base``.

    inventory(env, layer, item, ord, <props>), workspaces(env, layer, workspace_id), base(find_value,
    replace_value, pos). Per layer the workspace comes first, then its items by ``ord``, then the properties
    in the given order; of equal find values the last one counts and keeps the first place.
    """
    spaces = cross_env_mapping(
        workspaces.withColumn("ord", F.lit(0).cast("bigint")), "env", primary, ["layer"], ["workspace_id"], "ord",
        targets, keep_empty=True,
    ).select("layer", F.lit(0).alias("kind"), "ord", "prop_ord", "find_value", "replace_value")
    items = cross_env_mapping(inventory, "env", primary, ["layer", "item"], props, "ord", targets).select(
        "layer", F.lit(1).alias("kind"), F.col("ord").cast("bigint").alias("ord"), "prop_ord", "find_value", "replace_value"
    )
    writes = assign_identity(spaces.unionByName(items), ["layer", "kind", "ord", "prop_ord"], name="seq")
    return keyed_upsert(base, writes.select("find_value", "replace_value", "seq"), "find_value", "seq")


def release(
    content: DataFrame,
    mapping: DataFrame,
    published: DataFrame,
    environment: str,
    layers: Sequence[str],
    actual: DataFrame,
    remove_orphans: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Content as it is to be published, and what to create, skip or delete.

    content(layer, item, text), mapping(find_value, replace_value, ord), published(layer, logical_id, guid,
    ord). Each layer sees the mapping and then, for every logical id, the guid that the first of the layers
    released before it has published.
    """
    names = [name.strip().lower() for name in layers]
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.lower("layer")).cast("int")
    wanted = filter_layers(content, "layer", names)
    known = filter_layers(published, "layer", names).withColumn("at", rank)
    # an id is a target in every layer; the layers are a handful
    targets = known.groupBy("logical_id").agg(F.min("ord").alias("id_ord")).withColumn(
        "target_at", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
    first = known.withColumn("place", F.struct("at", "ord")).groupBy("logical_id", "at").agg(F.min_by("guid", "place").alias("guid"))
    found = stage(
        resolve_from_earlier(targets, first, "logical_id", "target_at", "at", "guid").filter("guid IS NOT NULL"), "resolved")
    after = mapping.agg(F.coalesce(F.max("ord"), F.lit(0)).cast("bigint").alias("after"))  # one row
    layer = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("target_at"))
    ids = found.crossJoin(after).select(
        F.col("logical_id").alias("find_value"), F.create_map(F.lit(environment), "guid").alias("replace_value"),
        (F.col("id_ord") + F.col("after") + 1).alias("ord"), layer.alias("__layer"))
    steps = mapping.select(
        "find_value", "replace_value", F.col("ord").cast("bigint").alias("ord"), F.lit(None).cast("string").alias("__layer")).unionByName(ids)
    texts = apply_find_replace(wanted.withColumn("__layer", F.lower("layer")), "text", steps, environment, scope="__layer")
    return texts.drop("__layer"), reconcile(wanted, filter_layers(actual, "layer", names), ["layer", "item"], remove_orphans)


def bind_models(
    definition: DataFrame,
    layer: str,
    templates: DataFrame,
    connections: DataFrame,
    models: DataFrame,
    environment: str,
) -> tuple[DataFrame, DataFrame]:
    """After a release: the models of a layer with the connection each is bound to, and those that cannot be bound.

    definition(lakehouse_name, lakehouse_ws_layer, layer, semantic_models) holds the bindings as defined; only
    complete ones of ``layer`` count. The other frames are those of ``resolve_bindings``.
    """
    complete = valid_bindings(
        definition, ["lakehouse_name", "lakehouse_ws_layer", "layer", "semantic_models"], "layer", layer, "semantic_models")
    one = complete.select("lakehouse_name", "lakehouse_ws_layer", F.array("semantic_models").alias("semantic_models"))
    return resolve_bindings(one, templates, connections, models, environment)


def provision(
    items: DataFrame,
    overrides: DataFrame,
    generic_permissions: DataFrame,
    layer_permissions: DataFrame,
    actual: DataFrame,
    template: str,
    environment: str,
    keys: Sequence[str] = ("layer", "item_type", "item_name"),
    policy: int = 2,
) -> Mapping[str, DataFrame]:
    """Merged items with their workspace name, merged permissions per layer, and the actions on items.

    Items flagged ``skip_item_creation`` take no part in the reconciliation.
    """
    merged = overlay_merge(items, overrides, list(keys), policy).drop("slot")
    named = expand_name_template(merged, template, {"layer": "layer", "environment": F.lit(environment)}, "workspace")
    place = ["workspace", "item_type", "item_name"]
    wanted = named.filter(~F.coalesce(F.col("skip_item_creation"), F.lit(False)))
    return {
        "items": named,
        "permissions": union_dedupe_priority(
            generic_permissions, layer_permissions, ["layer", "role", "principal_id"], "ord"
        ),
        "actions": reconcile(wanted, actual, place, remove_orphans=False),
    }
