"""Upsert, overlay, reconciliation and the aggregates around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekeel.plans.skew import as_list, distinct_keys, first_per_key, lookup_join
from lakekeel.sources.sinks import canonical_json


def env_value_map(df: DataFrame, key: str | Sequence[str], env: str, value: str, ord: str) -> DataFrame:
    """Per key the map environment -> value; of several values of one environment the first by ``ord``.

    The second grouping sees one row per key and environment, so a group is as large as its map.
    """
    keys = as_list(key)
    one = df.groupBy(*keys, env).agg(F.min_by(value, ord).alias("__v"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(env), F.col("__v"))))
    return one.groupBy(*keys).agg(F.map_from_entries(pairs).alias("values"))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).filter(F.col(col).isNotNull() & (F.col(col) != "")).distinct().orderBy(col)


def any_flag(df: DataFrame, group: str | Sequence[str], predicate: Column) -> DataFrame:
    return df.groupBy(*as_list(group)).agg(F.bool_or(F.coalesce(predicate, F.lit(False))).alias("flag"))


def _same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Equality of the named columns in which null equals null."""
    cond = F.lit(True)
    for x, y in pairs:
        cond = cond & left[x].eqNullSafe(right[y])
    return cond


def keyed_upsert(
    base: DataFrame, changes: DataFrame, key: str | Sequence[str], seq: str, pos: str = "pos"
) -> DataFrame:
    """Apply keyed changes: the last write replaces the whole row, which keeps its old position.

    New keys come after all base rows, in the order of their first write. ``base`` has one row per key and
    its position in ``pos``; ``changes`` has the other columns of ``base`` and the write order ``seq``. The
    result has the columns of ``base`` and ``is_new``; new rows have their first ``seq`` as position. A null in
    the key is a value like any other: a change with a null key replaces the base row with a null key. A change
    without ``seq`` counts as written before all others of its key.

    The changes are cut to one row per key in the map tasks, and one full outer join reads each side once.
    """
    keys = as_list(key)
    payload = [c for c in base.columns if c not in (*keys, pos)]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct(F.col(seq).isNotNull(), F.col(seq))).alias("__new"), F.min(seq).alias("__first"))
    last = last.select(*[F.col(k).alias(f"__n{i}") for i, k in enumerate(keys)], "__new", "__first")
    old = base.withColumn("__old", F.lit(True))
    rows = old.join(last, _same(old, last, [(k, f"__n{i}") for i, k in enumerate(keys)]), "full_outer")
    # both are set to a struct or a flag where their side has a row, whatever its values
    there, hit = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    return rows.select(
        *[F.when(there, F.col(k)).otherwise(F.col(f"__n{i}")).alias(k) for i, k in enumerate(keys)],
        *[F.when(hit, F.col("__new")[c]).otherwise(F.col(c)).alias(c) for c in payload],
        F.when(there, F.col(pos)).otherwise(F.col("__first")).alias(pos),
        (~there).alias("is_new"),
    )


def keyed_delete(base: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Base rows without the given keys; unknown keys change nothing, and a null key is never deleted."""
    return lookup_join(base, distinct_keys(keys, on), on, "left_anti")


def merge_items(
    base: Column, over: Column, item: T.StructType, key: str = "item_name", present: str = "present"
) -> Column:
    """Merge two arrays of items by ``key``, in the order of the first item of each name.

    Items without a key come first, those of ``over`` only if not there yet. Then every item of ``base`` replaces
    an earlier one of its name, and every item of ``over`` updates it, attribute by attribute. An attribute of an
    item is there if it is not null; items with a field ``present``, an array of names, say themselves which are
    there, and then a present null replaces. Runs inside the row, on lists that are part of it.
    """
    kind = T.ArrayType(item)
    none = F.array().cast(kind)
    base, over = F.coalesce(base, none), F.coalesce(over, none)
    loose = F.filter(base, lambda x: x[key].isNull())
    loose_new = F.array_except(F.filter(over, lambda x: x[key].isNull()), loose)

    def updated(old: Column, new: Column) -> Column:
        def value(f: str) -> Column:
            there = new[f].isNotNull()
            if present in item.names and f != present:
                there = F.coalesce(F.array_contains(new[present], f), there)
            return F.when(there, new[f]).otherwise(old[f]).alias(f)

        return F.struct(*[value(f) for f in item.names])

    def put(combine):
        def step(acc: Column, x: Column) -> Column:
            return F.when(
                F.exists(acc, lambda y: y[key] == x[key]),
                F.transform(acc, lambda y: F.when(y[key] == x[key], combine(y, x)).otherwise(y)),
            ).otherwise(F.concat(acc, F.array(x)))

        return step

    named = F.aggregate(F.filter(base, lambda x: x[key].isNotNull()), none, put(lambda old, new: new))
    merged = F.aggregate(F.filter(over, lambda x: x[key].isNotNull()), named, put(updated))
    return F.concat(loose, loose_new, merged)


def merge_values(
    old: Column,
    new: Column,
    kind: T.DataType,
    mode: Column,
    there: Column | None = None,
    item_key: str = "item_name",
    marker: str | None = None,
) -> Column:
    """``new`` laid over ``old`` under policy ``mode`` (0, 1 or 2), at every level of structs and maps.

    Structs and maps are merged entry by entry whatever the policy; an entry that both sides have as struct or map
    is merged in turn. Of other entries policy 0 keeps the old one and 1 and 2 take the new one; 2 merges lists.
    A field of a struct is there if it is not null, an entry of a map if its key is there. A field or key
    ``marker`` of ``new`` sets the policy of its level and those below; as data it stays as it was.
    """
    there = new.isNotNull() if there is None else there
    both = old.isNotNull() & new.isNotNull()
    taken = F.when(mode == 0, old).otherwise(new)
    if isinstance(kind, T.StructType):
        level = F.coalesce(new[marker].cast("int"), mode) if marker in kind.names else mode
        fields = [
            (old[f.name] if f.name == marker else merge_values(
                old[f.name], new[f.name], f.dataType, level, None, item_key, marker)).alias(f.name)
            for f in kind.fields
        ]
        taken = F.when(both, F.struct(*fields)).otherwise(taken)
    elif isinstance(kind, T.MapType):
        level = mode
        named = marker is not None and isinstance(kind.keyType, T.StringType)
        if named and isinstance(kind.valueType, (T.StringType, T.IntegerType, T.LongType)):
            level = F.coalesce(F.try_element_at(new, F.lit(marker)).try_cast("int"), mode)

        def entry(k: Column, x: Column, y: Column) -> Column:
            value = merge_values(x, y, kind.valueType, level, F.map_contains_key(new, k), item_key, marker)
            return F.when(k == marker, x).otherwise(value) if named else value

        merged = F.map_zip_with(old, new, entry)
        if named:
            merged = F.map_filter(merged, lambda k, _: (k != marker) | F.map_contains_key(old, k))
        taken = F.when(both, merged).otherwise(taken)
    elif isinstance(kind, T.ArrayType):
        element = kind.elementType
        if isinstance(element, T.StructType) and item_key in element.names:
            lists = merge_items(old, new, element, item_key)
        else:
            lists = F.concat(old, F.array_except(new, old))
        taken = F.when((mode == 2) & both, lists).otherwise(taken)
    return F.when(F.coalesce(there, F.lit(False)), taken).otherwise(old)


def overlay_merge(
    base: DataFrame,
    over: DataFrame,
    keys: str | Sequence[str],
    policy: int,
    present: str | None = None,
    policy_col: str | None = None,
    item_key: str = "item_name",
    marker: str | None = "merge_type",
) -> DataFrame:
    """Lay override rows over base rows, by key. Each side has one row per key.

    policy 0 keeps the base: a key that only ``over`` has comes out with null attributes.
    policy 1 replaces: attributes present in ``over`` win, arrays as a whole.
    policy 2 is policy 1 with lists merged: arrays item by item, and rows without a key added if they are
    not there yet. ``slot`` gives the order of the parts: 0 without key, 1 base keys, 2 new keys.
    Struct and map columns are merged at every level, and may set another policy there (see ``merge_values``).

    An attribute is present if it is not null, or named in the array column ``present`` of ``over`` (which
    then decides alone). ``policy_col`` of ``over`` replaces ``policy`` for its row where set.
    """
    if policy not in (0, 1, 2):
        raise ValueError("policy must be 0, 1 or 2")
    keys = as_list(keys)
    attrs = [c for c in base.columns if c not in keys]
    extra = [c for c in (present, policy_col) if c]
    has_key = F.lit(True)
    for k in keys:
        has_key = has_key & F.col(k).isNotNull()

    b = base.select(*keys, F.struct(*attrs).alias("__b"))
    o = over.select(*keys, F.struct(*attrs).alias("__o"), *[F.col(c).alias(f"__{c}") for c in extra])
    rows = b.filter(has_key).join(o.filter(has_key), keys, "full_outer")
    in_base, in_over = F.col("__b").isNotNull(), F.col("__o").isNotNull()
    mode = F.coalesce(F.col(f"__{policy_col}"), F.lit(policy)) if policy_col else F.lit(policy)

    def merged(c: str) -> Column:
        old, new = F.col("__b")[c], F.col("__o")[c]
        there = F.array_contains(F.col(f"__{present}"), c) if present else new.isNotNull()
        dtype = base.schema[c].dataType
        taken = merge_values(old, new, dtype, mode, there, item_key, marker)
        # a key that only the override has follows the policy of the level above
        alone = new if policy != 0 else F.lit(None).cast(dtype)
        return F.when(in_base & in_over, taken).when(in_over, alone).otherwise(old).alias(c)

    slot = F.when(in_base, 1).otherwise(2).alias("slot")
    out = rows.select(*keys, *[merged(c) for c in attrs], slot)
    if policy == 2:
        # rows are compared as canonical JSON, which maps and structs of any depth have
        loose = base.filter(~has_key).select(*keys, *attrs)
        new = over.filter(~has_key).select(*keys, *attrs)
        new = first_per_key(new.withColumn("__row", canonical_json(new)), "__row", ["__row"])
        known = loose.select(canonical_json(loose).alias("__row")).distinct()
        more = new.join(known, "__row", "left_anti").drop("__row")
        out = out.unionByName(loose.unionByName(more).withColumn("slot", F.lit(0)))
    return out


def union_dedupe_priority(
    first: DataFrame, second: DataFrame, keys: str | Sequence[str], ord: str
) -> DataFrame:
    """All rows of ``first``, then the rows of ``second`` whose key is not there yet.

    ``first`` keeps its own duplicates; of equal keys in ``second`` the first by ``ord`` stays. Null keys
    are equal to each other.
    """
    keys = as_list(keys)
    new = first_per_key(second, keys, [ord])
    known = distinct_keys(first, keys)
    cond = F.lit(True)
    for k in keys:
        cond = cond & new[k].eqNullSafe(known[k])
    added = new.join(known, cond, "left_anti")
    return first.withColumn("src", F.lit(0)).unionByName(added.withColumn("src", F.lit(1)))


def reconcile(
    desired: DataFrame, actual: DataFrame, keys: str | Sequence[str], remove_orphans: bool = True
) -> DataFrame:
    """Per key create, skip or delete; without ``remove_orphans`` the keys only in ``actual`` are left out.

    Null keys are equal to each other.
    """
    keys = as_list(keys)
    want = distinct_keys(desired, keys).withColumn("__want", F.lit(True))
    have = distinct_keys(actual, keys).select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)], F.lit(True).alias("__have"))
    how = "full_outer" if remove_orphans else "left"
    rows = want.join(have, _same(want, have, [(k, f"__h{i}") for i, k in enumerate(keys)]), how)
    action = F.when(F.col("__have").isNull(), "create").when(F.col("__want").isNull(), "delete").otherwise("skip")
    named = [F.when(F.col("__want").isNull(), F.col(f"__h{i}")).otherwise(F.col(k)).alias(k) for i, k in enumerate(keys)]
    return rows.select(*named, action.alias("action"))
