"""Nested values to rows, and rewriting of reference text."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekeel.functions import text as tx
from lakekeel.plans.grams import found_in
from lakekeel.session import stage


def _struct_leaves(c: Column, t: T.StructType, prefix: str) -> list[Column]:
    leaves = []
    for f in t.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        if isinstance(f.dataType, T.StructType):
            leaves += _struct_leaves(c[f.name], f.dataType, path)
        else:
            plain = not isinstance(f.dataType, (T.ArrayType, T.MapType))
            value = c[f.name].cast("string") if plain else F.to_json(c[f.name])
            leaves.append(F.struct(F.lit(path).alias("path"), value.alias("value")))
    return leaves


LEAVES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))


def _json_leaves() -> Callable[[str], Column]:
    """Arrow UDF from JSON text to its leaves. Nested, so that executors get it with the plan."""

    class Number(str):
        """A JSON number, kept as it is written."""

    def as_text(v) -> str:
        if isinstance(v, Number):
            return str(v)
        if isinstance(v, list):
            return "[" + ",".join(map(as_text, v)) + "]"
        if isinstance(v, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{as_text(x)}" for k, x in v.items()) + "}"
        return json.dumps(v, ensure_ascii=False)

    def leaves(text: str):
        todo = [("", json.loads(text, parse_int=Number, parse_float=Number))]
        while todo:
            path, v = todo.pop()
            if isinstance(v, dict):
                todo += [(f"{path}.{k}" if path else k, x) for k, x in reversed(v.items())]
            else:
                yield path, v if v is None or isinstance(v, str) else as_text(v)

    def batch(texts: pa.Array) -> pa.Array:
        offsets, paths, values = [0], [], []
        for text in texts.to_pylist():
            try:
                found = list(leaves(text)) if text is not None else None
            except (ValueError, RecursionError):
                found = None
            for path, value in found or ():
                paths.append(path)
                values.append(value)
            # a null offset makes the list itself null: no JSON
            offsets.append(len(paths))
            if found is None:
                offsets[-2] = None
        items = pa.StructArray.from_arrays(
            [pa.array(paths, pa.string()), pa.array(values, pa.string())], names=["path", "value"]
        )
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)

    return F.arrow_udf(batch, LEAVES)


def flatten_paths(df: DataFrame, col: str, id: str | Sequence[str]) -> DataFrame:
    """(id, path, value) for every leaf below ``col``, with dotted paths.

    Arrays are leaves, empty objects vanish and null leaves stay. A struct is walked by its schema. JSON text of
    any shape and depth is read once per row, in Arrow batches; the built-in way, a recursive query over
    ``variant_explode``, goes over the rows once per level of depth. Text that is no JSON gives no rows here: see
    ``malformed``.
    """
    ids = [id] if isinstance(id, str) else list(id)
    t = df.schema[col].dataType
    if isinstance(t, T.StructType):
        leaves = F.array(*_struct_leaves(F.col(col), t, ""))
    else:
        leaves = _json_leaves()(col)
    return df.select(*ids, F.explode(leaves).alias("__e")).select(*ids, "__e.path", "__e.value")


def malformed(df: DataFrame, col: str) -> DataFrame:
    """The rows whose text ``flatten_paths`` leaves out: neither null nor one JSON value of bearable depth."""
    return df.filter(F.col(col).isNotNull() & _json_leaves()(col).isNull())


def explode_map_of_lists(df: DataFrame, map_col: str, id: str | Sequence[str]) -> DataFrame:
    """(id, key, pos, element) for a map of arrays."""
    ids = [id] if isinstance(id, str) else list(id)
    lists = df.select(*ids, F.explode(map_col).alias("key", "__list"))
    return lists.select(*ids, "key", F.posexplode("__list").alias("pos", "element"))


def role_assignments(
    df: DataFrame, map_col: str, id: str | Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Principals of a role map: (direct assignments, workspace identities to assign later).

    The role Admin owns a connection, every other role uses it.
    """
    rows = explode_map_of_lists(df, map_col, id)
    access = F.when(F.col("key") == "Admin", "Owner").otherwise("User")
    rows = rows.withColumn("access", access)
    deferred = F.coalesce(F.lower("element.type") == "workspaceidentity", F.lit(False))
    return rows.filter(~deferred), rows.filter(deferred)


def valid_bindings(
    df: DataFrame, required: Sequence[str], layer_col: str, layer: str, list_col: str
) -> DataFrame:
    """One row per named model of the complete bindings of a layer.

    Required fields must be non-empty, the layer is compared trimmed and in lower case, a single name counts
    as a list of one, and blank-free empty names inside the list are dropped.
    """
    is_list = isinstance(df.schema[list_col].dataType, T.ArrayType)
    names = F.col(list_col) if is_list else F.array(F.col(list_col))
    ok = F.size(names) > 0 if is_list else ~tx.is_empty(list_col)
    for c in required:
        if c != list_col:
            ok = ok & ~tx.is_empty(c)
    ok = ok & (F.lower(tx.strip(layer_col)) == layer.strip().lower())
    return (
        df.filter(F.coalesce(ok, F.lit(False)))
        .withColumn(list_col, F.explode(F.filter(names, lambda n: ~tx.is_empty(n))))
    )


FEW = 100  # entries up to which every row goes through all of them
MARK = "\x01"


def _stepwise(start: Column, steps: Column) -> Column:
    """The text after all steps (ord, needle, new_value), in order."""
    return F.aggregate(steps, start, lambda text, s: F.replace(text, s["needle"], s["new_value"]))


def _made(start: Column, steps: Column, reach: Column) -> Column:
    """What the steps that change the text have made of it: each time the new values, and ``reach`` characters around.

    Whatever a step brings about overlaps a new value, so that is where to look. A text that holds ``MARK`` stays whole.
    """
    def around(text: Column, s: Column) -> Column:
        pieces = F.split(F.replace(text, s["needle"], F.lit(MARK)), MARK, -1)
        short = F.transform(pieces, lambda p, i: F.when(F.length(p) <= 2 * reach, p).when(
            i == 0, F.right(p, reach)).when(i == F.size(pieces) - 1, F.left(p, reach)).otherwise(
            F.concat(F.left(p, reach), F.lit(MARK), F.right(p, reach))))
        whole = F.replace(text, s["needle"], s["new_value"])
        return F.when(F.contains(text, F.lit(MARK)), whole).otherwise(F.call_function("array_join", short, s["new_value"]))

    def step(done: Column, s: Column) -> Column:
        text = done["text"]
        there = F.contains(text, s["needle"])
        return F.struct(
            F.replace(text, s["needle"], s["new_value"]).alias("text"),
            F.when(there, F.concat(done["made"], F.array(around(text, s)))).otherwise(done["made"]).alias("made"))

    first = F.struct(start.alias("text"), F.array().cast("array<string>").alias("made"))
    return F.array_distinct(F.aggregate(steps, first, step, lambda done: done["made"]))


def apply_find_replace(df: DataFrame, text: str, mapping: DataFrame, env: str, scope: str | None = None) -> DataFrame:
    """Apply the replacements of one environment to a text, one after the other by ``ord`` and literally.

    mapping(find_value, replace_value map, ord). Entries without the environment are skipped. With ``scope``, a
    column of both frames, an entry holds for rows of its scope only, or for all if its scope is null.

    Up to ``FEW`` entries are tried in every row, where it is. Of more, each distinct text meets only the entries whose
    find value it contains, and these are applied in order. An entry whose find value comes about only by replacing
    others is found around what the steps before it have put in; the look-up is repeated for such texts until
    nothing new is found. Time does not depend on how long the mapping is.
    """
    entries = stage(mapping.select(
        F.col("ord").cast("bigint").alias("ord"),
        F.col("find_value").alias("needle"),
        F.element_at("replace_value", F.lit(env)).alias("new_value"),
        (F.col(scope) if scope else F.lit(None).cast("string")).alias("for"),
    ).filter("needle <> '' AND new_value IS NOT NULL").distinct(), "entries")
    where = F.col(scope) if scope else F.lit(None).cast("string")
    entry = F.struct("ord", "needle", "new_value")
    if len(entries.select("ord").take(FEW + 1)) <= FEW:
        one = entries.agg(F.collect_list(F.struct(entry.alias("step"), "for")).alias("__entries"))
        own = F.filter("__entries", lambda e: e["for"].isNull() | (e["for"] == where))
        steps = F.array_sort(F.array_distinct(F.transform(own, lambda e: e["step"])))
        rows = df.crossJoin(F.broadcast(one))
        return rows.withColumn(text, _stepwise(F.col(text), steps)).select(*df.columns)

    start = df.select(F.col(text).alias("start"), where.alias("scope")).filter("start is not null").distinct()
    start = stage(start.withColumn("id", F.monotonically_increasing_id()), "starts")
    reach = entries.agg(F.max(F.length("needle")).alias("reach"))

    def hits(places: DataFrame) -> DataFrame:
        """(id, scope, ord, needle, new_value) of the entries that some text of ``places`` (place, id, scope, text) contains."""
        pairs = found_in(places.select(F.col("place").alias("id"), "text"), entries.select("needle"))
        of = places.select("place", "id", "scope")
        met = pairs.withColumnRenamed("id", "place").join(of, "place").join(entries, "needle")
        return met.filter("for is null or for = scope").select("id", "ord", "needle", "new_value").distinct()

    def listed(steps: DataFrame) -> DataFrame:
        return steps.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("steps"))

    known = fresh = stage(hits(start.select(F.col("id").alias("place"), "id", "scope", F.col("start").alias("text"))), "steps")
    while not fresh.isEmpty():
        again = listed(known.join(fresh.select("id").distinct(), "id", "left_semi")).join(start, "id").crossJoin(F.broadcast(reach))
        made = again.select("id", "scope", F.explode(_made(F.col("start"), F.col("steps"), F.col("reach"))).alias("text"))
        more = hits(stage(made.withColumn("place", F.monotonically_increasing_id()), "made"))
        fresh = stage(more.join(known, [more[c].eqNullSafe(known[c]) for c in ("id", "ord", "needle")], "left_anti"), "steps")
        known = known.unionByName(fresh)
    done = start.join(listed(known), "id").select(
        F.col("start").alias("__start"), F.col("scope").alias("__scope"), _stepwise(F.col("start"), F.col("steps")).alias("__done"))
    same = (F.col(text) == F.col("__start")) & where.eqNullSafe(F.col("__scope"))
    rows = df.join(done, same, "left").withColumn(text, F.coalesce("__done", F.col(text)))
    return rows.select(*df.columns)


def rewrite_quoted_head(df: DataFrame, name: str, text: str, target: str, value: str) -> DataFrame:
    """Rewrite the quoted head of the expressions with this name; all other rows stay unchanged."""
    new = F.when(F.col(name) == target, tx.quoted_head(text, value)).otherwise(F.col(text))
    return df.withColumn(text, new)


def rewrite_named_expression(
    df: DataFrame, text: str, target: str, value: str
) -> tuple[DataFrame, DataFrame]:
    """Set the quoted value of ``expression <target> = ".." meta [..]`` wherever it occurs.

    Returns the rows with ``n_replaced``, and the rows in which the expression was not found.
    """
    pattern = tx.named_expression_pattern(target)
    safe = value.replace("\\", "\\\\").replace("$", "\\$")
    rows = df.withColumn("n_replaced", F.regexp_count(F.col(text), F.lit(pattern)))
    rows = rows.withColumn(text, F.regexp_replace(F.col(text), pattern, f"$1{safe}$2"))
    return rows.filter("n_replaced > 0"), rows.filter("n_replaced = 0").drop("n_replaced")
