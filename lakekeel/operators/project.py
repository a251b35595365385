"""Projections and filters on one frame. Nothing here shuffles the frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekeel.functions import text as tx
from lakekeel.plans.grams import containing
from lakekeel.plans.skew import lookup_join


# Part of a private-link resource id -> resource type, in test order.
RESOURCE_TYPES = [
    ("Microsoft.KeyVault", "vault"),
    ("Microsoft.Sql", "sqlServer"),
    ("Microsoft.Storage/storageAccounts", "blob"),
    ("Microsoft.Databricks", "databricks_ui_api"),
    ("Microsoft.DocumentDB", "SQL"),
    ("Microsoft.Kusto/clusters", "cluster"),
    ("Microsoft.Synapse/workspaces", "Sql"),
    ("Microsoft.Web/sites", "sites"),
    ("Microsoft.EventHub/namespaces", "namespace"),
    ("Microsoft.Devices/IotHubs", "iotHub"),
    ("Microsoft.Purview/accounts", "account"),
    ("Microsoft.MachineLearningServices/workspaces", "amlworkspace"),
]
CASES = 100  # rules that are written out as one expression
Rules = DataFrame | Sequence[tuple[str, str]]


def rule_frame(spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(ord, needle, label) for an ordered list of pairs."""
    rows = [(i, needle, label) for i, (needle, label) in enumerate(pairs, 1)]
    return spark.createDataFrame(rows, "ord int, needle string, label string")


def expand_name_template(
    df: DataFrame, template: Column | str, mapping: Mapping[str, Column | str], out: str
) -> DataFrame:
    return df.withColumn(out, tx.expand_template(template, mapping))


def retarget_env(df: DataFrame, name: str, envs: Sequence[str], marker: str = "dev") -> DataFrame:
    """One row per row and environment, with the name moved to that environment."""
    rows = df.withColumn("env", F.explode(F.array(*[F.lit(e) for e in envs])))
    return rows.withColumn("value", tx.retarget(name, "env", marker))


def workspace_reference(df: DataFrame, ws: str, envs: Sequence[str], marker: str = "dev") -> DataFrame:
    """``$workspace.<name>`` per environment."""
    rows = retarget_env(df, ws, envs, marker)
    return rows.withColumn("value", F.concat(F.lit("$workspace."), "value"))


def dynamic_reference(
    df: DataFrame,
    ws: str,
    type: str,
    name: str,
    props: Mapping[str, tuple[Column | str, Sequence[str] | None]],
    envs: Sequence[str],
    marker: str = "dev",
) -> DataFrame:
    """``$workspace.<ws>.$items.<type>.<name>.$<prop>`` per property and environment.

    ``props`` gives for each property the column with its present value and the item types that have it
    (None: all). A property without a value gives no row.
    """
    found = []
    for prop, (value, types) in props.items():
        value = (F.col(value) if isinstance(value, str) else value).cast("string")
        here = ~tx.is_empty(value)
        if types is not None:
            here = here & F.col(type).isin(list(types))
        found.append(F.when(here, F.struct(F.lit(prop).alias("prop"), value.alias("find_value"))))
    rows = df.select("*", F.explode(F.array_compact(F.array(*found))).alias("__p"))
    rows = rows.select(*df.columns, "__p.prop", "__p.find_value")
    rows = retarget_env(rows, ws, envs, marker)
    ref = F.concat(
        F.lit("$workspace."), "value", F.lit(".$items."), F.col(type), F.lit("."), F.col(name), F.lit(".$"), "prop"
    )
    return rows.withColumn("value", ref)


def _first_hit(df: DataFrame, col: Column, rules: Rules, out: str) -> DataFrame:
    """Add the label of the first rule whose needle is in the text; null without a hit.

    Up to ``CASES`` rules become one CASE, which stops at the first hit. A longer table is looked up: each distinct
    text meets only the needles that have a rare part in common with it.
    """
    if isinstance(rules, DataFrame):
        few = rules.filter("needle is not null").select("ord", "needle", "label").limit(CASES + 1).collect()  # no more than that
        if len(few) <= CASES:
            rules = [(r["needle"], r["label"]) for r in sorted(few, key=lambda r: (r["ord"], r["needle"]))]
    if not isinstance(rules, DataFrame) and len(rules) <= CASES:
        label = F.lit(None).cast("string")
        for needle, name in reversed([r for r in rules if r[0] is not None]):
            label = F.when(F.contains(col, F.lit(needle)), F.lit(name)).otherwise(label)
        return df.withColumn(out, label)
    table = rules if isinstance(rules, DataFrame) else rule_frame(df.sparkSession, rules)
    first = table.filter("needle is not null").groupBy("needle").agg(F.min(F.struct("ord", "label")).alias("rule"))
    texts = df.select(col.alias("text")).filter("text is not null").distinct()
    hits = containing(texts, first.select("needle")).join(first, "needle")
    labels = hits.groupBy("text").agg(F.min(F.struct("rule.ord", "needle", "rule.label")).alias("hit"))
    labels = labels.select(F.col("text").alias("__text"), F.col("hit.label").alias(out))
    return lookup_join(df.drop(out).withColumn("__text", col), labels, "__text").drop("__text")


def classify_first_match(df: DataFrame, col: str, rules: Rules, out: str = "label") -> DataFrame:
    """Label of the first rule whose needle the text contains; case counts, null without a hit.

    ``rules`` is a table (ord, needle, label) of any length, or an ordered list of (needle, label).
    """
    return _first_hit(df, F.col(col), rules, out)


def match_labels(
    df: DataFrame,
    col: str,
    rules: Rules,
    overlays: Rules | Mapping[str, Rules] | None = None,
    out: str = "label",
) -> DataFrame:
    """Ordered label rules on the lower-cased text.

    The first hit that is not "default" decides; its label "" stands for null. "default" does not stop the
    search, so it only remains when no other rule hits. ``overlays`` are more first-match rules by the name of
    their column (one alone: ``overlay``), used on rows that got a label of their own.
    """
    low = F.lower(col)

    def those(default: bool) -> Rules:
        if isinstance(rules, DataFrame):
            return rules.filter((F.col("label") == "default") == default)
        return [r for r in rules if (r[1] == "default") == default]

    found = _first_hit(df, low, those(False), "__stop")
    found = _first_hit(found, low, those(True), "__default")
    stop = F.col("__stop")
    label = F.when(stop.isNotNull(), F.nullif(stop, F.lit(""))).otherwise(F.col("__default"))
    found = found.withColumn(out, label)
    own = stop.isNotNull() & (stop != "")
    more = overlays if isinstance(overlays, Mapping) else {} if overlays is None else {"overlay": overlays}
    for name, table in more.items():
        found = _first_hit(found, low, table, "__over").withColumn(name, F.when(own, F.col("__over"))).drop("__over")
    return found.drop("__stop", "__default")


def filter_must_either(df: DataFrame, col: str, must: str, either: Sequence[str]) -> DataFrame:
    """Rows whose text contains ``must`` and at least one of ``either``; case counts."""
    any_of = F.lit(False)
    for e in either:
        any_of = any_of | F.contains(F.col(col), F.lit(e))
    return df.filter(F.contains(F.col(col), F.lit(must)) & any_of)


def filter_layers(df: DataFrame, col: str, wanted: str | Sequence[str]) -> DataFrame:
    """Rows whose lower-cased value is in the list; the list is trimmed and lower-cased, the column not trimmed."""
    names = wanted.split(",") if isinstance(wanted, str) else wanted
    return df.filter(F.lower(col).isin([n.strip().lower() for n in names]))


def filter_by_prefix_or_all(df: DataFrame, key: str, always: Column | str, branch: str) -> DataFrame:
    """Rows of the layer named by the first branch segment, plus the rows flagged ``always``.

    A branch without a slash, or with a first segment that names no layer, keeps every row.
    """
    first, slash, _ = branch.partition("/")
    if not slash:
        return df
    always = F.col(always) if isinstance(always, str) else always
    named = F.lower(key) == first.lower()
    known = df.filter(named).exists()
    return df.filter(~known | F.coalesce(named, F.lit(False)) | F.coalesce(always, F.lit(False)))


def project_by_type(
    df: DataFrame, type_col: str, cases: Mapping[str, Mapping[str, Column | str]]
) -> DataFrame:
    """Columns whose source depends on the type; null for the types that do not have them."""
    outs: dict[str, Column] = {}
    for kind, columns in cases.items():
        for out, value in columns.items():
            value = F.col(value) if isinstance(value, str) else value
            hit = F.col(type_col) == kind
            outs[out] = outs[out].when(hit, value) if out in outs else F.when(hit, value)
    return df.select("*", *[c.alias(n) for n, c in outs.items()])


def strip_noise_lines(df: DataFrame, col: str, prefixes: Sequence[str]) -> DataFrame:
    return df.withColumn(col, tx.strip_noise(col, prefixes))


def sync_status(
    df: DataFrame, head: str, remote: str, changes: str | None = None, out: str = "status"
) -> DataFrame:
    """not_possible, up_to_date, no_changes or update, tested in this order.

    Without ``changes`` there is no no_changes case.
    """
    status = F.when(F.col(head).isNull() & F.col(remote).isNull(), "not_possible").when(
        F.col(head).eqNullSafe(F.col(remote)), "up_to_date"
    )
    if changes:
        status = status.when(F.col(changes) == 0, "no_changes")
    return df.withColumn(out, status.otherwise("update"))


def sync_enabled(df: DataFrame, flag: str, disconnected: str, default: bool) -> DataFrame:
    """Rows to synchronise: flag set (``default`` where it is null) and not disconnected."""
    return df.filter(F.coalesce(F.col(flag), F.lit(default)) & ~F.coalesce(F.col(disconnected), F.lit(False)))
