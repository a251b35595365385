"""Quality rules over metadata objects.

Frames (``object_id`` is any comparable type):

objects        object_id, object_type, parent_id, name, data_type, is_visible, is_available_in_mdx,
               format_string, summarize_by, display_folder, description, expression, connection_string
usage          object_id, kind  (reference, relationship, sort_by, hierarchy, variation, perspective)
translations   culture, object_id, t_name, t_description, t_folder   (one row per object and culture)
cultures       culture
relationships  rel_id, from_table, from_column, to_table, to_column, from_column_id
references     from_id, to_type, fully_qualified

Every check returns (rule_id, severity, object_id). Links are first reduced to one row of flags per object
with partial aggregation, then joined once; the rules themselves are expressions evaluated in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakekeel.functions.text import is_blank, is_empty
from lakekeel.plans.skew import distinct_keys, lookup_join
from lakekeel.session import stage


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    severity: int
    scope: str
    level: int
    has_fix: bool = False


# Rule ids, categories, severities, scopes and compatibility levels.
RULES = [
    Rule("DAX_COLUMNS_FULLY_QUALIFIED", "DAX Expressions", 2, "Measure, CalculatedColumn, CalculatedTable, KPI", 1200),
    Rule("DAX_DIVISION_COLUMNS", "DAX Expressions", 2, "Measure, CalculatedColumn, CalculatedTable", 1200),
    Rule("DAX_MEASURES_UNQUALIFIED", "DAX Expressions", 2, "Measure, CalculatedColumn, CalculatedTable, KPI", 1200),
    Rule("DAX_TODO", "DAX Expressions", 1, "Measure, Partition, CalculatedColumn, CalculatedTable", 1200),
    Rule("APPLY_FORMAT_STRING_COLUMNS", "Formatting", 2, "DataColumn, CalculatedColumn, CalculatedTableColumn", 1200),
    Rule("APPLY_FORMAT_STRING_MEASURES", "Formatting", 2, "Measure", 1200),
    Rule("DISABLE_ATTRIBUTE_HIERACHIES", "Metadata", 2, "DataColumn", 1400, True),
    Rule("META_AVOID_FLOAT", "Metadata", 2, "DataColumn, CalculatedColumn, CalculatedTableColumn", 1200, True),
    Rule("META_SUMMARIZE_NONE", "Metadata", 1, "DataColumn, CalculatedColumn, CalculatedTableColumn", 1200, True),
    Rule("LAYOUT_ADD_TO_PERSPECTIVES", "Model Layout", 1, "Table, Measure, Hierarchy, DataColumn, CalculatedColumn, CalculatedTableColumn", 1200),
    Rule("LAYOUT_COLUMNS_HIERARCHIES_DF", "Model Layout", 1, "Table", 1200),
    Rule("LAYOUT_HIDE_FK_COLUMNS", "Model Layout", 1, "DataColumn, CalculatedColumn, CalculatedTableColumn", 1200, True),
    Rule("LAYOUT_LOCALIZE_DF", "Model Layout", 1, "Measure, Hierarchy, DataColumn, CalculatedColumn, CalculatedTableColumn", 1200, True),
    Rule("LAYOUT_MEASURES_DF", "Model Layout", 1, "Table", 1200),
    Rule("TRANSLATE_DESCRIPTIONS", "Model Layout", 1, "Model, Table, Measure, Hierarchy, Level, Perspective, DataColumn, CalculatedColumn, CalculatedTable, CalculatedTableColumn", 1200),
    Rule("TRANSLATE_HIDEABLE_OBJECT_NAMES", "Model Layout", 1, "Table, Measure, Hierarchy, DataColumn, CalculatedColumn, CalculatedTable, CalculatedTableColumn", 1200),
    Rule("TRANSLATE_HIERARCHY_LEVEL_NAMES", "Model Layout", 1, "Level", 1200),
    Rule("TRANSLATE_OTHER_NAMES", "Model Layout", 1, "Model, Perspective", 1200),
    Rule("NO_CAMELCASE_COLUMNS_HIERARCHIES", "Naming Conventions", 2, "Hierarchy, DataColumn, CalculatedColumn, CalculatedTableColumn", 1200),
    Rule("NO_CAMELCASE_MEASURES_TABLES", "Naming Conventions", 2, "Table, Measure, CalculatedTable", 1200),
    Rule("PARTITION_NAMES_SHOULD_MATCH_TABLE_NAMES", "Naming Conventions", 1, "Partition", 1200),
    Rule("RELATIONSHIP_COLUMN_NAMES", "Naming Conventions", 2, "Relationship", 1200),
    Rule("UPPERCASE_FIRST_LETTER_COLUMNS_HIERARCHIES", "Naming Conventions", 2, "DataColumn, CalculatedColumn, CalculatedTableColumn", 1200),
    Rule("UPPERCASE_FIRST_LETTER_MEASURES_TABLES", "Naming Conventions", 2, "Table, Measure, CalculatedTable", 1200),
    Rule("AVOID_SINGLE_ATTRIBUTE_DIMENSIONS", "Performance", 2, "Table", 1200),
    Rule("PERF_UNUSED_COLUMNS", "Performance", 2, "DataColumn, CalculatedColumn, CalculatedTableColumn", 1200, True),
    Rule("PERF_UNUSED_MEASURES", "Performance", 1, "Measure", 1200, True),
    Rule("SPECIFY_APPLICATION_NAME_IN_CONNECTION_STRING", "Performance", 1, "ProviderDataSource", 1200),
    Rule("USE_MSOLEDBSQL_PROVIDER", "Performance", 2, "ProviderDataSource", 1200),
]
# Types, providers and patterns the rules name.
FORMATTED_TYPES = ["Int64", "DateTime", "Double", "Decimal"]
SUMMED_TYPES = ["Double", "Decimal", "Int64"]
SQL_PROVIDERS = ["SQLNCLI", "SQLOLEDB", "MSOLEDBSQL"]
OLD_PROVIDERS = ["SQLNCLI", "SQLOLEDB"]
CAMEL_CASE = "[A-Z]([A-Z0-9]*[a-z][a-z0-9]*[A-Z]|[a-z0-9]*[A-Z][A-Z0-9]*[a-z])[A-Za-z0-9]*"
COLUMN_TYPES = ["DataColumn", "CalculatedColumn", "CalculatedTableColumn"]
FOLDER_LIMIT = 10
MODEL_LEVEL = 1500

BY_ID = {r.rule_id: r for r in RULES}
USAGE_KINDS = ["reference", "relationship", "sort_by", "hierarchy", "variation", "perspective"]

# Text forms for the checks on expressions. Approximations of a full tokenizer, without lookaround.
COMMENT = r"""("[^"]*"|'[^']*'|\[[^\]]*\])|//[^\n]*|--[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"""
LITERAL = r"""("[^"]*"|'[^']*'|\[[^\]]*\])"""
DIVISION = r"/\s*[^\s\d.]"
REFERENCE = r"((?:'[^']+'|[A-Za-z_][A-Za-z0-9_]*)?)\[([^\]]+)\]"


def rules_frame(spark: SparkSession) -> DataFrame:
    rows = [(r.rule_id, r.category, r.severity, r.scope, r.level, r.has_fix) for r in RULES]
    return spark.createDataFrame(
        rows, "rule_id string, category string, severity int, scope string, level int, has_fix boolean"
    )


def rules_in_scope(rules: DataFrame, objects: DataFrame, level: int = MODEL_LEVEL) -> DataFrame:
    """(rule_id, object_id) for the rules that apply to each object by type and compatibility level.

    The rules are read as one map from type to rule ids, so the objects are neither shuffled nor joined.
    """
    kinds = rules.filter(F.col("level") <= level).select(
        "rule_id", F.explode(F.split("scope", ",")).alias("kind")
    )
    kinds = kinds.select("rule_id", F.trim("kind").alias("object_type"))
    per_type = kinds.groupBy("object_type").agg(F.collect_list("rule_id").alias("ids"))  # a handful of types
    by_type = per_type.agg(F.map_from_entries(F.collect_list(F.struct("object_type", "ids"))).alias("m")).scalar()
    rows = objects.select("object_id", F.try_element_at(by_type, F.col("object_type")).alias("__rules"))
    return rows.select(F.explode("__rules").alias("rule_id"), "object_id")


# ---- flags per object -----------------------------------------------------------------------------


def with_usage(objects: DataFrame, usage: DataFrame) -> DataFrame:
    """Add ``used_<kind>`` flags, from one aggregate and one join."""
    flags = usage.groupBy("object_id").agg(
        *[F.bool_or(F.col("kind") == k).alias(f"used_{k}") for k in USAGE_KINDS]
    )
    rows = objects.join(flags, "object_id", "left")
    return rows.withColumns({f"used_{k}": F.coalesce(f"used_{k}", F.lit(False)) for k in USAGE_KINDS})


def with_translations(objects: DataFrame, translations: DataFrame, cultures: DataFrame, names: bool = True) -> DataFrame:
    """Add how many cultures there are and how many have a name, description and folder for the object.

    Translations into cultures that are not listed do not count, and repeated rows of an object and culture count
    once. ``exempt_name`` tells whether a translated name is "" or equal to the name of the object; without ``names``
    the names of the objects are not looked up, and it tells of "" only.
    """
    listed = distinct_keys(cultures, "culture").filter("culture IS NOT NULL")
    counted = {"t_name": "n_names", "t_description": "n_descriptions", "t_folder": "n_folders"}
    named = translations.join(listed, "culture", "left_semi")
    if names:
        named = named.join(objects.select("object_id", F.col("name").alias("__name")), "object_id")
    else:
        named = named.withColumn("__name", F.lit(None).cast("string"))
    exempt = (F.col("t_name") == "") | (F.col("t_name") == F.col("__name"))
    per_culture = named.groupBy("object_id", "culture").agg(
        *[F.bool_or(~is_empty(c)).alias(n) for c, n in counted.items()],
        F.bool_or(F.coalesce(exempt, F.lit(False))).alias("exempt_name"))
    per_object = per_culture.groupBy("object_id").agg(
        *[F.count_if(n).alias(n) for n in counted.values()], F.bool_or("exempt_name").alias("exempt_name"))
    n = listed.agg(F.count("*").alias("n")).scalar()
    rows = objects.join(per_object, "object_id", "left")
    return rows.withColumns(
        {
            "n_cultures": n,
            **{c: F.coalesce(c, F.lit(0)) for c in counted.values()},
            "exempt_name": F.coalesce("exempt_name", F.lit(False)),
        }
    )


def with_parent(
    objects: DataFrame, children: DataFrame | None = None, count_partitions: bool = True
) -> DataFrame:
    """Add name, type and visibility of the parent, and how many partitions it has.

    ``children`` limits the rows that are returned; parents are looked up among all ``objects``.
    """
    children = objects if children is None else children
    parents = objects.select(
        F.col("object_id").alias("parent_id"),
        F.col("name").alias("parent_name"),
        F.col("object_type").alias("parent_type"),
        F.col("is_visible").alias("parent_visible"),
    )
    if count_partitions:
        parts = objects.filter("object_type = 'Partition' AND parent_id IS NOT NULL")
        sizes = parts.groupBy("parent_id").agg(F.count("*").alias("n_siblings"))
        parents = parents.join(sizes, "parent_id", "left")
    return lookup_join(children, parents, "parent_id")


def with_child_counts(
    objects: DataFrame, usage: DataFrame | None = None, parents: DataFrame | None = None
) -> DataFrame:
    """Add counts of the children of each object: visible ones without folder, and free columns.

    ``parents`` limits the rows that are returned; children are counted among all ``objects``.
    """
    loose = F.col("is_visible") & is_empty("display_folder")
    kids = objects if usage is None else with_usage(objects, usage)
    counts = [
        F.count_if(loose & F.col("object_type").isin([*COLUMN_TYPES, "Hierarchy"])).alias("n_loose_columns"),
        F.count_if(loose & (F.col("object_type") == "Measure")).alias("n_loose_measures"),
    ]
    if usage is not None:
        free = F.col("is_visible") & ~F.col("used_relationship") & F.col("object_type").isin(COLUMN_TYPES)
        counts.append(F.count_if(free).alias("n_free_columns"))
    per_parent = kids.filter(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(*counts)
    names = [c for c in per_parent.columns if c != "parent_id"]
    rows = (objects if parents is None else parents).join(
        per_parent.withColumnRenamed("parent_id", "object_id"), "object_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in names})


def _references_in(text: str) -> Column:
    """Array of the different bracketed references in an expression, comments and strings left out."""
    code = F.regexp_replace(F.regexp_replace(text, COMMENT, "$1"), '"[^"]*"', "")
    refs = F.array_distinct(F.regexp_extract_all(code, F.lit(REFERENCE), F.lit(0)))
    # most texts have no bracket at all, and need no pattern
    return F.when(F.contains(F.col(text), F.lit("[")), refs)


def _exploded_references(objects: DataFrame, refs: Column) -> DataFrame:
    rows = objects.select(F.col("object_id").alias("from_id"), F.explode(refs).alias("ref"))
    name = F.rtrim(F.regexp_replace("ref", r"^('[^']*'|[^\['])*\[", ""), F.lit("]"))
    return rows.select("from_id", name.alias("name"), (~F.startswith("ref", F.lit("["))).alias("fully_qualified"))


def extract_references(objects: DataFrame) -> DataFrame:
    """(from_id, name, fully_qualified) for the references in the expressions."""
    return _exploded_references(objects, _references_in("expression"))


def resolve_references(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Add ``to_type``: Measure if a measure has the name, else Column if a column has it, else null."""
    measure = F.col("object_type") == "Measure"
    named = (
        objects.filter(measure | F.col("object_type").isin(COLUMN_TYPES))
        .groupBy("name")
        .agg(F.when(F.bool_or(measure), "Measure").otherwise("Column").alias("to_type"))
    )
    return lookup_join(refs, named, "name").select("from_id", "to_type", "fully_qualified")


def with_references(objects: DataFrame, references: DataFrame) -> DataFrame:
    """Flags for unqualified column references and qualified measure references."""
    qualified = F.col("fully_qualified")
    flags = references.groupBy(F.col("from_id").alias("object_id")).agg(
        F.bool_or((F.col("to_type") == "Column") & ~qualified).alias("bare_column"),
        F.bool_or((F.col("to_type") == "Measure") & qualified).alias("qualified_measure"),
    )
    rows = objects.join(flags, "object_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("bare_column", "qualified_measure")})


# ---- predicates -----------------------------------------------------------------------------------


def _has(text: str, needles: Iterable[str]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(n.lower())) for n in needles])


def _visible() -> Column:
    return F.col("is_visible")


def _of_type(types: Iterable[str]) -> Column:
    return F.col("data_type").isin(list(types))


def _divides() -> Column:
    code = F.regexp_replace("expression", COMMENT, "$1")
    # most texts have no slash at all, and need no pattern
    return F.contains(F.col("expression"), F.lit("/")) & F.regexp_replace(code, LITERAL, "x").rlike(DIVISION)


def _camel() -> Column:
    plain = F.col("name").rlike(CAMEL_CASE) & ~F.contains(F.col("name"), F.lit(" "))
    return _visible() & plain & _untranslated()


def _lower_start() -> Column:
    return _visible() & F.col("name").rlike(r"^\p{Ll}") & _untranslated()


def _untranslated() -> Column:
    return (F.col("n_cultures") == 0) | F.col("exempt_name")


def _lacks(count: str) -> Column:
    return F.col(count) < F.col("n_cultures")


def _unused(*kinds: str) -> Column:
    return reduce(lambda a, b: a & b, [~F.col(f"used_{k}") for k in kinds])


PREDICATES: dict[str, Callable[[], Column]] = {
    "DAX_COLUMNS_FULLY_QUALIFIED": lambda: F.col("bare_column"),
    "DAX_DIVISION_COLUMNS": _divides,
    "DAX_MEASURES_UNQUALIFIED": lambda: F.col("qualified_measure"),
    "DAX_TODO": lambda: _has("expression", ["todo"]),
    "APPLY_FORMAT_STRING_COLUMNS": lambda: _visible() & is_blank("format_string") & _of_type(FORMATTED_TYPES),
    "APPLY_FORMAT_STRING_MEASURES": lambda: _visible() & is_blank("format_string") & _of_type(FORMATTED_TYPES),
    "DISABLE_ATTRIBUTE_HIERACHIES": lambda: ~_visible() & F.col("is_available_in_mdx") & _unused("hierarchy", "variation", "sort_by"),
    "META_AVOID_FLOAT": lambda: F.col("data_type") == "Double",
    "META_SUMMARIZE_NONE": lambda: _visible() & ~F.col("summarize_by").eqNullSafe("None") & _of_type(SUMMED_TYPES),
    "LAYOUT_ADD_TO_PERSPECTIVES": lambda: _visible() & F.col("has_perspectives") & _unused("perspective"),
    "LAYOUT_COLUMNS_HIERARCHIES_DF": lambda: F.col("n_loose_columns") > F.col("folder_limit"),
    "LAYOUT_HIDE_FK_COLUMNS": lambda: _visible() & F.col("on_many_side"),
    "LAYOUT_LOCALIZE_DF": lambda: _visible() & ~is_empty("display_folder") & _lacks("n_folders"),
    "LAYOUT_MEASURES_DF": lambda: F.col("n_loose_measures") > F.col("folder_limit"),
    "TRANSLATE_DESCRIPTIONS": lambda: ~is_empty("description") & _lacks("n_descriptions"),
    "TRANSLATE_HIDEABLE_OBJECT_NAMES": lambda: _visible() & _lacks("n_names"),
    "TRANSLATE_HIERARCHY_LEVEL_NAMES": lambda: F.col("parent_visible") & _lacks("n_names"),
    "TRANSLATE_OTHER_NAMES": lambda: _lacks("n_names"),
    "NO_CAMELCASE_COLUMNS_HIERARCHIES": _camel,
    "NO_CAMELCASE_MEASURES_TABLES": _camel,
    "UPPERCASE_FIRST_LETTER_COLUMNS_HIERARCHIES": _lower_start,
    "UPPERCASE_FIRST_LETTER_MEASURES_TABLES": _lower_start,
    "AVOID_SINGLE_ATTRIBUTE_DIMENSIONS": lambda: (F.col("n_free_columns") <= 1) & (F.col("n_incoming") == 1),
    "PERF_UNUSED_COLUMNS": lambda: ~_visible() & _unused("reference", "relationship", "sort_by", "hierarchy", "variation"),
    "PERF_UNUSED_MEASURES": lambda: ~_visible() & _unused("reference"),
    "SPECIFY_APPLICATION_NAME_IN_CONNECTION_STRING": lambda: _has("connection_string", SQL_PROVIDERS) & ~_has("connection_string", ["application name"]),
    "USE_MSOLEDBSQL_PROVIDER": lambda: _has("connection_string", OLD_PROVIDERS),
    "PARTITION_NAMES_SHOULD_MATCH_TABLE_NAMES": lambda: (F.col("parent_type") != "CalculationGroupTable")
    & F.when(F.col("n_siblings") == 1, F.col("name") != F.col("parent_name")).otherwise(
        ~F.startswith("name", "parent_name")
    ),
}


def _failures(rule_ids: Iterable[str], level: int) -> Column:
    """Array of the rules that fail, with id and severity."""
    fails = []
    for rule in (BY_ID[r] for r in rule_ids):
        if rule.level <= level:
            kinds = [s.strip() for s in rule.scope.split(",")]
            bad = F.col("object_type").isin(kinds) & PREDICATES[rule.rule_id]()
            hit = F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"))
            fails.append(F.when(bad, hit))
    return F.array_compact(F.array(*fails))


def in_scopes(objects: DataFrame, rule_ids: Iterable[str]) -> DataFrame:
    """The objects of a type that some of the rules cover: cuts the rows before any join."""
    kinds = {s.strip() for r in rule_ids for s in BY_ID[r].scope.split(",")}
    return objects.filter(F.col("object_type").isin(sorted(kinds)))


def violations(objects: DataFrame, rule_ids: Iterable[str], level: int = MODEL_LEVEL) -> DataFrame:
    """Evaluate rules over objects that carry the flags they need, in one pass."""
    return _exploded_failures(objects, _failures(rule_ids, level))


def _exploded_failures(objects: DataFrame, failures: Column) -> DataFrame:
    hits = objects.select("object_id", F.explode(failures).alias("__v"))
    return hits.select("__v.rule_id", "__v.severity", "object_id")


# ---- checks ---------------------------------------------------------------------------------------

ROW_RULES = [
    "DAX_TODO",
    "APPLY_FORMAT_STRING_COLUMNS",
    "APPLY_FORMAT_STRING_MEASURES",
    "META_AVOID_FLOAT",
    "META_SUMMARIZE_NONE",
    "SPECIFY_APPLICATION_NAME_IN_CONNECTION_STRING",
    "USE_MSOLEDBSQL_PROVIDER",
]
NAME_RULES = [
    "NO_CAMELCASE_COLUMNS_HIERARCHIES",
    "NO_CAMELCASE_MEASURES_TABLES",
    "UPPERCASE_FIRST_LETTER_COLUMNS_HIERARCHIES",
    "UPPERCASE_FIRST_LETTER_MEASURES_TABLES",
]
USAGE_RULES = [
    "DISABLE_ATTRIBUTE_HIERACHIES",
    "LAYOUT_ADD_TO_PERSPECTIVES",
    "PERF_UNUSED_COLUMNS",
    "PERF_UNUSED_MEASURES",
]
COVERAGE_RULES = [
    "LAYOUT_LOCALIZE_DF",
    "TRANSLATE_DESCRIPTIONS",
    "TRANSLATE_HIDEABLE_OBJECT_NAMES",
    "TRANSLATE_HIERARCHY_LEVEL_NAMES",
    "TRANSLATE_OTHER_NAMES",
]
REFERENCE_RULES = ["DAX_COLUMNS_FULLY_QUALIFIED", "DAX_MEASURES_UNQUALIFIED"]
COUNT_RULES = ["LAYOUT_COLUMNS_HIERARCHIES_DF", "LAYOUT_MEASURES_DF"]


def check_predicates(objects: DataFrame, rule_ids: Iterable[str] = ROW_RULES) -> DataFrame:
    """Rules that need nothing but the object itself: one scan, no shuffle."""
    return violations(objects, rule_ids)


def check_names(objects: DataFrame, translations: DataFrame, cultures: DataFrame) -> DataFrame:
    """Naming rules; an object with a real translated name is exempt."""
    return violations(with_translations(in_scopes(objects, NAME_RULES), translations, cultures), NAME_RULES)


def check_group_counts(objects: DataFrame, limit: int = FOLDER_LIMIT) -> DataFrame:
    """Tables with more than ``limit`` visible children outside display folders."""
    rows = with_child_counts(objects, parents=in_scopes(objects, COUNT_RULES)).withColumn("folder_limit", F.lit(limit))
    return violations(rows, COUNT_RULES)


def check_unused(objects: DataFrame, usage: DataFrame) -> DataFrame:
    """Hidden objects that nothing uses, and visible ones in no perspective although there are some."""
    rows = with_usage(in_scopes(objects, USAGE_RULES), usage)
    return violations(rows.withColumn("has_perspectives", _any_perspective(usage)), USAGE_RULES)


def _any_perspective(usage: DataFrame) -> Column:
    return F.coalesce(usage.agg(F.bool_or(F.col("kind") == "perspective").alias("a")).scalar(), F.lit(False))


def _with_many_side(objects: DataFrame, relationships: DataFrame) -> DataFrame:
    many = relationships.select(F.col("from_column_id").alias("object_id")).distinct()
    rows = objects.join(many.withColumn("on_many_side", F.lit(True)), "object_id", "left")
    return rows.withColumn("on_many_side", F.coalesce("on_many_side", F.lit(False)))


def check_key_columns(objects: DataFrame, relationships: DataFrame) -> DataFrame:
    """Visible columns on the many side of a relationship."""
    rules = ["LAYOUT_HIDE_FK_COLUMNS"]
    return violations(_with_many_side(in_scopes(objects, rules), relationships), rules)


def check_coverage(objects: DataFrame, translations: DataFrame, cultures: DataFrame) -> DataFrame:
    """Objects that lack a translation in some culture.

    Counts the cultures that have one, so no object-culture pairs are built. Only that a description is there goes
    through the joins, not its text.
    """
    level = F.coalesce(F.col("object_type") == "Level", F.lit(False))
    slim = objects.withColumn("description", F.when(~is_empty("description"), F.lit("set")))
    levels = with_parent(objects, slim.filter(level), count_partitions=False).select(*objects.columns, "parent_visible")
    rest = in_scopes(slim.filter(~level), COVERAGE_RULES).withColumn("parent_visible", F.lit(None).cast("boolean"))
    return violations(with_translations(levels.unionByName(rest), translations, cultures, names=False), COVERAGE_RULES)


def check_siblings(objects: DataFrame, relationships: DataFrame) -> DataFrame:
    """Names that depend on how many partitions a table, or relationships a pair of tables, has."""
    parts = with_parent(objects, objects.filter("object_type = 'Partition'"))
    return violations(parts, ["PARTITION_NAMES_SHOULD_MATCH_TABLE_NAMES"]).unionByName(
        check_relationship_names(relationships)
    )


def check_relationship_names(relationships: DataFrame) -> DataFrame:
    """One relationship between two tables: equal column names; several: the from name ends with the to name."""
    pair = ["from_table", "to_table"]
    sizes = relationships.groupBy(*pair).agg(F.count("*").alias("n"))
    rows = lookup_join(relationships, sizes, pair)
    bad = F.when(F.col("n") == 1, F.col("from_column") != F.col("to_column")).otherwise(
        ~F.endswith("from_column", "to_column")
    )
    rule = BY_ID["RELATIONSHIP_COLUMN_NAMES"]
    return rows.filter(bad).select(
        F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.col("rel_id").alias("object_id")
    )


def _with_incoming(objects: DataFrame, relationships: DataFrame) -> DataFrame:
    incoming = relationships.groupBy(F.col("to_table").alias("object_id")).agg(F.count("*").alias("n_incoming"))
    rows = objects.join(incoming, "object_id", "left")
    return rows.withColumn("n_incoming", F.coalesce("n_incoming", F.lit(0)))


def check_single_use(objects: DataFrame, usage: DataFrame, relationships: DataFrame) -> DataFrame:
    """Tables with at most one free visible column and exactly one incoming relationship."""
    rules = ["AVOID_SINGLE_ATTRIBUTE_DIMENSIONS"]
    rows = _with_incoming(with_child_counts(objects, usage, in_scopes(objects, rules)), relationships)
    return violations(rows, rules)


def check_references(objects: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Rules on references and division in expressions.

    Without a table of resolved references they are taken from the expression text, once: the short list of
    references is staged.
    """
    if references is None:
        references = resolve_references(stage(extract_references(objects), "references"), objects)
    linked = violations(with_references(in_scopes(objects, REFERENCE_RULES), references), REFERENCE_RULES)
    return linked.unionByName(violations(objects, ["DAX_DIVISION_COLUMNS"]))


FLAGS = [*[f"used_{k}" for k in USAGE_KINDS], "bare_column", "qualified_measure", "on_many_side"]
COUNTS = ["n_incoming", "n_loose_columns", "n_loose_measures", "n_free_columns"]


def _link_flags(
    objects: DataFrame, usage: DataFrame, relationships: DataFrame, references: DataFrame
) -> DataFrame:
    """One row of flags and counts per object that any link points at: one union, one aggregate."""
    visible, qualified = F.col("is_visible"), F.col("fully_qualified")
    is_column = F.col("object_type").isin(COLUMN_TYPES)
    loose = visible & is_empty("display_folder")

    def one(condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0)

    parent = F.col("parent_id").alias("object_id")
    children = objects.filter(F.col("parent_id").isNotNull())
    related = usage.filter("kind = 'relationship'").select("object_id").distinct()
    # free columns: all the visible columns of the table, less those used in relationships
    bound = children.filter(visible & is_column).join(related, "object_id", "left_semi")
    # a relationship says something about its column and about its table: one reading, two rows
    ends = relationships.select(F.explode(F.array(
        F.struct(F.col("from_column_id").alias("object_id"), F.lit(True).alias("on_many_side"), F.lit(None).cast("int").alias("n_incoming")),
        F.struct(F.col("to_table").alias("object_id"), F.lit(None).cast("boolean").alias("on_many_side"), F.lit(1).alias("n_incoming")),
    )).alias("e")).select("e.*")
    frames = [
        usage.select("object_id", *[(F.col("kind") == k).alias(f"used_{k}") for k in USAGE_KINDS]),
        references.select(
            F.col("from_id").alias("object_id"),
            ((F.col("to_type") == "Column") & ~qualified).alias("bare_column"),
            ((F.col("to_type") == "Measure") & qualified).alias("qualified_measure"),
        ),
        ends,
        children.select(
            parent,
            one(loose & (is_column | (F.col("object_type") == "Hierarchy"))).alias("n_loose_columns"),
            one(loose & (F.col("object_type") == "Measure")).alias("n_loose_measures"),
            one(visible & is_column).alias("n_free_columns"),
        ),
        bound.select(parent, F.lit(-1).alias("n_free_columns")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.groupBy("object_id").agg(
        *[F.bool_or(c).alias(c) for c in FLAGS], *[F.sum(c).alias(c) for c in COUNTS]
    )


def run_rules(
    objects: DataFrame,
    usage: DataFrame,
    translations: DataFrame,
    cultures: DataFrame,
    relationships: DataFrame,
    references: DataFrame | None = None,
    limit: int = FOLDER_LIMIT,
    level: int = MODEL_LEVEL,
) -> DataFrame:
    """All rules together.

    One pass over the objects evaluates the rules on the object alone and takes the references from its
    expression; the result is staged without the long texts, and everything else reads that. Each kind of
    link becomes flags per object. The objects go through one join on the parent and then joins on the same
    object id, which share one shuffle.
    """
    alone = [*ROW_RULES, "DAX_DIVISION_COLUMNS"]
    slim = stage(
        objects.withColumns(
            {
                "own": _failures(alone, level),
                "refs": _references_in("expression") if references is None else F.lit(None).cast("array<string>"),
                "description": F.when(~is_empty("description"), F.lit("set")),
            }
        ).drop("expression", "connection_string"),
        "objects",
    )
    if references is None:
        references = resolve_references(_exploded_references(slim, F.col("refs")), slim)
    bare = slim.drop("own", "refs")
    rows = with_translations(with_parent(bare), translations, cultures)
    rows = rows.join(_link_flags(bare, usage, relationships, references), "object_id", "left")
    rows = rows.withColumns(
        {
            **{c: F.coalesce(c, F.lit(False)) for c in FLAGS},
            **{c: F.coalesce(c, F.lit(0)) for c in COUNTS},
            "has_perspectives": _any_perspective(usage),
            "folder_limit": F.lit(limit),
        }
    )
    return (
        _exploded_failures(slim, F.col("own"))
        .unionByName(violations(rows, [r for r in PREDICATES if r not in alone], level))
        .unionByName(check_relationship_names(relationships))
    )


# ---- fixes and gate -------------------------------------------------------------------------------

# What each rule's fix does to the object.
DELETES = ["PERF_UNUSED_COLUMNS", "PERF_UNUSED_MEASURES"]


def default_fixes() -> dict[str, tuple[str, Column]]:
    return {
        "DISABLE_ATTRIBUTE_HIERACHIES": ("is_available_in_mdx", F.lit(False)),
        "META_AVOID_FLOAT": ("data_type", F.lit("Decimal")),
        "META_SUMMARIZE_NONE": ("summarize_by", F.lit("None")),
        "LAYOUT_HIDE_FK_COLUMNS": ("is_visible", F.lit(False)),
    }


def apply_fixes(
    objects: DataFrame,
    found: DataFrame,
    fixes: Mapping[str, tuple[str, Column]] | None = None,
    deletes: Iterable[str] = DELETES,
) -> DataFrame:
    """Objects after the fixes of their violations; objects whose fix is deletion are left out."""
    fixes = default_fixes() if fixes is None else fixes
    per_object = found.groupBy("object_id").agg(F.collect_set("rule_id").alias("__rules"))
    rows = objects.join(per_object, "object_id", "left")
    broken = F.coalesce("__rules", F.array().cast("array<string>"))
    rows = rows.filter(~F.arrays_overlap(broken, F.array(*[F.lit(d) for d in deletes])))
    columns = {c: F.col(c) for c in objects.columns}
    for rule_id, (column, value) in fixes.items():
        columns[column] = F.when(F.array_contains(broken, rule_id), value).otherwise(columns[column])
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def reset_folders(translations: DataFrame, found: DataFrame, default_culture_folder: DataFrame) -> DataFrame:
    """The fix for untranslated folders: back to the folder of the object, in every culture it has.

    The objects with a violation are found once and staged, or Spark would find them again for every frame that the
    objects are a union of, all in one task. So are their folders: of known size, they may be broadcast to the translations.
    """
    broken = stage(found.filter("rule_id = 'LAYOUT_LOCALIZE_DF'").select("object_id").distinct(), "broken")
    folders = stage(default_culture_folder.join(broken, "object_id", "left_semi").select("object_id", "display_folder"), "folders")
    rows = lookup_join(translations, folders.withColumn("__hit", F.lit(True)), "object_id")
    reset = F.when(F.col("__hit"), F.col("display_folder")).otherwise(F.col("t_folder"))
    return rows.withColumn("t_folder", reset).select(*translations.columns)


def fix_column_types(df: DataFrame, precision: int = 19, scale: int = 4) -> DataFrame:
    """The floating-point fix on a data table: every double or float column becomes a decimal."""
    return df.select(
        *[
            F.col(n).cast(f"decimal({precision},{scale})").alias(n) if t in ("double", "float") else F.col(n)
            for n, t in df.dtypes
        ]
    )


def severity_gate(found: DataFrame, threshold: int = 3) -> DataFrame:
    """Violations per severity, and whether any reaches the threshold."""
    counts = found.groupBy("severity").agg(F.count("*").alias("n"))  # a handful of rows
    blocked = F.bool_or(F.col("severity") >= threshold).over(Window.partitionBy())
    return counts.withColumn("blocked", blocked)
