from pyspark.sql import functions as F

from lakekeel.bindings import metadata as M
from lakekeel.bindings.registry import query, table
from lakekeel.operators import rules as R

LIMIT = 12  # folder limit of the bound queries


def _hit(rule, severity, condition, kinds, source="objects"):
    names = ", ".join(f"'{k}'" for k in kinds)
    return (
        f"SELECT '{rule}' AS rule_id, {severity} AS severity, object_id FROM {source} "
        f"WHERE object_type IN ({names}) AND ({condition})"
    )


def _union(*parts):
    return "\nUNION ALL ".join(parts)


COLS = ("DataColumn", "CalculatedColumn", "CalculatedTableColumn")
FORMATTED = "data_type IN ('Int64', 'DateTime', 'Double', 'Decimal')"
BLANK = "trim(coalesce(format_string, ''), E' \\t\\n\\r') = ''"
CONN = "lower(connection_string)"

ROW_SQL = _union(
    _hit("DAX_TODO", 1, "contains(lower(expression), 'todo')", ("Measure", "Partition", "CalculatedColumn", "CalculatedTable")),
    _hit("APPLY_FORMAT_STRING_COLUMNS", 2, f"is_visible AND {BLANK} AND {FORMATTED}", COLS),
    _hit("APPLY_FORMAT_STRING_MEASURES", 2, f"is_visible AND {BLANK} AND {FORMATTED}", ("Measure",)),
    _hit("META_AVOID_FLOAT", 2, "data_type = 'Double'", COLS),
    _hit("META_SUMMARIZE_NONE", 1, "is_visible AND summarize_by IS DISTINCT FROM 'None' AND data_type IN ('Double', 'Decimal', 'Int64')", COLS),
    _hit("SPECIFY_APPLICATION_NAME_IN_CONNECTION_STRING", 1,
         f"({CONN} LIKE '%sqlncli%' OR {CONN} LIKE '%sqloledb%' OR {CONN} LIKE '%msoledbsql%') AND {CONN} NOT LIKE '%application name%'",
         ("ProviderDataSource",)),
    _hit("USE_MSOLEDBSQL_PROVIDER", 2, f"{CONN} LIKE '%sqlncli%' OR {CONN} LIKE '%sqloledb%'", ("ProviderDataSource",)),
)


@query("check_predicates", f"WITH {M.OBJECTS} {ROW_SQL}")
def check_predicates(spark, sf):
    return R.check_predicates(M.objects(spark, sf))


def _scope_values():
    return ", ".join(f"('{r.rule_id}', '{r.scope}', {r.level})" for r in R.RULES)


@query(
    "rules_in_scope",
    f"""
    WITH {M.OBJECTS}, rules(rule_id, scope, level) AS (VALUES {_scope_values()}),
    kinds AS (SELECT rule_id, trim(unnest(string_split(scope, ','))) AS kind FROM rules WHERE level <= 1300)
    SELECT rule_id, object_id FROM objects JOIN kinds ON kind = object_type
    """,
)
def rules_in_scope(spark, sf):
    return R.rules_in_scope(R.rules_frame(spark), M.objects(spark, sf), level=1300)


CAMEL = "[A-Z]([A-Z0-9]*[a-z][a-z0-9]*[A-Z]|[a-z0-9]*[A-Z][A-Z0-9]*[a-z])[A-Za-z0-9]*"
UNTRANSLATED = """((SELECT count(*) FROM cultures) = 0 OR EXISTS (SELECT 1 FROM translations t
    WHERE t.culture IN (SELECT culture FROM cultures) AND t.object_id = objects.object_id AND (t.t_name = '' OR t.t_name = objects.name)))"""
NAMES_SQL = _union(
    *[
        _hit(rule, 2, f"is_visible AND regexp_matches(name, '{CAMEL}') AND NOT contains(name, ' ') AND {UNTRANSLATED}", kinds)
        for rule, kinds in (("NO_CAMELCASE_COLUMNS_HIERARCHIES", ("Hierarchy", *COLS)),
                            ("NO_CAMELCASE_MEASURES_TABLES", ("Table", "Measure", "CalculatedTable")))
    ],
    *[
        _hit(rule, 2, rf"is_visible AND regexp_matches(name, '^\p{{Ll}}') AND {UNTRANSLATED}", kinds)
        for rule, kinds in (("UPPERCASE_FIRST_LETTER_COLUMNS_HIERARCHIES", COLS),
                            ("UPPERCASE_FIRST_LETTER_MEASURES_TABLES", ("Table", "Measure", "CalculatedTable")))
    ],
)


@query("check_names", f"WITH {M.OBJECTS}, {M.TRANSLATIONS} {NAMES_SQL}")
def check_names(spark, sf):
    return R.check_names(M.objects(spark, sf), M.translations(spark, sf), M.cultures(spark, sf))


LOOSE = """
    loose AS (SELECT parent_id, count_if(object_type <> 'Measure') AS n_columns, count_if(object_type = 'Measure') AS n_measures
              FROM objects WHERE is_visible AND coalesce(display_folder, '') = ''
              AND object_type IN ('Measure', 'Hierarchy', 'DataColumn', 'CalculatedColumn', 'CalculatedTableColumn') GROUP BY 1)
"""
COUNTS_SQL = _union(
    *[
        _hit(rule, 1, f"(SELECT {n} FROM loose WHERE loose.parent_id = objects.object_id) > {LIMIT}", ("Table",))
        for rule, n in (("LAYOUT_COLUMNS_HIERARCHIES_DF", "n_columns"), ("LAYOUT_MEASURES_DF", "n_measures"))
    ]
)


@query("check_group_counts", f"WITH {M.OBJECTS}, {LOOSE} {COUNTS_SQL}")
def check_group_counts(spark, sf):
    return R.check_group_counts(M.objects(spark, sf), LIMIT)


def _used(*kinds):
    names = ", ".join(f"'{k}'" for k in kinds)
    return f"EXISTS (SELECT 1 FROM usage u WHERE u.object_id = objects.object_id AND u.kind IN ({names}))"


UNUSED_SQL = _union(
    _hit("DISABLE_ATTRIBUTE_HIERACHIES", 2, f"NOT is_visible AND is_available_in_mdx AND NOT {_used('hierarchy', 'variation', 'sort_by')}", ("DataColumn",)),
    _hit("LAYOUT_ADD_TO_PERSPECTIVES", 1,
         f"is_visible AND EXISTS (SELECT 1 FROM usage WHERE kind = 'perspective') AND NOT {_used('perspective')}",
         ("Table", "Measure", "Hierarchy", *COLS)),
    _hit("PERF_UNUSED_COLUMNS", 2, f"NOT is_visible AND NOT {_used('reference', 'relationship', 'sort_by', 'hierarchy', 'variation')}", COLS),
    _hit("PERF_UNUSED_MEASURES", 1, f"NOT is_visible AND NOT {_used('reference')}", ("Measure",)),
)


@query("check_unused", f"WITH {M.OBJECTS}, {M.USAGE} {UNUSED_SQL}")
def check_unused(spark, sf):
    return R.check_unused(M.objects(spark, sf), M.usage(spark, sf))


KEYS_SQL = _hit("LAYOUT_HIDE_FK_COLUMNS", 1, "is_visible AND object_id IN (SELECT from_column_id FROM relationships)", COLS)


@query("check_key_columns", f"WITH {M.OBJECTS}, {M.RELATIONSHIPS} {KEYS_SQL}")
def check_key_columns(spark, sf):
    return R.check_key_columns(M.objects(spark, sf), M.relationships(spark, sf))


def _lacking(column):
    return f"""EXISTS (SELECT 1 FROM cultures c WHERE NOT EXISTS (SELECT 1 FROM translations t
        WHERE t.culture = c.culture AND t.object_id = objects.object_id AND coalesce(t.{column}, '') <> ''))"""


COVERAGE_SQL = _union(
    _hit("LAYOUT_LOCALIZE_DF", 1, f"is_visible AND coalesce(display_folder, '') <> '' AND {_lacking('t_folder')}", ("Measure", "Hierarchy", *COLS)),
    _hit("TRANSLATE_DESCRIPTIONS", 1, f"coalesce(description, '') <> '' AND {_lacking('t_description')}",
         ("Model", "Table", "Measure", "Hierarchy", "Level", "Perspective", "CalculatedTable", *COLS)),
    _hit("TRANSLATE_HIDEABLE_OBJECT_NAMES", 1, f"is_visible AND {_lacking('t_name')}", ("Table", "Measure", "Hierarchy", "CalculatedTable", *COLS)),
    _hit("TRANSLATE_HIERARCHY_LEVEL_NAMES", 1,
         f"(SELECT is_visible FROM objects p WHERE p.object_id = objects.parent_id) AND {_lacking('t_name')}", ("Level",)),
    _hit("TRANSLATE_OTHER_NAMES", 1, _lacking("t_name"), ("Model", "Perspective")),
)


@query("check_coverage", f"WITH {M.OBJECTS}, {M.TRANSLATIONS} {COVERAGE_SQL}")
def check_coverage(spark, sf):
    return R.check_coverage(M.objects(spark, sf), M.translations(spark, sf), M.cultures(spark, sf))


SIBLINGS = """
    parts AS (SELECT p.object_id, p.name, t.name AS t_name, t.object_type AS t_type,
                     count(*) OVER (PARTITION BY p.parent_id) AS n
              FROM objects p JOIN objects t ON t.object_id = p.parent_id WHERE p.object_type = 'Partition')
"""
RELATION_SQL = """
    SELECT 'RELATIONSHIP_COLUMN_NAMES' AS rule_id, 2 AS severity, rel_id AS object_id FROM (
        SELECT *, count(*) OVER (PARTITION BY from_table, to_table) AS n FROM relationships)
    WHERE (n = 1 AND from_column <> to_column) OR (n > 1 AND NOT ends_with(from_column, to_column))
"""
SIBLINGS_SQL = _union(
    """SELECT 'PARTITION_NAMES_SHOULD_MATCH_TABLE_NAMES' AS rule_id, 1 AS severity, object_id FROM parts
       WHERE t_type <> 'CalculationGroupTable' AND ((n = 1 AND name <> t_name) OR (n > 1 AND NOT starts_with(name, t_name)))""",
    RELATION_SQL,
)


@query("check_siblings", f"WITH {M.OBJECTS}, {M.RELATIONSHIPS}, {SIBLINGS} {SIBLINGS_SQL}")
def check_siblings(spark, sf):
    return R.check_siblings(M.objects(spark, sf), M.relationships(spark, sf))


SINGLE_SQL = _hit(
    "AVOID_SINGLE_ATTRIBUTE_DIMENSIONS", 2,
    f"""(SELECT count(*) FROM (SELECT * FROM objects) c WHERE c.parent_id = objects.object_id AND c.is_visible
         AND c.object_type IN {COLS} AND c.object_id NOT IN (SELECT object_id FROM usage WHERE kind = 'relationship')) <= 1
        AND (SELECT count(*) FROM relationships WHERE to_table = objects.object_id) = 1""",
    ("Table",),
)


@query("check_single_use", f"WITH {M.OBJECTS}, {M.USAGE}, {M.RELATIONSHIPS} {SINGLE_SQL}")
def check_single_use(spark, sf):
    return R.check_single_use(M.objects(spark, sf), M.usage(spark, sf), M.relationships(spark, sf))


Q = "''"  # a quote inside an SQL text
LITERAL = rf"\"[^\"]*\"|{Q}[^{Q}]*{Q}|\[[^\]]*\]".replace('\\"', '"')
COMMENT = rf"({LITERAL})|//[^\n]*|--[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
REFERENCE = rf"((?:{Q}[^{Q}]+{Q}|[A-Za-z_][A-Za-z0-9_]*)?)\[([^\]]+)\]"
REFS = rf"""
    code AS (SELECT object_id, object_type, regexp_replace(expression, '{COMMENT}', '\1', 'g') AS code FROM objects
             WHERE expression IS NOT NULL),
    found AS (SELECT object_id, object_type, unnest(regexp_extract_all(regexp_replace(code, '"[^"]*"', '', 'g'), '{REFERENCE}', 0)) AS ref
              FROM code),
    refs AS (SELECT object_id, object_type, ref NOT LIKE '[%' AS qualified, regexp_extract(ref, '{REFERENCE}', 2) AS name FROM found),
    named AS (SELECT name, bool_or(object_type = 'Measure') AS is_measure FROM objects
              WHERE object_type IN ('Measure', 'DataColumn', 'CalculatedColumn', 'CalculatedTableColumn') GROUP BY 1),
    linked AS (SELECT object_id, object_type, bool_or(NOT is_measure AND NOT qualified) AS bare_column,
                      bool_or(is_measure AND qualified) AS qualified_measure
               FROM refs JOIN named USING (name) GROUP BY 1, 2)
"""
SCOPE = ("Measure", "CalculatedColumn", "CalculatedTable", "KPI")
REFERENCE_SQL = _union(
    _hit("DAX_COLUMNS_FULLY_QUALIFIED", 2, "bare_column", SCOPE, "linked"),
    _hit("DAX_MEASURES_UNQUALIFIED", 2, "qualified_measure", SCOPE, "linked"),
    _hit("DAX_DIVISION_COLUMNS", 2, rf"regexp_matches(regexp_replace(code, '{LITERAL}', 'x', 'g'), '/\s*[^\s\d.]')", SCOPE[:3], "code"),
)


@query("check_references", f"WITH {M.OBJECTS}, {REFS} {REFERENCE_SQL}")
def check_references(spark, sf):
    return R.check_references(M.objects(spark, sf))


ALL_CTES = f"{M.OBJECTS}, {M.USAGE}, {M.TRANSLATIONS}, {M.RELATIONSHIPS}, {LOOSE}, {SIBLINGS}, {REFS}"
ALL_SQL = _union(
    ROW_SQL, NAMES_SQL, COUNTS_SQL, UNUSED_SQL, KEYS_SQL, COVERAGE_SQL, SIBLINGS_SQL, SINGLE_SQL, REFERENCE_SQL
)


def _all(spark, sf):
    return R.run_rules(
        M.objects(spark, sf), M.usage(spark, sf), M.translations(spark, sf), M.cultures(spark, sf),
        M.relationships(spark, sf), limit=LIMIT,
    )


@query("run_rules", f"WITH {ALL_CTES} {ALL_SQL}")
def run_rules(spark, sf):
    return _all(spark, sf)


@query(
    "severity_gate",
    f"""
    WITH {ALL_CTES}, v AS ({ALL_SQL})
    SELECT severity, count(*) AS n, (SELECT max(severity) FROM v) >= 2 AS blocked FROM v GROUP BY severity
    """,
)
def severity_gate(spark, sf):
    return R.severity_gate(_all(spark, sf), threshold=2)


FIXABLE_SQL = _union(ROW_SQL, UNUSED_SQL, KEYS_SQL)


@query(
    "apply_fixes",
    f"""
    WITH {M.OBJECTS}, {M.USAGE}, {M.RELATIONSHIPS}, v AS ({FIXABLE_SQL}),
    b AS (SELECT object_id, list(rule_id) AS r FROM v GROUP BY 1)
    SELECT object_id, object_type,
           CASE WHEN list_contains(r, 'LAYOUT_HIDE_FK_COLUMNS') THEN false ELSE is_visible END AS is_visible,
           CASE WHEN list_contains(r, 'DISABLE_ATTRIBUTE_HIERACHIES') THEN false ELSE is_available_in_mdx END AS is_available_in_mdx,
           CASE WHEN list_contains(r, 'META_AVOID_FLOAT') THEN 'Decimal' ELSE data_type END AS data_type,
           CASE WHEN list_contains(r, 'META_SUMMARIZE_NONE') THEN 'None' ELSE summarize_by END AS summarize_by
    FROM objects LEFT JOIN b USING (object_id)
    WHERE NOT coalesce(list_has_any(r, ['PERF_UNUSED_COLUMNS', 'PERF_UNUSED_MEASURES']), false)
    """,
)
def apply_fixes(spark, sf):
    objects, usage = M.objects(spark, sf), M.usage(spark, sf)
    found = (
        R.check_predicates(objects)
        .unionByName(R.check_unused(objects, usage))
        .unionByName(R.check_key_columns(objects, M.relationships(spark, sf)))
    )
    fixed = R.apply_fixes(objects, found)
    return fixed.select("object_id", "object_type", "is_visible", "is_available_in_mdx", "data_type", "summarize_by")


@query(
    "fix_column_types",
    """
    SELECT s_suppkey, s_nationkey, CAST(CAST(s_acctbal AS DECIMAL(19,4)) AS VARCHAR) AS s_acctbal FROM supplier
    """,
)
def fix_column_types(spark, sf):
    rows = R.fix_column_types(table(spark, sf, "supplier"))
    return rows.select("s_suppkey", "s_nationkey", F.col("s_acctbal").cast("string").alias("s_acctbal"))


@query(
    "reset_folders",
    f"""
    WITH {M.OBJECTS}, {M.TRANSLATIONS}, v AS ({COVERAGE_SQL})
    SELECT culture, object_id, t_name, t_description,
           CASE WHEN object_id IN (SELECT object_id FROM v WHERE rule_id = 'LAYOUT_LOCALIZE_DF')
                THEN (SELECT display_folder FROM objects o WHERE o.object_id = translations.object_id) ELSE t_folder END AS t_folder
    FROM translations
    """,
)
def reset_folders(spark, sf):
    objects, words = M.objects(spark, sf), M.translations(spark, sf)
    found = R.check_coverage(objects, words, M.cultures(spark, sf))
    return R.reset_folders(words, found, objects)
