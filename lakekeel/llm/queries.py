"""The queries of the text operators on the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekeel.llm import (
    bpe, chat, decontaminate, language, license, lines, phrases, quality, secrets, simhash, spelling, suffixes, urls,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_license")
def op1(spark, sf):
    docs = table(spark, sf, "documents")
    return license.digest(license.scan(docs, license.fit(docs)))


_STATS_SQL = r"""
d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g
        FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cover AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(5)) AS k) GROUP BY rid),
line AS (SELECT rid, unnest(string_split(t, chr(10))) AS s FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT s) AS n FROM line
        WHERE regexp_matches(s, '[^\x20\x09-\x0D]') GROUP BY rid),
stats AS (SELECT d.rid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN dup ON dup.rid = d.rid LEFT JOIN cover ON cover.rid = d.rid),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM stats),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM base
          WHERE source IS NOT NULL GROUP BY source),
sums AS (SELECT sum(n) AS n, sum(f) AS f, count(*) AS h, sum(f / n) AS r, sum((f / n) * (f / n)) AS rr,
                sum(1 / n) AS inv FROM hosts),
moments AS (SELECT (f + 0.5) / (n + 1.0) AS m,
    rr / h - (r / h) * (r / h) - ((f + 0.5) / (n + 1.0)) * (1 - (f + 0.5) / (n + 1.0)) * inv / h AS v FROM sums),
prior AS (SELECT m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1000.0 END, 1.0), 1000.0) AS w
          FROM moments),
bad AS (SELECT source FROM hosts, prior WHERE (hosts.f + m * w) / (hosts.n + w) > 0.5)
"""


@query("op2_quality", "WITH" + _STATS_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept FROM base""")
def op2(spark, sf):
    judged = quality.judge_quality(table(spark, sf, "documents"))
    return judged.select("doc_id", *quality.STATS, "base_failed", "kept")


@query("op3_secrets")
def op3(spark, sf):
    return secrets.digest(secrets.find_secrets(table(spark, sf, "documents")))


@query("op4_language")
def op4(spark, sf):
    docs = table(spark, sf, "documents")
    held = F.coalesce(language.fold(F.col("doc_id")) == 1, F.lit(False))
    model = language.fit(docs.filter(~held))
    found = language.predict(docs, model, reject=False)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "too_far")


def _terms_sql(terms) -> str:
    return " + ".join(
        f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)" for t in terms)


def _rules_sql() -> str:
    cases = []
    for rule in sorted(urls.RULES, key=len, reverse=True):
        host, _, tail = rule.partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{tail}') THEN '{rule}'")
    return "CASE " + " ".join(cases) + " END"


_ACTIONS_SQL = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in urls.RULES.items())


@query("op5_urls", rf"""
WITH lower_az AS (SELECT page_id, coalesce(url, '') AS url,
    translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u FROM pages),
rest AS (SELECT page_id, u, CASE WHEN instr(url, '://') > 0 THEN url[instr(url, '://') + 3:] ELSE '' END AS r
         FROM lower_az),
cut AS (SELECT page_id, u, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest),
parts AS (SELECT page_id, u, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(r[length(h) + 1:], '^[^?#]*') AS path FROM cut),
ruled AS (SELECT *, {_rules_sql()} AS rule, {_terms_sql(urls.STRICT)} AS strict_terms,
                 {_terms_sql(urls.SOFT)} AS n_soft FROM parts)
SELECT page_id, host, path, rule, n_soft,
    CASE {_ACTIONS_SQL} WHEN strict_terms > 0 OR n_soft >= {urls.SOFT_NEEDED} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""")
def op5(spark, sf):
    judged = urls.judge_urls(table(spark, sf, "pages"))
    return judged.select("page_id", "host", "path", "rule", "n_soft", "verdict")


@query("op6_bpe")
def op6(spark, sf):
    return bpe.digests(table(spark, sf, "documents"), vocabulary_path())


@query("op7_simhash")
def op7(spark, sf):
    return simhash.digest(simhash.near_duplicates(table(spark, sf, "documents")))


@query("op8_lines")
def op8(spark, sf):
    return lines.digest(lines.dropped_positions(table(spark, sf, "documents")))


@query("op9_chat")
def op9(spark, sf):
    turns = table(spark, sf, "conversations")
    fixed = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
        SCHEMAS["conversations"])
    return chat.digests(turns.unionByName(fixed))


@query("op10_decontaminate", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
runs AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
         FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i
               FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM runs),
placed AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT rid, placed.n, i, item_id FROM placed JOIN runs ON runs.n = placed.n AND runs.g = placed.g),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit
          FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM found) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed
          FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover ON cover.rid = d.rid LEFT JOIN items ON items.rid = d.rid""")
def op10(spark, sf):
    found = decontaminate.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return decontaminate.digest(found)


@query("op11_spelling")
def op11(spark, sf):
    return spelling.variants(table(spark, sf, "documents"))


@query("op12_collocations", r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM t),
p AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM placed, (SELECT unnest([1, 2, 3]) AS k)
      WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
longer AS (SELECT lang, phrase, max(a) AS a FROM
    (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN longer x ON x.lang = c.lang AND x.phrase = c.phrase AND c.k = 2
         WHERE x.a IS NULL OR 100 * x.a < 50 * c.a),
cuts AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:k], ' ') AS y
         FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
scored AS (SELECT cuts.lang, cuts.phrase, a, j, fx.f AS l, fy.f AS r,
    CAST((1000000::HUGEINT * a * a) // (fx.f::HUGEINT * fy.f) AS BIGINT) AS score
  FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT ranked.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""")
def op12(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"))


@query("op13_suffixes")
def op13(spark, sf):
    return suffixes.digest(suffixes.without_repeats(table(spark, sf, "documents")))
