"""URL filters: host and path rules, and a weighted vocabulary that an Aho-Corasick automaton counts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# strict terms reject alone, soft terms only together; terms are lower-case letters and digits, parts apart by -
STRICT = ("casino", "porn", "xxx", "viagra", "pills", "escort", "warez", "malware")
SOFT = ("ads", "bets", "bonus", "cheap", "click", "farm", "free", "loan", "promo", "spam", "track", "win")
SOFT_NEEDED = 2  # distinct soft terms
STRICT_WEIGHT, SOFT_WEIGHT = 1.0, 1.0 / SOFT_NEEDED

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, other characters as they are."""
    return F.translate(c, _UPPER, _LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased) and path; both empty for null and where there is no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return lower_ascii(host), path


def rule_of(host: Column, path: Column, rules: Mapping[str, str]) -> Column:
    """The longest rule that fits, or null. A rule ``host/path`` fits its host and all subdomains."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the longest is asked first
        name, _, tail = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{tail}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def term_counter(strict: Sequence[str], soft: Sequence[str]):
    """A function url -> (strict hits, distinct soft terms). A hit has no ASCII letter or digit on either side."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for term in {*strict, *soft}:
        automaton.add_word(term, term)
    if len(automaton):
        automaton.make_automaton()
    hard, mild = set(strict), set(soft) - set(strict)
    inside = set(_LOWER + "0123456789")
    to_lower = str.maketrans(_UPPER, _LOWER)

    def count(url: str | None) -> tuple[int, int]:
        if not url or not len(automaton):
            return 0, 0
        line = url.translate(to_lower)
        n, seen = 0, set()
        for end, term in automaton.iter(line):
            start = end - len(term)
            if (start >= 0 and line[start] in inside) or (end + 1 < len(line) and line[end + 1] in inside):
                continue
            if term in hard:
                n += 1
            if term in mild:
                seen.add(term)
        return n, len(seen)

    return count


def judge_urls(
    pages: DataFrame,
    rules: Mapping[str, str] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    key: str = "page_id",
) -> DataFrame:
    """Per row of pages(key, url): host, path, rule, n_strict, n_soft, score, verdict (``allow`` or ``block``).

    The rule that fits decides; else the vocabulary: one strict hit or ``SOFT_NEEDED`` distinct soft terms block.
    A null url, or one without ``://``, has an empty host and path, so no rule fits; terms are still counted in
    what there is. Repeated rows and null keys give a row each; other columns are not read. No shuffle.
    """

    @F.pandas_udf("n_strict bigint, n_soft bigint")
    def terms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = term_counter(strict, soft)
        for urls in batches:
            yield pd.DataFrame([count(u) for u in urls], columns=["n_strict", "n_soft"], dtype="int64")

    host, path = split_url(F.col("url"))
    judged = pages.select(F.col(key), host.alias("host"), path.alias("path"), terms("url").alias("terms")).select(
        key, "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), "terms.n_strict", "terms.n_soft")
    score = F.col("n_strict") * STRICT_WEIGHT + F.col("n_soft") * SOFT_WEIGHT
    action = F.lit(None).cast("string")
    for rule, what in rules.items():
        action = F.when(F.col("rule") == rule, F.lit(what)).otherwise(action)
    by_terms = F.when((F.col("n_strict") > 0) | (F.col("n_soft") >= SOFT_NEEDED), "block").otherwise("allow")
    return judged.withColumns({"score": score, "verdict": F.coalesce(action, by_terms)})
