"""Readers: tagged JSON files, saved listing pages, named text files, one source per group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekeel.functions.text import is_guid
from lakekeel.plans.skew import as_list, first_per_key
from lakekeel.session import stage


def _existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    found = []
    for p in paths:
        try:
            spark.read.format("binaryFile").load(p)
            found.append(p)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def scan_tagged_json(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType | str,
    tag_regex: str,
    tag: str = "env",
    multi_line: bool = True,
    **options,
) -> DataFrame:
    """Read JSON files and tag each row with a part of its file path.

    Missing files give no rows. Comments are allowed and, as the schema is explicit, the last one of
    repeated object keys counts. ``multi_line=False`` keeps large JSON-lines files splittable.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    found = _existing(spark, as_list(paths))
    if not found:
        return spark.createDataFrame([], schema.add(tag, T.StringType()))
    df = (
        spark.read.schema(schema)
        .options(multiLine=multi_line, allowComments=True, **options)
        .json(found)
    )
    return df.select("*", F.regexp_extract("_metadata.file_path", tag_regex, 1).alias(tag))


def explode_pages(
    pages: DataFrame, array_col: str, keep: Sequence[str] = (), guid_col: str | None = None
) -> DataFrame:
    """All items of all pages, with their place in the page. Rows whose ``guid_col`` is no GUID give nothing."""
    if guid_col:
        pages = pages.filter(is_guid(guid_col))
    item = pages.select(*keep, F.posexplode(array_col).alias("pos", "__item"))
    return item.select(*keep, "pos", "__item.*")


def ordered_pages(
    pages: DataFrame, source: str | Sequence[str], token: str, next_token: str
) -> tuple[DataFrame, DataFrame]:
    """Pages saved in any order, with their ``page_no`` in the order of their continuation; and those out of reach.

    The first page of a source has no ``token``; every other page has the one that the page before it names as
    ``next_token``. Pages behind a missing one or in a circle are out of reach, and so are those from a token on that
    two pages have or two pages name, or from a second first page on. Steps towards the first page double in each
    round, so a chain of n pages takes log n rounds of joins, each written to the shared folder.
    """
    keys = as_list(source)
    own = F.coalesce(F.col(token), F.lit("")).alias("at")

    def at(column: str) -> Column:
        """Whether the other side is the page whose token ``column`` has."""
        return reduce(lambda x, y: x & y, [F.col(column) == F.col("__at"), *[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]])

    def named(df: DataFrame, *more: Column) -> DataFrame:
        return df.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("at").alias("__at"), *more)

    links = stage(pages.select(*keys, own, F.col(next_token).alias("to")), "pages")
    single = links.groupBy(*keys, "at").agg(F.count("*").alias("n")).filter("n = 1").drop("n")
    before = links.filter("to <> ''").groupBy(*keys, F.col("to").alias("at0")).agg(
        F.min("at").alias("back"), F.count("*").alias("n")).filter("n = 1").select(*keys, F.col("at0").alias("at"), "back")
    back = named(before, F.col("back").alias("back"))
    # (source, at, back, n): n steps lead from a page back to another; the first page has the token "" and stays
    first = F.col("at") == ""
    now = stage(single.join(back, at("at"), "left").select(
        *keys, "at", F.when(first, "").otherwise(F.col("back")).alias("back"),
        F.when(first, 0).otherwise(1).cast("bigint").alias("n")).filter("back is not null"), "steps")
    for _ in range(links.count().bit_length()):  # after that many rounds only circles are left
        if now.filter("back <> ''").isEmpty():
            break
        ahead = named(now, F.col("back").alias("__back"), F.col("n").alias("__n"))
        now = stage(now.join(ahead, at("back")).select(
            *keys, "at", F.col("__back").alias("back"), (F.col("n") + F.col("__n")).alias("n")), "steps")
    there = named(now.filter("back = ''"), F.col("n").alias("page_no"))
    marked = pages.withColumn("at", own)
    reached = marked.join(there, at("at"), "left").select(*pages.columns, "page_no")
    return reached.filter("page_no is not null"), reached.filter("page_no is null").drop("page_no")


def named_text(df: DataFrame, path: Column | str, text: str, names: Sequence[str]) -> DataFrame:
    """Keep the rows whose last path segment is one of ``names``, whatever the case."""
    path = F.col(path) if isinstance(path, str) else path
    name = F.substring_index(path, "/", -1)
    wanted = [n.lower() for n in names]
    return df.select(path.alias("path"), name.alias("name"), F.col(text).alias("text")).filter(
        F.lower("name").isin(wanted)
    )


def scan_named_text(spark: SparkSession, root: str, names: Sequence[str], name_regex: str = r"([^/]*)$") -> DataFrame:
    """Whole text of the files below ``root`` with one of these names, whatever the case.

    The name is the first group of ``name_regex`` in the path: the file name, unless a folder carries it.
    """
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    rows = files.select(path.alias("path"), F.regexp_extract(path, name_regex, 1).alias("name"), F.col("value").alias("text"))
    return rows.filter(F.lower("name").isin([n.lower() for n in names]))


def pick_source_by_priority(
    df: DataFrame, group: str | Sequence[str], candidate: str, priorities: Sequence[str], ord: str
) -> DataFrame:
    """Per group the row whose candidate comes first in ``priorities``; groups without one disappear."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priorities]), F.col(candidate))
    listed = df.filter(F.col(candidate).isin(list(priorities)))
    return first_per_key(listed, group, [rank, F.col(ord)])
