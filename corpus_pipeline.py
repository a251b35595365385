"""The corpus pipeline: five stages from raw documents to token counts, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a frame. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekeel.llm import bpe, decontaminate, lines, quality, simhash
from lakekeel.llm.queries import table, vocabulary_path
from lakekeel.session import work_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the verdict on their host reject go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; n_chars follows."""
    rest = lines.without_repeats(docs)
    return rest.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.one_per_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of what is left."""
    return bpe.digests(docs, vocabulary_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]
ORACLE_SQL = None  # SimHash, groups and BPE are not SQL; the tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""

    def step(docs: DataFrame, stage) -> DataFrame:
        name, function = stage
        path = work_path(spark, name.replace(" ", "-"))
        out = function(spark, docs, sf_dir)
        out.write.parquet(path)
        return spark.read.schema(out.schema).parquet(path)

    return functools.reduce(step, STAGES, table(spark, sf_dir, "documents"))
