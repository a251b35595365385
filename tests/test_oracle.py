"""Every registered query against its SQL, on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from compare import TABLES, compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


BOUND = {k: f for k, f in entry.queries().items() if k not in entry.TEXT_QUERIES}


def test_every_query_has_an_oracle():
    assert set(BOUND) == set(entry.oracle_sql()) - set(entry.TEXT_ORACLES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).columns == ["k", "action"]
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("key", sorted({*BOUND, *entry.TEXT_ORACLES}))
def test_query_equals_sql(spark, con, key):
    _, verdict = compare(spark, con, key, entry.queries()[key], entry.oracle_sql()[key], SF)
    assert verdict == "ok"
