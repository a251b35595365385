"""Session settings and the shared folder for checkpoints and work tables."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "lakekeel", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` adds to them or replaces them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # state of streaming aggregates on disk, so that it may outgrow the memory of an executor
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="lakekeel-")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may go without one: it then gets a folder of its own. A cluster session
    without the setting is an error, since a folder on one machine is lost with that machine.
    """
    sc = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        path = _local_dir()
    return path


def work_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lakekeel/{label}-{uuid.uuid4().hex[:12]}"


_STAGED: list[str] = []


def staged_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder that ``staged_tables`` removes with the others."""
    path = work_path(spark, label)
    _STAGED.append(path)
    return path


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The table stays until ``staged_tables`` around the job ends, or for good without it.
    """
    spark = df.sparkSession
    path = staged_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def staged_tables(spark: SparkSession) -> Iterator[None]:
    """Around a whole job: removes the tables that ``stage`` has written inside, once the results are written."""
    before = len(_STAGED)
    try:
        yield
    finally:
        for path in _STAGED[before:]:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        del _STAGED[before:]
