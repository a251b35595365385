"""Keep a target at the newest version of every key while changes stream in."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lakekeel.plans.skew import as_list
from lakekeel.session import ROCKSDB

STORE = "spark.sql.streaming.stateStore.providerClass"
BATCH, BASE, KIND = "batch_id", "upto", "kind"
ROW, COUNT = "row", "count"  # kinds of what a batch writes: whole rows, or counts of keys that are up to date
CHANGES = "n_changes"


def _newest_of_batch(keys: Sequence[str], order: Sequence[str]):
    """In every Arrow batch one row per key, the newest, with the number of its rows: what a busy key costs later."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            by = [(c, "ascending") for c in (*keys, *order)]
            rows = rows.take(pc.sort_indices(rows, sort_keys=by, null_placement="at_start")).combine_chunks()
            last = np.zeros(len(rows), bool)
            last[-1] = True
            for k in keys:
                c = rows.column(k)
                a, b = c.slice(1), c.slice(0, len(c) - 1)
                other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
                last[:-1] |= other.to_numpy(zero_copy_only=False)
            at = np.flatnonzero(last)
            kept = rows.take(pa.array(at)).append_column(CHANGES, pa.array(np.diff(at, prepend=-1)))
            yield from kept.to_batches()

    return run


class NewestRow(StatefulProcessor):
    """Holds, per key, the order and head of the newest row so far and the number of changes; hands on newer rows."""

    def __init__(self, keys: Sequence[str], rest: Sequence[str], order: Sequence[str], head: str | None, state: T.StructType):
        self.keys, self.rest, self.order, self.head, self.state = keys, rest, order, head, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("newest", self.state)

    def _place(self, row) -> tuple:
        return tuple((row[c] is not None, row[c]) for c in self.order)  # null is before all values

    def handleInputRows(self, key, rows, timerValues):
        newest, n = None, 0
        for r in rows:
            n += r[CHANGES]
            if newest is None or self._place(r) > self._place(newest):
                newest = r
        was = self.held.get() if self.held.exists() else None
        n += was[-1] if was is not None else 0
        order = [newest[c] for c in self.order]
        write = was is None or self._place(newest) >= self._place(dict(zip(self.order, was)))
        if not write:
            order = list(was[:len(self.order)])
        elif was is not None and self.head is not None:
            write = newest[self.head] != was[len(self.order)]
        head = [] if self.head is None else [newest[self.head] if write or was is None else was[len(self.order)]]
        self.held.update((*order, *head, n))
        out = {c: newest[c] if write else None for c in self.rest}
        yield Row(**dict(zip(self.keys, key)), **out, **{CHANGES: n, KIND: ROW if write else COUNT})

    def close(self) -> None:
        pass


def sync_stream(
    stream: DataFrame,
    target_path: str,
    key: str | Sequence[str],
    ord: str | Sequence[str],
    checkpoint: str,
    head: str | None = None,
    compact_every: int = 50,
    available_now: bool = True,
) -> StreamingQuery:
    """Write, per micro-batch, the newest row of every key that changed in it.

    The order and head of the newest row of every key are the state of the stream; changes are combined per Arrow
    batch before they go to their key, so a busy key is no hot spot. A row that is older than what the target has is
    not written; on equal order the streamed row wins. With ``head``, the column that tells versions apart, a row
    whose head is that of the newest row so far is up to date and is not written again; only the number of
    changes of its key is. No batch reads the target. A batch owns the folder of its number and overwrites it when it is
    run again, which makes retries harmless.

    Every ``compact_every`` batches the current rows are written as a new base. From then on readers read that
    base and the batches after it.
    """
    keys, order = as_list(key), as_list(ord)
    rest = [c for c in stream.columns if c not in keys]
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    state = T.StructType([T.StructField(f"o{i}", kinds[c]) for i, c in enumerate(order)]
                         + ([] if head is None else [T.StructField("head", kinds[head])]) + [T.StructField("n", T.LongType())])
    slim = T.StructType([*stream.schema.fields, T.StructField(CHANGES, T.LongType())])
    schema = target_schema(stream, keys)
    result = T.StructType([*[f for f in schema.fields if f.name not in (BATCH, KIND)], T.StructField(KIND, T.StringType())])
    newest = stream.mapInArrow(_newest_of_batch(keys, order), slim).groupBy(*keys).transformWithState(
        NewestRow(keys, rest, order, head, state), outputStructType=result, outputMode="Update", timeMode="None")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(KIND).parquet(f"{target_path}/{BATCH}={batch_id}")
        if compact_every and batch_id % compact_every == compact_every - 1:
            compact(batch.sparkSession, target_path, schema, keys, batch_id)

    writer = newest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    # only this store holds such a state; the query keeps the settings it starts with, and the session gets its own back
    spark = stream.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.set(STORE, before)


def target_schema(stream: DataFrame, key: str | Sequence[str]) -> T.StructType:
    keys = as_list(key)
    fields = [stream.schema[k] for k in keys] + [f for f in stream.schema.fields if f.name not in keys]
    return T.StructType([*fields, T.StructField(CHANGES, T.LongType()), T.StructField(BATCH, T.LongType()), T.StructField(KIND, T.StringType())])


def _bases(spark: SparkSession, target_path: str) -> list[int]:
    """Numbers of the batches up to which there is a complete base, in order."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
            "pathGlobFilter", "_SUCCESS").load(f"{target_path}-{BASE}=*").select("path").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(int(re.search(rf"-{BASE}=(\d+)/", r[0])[1]) for r in files)


def current_rows(
    spark: SparkSession, target_path: str, schema: T.StructType, key: str | Sequence[str], before: int | None = None
) -> DataFrame:
    """The target as of now, or before a batch: the row of the last batch that wrote the key, and its changes so far."""
    log = spark.read.schema(schema).option("basePath", target_path).parquet(target_path)
    if before is not None:
        log = log.filter(F.col(BATCH) < before)
    bases = [b for b in _bases(spark, target_path) if before is None or b < before]
    if bases:
        plain = T.StructType([f for f in schema.fields if f.name not in (BATCH, KIND)])
        kept = spark.read.schema(plain).parquet(f"{target_path}-{BASE}={bases[-1]}")
        kept = kept.withColumns({BATCH: F.lit(bases[-1]).cast("bigint"), KIND: F.lit(ROW)})
        log = log.filter(F.col(BATCH) > bases[-1]).unionByName(kept)
    keys = as_list(key)
    rest = [f.name for f in schema.fields if f.name not in (*keys, CHANGES, BATCH, KIND)]
    found = log.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.when(F.col(KIND) == ROW, F.col(BATCH))).alias("__row"), F.max(CHANGES).alias(CHANGES))
    return found.select(*keys, "__row.*", CHANGES)


def compact(spark: SparkSession, target_path: str, schema: T.StructType, key: str | Sequence[str], upto: int) -> None:
    """Write the rows as of a batch as a base; the batches up to it are not read any more."""
    rows = current_rows(spark, target_path, schema, key, before=upto + 1)
    rows.write.mode("overwrite").parquet(f"{target_path}-{BASE}={upto}")
