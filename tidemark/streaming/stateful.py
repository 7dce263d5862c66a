"""The sync fold with its state in the streaming state store.

The second form of the streaming fold: the last comparison hash of each key lives in
the state store, and a stored table can hand its state over.  The rows of a
micro-batch are folded among themselves first, by the ordered pass that cuts hot keys
into ranges; the stateful operator then sees one summary row per key and batch: first
and last hash, first sighting, changes in between.  What it knew before the batch is
joined back to the rows, of which only the first one of a key depends on it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.operators.fold import FoldSpec, fold
from tidemark.operators.ordered import HOT_ROWS, null_safe_join

# The processor travels by value, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: State store the operator needs, and the setting that names it.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

_STATE = StructType(
    [StructField("hash", StringType()), StructField("first_seen", LongType()), StructField("changes", LongType())]
)
_SUMMARY = "key string, batch bigint, first_hash string, last_hash string, first_at bigint, changes bigint"
_CARRY = "key string, batch bigint, known boolean, first_changed boolean, first_seen bigint, before bigint"


class LastHash(StatefulProcessor):
    """Keeps the hash, first sighting and change count of one key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", _STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.held.update((row["hash"], int(row["first_seen"]), int(row["changes"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One row per batch that came since the last trigger.
        batches = pd.concat(list(rows), ignore_index=True).sort_values("batch", kind="stable")
        held, out = self.held.get(), []
        for b in batches.itertuples():
            known = held is not None
            changed = known and held[0] != b.first_hash
            first_seen, before = (held[1], held[2] + changed) if known else (int(b.first_at), 0)
            out.append((key[0], int(b.batch), known, bool(changed), first_seen, int(before)))
            held = (b.last_hash, first_seen, int(before + b.changes))
        self.held.update(held)
        yield pd.DataFrame(out, columns=["key", "batch", "known", "first_changed", "first_seen", "before"])

    def close(self) -> None:
        pass


def _spec(hot_rows: int | None) -> FoldSpec:
    return FoldSpec(
        key=["key"], order=["seq"], tracked=["hash"], hash=F.col("hash"), at=F.col("at"), hot_rows=hot_rows, keep=["hash"]
    )


def prefold(batch: DataFrame, batch_id: int, out: str, hot_rows: int | None = HOT_ROWS) -> None:
    """Folds one micro-batch of ``(key, seq, hash, at)`` by itself; writes its rows and one
    summary per key.  A repeated batch rewrites its own folders."""
    spark = batch.sparkSession
    rows = fold(batch, _spec(hot_rows)).select(
        "key", "seq", "hash", "change_type", "change_count", F.col("first_seen").alias("first_at")
    )
    rows.write.mode("overwrite").parquet(f"{out}/rows/v={batch_id}")
    done = spark.read.parquet(f"{out}/rows/v={batch_id}")
    summary = done.groupBy("key").agg(
        F.lit(batch_id).cast("bigint").alias("batch"),
        F.min_by("hash", "seq").alias("first_hash"),
        F.max_by("hash", "seq").alias("last_hash"),
        F.min("first_at").alias("first_at"),
        F.max("change_count").alias("changes"),
    )
    summary.write.mode("overwrite").parquet(f"{out}/summaries/v={batch_id}")


def stateful_fold(
    landed: DataFrame, out: str, checkpoint: str, stored: DataFrame | None = None, hot_rows: int | None = HOT_ROWS
) -> None:
    """Folds a stream of ``(key, seq, hash, at)`` until it is used up; see :func:`verdicts`.

    ``stored`` (key, hash, first_seen, changes) is what the store knows of its keys before the
    first batch of the checkpoint; later runs pass the same table or none.
    """
    spark = landed.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        prefold(batch, batch_id, out, hot_rows)

    folding = landed.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/rows")
    folding.trigger(availableNow=True).start().awaitTermination()
    kind = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        summaries = spark.readStream.schema(_SUMMARY).option("recursiveFileLookup", "true").parquet(f"{out}/summaries")
        carried = summaries.groupBy("key").transformWithStateInPandas(
            statefulProcessor=LastHash(),
            outputStructType=_CARRY,
            outputMode="Append",
            timeMode="None",
            initialState=None if stored is None else stored.select("key", "hash", "first_seen", "changes").groupBy("key"),
        )
        keeping = carried.writeStream.format("parquet").option("checkpointLocation", f"{checkpoint}/state")
        keeping.trigger(availableNow=True).start(f"{out}/carries").awaitTermination()
    finally:
        spark.conf.set(PROVIDER, kind)


def verdicts(spark: SparkSession, out: str) -> DataFrame:
    """``(key, seq, change_type, first_seen, change_count)`` of every folded row."""
    rows = spark.read.parquet(f"{out}/rows").withColumnRenamed("v", "batch")
    rows = rows.withColumn("batch", F.col("batch").cast("bigint"))
    carries = spark.read.schema(_CARRY).parquet(f"{out}/carries")
    joined = null_safe_join(rows, carries, ["key", "batch"])
    opening = F.when(~F.col("known"), "NEW").when(F.col("first_changed"), "CHANGED").otherwise("UNCHANGED")
    return joined.select(
        "key",
        "seq",
        F.when(F.col("change_type") == "NEW", opening).otherwise(F.col("change_type")).alias("change_type"),
        "first_seen",
        (F.col("before") + F.col("change_count")).alias("change_count"),
    )


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(key, hash, first_seen, changes)`` as the state store holds it now."""
    kind = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        state = spark.read.format("statestore").option("stateVarName", "held").load(f"{checkpoint}/state")
        return state.select(F.col("key.key").alias("key"), "value.hash", "value.first_seen", "value.changes")
    finally:
        spark.conf.set(PROVIDER, kind)
