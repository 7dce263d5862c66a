"""Watching a change feed for single keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_feed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The change feed written by a sync stream, as a stream."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def watch_key(feed: DataFrame, key: str, value: str) -> DataFrame:
    """Events of one key with flags for the images they carry."""
    return feed.filter(F.col(key) == value).withColumns(
        {"has_old_image": F.col("before").isNotNull(), "has_new_image": F.col("after").isNotNull()}
    )


def run_until(watched: DataFrame, sink: str, checkpoint: str, seconds: int | None = None) -> None:
    """Writes watched events to ``sink``: all that is there now, or for at most
    ``seconds`` of live feed."""
    writer = watched.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if seconds is None:
        writer.trigger(availableNow=True).start(sink).awaitTermination()
        return
    query = writer.start(sink)
    try:
        query.awaitTermination(seconds)
    finally:
        query.stop()
