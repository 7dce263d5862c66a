"""Crawl requests as a stream: each delivery of a message is routed once.

The queue delivers a message with the number of earlier ``attempts`` and offers it
again while it is pending.  A delivery is done, pending or, after ``MAX_RECEIVES``
failed ones, dead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.messages import check_requests, parse_requests

MAX_RECEIVES = 3


def routed(messages: DataFrame, sources: DataFrame, most: int = MAX_RECEIVES) -> DataFrame:
    """``(message_id, body, attempts)`` checked, with this attempt counted and its ``route``."""
    checked = check_requests(parse_requests(messages), sources)
    checked = checked.withColumn("attempts", F.coalesce("attempts", F.lit(0)).cast("bigint") + 1)
    route = (
        F.when(F.col("outcome") == "OK", F.lit("done"))
        .when(F.col("attempts") >= most, F.lit("dead"))
        .otherwise(F.lit("pending"))
    )
    return checked.withColumn("route", route)


def request_stream(messages: DataFrame, sources: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Routes a stream of messages into ``out``, partitioned by route, until it is used up.

    A micro-batch owns one folder, which is rewritten when the batch is repeated.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = routed(batch, sources)
        rows.write.mode("overwrite").partitionBy("route").parquet(f"{out}/v={batch_id}")

    return (
        messages.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
