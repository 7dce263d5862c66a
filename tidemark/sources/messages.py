"""Crawl request messages: building, parsing, checking against the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crawl_requests(
    sources: DataFrame,
    as_of: Column | int,
    reason: str = "SCHEDULED_SYNC",
    requested_by: str | None = None,
) -> DataFrame:
    """One JSON message per source."""
    as_of = F.lit(as_of) if isinstance(as_of, int) else as_of
    fields = [
        F.col("source_id"),
        F.lit(reason).alias("reason"),
        as_of.cast("bigint").alias("requested_at"),
    ]
    if requested_by is not None:
        fields.append(F.lit(requested_by).alias("requested_by"))
    return sources.select("source_id", F.to_json(F.struct(*fields)).alias("body"))


def parse_requests(messages: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``source_id`` and ``reject`` (null for a good message)."""
    v = F.try_parse_json(F.coalesce(F.col(body), F.lit("")))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    source = F.nullif(F.try_variant_get(v, "$.source_id", "string"), F.lit(""))
    reject = F.when(v.isNull(), F.lit("malformed")).when(~is_object, F.lit("not_an_object")).when(
        source.isNull(), F.lit("no_source_id")
    )
    return messages.withColumns({"source_id": F.when(is_object, source), "reject": reject})


def check_requests(parsed: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``outcome``: OK, or why the request cannot be served.

    Rejected messages name no source and take no part in the join.
    """
    known = sources.select("source_id", F.col("status").alias("__status"), F.lit(True).alias("__known"))
    joined = parsed.filter("reject is null").join(known, "source_id", "left")
    outcome = (
        F.when(F.col("__known").isNull(), F.lit("source_not_found"))
        .when(~F.col("__status").eqNullSafe(F.lit("ACTIVE")), F.lit("source_not_active"))
        .otherwise(F.lit("OK"))
    )
    served = joined.withColumn("outcome", outcome).select(*parsed.columns, "outcome")
    return served.unionByName(parsed.filter("reject is not null").withColumn("outcome", F.col("reject")))


def failures(checked: DataFrame, ts: Column) -> DataFrame:
    """FAILURE log rows of requests for registered sources that failed.

    A request that names no registered source leaves no trace in the log.
    """
    bad = checked.filter((F.col("outcome") == "source_not_active") & F.col("source_id").isNotNull())
    return bad.select("source_id", ts.cast("bigint").alias("ts"), F.lit("FAILURE").alias("kind"))
