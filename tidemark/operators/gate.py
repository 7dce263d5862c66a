"""Which feeds are due: the scheduling decision over the source table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_due(next_check: Column | str, as_of: Column | int) -> Column:
    """True when no check is planned or its time has come."""
    next_check = F.col(next_check) if isinstance(next_check, str) else next_check
    as_of = F.lit(as_of) if isinstance(as_of, int) else as_of
    return next_check.isNull() | (as_of >= next_check)


def gate(sources: DataFrame, as_of: Column | int) -> DataFrame:
    """``decision`` (QUEUED or SKIPPED) and ``reason`` for each source."""
    status = F.coalesce(F.col("status"), F.lit("None"))
    reason = F.when(status != "ACTIVE", F.concat(F.lit("status="), status)).when(
        ~is_due("next_check", as_of), F.lit("not_due")
    )
    return sources.withColumn("reason", reason).withColumn(
        "decision", F.when(F.col("reason").isNull(), F.lit("QUEUED")).otherwise(F.lit("SKIPPED"))
    )


def gate_summary(gated: DataFrame) -> DataFrame:
    """Sources found, queued and skipped, in one pass."""
    return gated.agg(
        F.count(F.lit(1)).alias("sources_found"),
        F.count_if(F.col("decision") == "QUEUED").alias("queued_count"),
        F.count_if(F.col("decision") == "SKIPPED").alias("skipped_count"),
    )


def skip_log(gated: DataFrame, as_of: Column | int) -> DataFrame:
    """Log rows that record the sources skipped because they are not due."""
    as_of = F.lit(as_of) if isinstance(as_of, int) else as_of
    return gated.filter(F.col("reason") == "not_due").select(
        "source_id", as_of.cast("bigint").alias("ts"), F.lit("SKIP").alias("kind")
    )


def due_payloads(payloads: DataFrame, gated: DataFrame) -> DataFrame:
    """Landed payloads of queued sources only; with a landing table partitioned
    by ``source_id`` the semi-join prunes partitions at run time."""
    queued = gated.filter(F.col("decision") == "QUEUED").select("source_id")
    return payloads.join(queued, "source_id", "left_semi")
