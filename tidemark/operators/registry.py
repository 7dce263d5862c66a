"""Administrator commands over the table of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import slug
from tidemark.operators.ordered import HOT_ROWS, last_before

#: What an accepted or refused command answers.
CREATED, ACCEPTED, OK = 201, 202, 200
BAD_REQUEST, FORBIDDEN, NOT_FOUND, CONFLICT = 400, 403, 404, 409


def new_source_id(name: str = "source_name", command: str = "command_id"):
    """``custom-<slug>-<8 hex>``; the suffix depends on the command only."""
    suffix = F.substring(F.sha2(F.col(command).cast("string"), 256), 1, 8)
    return F.concat(F.lit("custom-"), slug(name), F.lit("-"), suffix)


def apply_commands(
    commands: DataFrame, registry: DataFrame, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Commands with ``outcome`` and the source row's ``status`` and ``next_check`` after them.

    A command row is ``(command_id, seq, ts, op, source_id, source_name, status,
    violations)``; ``op`` is CREATE, SET_STATUS or SYNC and ``violations`` are
    those of the submitted configuration (see ``quality.config_lint``).  Commands
    see the effect of earlier ones: a SYNC is refused after a DISABLE, and a CREATE
    that is delivered again.  ``api_config`` and ``crawl_interval`` are kept if given.
    """
    created = F.col("op") == "CREATE"
    target = F.when(created, new_source_id()).otherwise(F.nullif(F.col("source_id"), F.lit("")))
    known = registry.select(
        F.col("source_id").alias("target_id"),
        F.upper(F.coalesce("source_type", F.lit("BUILTIN"))).alias("__type"),
        F.col("status").alias("__status"),
        F.lit(True).alias("__stored"),
    )
    wanted = F.upper(F.coalesce(F.col("status"), F.lit("")))
    every = commands.withColumn("target_id", target).withColumn("wanted", wanted)
    # Commands without a target are refused as they are: they share no history.
    keyless = every.filter("target_id is null")
    rows = every.filter("target_id is not null").join(known, "target_id", "left")
    valid = created & (F.size("violations") == 0)
    # A source made by an earlier CREATE is a custom one and exists from then on.
    rows = last_before(
        rows, ["target_id"], ["seq"], F.when(valid, F.lit(True)), "__made", hot_rows=hot_rows
    )
    exists = F.coalesce(F.col("__stored"), F.col("__made"), F.lit(False))
    custom = F.coalesce(F.col("__made"), F.col("__type") == "CUSTOM_API", F.lit(False))
    toggled = (
        (F.col("op") == "SET_STATUS")
        & F.col("target_id").isNotNull()
        & F.col("wanted").isin("ACTIVE", "DISABLED")
        & exists
        & custom
    )
    set_to = F.when(toggled, F.col("wanted")).when(valid & ~exists, F.lit("ACTIVE"))
    rows = rows.withColumns({"__exists": exists, "__custom": custom, "__set_to": set_to})
    rows = last_before(rows, ["target_id"], ["seq"], F.col("__set_to"), "__before", hot_rows=hot_rows)
    current = F.coalesce("__before", "__status")
    outcome = (
        F.when(
            created,
            F.when(F.size("violations") > 0, F.lit(BAD_REQUEST))
            .when(F.col("__exists"), F.lit(CONFLICT))
            .otherwise(F.lit(CREATED)),
        )
        .when(
            F.col("op") == "SET_STATUS",
            F.when(~F.col("wanted").isin("ACTIVE", "DISABLED"), F.lit(BAD_REQUEST))
            .when(~F.col("__exists"), F.lit(NOT_FOUND))
            .when(~F.col("__custom"), F.lit(FORBIDDEN))
            .otherwise(F.lit(OK)),
        )
        .when(
            F.col("op") == "SYNC",
            F.when(~F.col("__exists"), F.lit(NOT_FOUND))
            .when(~current.eqNullSafe(F.lit("ACTIVE")), F.lit(CONFLICT))
            .otherwise(F.lit(ACCEPTED)),
        )
        .otherwise(F.lit(BAD_REQUEST))
    )
    status_after = F.coalesce("__set_to", "__before", "__status")
    next_check = F.when(F.col("__set_to") == "ACTIVE", F.col("ts")).when(
        F.col("__set_to") == "DISABLED", F.lit(0)
    )
    kept = [c for c in ("api_config", "crawl_interval") if c in commands.columns]
    first = ["command_id", "seq", "ts", "op", F.col("target_id").alias("source_id"), "source_name"]
    decided = rows.select(
        *first,
        outcome.alias("outcome"),
        status_after.alias("status"),
        next_check.cast("bigint").alias("next_check"),
        *kept,
    )
    refused = keyless.select(
        *first,
        F.lit(BAD_REQUEST).alias("outcome"),
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("bigint").alias("next_check"),
        *kept,
    )
    return decided.unionByName(refused)


def created_sources(applied: DataFrame) -> DataFrame:
    """Registry rows of accepted CREATE commands with their configuration: due at once,
    no failures yet."""
    kept = [c for c in ("api_config", "crawl_interval") if c in applied.columns]
    made = applied.filter((F.col("op") == "CREATE") & (F.col("outcome") == CREATED))
    return made.select(
        "source_id",
        F.trim("source_name").alias("source_name"),
        F.lit("CUSTOM_API").alias("source_type"),
        F.lit("ACTIVE").alias("status"),
        F.col("ts").alias("created_at"),
        F.lit(0).cast("bigint").alias("last_checked"),
        F.col("ts").alias("next_check"),
        F.lit(0).cast("bigint").alias("failure_count"),
        F.lit(1).alias("config_version"),
        *kept,
    )


def toggle_log(applied: DataFrame) -> DataFrame:
    """Crawl-log rows of accepted status changes."""
    accepted = applied.filter((F.col("op") == "SET_STATUS") & (F.col("outcome") == OK))
    kind = F.when(F.col("status") == "ACTIVE", F.lit("ENABLE")).otherwise(F.lit("DISABLE"))
    return accepted.select("source_id", "seq", "ts", kind.alias("kind"))


def insert_absent(registry: DataFrame, rows: DataFrame, key: str = "source_id") -> DataFrame:
    """``registry`` plus the rows whose key it does not hold yet, one row per key."""
    new = rows.join(registry.select(key), key, "left_anti").dropDuplicates([key])
    return registry.unionByName(new, allowMissingColumns=True)
