"""Counts, shares and reports over postings, verdicts and source state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.identity import KEY
from tidemark.functions.values import first_declared, hit_rate, to_int
from tidemark.operators.fold import TYPES, with_cache_figures
from tidemark.operators.ordered import HOT_ROWS, row_numbers

#: Metric name -> unit of the run metrics a crawl emits.
RUN_METRICS = {
    "JobsFetched": "Count",
    "JobsNew": "Count",
    "JobsChanged": "Count",
    "CacheHits": "Count",
    "CacheMisses": "Count",
    "RedundantUpdatesPrevented": "Count",
    "CrawlDurationSeconds": "Seconds",
    "CrawlSuccesses": "Count",
    "CrawlFailures": "Count",
}

#: Operations metric -> the column names it may be stored under.
OPS_METRICS = {
    "fetch_attempts": ("fetch_attempt_count", "fetch_attempts"),
    "successful_crawls": ("successful_crawl_count", "successful_crawls"),
    "failed_crawls": ("failed_crawl_count", "failed_crawls"),
    "new": ("new_count", "new"),
    "unchanged": ("unchanged_count", "unchanged"),
    "changed": ("changed_count", "changed"),
    "cache_hits": ("cache_hit_count", "cache_hits"),
    "cache_misses": ("cache_miss_count", "cache_misses"),
    "redundant_updates_prevented": ("redundant_updates_prevented",),
    "controller_skips": ("skip_count", "controller_skips"),
    "jobs_processed": ("total_jobs_processed", "jobs_processed"),
}


# --------------------------------------------------------- sync run figures


def sync_rollup(verdicts: DataFrame, source: str = "source") -> DataFrame:
    """Counts per (source, type), per source and overall; ``ALL`` marks totals."""
    rolled = verdicts.rollup(source, "change_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.grouping(source).alias("__all_sources"),
        F.grouping("change_type").alias("__all_types"),
    )
    return rolled.select(
        F.when(F.col("__all_sources") == 1, F.lit("ALL")).otherwise(F.col(source)).alias("source"),
        F.when(F.col("__all_types") == 1, F.lit("ALL")).otherwise(F.col("change_type")).alias("change_type"),
        "n",
    )


def run_metrics(verdicts: DataFrame, by: Sequence[str], duration: Column | None = None) -> DataFrame:
    """One row per run and metric: known names only, counts as whole numbers."""
    counts = with_cache_figures(
        verdicts.groupBy(*by).agg(
            *[F.count_if(F.col("change_type") == t).alias(f"n_{t.lower()}") for t in TYPES],
            (duration if duration is not None else F.lit(None).cast("double")).alias("duration"),
        )
    )
    values = {
        "JobsFetched": F.col("jobs_processed"),
        "JobsNew": F.col("n_new"),
        "JobsChanged": F.col("n_changed"),
        "CacheHits": F.col("cache_hits"),
        "CacheMisses": F.col("cache_misses"),
        "RedundantUpdatesPrevented": F.col("redundant_updates_prevented"),
        "CrawlDurationSeconds": F.round("duration", 3),
        "CrawlSuccesses": F.lit(1),
    }
    return metric_rows(counts, by, values)


def failure_metrics(log: DataFrame, by: Sequence[str] = ("source_id",)) -> DataFrame:
    """One row per source with failed crawls in a log."""
    failed = log.filter("kind = 'FAILURE'").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return metric_rows(failed, by, {"CrawlFailures": F.col("n")})


def metric_rows(df: DataFrame, by: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Long form ``(metric, unit, value)``; unknown names and nulls are dropped."""
    known = [
        F.struct(
            F.lit(name).alias("metric"),
            F.lit(RUN_METRICS[name]).alias("unit"),
            (F.floor(c) if RUN_METRICS[name] == "Count" else c).cast("double").alias("value"),
        )
        for name, c in values.items()
        if name in RUN_METRICS
    ]
    rows = df.select(*by, F.inline(F.array(*known)))
    return rows.filter(F.col("value").isNotNull())


# ------------------------------------------------------------ source figures


def ops_metrics(sources: DataFrame) -> DataFrame:
    """Per-source metrics; each falls back to an older column name, else 0."""
    have = sources.columns
    names = [F.nullif(F.col(c), F.lit("")) for c in ("name", "source_name") if c in have]
    shown = F.coalesce(*names, F.nullif(F.col("source_id"), F.lit("")), F.lit("Unknown"))
    status = F.nullif(first_declared(have, "status").cast("string"), F.lit(""))
    return sources.select(
        "source_id",
        shown.alias("source_name"),
        F.coalesce(status, F.lit("UNKNOWN")).alias("status"),
        *[
            to_int(first_declared(have, *stored, default=0)).alias(metric)
            for metric, stored in OPS_METRICS.items()
        ],
    )


def ops_totals(metrics: DataFrame) -> DataFrame:
    """Sums over all sources, their number and the cache hit rate."""
    sums = metrics.agg(
        F.count(F.lit(1)).alias("sources"),
        *[F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(m) for m in OPS_METRICS],
    )
    return sums.withColumn("hit_rate", hit_rate("cache_hits", "cache_misses"))


def public_sources(sources: DataFrame) -> DataFrame:
    """Registry rows as shown to administrators: defaults, whole numbers, and only
    selected parts of the configuration."""
    have = sources.columns
    out = [
        F.col("source_id"),
        F.coalesce(F.nullif(first_declared(have, "source_name").cast("string"), F.lit("")), F.col("source_id")).alias("source_name"),
        F.coalesce(first_declared(have, "source_type").cast("string"), F.lit("BUILTIN")).alias("source_type"),
        F.coalesce(first_declared(have, "status").cast("string"), F.lit("UNKNOWN")).alias("status"),
        to_int(F.coalesce(first_declared(have, "crawl_interval").cast("string"), F.lit("3600"))).alias("crawl_interval"),
        to_int(first_declared(have, "successful_crawl_count", default=0)).alias("successful_crawl_count"),
        to_int(first_declared(have, "failed_crawl_count", default=0)).alias("failed_crawl_count"),
        first_declared(have, "last_checked").cast("bigint").alias("last_checked"),
        first_declared(have, "next_check").cast("bigint").alias("next_check"),
    ]
    if "api_config" in have:
        config = F.col("api_config")
        shown = config.isNotNull()
        out += [
            F.when(shown, F.coalesce(config["endpoint"], F.lit(""))).alias("endpoint"),
            F.when(shown, F.coalesce(config["records_path"], F.lit("jobs"))).alias("records_path"),
            F.when(shown, F.coalesce(config["pagination"]["type"], F.lit("NONE"))).alias("pagination_type"),
        ]
    return sources.select(*out).orderBy("source_id")


# ----------------------------------------------------------- posting figures


def source_distribution(jobs: DataFrame) -> DataFrame:
    """Rows per source (missing counts as UNKNOWN) with the total, by name."""
    counts = jobs.groupBy(F.coalesce("source", F.lit("UNKNOWN")).alias("source")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0)))).orderBy("source")


def source_share(jobs: DataFrame) -> DataFrame:
    """Count and share of each named source, largest first, ties by name."""
    named = jobs.filter(F.coalesce(F.col("source"), F.lit("")) != "")
    counts = named.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    # One row per source reaches this window.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    shares = counts.withColumn("share", F.round(100.0 * F.col("n") / total, 1))
    return shares.orderBy(F.desc("n"), "source")


def distinct_sources(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.coalesce(F.col("source"), F.lit("")) != "").select("source").distinct()


def source_report(jobs: DataFrame, source: str | None = None) -> DataFrame:
    """Per source and status: rows; per source: rows and distinct feed ids.

    A missing feed id counts as one more distinct value.  Feed ids are counted
    from distinct (source, id) pairs, so a large source never sits in one task.
    """
    mine = jobs if source is None else jobs.filter(F.col("source") == source)
    by_id = mine.groupBy(
        "source", F.coalesce("status", F.lit("UNKNOWN")).alias("status"), "source_id"
    ).agg(F.count(F.lit(1)).alias("n"))
    ids = by_id.select("source", "source_id").distinct().groupBy("source").agg(
        F.count(F.lit(1)).alias("distinct_ids")
    )
    per_status = by_id.groupBy("source", "status").agg(F.sum("n").alias("n"))
    totals = per_status.withColumn("records", F.sum("n").over(Window.partitionBy("source")))
    return totals.join(ids, "source").select("source", "status", "n", "records", "distinct_ids")


def first_seen_listing(jobs: DataFrame, source: str | None = None) -> DataFrame:
    """Records by the text of ``first_seen``, missing first."""
    mine = jobs if source is None else jobs.filter(F.col("source") == source)
    listed = mine.select("first_seen", KEY, "source_id", "company", "title", "status")
    return listed.orderBy(F.coalesce(F.col("first_seen").cast("string"), F.lit("")), KEY)


def numbered_listing(
    verdicts: DataFrame, order: Sequence[str], source: str = "source", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Run listing with ``001.`` and ``[i/n]`` labels per source."""
    rows = row_numbers(verdicts, order, [source], hot_rows=hot_rows, total="n_rows")
    label = F.format_string("%03d.", F.col("row_no"))
    part = F.format_string("[%d/%d]", F.col("row_no"), F.col("n_rows"))
    return rows.withColumns({"label": label, "progress": part})


def cross_source_duplicates(jobs: DataFrame, key: str = KEY) -> DataFrame:
    """Keys that several rows share: rows, feeds and the sorted feed names.

    Counted per (key, source) first, so only one row per pair reaches a group.
    """
    pairs = jobs.groupBy(key, "source").agg(F.count(F.lit(1)).alias("n"))
    groups = pairs.groupBy(key).agg(
        F.sum("n").alias("n_rows"),
        F.count("source").alias("n_sources"),
        F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"),
    )
    return groups.filter(F.col("n_rows") > 1)
