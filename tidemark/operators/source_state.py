"""Per-feed crawl state as a rollup of an append-only crawl log.

A log row is ``(source_id, ts, seq, kind, n_new, n_changed, n_unchanged,
n_fetched, duration)``; ``kind`` is START, SUCCESS, FAILURE, SKIP, ENABLE or
DISABLE and ``(ts, seq)`` orders the rows of a source.

The state is shown from one summary row per source.  Summaries are associative:
sums, the latest row of each kind, and the failures behind the last success.
:func:`advance` keeps them in a state table and adds new log rows only, so a tick
costs what the tick logged.  Rows may come late: a late success that falls among
failures already counted makes the failures of that one source be counted anew
from the log; every other late row merges like a new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import null_safe_join
from tidemark.session import written
from tidemark.sources.snapshots import StateTable

#: Consecutive failures after which a source is in ERROR.
FAILURES_TO_ERROR = 3
#: Seconds between crawls when the registry names none.
DEFAULT_INTERVAL = 3600

COUNTERS = (
    "fetch_attempt_count",
    "successful_crawl_count",
    "failed_crawl_count",
    "skip_count",
    "total_jobs_processed",
    "new_count",
    "unchanged_count",
    "changed_count",
    "cache_hit_count",
    "cache_miss_count",
    "redundant_updates_prevented",
    "change_count",
)


def _is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def counter_columns() -> list[Column]:
    """The running counters as mergeable sums (also fit for a streaming update)."""
    ok = _is("SUCCESS")

    def total(value: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(ok, value)), F.lit(0)).cast("bigint").alias(name)

    new, changed, same = F.col("n_new"), F.col("n_changed"), F.col("n_unchanged")
    return [
        F.count_if(_is("START")).alias("fetch_attempt_count"),
        F.count_if(ok).alias("successful_crawl_count"),
        F.count_if(_is("FAILURE")).alias("failed_crawl_count"),
        F.count_if(_is("SKIP")).alias("skip_count"),
        total(new + changed + same, "total_jobs_processed"),
        total(new, "new_count"),
        total(same, "unchanged_count"),
        total(changed, "changed_count"),
        total(same, "cache_hit_count"),
        total(new + changed, "cache_miss_count"),
        total(same, "redundant_updates_prevented"),
        F.count_if(ok & (new + changed > 0)).alias("change_count"),
    ]


def run_log(
    gated: DataFrame, verdicts: DataFrame, rejects: DataFrame, as_of: Column | int, source: str = "source"
) -> DataFrame:
    """Crawl-log rows of one scheduled run.

    Every queued source starts and then succeeds with its counts, or fails where
    pages were rejected and so nothing was mapped (``feeds.union_feeds`` maps complete
    runs only); sources that are not due are skipped.
    """
    as_of = (F.lit(as_of) if isinstance(as_of, int) else as_of).cast("bigint")
    types = {"n_new": "NEW", "n_changed": "CHANGED", "n_unchanged": "UNCHANGED"}
    counts = verdicts.groupBy(F.col(source).alias("source_id")).agg(
        *[F.count_if(F.col("change_type") == t).alias(c) for c, t in types.items()],
        F.count(F.lit(1)).alias("n_fetched"),
    )
    broken = rejects.select("source_id").distinct().withColumn("__broken", F.lit(True))
    queued = gated.filter("decision = 'QUEUED'").select("source_id")
    ended = queued.join(counts, "source_id", "left").join(broken, "source_id", "left")
    failed = F.col("__broken").isNotNull() & F.col("n_fetched").isNull()
    numbers = [*types, "n_fetched"]
    end = ended.select(
        "source_id",
        F.lit(1).cast("bigint").alias("seq"),
        F.when(failed, F.lit("FAILURE")).otherwise(F.lit("SUCCESS")).alias("kind"),
        *[F.when(~failed, F.coalesce(c, F.lit(0))).alias(c) for c in numbers],
    )
    nothing = [F.lit(None).cast("bigint").alias(c) for c in numbers]
    start = queued.select("source_id", F.lit(0).cast("bigint").alias("seq"), F.lit("START").alias("kind"), *nothing)
    skipped = gated.filter("reason = 'not_due'").select(
        "source_id", F.lit(0).cast("bigint").alias("seq"), F.lit("SKIP").alias("kind"), *nothing
    )
    rows = start.unionByName(end).unionByName(skipped)
    return rows.withColumns({"ts": as_of, "duration": F.lit(None).cast("double")})


def counters(log: DataFrame) -> DataFrame:
    """Running counters per source, for batch or streaming logs."""
    return log.groupBy("source_id").agg(*counter_columns())


#: The latest log row of each sort that a summary keeps: its condition and values.
def _latest() -> dict[str, tuple[Column, tuple[str, ...]]]:
    ok = _is("SUCCESS")
    return {
        "l_start": (_is("START"), ()),
        "l_ok": (ok, ("n_new", "n_unchanged", "n_changed")),
        "l_failure": (_is("FAILURE"), ()),
        "l_fetched": (ok & F.col("n_fetched").isNotNull(), ("n_fetched",)),
        "l_duration": (ok & F.col("duration").isNotNull(), ("duration",)),
        "l_checked": (_is("SUCCESS", "FAILURE"), ()),
        "l_changed": (ok & (F.col("n_new") + F.col("n_changed") > 0), ()),
        "l_skip": (_is("SKIP"), ()),
        "l_status": (_is("SUCCESS", "FAILURE", "ENABLE", "DISABLE"), ("kind",)),
        "l_toggle": (_is("ENABLE", "DISABLE"), ("kind",)),
        "l_due": (_is("SUCCESS", "ENABLE", "DISABLE"), ("kind",)),
    }


def _at(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.struct(F.col(f"{name}.ts"), F.col(f"{name}.seq")))


def summarise(log: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One mergeable summary row per source of ``log``.

    ``tail_failures`` counts the failures behind the last success, be it in ``log``
    or in ``known``, the summaries of other rows of the same log.  Both passes are
    plain aggregations, merged before the shuffle, so a hot source needs no slices.
    """
    sums = log.groupBy("source_id").agg(
        *counter_columns(),
        *[
            F.max(F.when(condition, F.struct("ts", "seq", *values))).alias(name)
            for name, (condition, values) in _latest().items()
        ],
    )
    oks = sums.select("source_id", _at("l_ok").alias("__ok"))
    if known is not None:
        oks = oks.unionByName(known.select("source_id", _at("l_ok").alias("__ok")))
    ends = oks.groupBy("source_id").agg(F.max("__ok").alias("__ok"))
    return null_safe_join(sums, failures_behind(log, ends, "tail_failures"), ["source_id"])


def failures_behind(log: DataFrame, ends: DataFrame, name: str) -> DataFrame:
    """Failures in ``log`` behind the instant ``__ok`` of each source of ``ends`` (0 too)."""
    failed = log.filter(_is("FAILURE")).select("source_id", F.struct("ts", "seq").alias("__at"))
    behind = null_safe_join(failed, ends, ["source_id"]).filter(
        F.col("__ok").isNull() | (F.col("__at") > F.col("__ok"))
    )
    counted = behind.groupBy("source_id").agg(F.count(F.lit(1)).alias(name))
    return null_safe_join(ends.select("source_id"), counted, ["source_id"], "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(0))
    )


def merge(stored: DataFrame, fresh: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Summaries of ``stored`` and ``fresh`` rows together, one row per source of ``fresh``.

    ``fresh`` is made by ``summarise(new_rows, stored)``.  ``log`` holds the rows
    behind ``stored``; only sources with a late success read it, and without it such
    a success raises.
    """
    old = stored.withColumnsRenamed({c: f"__old_{c}" for c in stored.columns if c != "source_id"})
    both = null_safe_join(fresh, old, ["source_id"], "left")
    newer_ok = F.col("l_ok").isNotNull() & (F.col("__old_l_ok").isNull() | (_at("l_ok") > _at("__old_l_ok")))
    # A success after all stored failures ends their streak, one among them cuts it.
    among = newer_ok & F.col("__old_l_failure").isNotNull() & (_at("__old_l_failure") > _at("l_ok"))
    among = among & (F.col("__old_tail_failures") > 0)
    late = both.filter(among).select("source_id", _at("l_ok").alias("__ok"))
    carried = F.when(newer_ok, F.lit(0)).otherwise(F.coalesce("__old_tail_failures", F.lit(0)))
    if not late.isEmpty():
        if log is None:
            raise ValueError("a late success needs the log behind the stored summaries")
        recounted = failures_behind(null_safe_join(log, late.select("source_id"), ["source_id"]), late, "__recount")
        both = null_safe_join(both, recounted, ["source_id"], "left")
        carried = F.coalesce("__recount", carried)
    latest = [c for c in fresh.columns if c.startswith("l_")]
    return both.select(
        "source_id",
        *[(F.col(c) + F.coalesce(f"__old_{c}", F.lit(0))).alias(c) for c in COUNTERS],
        *[F.greatest(F.col(c), F.col(f"__old_{c}")).alias(c) for c in latest],
        (F.col("tail_failures") + carried).cast("bigint").alias("tail_failures"),
    )


def merge_all(stored: DataFrame, fresh: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """:func:`merge`, with the stored sources that ``fresh`` does not touch."""
    others = stored.join(fresh.select("source_id"), stored["source_id"].eqNullSafe(fresh["source_id"]), "left_anti")
    return others.unionByName(merge(stored, fresh, log))


def summary_table(spark, root: str) -> StateTable:
    """Stored summaries, by source."""
    return StateTable(spark, root, ["source_id"])


def advance(table: StateTable, rows: DataFrame, batch: int, log: DataFrame | None = None, stream: str = "") -> bool:
    """Adds new log rows to the stored summaries; False when the batch was added before.

    Only the summaries of sources in ``rows`` are written.  ``log`` holds the rows of
    earlier batches (see :func:`merge`).
    """
    if table.applied(batch, stream):
        return False
    stored = table.read()
    # Written, as the merge reads it several times.
    fresh = summarise(rows, stored)
    fresh = fresh if stored is None else written(fresh, "summaries")
    return table.upsert(fresh if stored is None else merge(stored, fresh, log), batch, stream)


def source_state(
    log: DataFrame, registry: DataFrame | None = None, respect_disabled: bool = False
) -> DataFrame:
    """:func:`shown` over a whole log."""
    return shown(summarise(log), registry, respect_disabled)


def shown(
    summaries: DataFrame, registry: DataFrame | None = None, respect_disabled: bool = False
) -> DataFrame:
    """Status, failure streak, counters, last values and next check per source.

    A failure below the limit sets ACTIVE even for a disabled source, as the
    original does; ``respect_disabled`` keeps a disabled source disabled.
    """
    merged = summaries.withColumnRenamed("tail_failures", "failure_count")
    interval = F.lit(None).cast("bigint")
    if registry is not None:
        intervals = registry.select("source_id", F.col("crawl_interval").cast("bigint").alias("__interval"))
        merged = merged.join(intervals, "source_id", "left")
        interval = F.col("__interval")
    if registry is not None and "failure_count" in registry.columns:
        # A stored streak goes on until the first success in the log.
        kept = registry.select("source_id", F.col("failure_count").alias("__stored"))
        goes_on = F.when(F.col("successful_crawl_count") == 0, F.col("__stored").cast("bigint"))
        merged = merged.join(kept, "source_id", "left").withColumn(
            "failure_count", F.col("failure_count") + F.coalesce(goes_on, F.lit(0))
        )
    due = (
        F.when(F.col("l_due.kind") == "SUCCESS", F.col("l_due.ts") + F.coalesce(interval, F.lit(DEFAULT_INTERVAL)))
        .when(F.col("l_due.kind") == "ENABLE", F.col("l_due.ts"))
        .when(F.col("l_due.kind") == "DISABLE", F.lit(0))
    )
    kind = F.col("l_status.kind")
    status = (
        F.when(kind.isin("SUCCESS", "ENABLE"), F.lit("ACTIVE"))
        .when(kind == "DISABLE", F.lit("DISABLED"))
        .when(kind == "FAILURE", F.when(F.col("failure_count") >= FAILURES_TO_ERROR, F.lit("ERROR"))
              .otherwise(F.lit("ACTIVE")))
    )
    if respect_disabled:
        status = F.when(F.col("l_toggle.kind") == "DISABLE", F.lit("DISABLED")).otherwise(status)
    new, same, changed = (F.col(f"l_ok.{c}") for c in ("n_new", "n_unchanged", "n_changed"))
    state = merged.select(
        "source_id",
        status.alias("status"),
        "failure_count",
        *COUNTERS,
        F.col("l_start.ts").alias("last_crawl_started"),
        F.col("l_ok.ts").alias("last_crawl_completed"),
        new.alias("last_sync_new"),
        same.alias("last_sync_unchanged"),
        changed.alias("last_sync_changed"),
        (new + same + changed).alias("last_sync_total"),
        same.alias("last_cache_hits"),
        (new + changed).alias("last_cache_misses"),
        F.col("l_fetched.n_fetched").alias("last_fetched_count"),
        F.round("l_duration.duration", 2).alias("last_crawl_duration"),
        F.col("l_checked.ts").alias("last_checked"),
        F.col("l_changed.ts").alias("last_changed"),
        F.col("l_skip.ts").alias("last_skipped"),
        due.cast("bigint").alias("next_check"),
    )
    return state if registry is None else _with_registry(registry, state)


def _with_registry(registry: DataFrame, state: DataFrame) -> DataFrame:
    """Registry rows with the rolled-up columns laid over their stored values."""
    fresh = [c for c in state.columns if c != "source_id"]
    derived = state.select("source_id", *[F.col(c).alias(f"__{c}") for c in fresh])
    joined = registry.join(derived, "source_id", "left")
    summed = set(COUNTERS)
    out = {}
    for c in fresh:
        stored = F.col(c) if c in registry.columns else F.lit(None)
        if c in summed:
            kept = F.coalesce(stored.cast("bigint"), F.lit(0))
            out[c] = kept + F.coalesce(f"__{c}", F.lit(0))
        else:
            out[c] = F.coalesce(F.col(f"__{c}"), stored.cast(state.schema[c].dataType))
    return joined.withColumns(out).drop(*[f"__{c}" for c in fresh])
