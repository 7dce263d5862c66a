"""Streaming forms of the sync fold and the request queue over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.changes import IMAGE
from tidemark.operators.source_state import counters
from tidemark.plans import views
from tidemark.plans.catalogue import query
from tidemark.plans.catalogue import sources as src
from tidemark.plans.catalogue import sqltext as q
from tidemark.plans.catalogue.sync import postings, spec
from tidemark.session import work_dir, written
from tidemark.sources.snapshots import StateTable
from tidemark.streaming.feed_source import ChangeFeed
from tidemark.streaming.requests import request_stream
from tidemark.streaming.stateful import held, stateful_fold, verdicts
from tidemark.streaming.sync import sync_batch, sync_stream
from tidemark.streaming.watch import read_feed, run_until, watch_key

#: Parts a table is landed in; each becomes one micro-batch.
N_PARTS = 3


def in_parts(
    rows: DataFrame,
    order: str,
    path: str,
    run: Callable[[DataFrame], StreamingQuery],
    n_parts: int = N_PARTS,
) -> None:
    """Lands rows in parts of rising ``order``; after each the stream takes what is new.

    The rows are computed and written once, cut by part.  A part then becomes one
    micro-batch, whatever its number of files, so micro-batches arrive in order.
    """
    spark = rows.sparkSession
    low, high = rows.agg(F.min(order), F.max(order)).first()
    width = (high - low) // n_parts + 1
    part = F.floor((F.col(order) - low) / width).cast("int")
    rows.withColumn("part", part).write.partitionBy("part").parquet(f"{path}-cut")
    cut = spark.read.parquet(f"{path}-cut")
    for i in range(n_parts):
        cut.filter(F.col("part") == i).drop("part").write.mode("append").parquet(f"{path}/part={i}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true")
        run(stream.parquet(path)).awaitTermination()


def synced(spark: SparkSession, sf_dir: str) -> tuple[StateTable, str]:
    """Runs the postings as a stream into a state table."""
    root = work_dir(spark, "sync")
    rows = postings(spark, sf_dir).withColumn("status", F.lit("OPEN"))
    table = StateTable(spark, f"{root}/state", spec().key)
    in_parts(
        rows,
        "seq",
        f"{root}/in",
        lambda s: sync_stream(s, spec(), table, root, f"{root}/checkpoint", IMAGE),
    )
    return table, root


@query(
    "stream_sync",
    f"""{q.sync_cte()} select seq, canonical_job_id, change_type, changed_fields, first_seen, last_changed, change_count from f""",
)
def stream_sync(spark, sf_dir):
    _, root = synced(spark, sf_dir)
    verdicts = spark.read.parquet(f"{root}/results")
    return verdicts.select(
        "seq",
        "canonical_job_id",
        "change_type",
        F.array_join("changed_fields", ",").alias("changed_fields"),
        "first_seen",
        "last_changed",
        "change_count",
    )


@query(
    "stream_state",
    f"""{q.sync_cte()} select canonical_job_id, seq, title, description, first_seen, last_changed, change_count
        from f where written qualify row_number() over (partition by canonical_job_id order by seq desc) = 1""",
)
def stream_state(spark, sf_dir):
    table, _ = synced(spark, sf_dir)
    return table.read().select(
        "canonical_job_id", "seq", "title", "description", "first_seen", "last_changed", "change_count"
    )


@query(
    "stream_watch_key",
    f"""{q.sync_cte()} select canonical_job_id, seq, case change_type when 'NEW' then 'INSERT' else 'MODIFY' end as event_name,
          change_type <> 'NEW' as has_old_image, true as has_new_image
        from f where written and canonical_job_id = (select max(canonical_job_id) from j)""",
)
def stream_watch_key(spark, sf_dir):
    table, root = synced(spark, sf_dir)
    key = table.read().agg(F.max("canonical_job_id")).first()[0]
    schema = spark.read.parquet(f"{root}/feed").drop("v").schema
    feed = read_feed(spark, f"{root}/feed", schema)
    run_until(watch_key(feed, "canonical_job_id", key), f"{root}/watched", f"{root}/watch-checkpoint")
    watched = spark.read.parquet(f"{root}/watched")
    return watched.select("canonical_job_id", "seq", "event_name", "has_old_image", "has_new_image")


@query(
    "stream_feed_versions",
    f"""{q.sync_cte()} select canonical_job_id, seq, case change_type when 'NEW' then 'INSERT' else 'MODIFY' end as event_name,
          change_count from f where written""",
)
def stream_feed_versions(spark, sf_dir):
    """The change feed through its own source: a version at a time, restarted in between;
    a run more than there are versions reads nothing twice."""
    _, root = synced(spark, sf_dir)
    for _ in range(N_PARTS + 1):
        _followed(spark, root, "all", versionsPerBatch="1")
    events = spark.read.parquet(f"{root}/followed-all")
    return events.select("canonical_job_id", "seq", "event_name", F.col("after.change_count").alias("change_count"))


@query(
    "stream_feed_key",
    f"""{q.sync_cte()} select canonical_job_id, seq, case change_type when 'NEW' then 'INSERT' else 'MODIFY' end as event_name
        from f where written and canonical_job_id = (select max(canonical_job_id) from j)""",
)
def stream_feed_key(spark, sf_dir):
    """Events of one key: the source itself skips row groups and rows of other keys."""
    table, root = synced(spark, sf_dir)
    key = table.read().agg(F.max("canonical_job_id")).first()[0]
    _followed(spark, root, "key", keyColumn="canonical_job_id", keyValue=key)
    return spark.read.parquet(f"{root}/followed-key").select("canonical_job_id", "seq", "event_name")


def _followed(spark, root: str, name: str, **options: str) -> None:
    """Writes what the feed holds now into ``followed-<name>``."""
    spark.dataSource.register(ChangeFeed)
    schema = spark.read.parquet(f"{root}/feed").drop("v").schema
    feed = spark.readStream.format("change_feed").schema(schema).options(path=f"{root}/feed", **options).load()
    run_until(feed, f"{root}/followed-{name}", f"{root}/followed-{name}-checkpoint")


_ROUTED = f"""{src.MESSAGES_SQL}, rt as (select message_id, source_id, outcome, cast(cast(message_id as bigint) % 3 + 1 as bigint) as attempts from chk)"""


@query(
    "stream_dead_letter",
    f"with {_ROUTED} select message_id, source_id, outcome, attempts from rt where outcome <> 'OK' and attempts >= 3",
)
def stream_dead_letter(spark, sf_dir):
    return _routed(spark, sf_dir, "dead").select("message_id", "source_id", "outcome", "attempts")


@query(
    "stream_requests_pending",
    f"with {_ROUTED} select message_id, source_id, outcome, attempts from rt where outcome <> 'OK' and attempts < 3",
)
def stream_requests_pending(spark, sf_dir):
    return _routed(spark, sf_dir, "pending").select("message_id", "source_id", "outcome", "attempts")


@query(
    "stream_requests_done",
    f"with {_ROUTED} select message_id, source_id, attempts from rt where outcome = 'OK'",
)
def stream_requests_done(spark, sf_dir):
    return _routed(spark, sf_dir, "done").select("message_id", "source_id", "attempts")


def _routed(spark, sf_dir, route: str) -> DataFrame:
    """Deliveries of every message, some of them repeated ones."""
    root = work_dir(spark, "requests")
    number = F.col("message_id").cast("bigint")
    rows = src.messages(spark, sf_dir).withColumns({"n": number, "attempts": number % 3})
    registry = views.registry(spark, sf_dir)
    in_parts(rows, "n", f"{root}/in", lambda s: request_stream(s, registry, f"{root}/out", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/out").filter(F.col("route") == route)


@query(
    "stream_counters",
    f"with {src._STATE} select source_id, total_jobs_processed, failed_crawl_count, cache_hit_count from st",
)
def stream_counters(spark, sf_dir):
    """Running counters as a streaming aggregation in complete mode."""
    root = work_dir(spark, "counters")
    log = views.crawl_log(spark, sf_dir)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/v={batch_id}")

    def run(stream: DataFrame) -> StreamingQuery:
        counted = counters(stream).writeStream.outputMode("complete").foreachBatch(keep)
        return counted.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()

    in_parts(log, "seq", f"{root}/in", run)
    out = spark.read.parquet(f"{root}/out")
    newest = out.agg(F.max("v")).first()[0]
    return out.filter(F.col("v") == newest).select(
        "source_id", "total_jobs_processed", "failed_crawl_count", "cache_hit_count"
    )


@query(
    "stream_state_store",
    f"{q.sync_cte()} select canonical_job_id as key, seq, change_type, first_seen, change_count from f",
)
def stream_state_store(spark, sf_dir):
    """The fold with its state in the streaming state store."""
    root = work_dir(spark, "state-store")
    rows = written(_hashed(postings(spark, sf_dir)), "hashed")
    for i in range(N_PARTS):
        _land(_first_part(rows, i), f"{root}/in/part={i}")
        stateful_fold(_landed(spark, root, rows), f"{root}/out", f"{root}/checkpoint", hot_rows=50)
    return verdicts(spark, f"{root}/out")


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("canonical_job_id").alias("key"), "seq", spec().hash.alias("hash"), F.col("seq").alias("at")
    )


def _land(rows: DataFrame, path: str) -> None:
    rows.write.parquet(path)


def _landed(spark, root: str, rows: DataFrame) -> DataFrame:
    return spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")


@query(
    "stream_state_handover",
    f"""{q.sync_cte()} select canonical_job_id as key, cast(min(first_seen) as bigint) as first_seen, cast(max(change_count) as bigint) as changes,
          true as same_hash from f group by 1""",
)
def stream_state_handover(spark, sf_dir):
    """A stored table hands its state to the state store, which folds the other two
    thirds; what the store holds then is read back and laid beside the whole fold."""
    root = work_dir(spark, "handover")
    rows = written(postings(spark, sf_dir).withColumn("status", F.lit("OPEN")), "postings")
    table = StateTable(spark, f"{root}/state", spec().key)
    sync_batch(_first_part(rows, 0), 0, spec(), table, root)
    stored = table.read().select(
        F.col("canonical_job_id").alias("key"), spec().hash.alias("hash"), "first_seen",
        F.col("change_count").alias("changes"),
    )
    hashed = written(_hashed(rows), "hashed")
    stored = written(stored, "stored")
    for i in (1, 2):
        _land(_first_part(hashed, i), f"{root}/in/part={i}")
        stateful_fold(_landed(spark, root, hashed), f"{root}/out", f"{root}/checkpoint", stored)
    last = hashed.groupBy("key").agg(F.max_by("hash", "seq").alias("__last"))
    now = held(spark, f"{root}/checkpoint").join(last, "key")
    return now.select("key", "first_seen", "changes", (F.col("hash") == F.col("__last")).alias("same_hash"))


def _first_part(rows: DataFrame, part: int) -> DataFrame:
    """A third of the stored postings by sequence number."""
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    width = (high - low) // N_PARTS + 1
    return rows.filter(F.floor((F.col("seq") - low) / width) == part)


_STATE_SQL = f"""{q.sync_cte()} select canonical_job_id, seq, title, change_count
        from f where written qualify row_number() over (partition by canonical_job_id order by seq desc) = 1"""


@query("state_compact_between_batches", _STATE_SQL)
def state_compact_between_batches(spark, sf_dir):
    """Three batches with a compaction after the second: none is lost or written twice."""
    root = work_dir(spark, "compact")
    rows = written(postings(spark, sf_dir).withColumn("status", F.lit("OPEN")), "postings")
    table = StateTable(spark, f"{root}/state", spec().key)
    for i in range(N_PARTS):
        sync_batch(_first_part(rows, i), i, spec(), table, root)
        if i == 1:
            table.compact()
    return table.read().select("canonical_job_id", "seq", "title", "change_count")


@query("replay_batch", _STATE_SQL)
def replay_batch(spark, sf_dir):
    """Every batch is delivered twice; the second delivery changes nothing."""
    root = work_dir(spark, "replay")
    rows = written(postings(spark, sf_dir).withColumn("status", F.lit("OPEN")), "postings")
    table = StateTable(spark, f"{root}/state", spec().key)
    for i in range(N_PARTS):
        for _ in range(2):
            sync_batch(_first_part(rows, i), i, spec(), table, root)
    return table.read().select("canonical_job_id", "seq", "title", "change_count")


@query(
    "state_delete",
    """select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'F'
       union all select o_orderkey, 'again' from orders where o_orderstatus = 'F' and o_orderkey % 2 = 0""",
)
def state_delete(spark, sf_dir):
    """Orders stored, finished ones deleted, half of those stored again."""
    root = work_dir(spark, "delete")
    orders = views.load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    table = StateTable(spark, root, ["o_orderkey"])
    done = orders.filter("o_orderstatus = 'F'")
    table.upsert(orders)
    table.delete(done)
    table.compact()
    table.upsert(done.filter("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("again")))
    return table.read()


@query(
    "state_lookup",
    """select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 64 = 1 and o_orderstatus <> 'F'""",
)
def state_lookup(spark, sf_dir):
    """Orders stored and compacted, finished ones deleted; some asked for by key."""
    root = work_dir(spark, "lookup")
    orders = views.load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    table = StateTable(spark, root, ["o_orderkey"])
    table.upsert(orders)
    table.compact()
    table.delete(orders.filter("o_orderstatus = 'F'"))
    asked = orders.select("o_orderkey").filter("o_orderkey % 64 = 1")
    return table.lookup(asked, most=asked.count())
