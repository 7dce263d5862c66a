"""Source state, gating, request messages and administrator commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import gate as gt
from tidemark.operators import metrics as mt
from tidemark.operators import registry as rg
from tidemark.operators import source_state as ss
from tidemark.plans import views
from tidemark.plans.catalogue import query
from tidemark.session import work_dir, written
from tidemark.sources import messages as ms
from tidemark.sources.landed import seed_rows

_LOG = f"log as ({views.duck(views.DUCK_LOG_SQL)})"

#: Rollup of the log per source: CTE ``st``.
_STATE = f"""{_LOG},
isl as (select *, sum(case when kind = 'SUCCESS' then 1 else 0 end)
          over (partition by source_id order by ts, seq rows unbounded preceding) as island from log),
cur as (select source_id, cast(count(*) filter (kind = 'FAILURE') as bigint) as failure_count
        from isl where island = (select max(i.island) from isl i where i.source_id = isl.source_id)
        group by source_id),
agg as (select source_id,
    count(*) filter (kind = 'START') as fetch_attempt_count,
    count(*) filter (kind = 'SUCCESS') as successful_crawl_count,
    count(*) filter (kind = 'FAILURE') as failed_crawl_count,
    count(*) filter (kind = 'SKIP') as skip_count,
    cast(coalesce(sum(n_new + n_changed + n_unchanged) filter (kind = 'SUCCESS'), 0) as bigint) as total_jobs_processed,
    cast(coalesce(sum(n_new) filter (kind = 'SUCCESS'), 0) as bigint) as new_count,
    cast(coalesce(sum(n_unchanged) filter (kind = 'SUCCESS'), 0) as bigint) as unchanged_count,
    cast(coalesce(sum(n_changed) filter (kind = 'SUCCESS'), 0) as bigint) as changed_count,
    count(*) filter (kind = 'SUCCESS' and n_new + n_changed > 0) as change_count,
    max(ts) filter (kind = 'START') as last_crawl_started,
    max(ts) filter (kind = 'SUCCESS') as last_crawl_completed,
    arg_max(n_new, (ts, seq)) filter (kind = 'SUCCESS') as last_sync_new,
    arg_max(n_unchanged, (ts, seq)) filter (kind = 'SUCCESS') as last_sync_unchanged,
    arg_max(n_changed, (ts, seq)) filter (kind = 'SUCCESS') as last_sync_changed,
    arg_max(n_fetched, (ts, seq)) filter (kind = 'SUCCESS' and n_fetched is not null) as last_fetched_count,
    round(arg_max(duration, (ts, seq)) filter (kind = 'SUCCESS' and duration is not null), 2) as last_crawl_duration,
    max(ts) filter (kind in ('SUCCESS', 'FAILURE')) as last_checked,
    max(ts) filter (kind = 'SUCCESS' and n_new + n_changed > 0) as last_changed,
    max(ts) filter (kind = 'SKIP') as last_skipped,
    arg_max(kind, (ts, seq)) filter (kind in ('SUCCESS', 'FAILURE', 'ENABLE', 'DISABLE')) as last_kind,
    arg_max(case kind when 'SUCCESS' then ts + 3600 when 'ENABLE' then ts else 0 end, (ts, seq))
      filter (kind in ('SUCCESS', 'ENABLE', 'DISABLE')) as next_check
  from log group by source_id),
st as (select agg.*, failure_count,
    case when last_kind in ('SUCCESS', 'ENABLE') then 'ACTIVE' when last_kind = 'DISABLE' then 'DISABLED'
      when failure_count >= 3 then 'ERROR' else 'ACTIVE' end as status,
    unchanged_count as cache_hit_count, new_count + changed_count as cache_miss_count,
    unchanged_count as redundant_updates_prevented
  from agg join cur using (source_id))"""

_STATE_COLUMNS = (
    "source_id, status, failure_count, fetch_attempt_count, successful_crawl_count, failed_crawl_count, "
    "skip_count, total_jobs_processed, new_count, unchanged_count, changed_count, cache_hit_count, "
    "cache_miss_count, redundant_updates_prevented, change_count, last_crawl_started, "
    "last_crawl_completed, last_sync_new, last_sync_unchanged, last_sync_changed, last_fetched_count, "
    "last_crawl_duration, last_checked, last_changed, last_skipped, next_check"
)


def state(spark, sf_dir, **options):
    return ss.source_state(views.crawl_log(spark, sf_dir), **options)


@query("source_state", f"with {_STATE} select {_STATE_COLUMNS} from st")
def source_state(spark, sf_dir):
    return state(spark, sf_dir).select(*_STATE_COLUMNS.split(", "))


@query("source_state_hot_sources", f"with {_STATE} select {_STATE_COLUMNS} from st")
def source_state_hot_sources(spark, sf_dir):
    """The log is cut at instants; each cut is summarised apart and merged with the ones before."""
    log = views.crawl_log(spark, sf_dir)
    low, high = log.agg(F.min("ts"), F.max("ts")).first()
    cut = F.least(F.floor((F.col("ts") - low) * 3 / (high - low + 1)), F.lit(2))
    merged = written(ss.summarise(log.filter(cut == 0)), "summaries")
    for i in (1, 2):
        fresh = written(ss.summarise(log.filter(cut == i), merged), "summaries")
        merged = written(ss.merge_all(merged, fresh), "summaries")
    return ss.shown(merged).select(*_STATE_COLUMNS.split(", "))


@query("source_state_incremental", f"with {_STATE} select {_STATE_COLUMNS} from st")
def source_state_incremental(spark, sf_dir):
    """Three batches into stored summaries; every batch reaches over the whole time of the
    log, so successes come late among failures that are already counted."""
    root = work_dir(spark, "summaries")
    log = views.crawl_log(spark, sf_dir)
    table = ss.summary_table(spark, f"{root}/state")
    batch = F.col("seq") % 3
    for i in range(3):
        rows = log.filter(batch == i)
        ss.advance(table, rows, i, log.filter(batch < i))
        ss.advance(table, rows, i, log.filter(batch < i))
    return ss.shown(table.read()).select(*_STATE_COLUMNS.split(", "))


@query(
    "source_state_with_registry",
    f"""with {_STATE}, reg as ({views.duck(views.REGISTRY_SQL)}),
        iv as (select log.*, coalesce(cast(crawl_interval as bigint), 3600) as iv from log left join reg using (source_id)),
        nx as (select source_id, arg_max(case kind when 'SUCCESS' then ts + iv when 'ENABLE' then ts else 0 end, (ts, seq))
                 filter (kind in ('SUCCESS', 'ENABLE', 'DISABLE')) as due from iv group by source_id),
        j as (select reg.source_id, reg.status as s0, reg.failure_count as f0, reg.next_check as n0, st.status as s1,
                st.failure_count as f1, st.successful_crawl_count as ok, st.last_kind, due
              from reg left join st using (source_id) left join nx using (source_id))
        select source_id, cast(case when f1 is null then f0 when ok = 0 then f0 + f1 else f1 end as bigint) as failure_count,
          case when s1 is null then s0 when last_kind = 'FAILURE' then
            case when case when ok = 0 then f0 + f1 else f1 end >= 3 then 'ERROR' else 'ACTIVE' end else s1 end as status,
          coalesce(due, n0) as next_check
        from j""",
)
def source_state_with_registry(spark, sf_dir):
    registry = views.registry(spark, sf_dir)
    merged = state(spark, sf_dir, registry=registry)
    return merged.select("source_id", F.col("failure_count").cast("bigint"), "status", "next_check")


_GATED = f"""{_STATE},
g as (select source_id, case when status <> 'ACTIVE' then concat('status=', status)
        when next_check is not null and {views.AS_OF} < next_check then 'not_due' end as reason from st)"""


@query(
    "due_gate",
    f"with {_GATED} select source_id, case when reason is null then 'QUEUED' else 'SKIPPED' end as decision, reason from g",
)
def due_gate(spark, sf_dir):
    return gt.gate(state(spark, sf_dir), views.AS_OF).select("source_id", "decision", "reason")


@query(
    "gate_summary",
    f"""with reg as ({views.duck(views.REGISTRY_SQL)}),
        g as (select status = 'ACTIVE' and (next_check is null or {views.AS_OF} >= next_check) as due from reg)
        select count(*) as sources_found, count(*) filter (due) as queued_count, count(*) filter (not due) as skipped_count from g""",
)
def gate_summary(spark, sf_dir):
    return gt.gate_summary(gt.gate(views.registry(spark, sf_dir), views.AS_OF))


@query(
    "crawl_requests",
    f"""with reg as ({views.duck(views.REGISTRY_SQL)})
        select source_id, concat('{{"source_id":"', source_id, '","reason":"SCHEDULED_SYNC","requested_at":{views.AS_OF}}}') as body
        from reg where status = 'ACTIVE' and (next_check is null or {views.AS_OF} >= next_check)""",
)
def crawl_requests(spark, sf_dir):
    gated = gt.gate(views.registry(spark, sf_dir), views.AS_OF)
    return ms.crawl_requests(gated.filter("decision = 'QUEUED'"), views.AS_OF)


@query(
    "skip_log",
    f"""with reg as ({views.duck(views.REGISTRY_SQL)})
        select source_id, cast({views.AS_OF} as bigint) as ts, 'SKIP' as kind from reg
        where status = 'ACTIVE' and {views.AS_OF} < next_check""",
)
def skip_log(spark, sf_dir):
    return gt.skip_log(gt.gate(views.registry(spark, sf_dir), views.AS_OF), views.AS_OF)


def messages(spark, sf_dir):
    """One request body per event; some are malformed or lack the source."""
    events = views.load(spark, sf_dir, "events")
    eid = F.col("event_id")
    good = F.concat(F.lit('{"source_id":"src'), (F.col("user_id") % 25).cast("string"), F.lit('"}'))
    body = (
        F.when(eid % 17 == 0, F.lit("{not json"))
        .when(eid % 13 == 0, F.lit('{"reason":"x"}'))
        .when(eid % 11 == 0, F.lit("[1]"))
        .otherwise(good)
    )
    return events.select(eid.cast("string").alias("message_id"), body.alias("body"))


MESSAGES_SQL = f"""msg as (select cast(event_id as varchar) as message_id,
    case when event_id % 17 = 0 then 'malformed' when event_id % 13 = 0 then 'no_source_id'
         when event_id % 11 = 0 then 'not_an_object' end as reject,
    case when event_id % 17 <> 0 and event_id % 13 <> 0 and event_id % 11 <> 0
         then concat('src', user_id % 25) end as source_id from events),
reg as ({views.duck(views.REGISTRY_SQL)}),
chk as (select message_id, source_id, case when reject is not null then reject when reg.source_id is null then 'source_not_found'
    when status <> 'ACTIVE' then 'source_not_active' else 'OK' end as outcome from msg left join reg using (source_id))"""


@query("request_validation", f"with {MESSAGES_SQL} select message_id, source_id, outcome from chk")
def request_validation(spark, sf_dir):
    parsed = ms.parse_requests(messages(spark, sf_dir))
    checked = ms.check_requests(parsed, views.registry(spark, sf_dir))
    return checked.select("message_id", "source_id", "outcome")


@query(
    "request_failures",
    f"with {MESSAGES_SQL} select source_id, 'FAILURE' as kind, count(*) as n from chk where outcome = 'source_not_active' group by 1",
)
def request_failures(spark, sf_dir):
    parsed = ms.parse_requests(messages(spark, sf_dir))
    failed = ms.failures(ms.check_requests(parsed, views.registry(spark, sf_dir)), F.lit(views.AS_OF))
    return failed.groupBy("source_id", "kind").agg(F.count(F.lit(1)).alias("n"))


_OPS = """source_id, source_id as source_name, status, fetch_attempt_count as fetch_attempts,
  successful_crawl_count as successful_crawls, failed_crawl_count as failed_crawls, new_count as new,
  unchanged_count as unchanged, changed_count as changed, cache_hit_count as cache_hits,
  cache_miss_count as cache_misses, redundant_updates_prevented, skip_count as controller_skips,
  total_jobs_processed as jobs_processed"""


@query("ops_metrics", f"with {_STATE} select {_OPS} from st")
def ops_metrics(spark, sf_dir):
    return mt.ops_metrics(state(spark, sf_dir))


_TOTALS = ", ".join(f"cast(sum({m}) as bigint) as {m}" for m in mt.OPS_METRICS)


@query(
    "ops_totals",
    f"""with {_STATE}, o as (select {_OPS} from st)
        select count(*) as sources, {_TOTALS},
          round(100.0 * sum(cache_hits) / nullif(sum(cache_hits) + sum(cache_misses), 0), 1) as hit_rate from o""",
)
def ops_totals(spark, sf_dir):
    return mt.ops_totals(mt.ops_metrics(state(spark, sf_dir)))


@query(
    "running_counters",
    f"with {_STATE} select source_id, {', '.join(ss.COUNTERS)} from st",
)
def running_counters(spark, sf_dir):
    return ss.counters(views.crawl_log(spark, sf_dir))


@query(
    "crawl_failure_metrics",
    f"""with log as ({views.duck(views.DUCK_LOG_SQL)}) select source_id, 'CrawlFailures' as metric, 'Count' as unit, cast(count(*) as double) as value
        from log where kind = 'FAILURE' group by 1""",
)
def crawl_failure_metrics(spark, sf_dir):
    return mt.failure_metrics(views.crawl_log(spark, sf_dir))


@query(
    "public_sources",
    f"""with reg as ({views.duck(views.REGISTRY_SQL)})
        select source_id, case when source_name = '' then source_id else source_name end as source_name,
          coalesce(source_type, 'BUILTIN') as source_type, status, cast(crawl_interval as bigint) as crawl_interval,
          0 as successful_crawl_count, 0 as failed_crawl_count, cast(null as bigint) as last_checked, next_check
        from reg""",
)
def public_sources(spark, sf_dir):
    return mt.public_sources(views.registry(spark, sf_dir))


def commands(spark, sf_dir):
    """One administrator command per customer, aimed at the registry of suppliers."""
    c = views.load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    op = F.when(k % 3 == 0, F.lit("CREATE")).when(k % 3 == 1, F.lit("SET_STATUS")).otherwise(F.lit("SYNC"))
    n = k % 90
    target = F.when(k % 10 == 9, F.lit("")).otherwise(
        F.concat(F.when(n % 3 == 0, F.lit("custom-")).otherwise(F.lit("src")), n.cast("string"))
    )
    # Custom sources are numbered by threes; spread the commands over both kinds.
    target = F.when(target == "", target).when(
        k % 2 == 0, F.concat(F.lit("custom-"), (n - n % 3).cast("string"))
    ).otherwise(target)
    return c.select(
        k.cast("string").alias("command_id"),
        k.alias("seq"),
        (F.lit(views.AS_OF) + k).alias("ts"),
        op.alias("op"),
        target.alias("source_id"),
        F.concat("c_name", F.lit(" & Co!")).alias("source_name"),
        F.when(k % 4 == 0, F.lit("active")).when(k % 4 == 1, F.lit("DISABLED"))
        .when(k % 8 == 2, F.lit("paused")).otherwise(F.lit("disabled")).alias("status"),
        F.when(k % 12 == 0, F.array(F.lit("endpoint"))).otherwise(F.array().cast("array<string>")).alias("violations"),
        F.struct(
            F.concat(F.lit("https://api.example.com/"), k.cast("string")).alias("endpoint"),
            F.when(k % 2 == 0, F.lit("data.jobs")).alias("records_path"),
            F.create_map(F.lit("title"), F.lit("t"), F.lit("company"), F.lit("c")).alias("fields"),
            F.struct(
                F.lit("PAGE").alias("type"), F.lit("page").alias("page_parameter"),
                F.lit(1).cast("bigint").alias("start_page"), F.lit(5).cast("bigint").alias("max_pages"),
            ).alias("pagination"),
        ).alias("api_config"),
        (900 + k % 7 * 60).cast("bigint").alias("crawl_interval"),
    )


_COMMANDS = f"""reg as ({views.duck(views.REGISTRY_SQL)}),
cmd0 as (select c_custkey as k, c_name, c_custkey % 90 as n from customer),
cmd as (select cast(k as varchar) as command_id, k as seq, {views.AS_OF} + k as ts,
    case k % 3 when 0 then 'CREATE' when 1 then 'SET_STATUS' else 'SYNC' end as op,
    case when k % 3 = 0 then concat('custom-', substr(trim(regexp_replace(lower(concat(c_name, ' & Co!')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 32),
           '-', substr(sha256(cast(k as varchar)), 1, 8))
         when k % 10 = 9 then null when k % 2 = 0 then concat('custom-', n - n % 3)
         when n % 3 = 0 then concat('custom-', n) else concat('src', n) end as source_id,
    concat(c_name, ' & Co!') as source_name, k % 3 = 0 and k % 12 = 0 as invalid,
    case when k % 4 = 0 then 'ACTIVE' when k % 4 = 1 then 'DISABLED' when k % 8 = 2 then 'PAUSED' else 'DISABLED' end as wanted
  from cmd0),
x1 as (select cmd.*, reg.source_id is not null as stored, coalesce(source_type, 'BUILTIN') = 'CUSTOM_API' and reg.source_id is not null as custom,
    reg.status as s0 from cmd left join reg using (source_id)),
x2 as (select *, case when op = 'CREATE' and not invalid then 'ACTIVE'
    when op = 'SET_STATUS' and source_id is not null and wanted in ('ACTIVE', 'DISABLED') and stored and custom then wanted end as set_to from x1),
x3 as (select *, coalesce(last_value(set_to ignore nulls) over (partition by source_id order by seq
    rows between unbounded preceding and 1 preceding), s0) as current_status from x2),
x as (select *, case when op = 'CREATE' then case when invalid then 400 else 201 end
    when source_id is null then 400
    when op = 'SET_STATUS' then case when wanted not in ('ACTIVE', 'DISABLED') then 400 when not stored then 404 when not custom then 403 else 200 end
    else case when not stored then 404 when current_status <> 'ACTIVE' then 409 else 202 end end as outcome from x3)"""


@query(
    "apply_commands",
    f"""with {_COMMANDS} select command_id, op, source_id, outcome, coalesce(set_to, current_status) as status,
          case when set_to = 'ACTIVE' then ts when set_to = 'DISABLED' then 0 end as next_check from x""",
)
def apply_commands(spark, sf_dir):
    applied = rg.apply_commands(commands(spark, sf_dir), views.registry(spark, sf_dir))
    return applied.select("command_id", "op", "source_id", "outcome", "status", "next_check")


@query(
    "created_sources",
    f"""with {_COMMANDS} select source_id, source_name, status, next_check, failure_count, crawl_interval, endpoint, records_path from (
          select source_id, source_name, status, next_check, failure_count, cast(crawl_interval as bigint) as crawl_interval,
            cast(null as varchar) as endpoint, cast(null as varchar) as records_path from reg
          union all
          select source_id, source_name, 'ACTIVE', ts, 0, 900 + seq % 7 * 60, concat('https://api.example.com/', command_id),
            case when seq % 2 = 0 then 'data.jobs' end from x where outcome = 201)""",
)
def created_sources(spark, sf_dir):
    registry = views.registry(spark, sf_dir)
    made = rg.created_sources(rg.apply_commands(commands(spark, sf_dir), registry))
    # A command that is delivered again makes no second source.
    grown = rg.insert_absent(registry.withColumn("crawl_interval", F.col("crawl_interval").cast("bigint")), made.union(made))
    return grown.select(
        "source_id", "source_name", "status", "next_check", "failure_count", "crawl_interval",
        F.col("api_config.endpoint").alias("endpoint"), F.col("api_config.records_path").alias("records_path"),
    )


@query(
    "toggle_log",
    f"""with {_COMMANDS} select source_id, seq, ts, case set_to when 'ACTIVE' then 'ENABLE' else 'DISABLE' end as kind
        from x where op = 'SET_STATUS' and outcome = 200""",
)
def toggle_log(spark, sf_dir):
    return rg.toggle_log(rg.apply_commands(commands(spark, sf_dir), views.registry(spark, sf_dir)))


@query(
    "seed_load",
    """select 'Sources' as table_name, concat('s', s_suppkey) as source_id, s_name as source_name,
         concat('https://api.example.com/', s_suppkey) as endpoint, 900 + s_suppkey as crawl_interval,
         0 as change_count, cast(null as bigint) as failure_count, 'ACTIVE' as status from supplier""",
)
def seed_load(spark, sf_dir):
    s = views.load(spark, sf_dir, "supplier")
    text = lambda c: F.struct(c.alias("S"))
    number = lambda c: F.struct(c.cast("string").alias("N"))
    k = F.col("s_suppkey")
    item = F.struct(
        text(F.concat(F.lit("s"), k.cast("string"))).alias("source_id"),
        text(F.col("s_name")).alias("source_name"),
        text(F.concat(F.lit("https://api.example.com/"), k.cast("string"))).alias("endpoint"),
        number(k + 900).alias("crawl_interval"),
        number(F.lit(0)).alias("change_count"),
        text(F.lit("ACTIVE")).alias("status"),
    )
    put = F.array(F.struct(F.struct(item.alias("Item")).alias("PutRequest")))
    return seed_rows(s.select(F.to_json(F.struct(put.alias("Sources"))).alias("body")), "body")
