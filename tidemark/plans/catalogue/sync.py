"""The sync fold, change feed and state over postings and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.identity import tracked_hash
from tidemark.operators import changes as ch
from tidemark.operators import fold as fd
from tidemark.operators.metrics import numbered_listing, run_metrics, sync_rollup
from tidemark.plans import views
from tidemark.plans.catalogue import query
from tidemark.plans.catalogue import sqltext as q
from tidemark.plans.jobs import clean_postings, posting_spec
from tidemark.session import written

_CTE = q.sync_cte()


def spec(**options):
    return posting_spec(at=F.col("seq"), **options)


def postings(spark, sf_dir):
    return clean_postings(views.jobs(spark, sf_dir))


def classified(spark, sf_dir):
    """Postings and their verdicts, each cleaned and folded once."""
    rows = written(postings(spark, sf_dir), "postings")
    return rows, written(fd.fold(rows, spec()), "verdicts")


def by_source(spark, sf_dir):
    """Verdicts with the feed each row came from."""
    return fd.fold(postings(spark, sf_dir), spec(keep=["source"]))


@query("sync_classify", f"{_CTE} select seq, canonical_job_id, change_type from f")
def sync_classify(spark, sf_dir):
    _, verdicts = classified(spark, sf_dir)
    return verdicts.select("seq", "canonical_job_id", "change_type")


@query(
    "sync_changed_fields",
    f"""{_CTE} select seq, canonical_job_id, changed_fields, first_seen, last_changed, change_count
        from f where change_type = 'CHANGED'""",
)
def sync_changed_fields(spark, sf_dir):
    _, verdicts = classified(spark, sf_dir)
    return verdicts.filter("change_type = 'CHANGED'").select(
        "seq",
        "canonical_job_id",
        F.array_join("changed_fields", ",").alias("changed_fields"),
        "first_seen",
        "last_changed",
        "change_count",
    )


_COUNTS = """count(*) filter (change_type = 'NEW') as n_new,
  count(*) filter (change_type = 'UNCHANGED') as n_unchanged,
  count(*) filter (change_type = 'CHANGED') as n_changed"""
_FIGURES = """n_unchanged as cache_hits, n_new + n_changed as cache_misses,
  n_new + n_changed + n_unchanged as jobs_processed, n_unchanged as redundant_updates_prevented,
  round(100.0 * n_unchanged / nullif(n_new + n_changed + n_unchanged, 0), 1) as hit_rate"""


@query(
    "sync_summary",
    f"{_CTE}, s as (select source, {_COUNTS} from f group by source) select *, {_FIGURES} from s",
)
def sync_summary(spark, sf_dir):
    return fd.summary(by_source(spark, sf_dir), ["source"])


_STATE = "canonical_job_id, seq, source, title, company, location, employment_type, description, apply_url"


@query(
    "sync_final_state",
    f"""{_CTE} select {_STATE}, cast(salary_min as double) as salary_min, cast(salary_max as double) as salary_max,
          first_seen, last_changed, change_count
        from f where written qualify row_number() over (partition by canonical_job_id order by seq desc) = 1""",
)
def sync_final_state(spark, sf_dir):
    state = final_postings(spark, sf_dir)
    return state.select(
        *_STATE.split(", "),
        F.col("salary_min").cast("double").alias("salary_min"),
        F.col("salary_max").cast("double").alias("salary_max"),
        *fd.LIFECYCLE,
    )


def final_postings(spark, sf_dir):
    """Stored postings after the whole table was synced."""
    rows, verdicts = classified(spark, sf_dir)
    return fd.final_state(rows, verdicts, spec())


@query(
    "sync_incremental",
    f"""{_CTE} select seq, case when seq < (select (max(doc_id) + 1) // 2 from documents) then 1 else 2 end as batch_no,
          change_type, changed_fields, first_seen, last_changed, change_count from f""",
)
def sync_incremental(spark, sf_dir):
    """Two batches in turn: the second is folded against what the first stored."""
    docs = views.load(spark, sf_dir, "documents")
    cut = docs.agg(F.floor((F.max("doc_id") + 1) / 2)).first()[0]
    rows = written(postings(spark, sf_dir), "postings")
    first, second = rows.filter(F.col("seq") < cut), rows.filter(F.col("seq") >= cut)
    one = written(fd.fold(first, spec()), "verdicts")
    state = written(fd.final_state(first, one, spec()), "state")
    two = fd.fold(second, spec(), state)
    both = one.withColumn("batch_no", F.lit(1)).unionByName(two.withColumn("batch_no", F.lit(2)))
    return both.select(
        "seq",
        "batch_no",
        "change_type",
        F.array_join("changed_fields", ",").alias("changed_fields"),
        *fd.LIFECYCLE,
    )


_ORDER_TRACKED = ("o_orderstatus", "o_orderpriority")
_ORDER_HASH = "concat(o_orderstatus, '|', o_orderpriority)"


def orders_spec(key: str, order: list[str], hot_rows: int | None = fd.HOT_ROWS) -> fd.FoldSpec:
    return fd.FoldSpec(
        key=[key],
        order=order,
        tracked=_ORDER_TRACKED,
        hash=tracked_hash(_ORDER_TRACKED),
        at=F.unix_seconds(F.col("o_orderdate").cast("timestamp")),
        hot_rows=hot_rows,
    )


def _orders_oracle(key: str, order: str, more: str = "", show: str = "o_orderkey") -> str:
    folded = q.fold("r", key, order, _ORDER_TRACKED, "floor(epoch(o_orderdate))")
    return f"""with r as (select *{more}, {_ORDER_HASH} as chash from orders), {folded}
      select {show}, {key}, change_type, changed_fields, first_seen, last_changed, change_count from f"""


def _orders_verdicts(spark, sf_dir, key, order, hot_rows, **more):
    orders = views.load(spark, sf_dir, "orders").withColumns(more)
    verdicts = fd.fold(orders, orders_spec(key, order, hot_rows))
    return verdicts.select(
        order[-1],
        key,
        "change_type",
        F.array_join("changed_fields", ",").alias("changed_fields"),
        *fd.LIFECYCLE,
    )


@query("sync_orders", _orders_oracle("o_custkey", "o_orderdate, o_orderkey"))
def sync_orders(spark, sf_dir):
    return _orders_verdicts(spark, sf_dir, "o_custkey", ["o_orderdate", "o_orderkey"], fd.HOT_ROWS)


@query("sync_orders_hot_keys", _orders_oracle("o_orderpriority", "o_orderkey"))
def sync_orders_hot_keys(spark, sf_dir):
    """Five keys hold the whole table: each is cut into slices of the order column."""
    return _orders_verdicts(spark, sf_dir, "o_orderpriority", ["o_orderkey"], 1000)


@query(
    "sync_hot_null_key",
    "select * replace (nullif(urgency, '~') as urgency) from ("
    + _orders_oracle("urgency", "o_orderkey", ", replace(o_orderpriority, '1-URGENT', '~') as urgency")
    + ")",
)
def sync_hot_null_key(spark, sf_dir):
    """Orders without a key are one hot group like any other."""
    urgency = F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT"))
    return _orders_verdicts(spark, sf_dir, "urgency", ["o_orderkey"], 100, urgency=urgency)


@query(
    "sync_hot_text_order",
    _orders_oracle("o_orderpriority", "label", ", concat('n', lpad(cast(o_orderkey as varchar), 12, '0')) as label", "label"),
)
def sync_hot_text_order(spark, sf_dir):
    """Hot keys whose rows are ordered by a text column."""
    label = F.concat(F.lit("n"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    return _orders_verdicts(spark, sf_dir, "o_orderpriority", ["label"], 100, label=label)


@query(
    "change_feed",
    f"""{_CTE} select p.canonical_job_id, p.seq,
          case p.change_type when 'NEW' then 'INSERT' else 'MODIFY' end as event_name, p.changed_fields,
          o.description as old_description, o.employment_type as old_employment_type,
          p.description as new_description, p.change_count
        from f p left join f o on p.change_type = 'CHANGED' and o.canonical_job_id = p.canonical_job_id and o.wn = p.old_wn
        where p.written""",
)
def change_feed(spark, sf_dir):
    rows, verdicts = classified(spark, sf_dir)
    feed = ch.change_feed(rows, verdicts, spec(), ch.IMAGE)
    return feed.select(
        "canonical_job_id",
        "seq",
        "event_name",
        F.array_join("changed_fields", ",").alias("changed_fields"),
        F.col("before.description").alias("old_description"),
        F.col("before.employment_type").alias("old_employment_type"),
        F.col("after.description").alias("new_description"),
        F.col("after.change_count").alias("change_count"),
    )


@query(
    "business_events",
    f"""{_CTE} select canonical_job_id, case when change_type = 'NEW' then 'NEW_JOB'
            when changed_fields not like '%,%' then concat(upper(changed_fields), '_CHANGED') else 'MULTIPLE_CHANGED' end as change_type,
          changed_fields, company, title, location, 'OPEN' as status,
          substr(sha256(concat(canonical_job_id, '|', seq)), 1, 32) as source_event_id
        from f where written""",
)
def business_events(spark, sf_dir):
    rows = postings(spark, sf_dir).withColumn("status", F.lit("OPEN"))
    feed = ch.change_feed(rows, fd.fold(rows, spec()), spec(), ch.IMAGE)
    events = ch.business_events(feed, spec().key)
    return events.withColumn("changed_fields", F.array_join("changed_fields", ","))


@query(
    "event_messages",
    f"""{_CTE} select canonical_job_id, seq, json_object('seq', seq, 'title', title) as message,
          salary_min is null as salary_left_out
        from f where written""",
)
def event_messages(spark, sf_dir):
    rows, verdicts = classified(spark, sf_dir)
    written = verdicts.filter("written").select("canonical_job_id", "seq")
    slim = rows.select("seq", "title", "salary_min").join(written, "seq")
    text = ch.as_messages(slim.select("seq", "title", "salary_min"), ["seq"])
    nulls_left_out = ~F.col("message").contains("salary_min")
    out = text.withColumn("salary_left_out", nulls_left_out).withColumn(
        "message", F.regexp_replace("message", r',"salary_min":[0-9.]+', "")
    )
    return out.join(written, "seq")


@query(
    "sync_rollup",
    f"""{_CTE} select coalesce(source, 'ALL') as source, coalesce(change_type, 'ALL') as change_type, count(*) as n
        from f group by rollup (source, change_type)""",
)
def rollup(spark, sf_dir):
    return sync_rollup(by_source(spark, sf_dir))


@query(
    "run_listing",
    f"""{_CTE} select seq, source, change_type,
          printf('%03d.', row_number() over (partition by source order by seq)) as label,
          concat('[', row_number() over (partition by source order by seq), '/', count(*) over (partition by source), ']') as progress
        from f""",
)
def run_listing(spark, sf_dir):
    listed = numbered_listing(by_source(spark, sf_dir), ["seq"])
    return listed.select("seq", "source", "change_type", "label", "progress")


@query(
    "run_metrics",
    f"""{_CTE}, s as (select source, {_COUNTS}, count(*) as n from f group by source)
        select source, unnest(['JobsFetched', 'JobsNew', 'JobsChanged', 'CacheHits', 'CacheMisses',
            'RedundantUpdatesPrevented', 'CrawlDurationSeconds', 'CrawlSuccesses']) as metric,
          unnest(['Count', 'Count', 'Count', 'Count', 'Count', 'Count', 'Seconds', 'Count']) as unit,
          cast(unnest([n, n_new, n_changed, n_unchanged, n_new + n_changed, n_unchanged, n, 1]) as double)
            / unnest([1, 1, 1, 1, 1, 1, 8, 1]) as value
        from s""",
)
def metrics_of_a_run(spark, sf_dir):
    return run_metrics(by_source(spark, sf_dir), ["source"], duration=F.count(F.lit(1)) / 8)


