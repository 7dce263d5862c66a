"""Landed payloads through adapters, configured mapping and paging rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import decimal_text
from tidemark.plans import views
from tidemark.plans.catalogue import query
from tidemark.plans.catalogue import sqltext as q
from tidemark.session import work_dir
from tidemark.sources import custom, feeds
from tidemark.sources.landed import parse_bodies

_FIELDS = {
    "source_id": "id",
    "title": " position.title ",
    "company": "employer.name",
    "location": "",
    "employment_type": "tags.1",
    "description": "remote",
    "salary_min": "pay",
}


def payloads(spark, sf_dir, text: str = views.PAYLOADS_SQL) -> DataFrame:
    """Landed pages of configured feeds; a page is one aggregated document."""
    records = views.run(spark, sf_dir, text)
    ordered = F.array_sort(F.collect_list(F.struct("k", "o")))
    kept = F.filter(ordered, lambda x: x["k"].isNotNull())
    body = F.array_join(F.transform(kept, lambda x: x["o"]), ",")
    # Ten parts make a page, so the list that is collected never grows.
    pages = records.groupBy("source_id", "page_no").agg(body.alias("items"))
    return pages.select(
        "source_id",
        "page_no",
        F.concat(F.lit('{"data":{"jobs":['), "items", F.lit("]}}")).alias("payload"),
    )


def configs(spark, sf_dir) -> DataFrame:
    """One configuration per configured feed that occurs in the parts."""
    parts = views.load(spark, sf_dir, "part")
    number = F.floor(F.col("p_partkey") / 40)
    ids = parts.select(F.concat(F.lit("custom-"), number.cast("string")).alias("source_id"))
    fields = F.create_map(*[F.lit(x) for kv in _FIELDS.items() for x in kv])
    config = F.struct(
        F.lit("https://api.example.com/jobs").alias("endpoint"),
        F.lit("data.jobs").alias("records_path"),
        fields.alias("fields"),
        F.struct(
            F.lit("page").alias("type"),
            F.lit("page").alias("page_parameter"),
            F.lit(0).cast("bigint").alias("start_page"),
            F.lit(10).cast("bigint").alias("max_pages"),
        ).alias("pagination"),
    )
    return ids.distinct().select("source_id", F.lit("CUSTOM_API").alias("source_type"), config.alias("api_config"))


def _records(text: str) -> str:
    return f"""x as ({views.duck(text)}),
pg as (select source_id, page_no, concat('{{"data":{{"jobs":[', coalesce(string_agg(o, ',' order by k) filter (k is not null), ''), ']}}}}') as payload
       from x group by all),
stop as (select source_id, min(page_no) as stop from pg where json_array_length(payload, '$.data.jobs') = 0 group by 1),
rd as (select pg.* from pg left join stop using (source_id) where page_no < 10 and (stop is null or page_no < stop)),
rec as (select source_id as source, page_no, unnest(json_extract(payload, '$.data.jobs[*]')) as r,
          unnest(range(cast(json_array_length(payload, '$.data.jobs') as bigint))) as pos from rd),
m0 as (select source, page_no, pos, coalesce(r->>'$.id', '') as source_id, {q.clean("r->>'$.position.title'")} as title,
         coalesce(r->>'$.employer.name', '') as company, '' as location, r->>'$.tags[1]' as employment_type,
         case r->>'$.remote' when 'true' then 'True' else 'False' end as description,
         r->'$.pay' as pay, '' as apply_url, '' as published_at from rec),
m1 as (select *, case when json_type(pay) = 'VARCHAR' then try_cast(nullif(regexp_replace(pay->>'$', '[^0-9.+-]', '', 'g'), '') as double)
         else try_cast(pay->>'$' as double) end as salary from m0 where title <> '' and company <> ''),
m as (select source, page_no, pos, source_id, title, company, location, employment_type,
        {q.decimal_text('salary')} as salary_min, cast(null as varchar) as salary_max, description, apply_url, published_at from m1)"""


_RECORDS = _records(views.PAYLOADS_SQL)

_OUT = "source, page_no, pos, source_id, title, company, location, employment_type, salary_min, salary_max, description, apply_url, published_at"


def _shown(postings: DataFrame) -> DataFrame:
    """Money as exact text, positions as whole numbers."""
    return postings.withColumns(
        {
            "salary_min": decimal_text("salary_min"),
            "salary_max": decimal_text("salary_max"),
            "pos": F.col("pos").cast("bigint"),
        }
    ).select(*_OUT.split(", "))


@query("map_custom_records", f"with {_RECORDS} select {_OUT} from m")
def map_custom_records(spark, sf_dir):
    pages = custom.readable_pages(custom.with_records(payloads(spark, sf_dir), configs(spark, sf_dir)))
    return _shown(custom.mapped(pages))


@query(
    "page_stop_and_cap",
    f"with {_records(views.STOPPED_SQL)} select {_OUT} from m qualify row_number() over (partition by source order by page_no, pos) <= 50",
)
def page_stop_and_cap(spark, sf_dir):
    landed = payloads(spark, sf_dir, views.STOPPED_SQL)
    return _shown(custom.map_records(landed, configs(spark, sf_dir), limit=50))


@query(
    "preview_sample",
    f"""with {_RECORDS}, one as (select *, row_number() over (partition by source order by pos) as rn from m where page_no = 0)
        select source, pos, title, company, location, {q.employment('employment_type')} as employment_type, apply_url,
          count(*) over (partition by source) as sample_count,
          (select count(*) from rec where rec.source = one.source and page_no = 0) as records_seen
        from one where rn <= 3""",
)
def preview_sample(spark, sf_dir):
    shown = custom.preview(payloads(spark, sf_dir), configs(spark, sf_dir))
    return shown.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "rejected_pages",
    """with d as (select doc_id % 5 as s, doc_id, case when doc_id % 3 = 0 then '{"data":{"jobs":7}}' when doc_id % 3 = 1 then text
           else '{"data":{"jobs":[]}}' end as payload from documents)
       select concat('custom-', s) as source_id, doc_id as page_no,
         case when json_valid(payload) then 'no_record_array' else 'not_json' end as reject
       from d where not json_valid(payload) or json_type(case when json_valid(payload) then payload end, '$.data.jobs') <> 'ARRAY'""",
)
def rejected_pages(spark, sf_dir):
    docs = views.load(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 3
    landed = docs.select(
        F.concat(F.lit("custom-"), (F.col("doc_id") % 5).cast("string")).alias("source_id"),
        F.col("doc_id").alias("page_no"),
        F.when(kind == 0, F.lit('{"data":{"jobs":7}}')).when(kind == 1, F.col("text"))
        .otherwise(F.lit('{"data":{"jobs":[]}}')).alias("payload"),
    )
    return custom.rejected_pages(landed, configs(spark, sf_dir))


def feed_pages(spark, sf_dir) -> DataFrame:
    """Landed pages of the three built-in feeds, built from the suppliers."""
    items = views.run(spark, sf_dir, views.FEED_ITEMS_SQL)

    def page(source: str, item: str, head: str, tail: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("k", F.col(item).alias("o"))))
        body = F.array_join(F.transform(ordered, lambda x: x["o"]), ",")
        pages = items.groupBy("page_no").agg(body.alias("items"))
        return pages.select(
            F.lit(source).alias("source_id"), "page_no", F.concat(F.lit(head), "items", F.lit(tail)).alias("payload")
        )

    a = page("himalayas", "item_a", '{"jobs":[', "]}")
    b = page("jobicy", "item_b", '{"jobs":[', "]}")
    c = page("remoteok", "item_c", "[", "]")
    return a.unionByName(b).unionByName(c)


_ITEMS = f"""i as ({views.duck(views.FEED_ITEMS_SQL)}),
raw as (select k, page_no, row_number() over (partition by page_no order by k) - 1 as pos,
          item_a::json as a, item_b::json as b, item_c::json as c from i)"""
_A = f"""a as (select 'himalayas' as source, page_no, pos, coalesce(nullif(a->>'$.guid', ''), a->>'$.applicationLink') as source_id,
    {q.clean("a->>'$.title'")} as title, {q.clean("a->>'$.companyName'")} as company,
    case when json_type(a, '$.locationRestrictions') = 'ARRAY' then array_to_string(a->>'$.locationRestrictions[*]', ', ')
      else a->>'$.locationRestrictions' end as location, a->>'$.employmentType' as employment_type,
    a->>'$.minSalary' as salary_min, a->>'$.maxSalary' as salary_max, {q.clean("a->>'$.description'")} as description,
    a->>'$.applicationLink' as apply_url, coalesce(a->>'$.pubDate', '') as published_at from raw)"""
_B = f"""b as (select 'jobicy' as source, page_no, pos, b->>'$.id' as source_id, b->>'$.jobTitle' as title,
    b->>'$.companyName' as company, b->>'$.jobGeo' as location,
    case when json_type(b, '$.jobType') = 'ARRAY' then array_to_string(list_transform(b->>'$.jobType[*]', lambda t: {q.clean('t')}), ', ')
      else b->>'$.jobType' end as employment_type, cast(null as varchar) as salary_min, cast(null as varchar) as salary_max,
    {q.clean("b->>'$.jobDescription'")} as description, b->>'$.url' as apply_url, b->>'$.pubDate' as published_at from raw)"""
_C = """c as (select 'remoteok' as source, page_no, pos, c->>'$.id' as source_id, c->>'$.position' as title, c->>'$.company' as company,
    c->>'$.location' as location, array_to_string(list_filter(list_transform(c->>'$.tags[*]', lambda t: lower(t)),
      lambda t: t in ('full time', 'contract')), ', ') as employment_type,
    c->>'$.salary_min' as salary_min, c->>'$.salary_max' as salary_max, c->>'$.description' as description,
    coalesce(nullif(c->>'$.apply_url', ''), c->>'$.url') as apply_url, c->>'$.date' as published_at
  from raw where json_type(c) = 'OBJECT' and json_exists(c, '$.position'))"""


def _one_feed(spark, sf_dir, name):
    landed = feed_pages(spark, sf_dir).filter(F.col("source_id") == name)
    return _shown(feeds.adapt(landed, name))


@query("adapter_a", f"with {_ITEMS}, {_A} select {_OUT} from a")
def adapter_a(spark, sf_dir):
    return _one_feed(spark, sf_dir, "himalayas")


@query("adapter_b", f"with {_ITEMS}, {_B} select {_OUT} from b")
def adapter_b(spark, sf_dir):
    return _one_feed(spark, sf_dir, "jobicy")


@query("adapter_c", f"with {_ITEMS}, {_C} select {_OUT} from c")
def adapter_c(spark, sf_dir):
    return _one_feed(spark, sf_dir, "remoteok")


@query(
    "union_feeds",
    f"""with {_ITEMS}, {_A}, {_B}, {_C}, {_RECORDS}, capped as (select {_OUT} from m),
        un as (select 0 as source_ord, {_OUT} from a union all select 1, {_OUT} from b union all select 2, {_OUT} from c
               union all select 3, {_OUT} from capped)
        select source_ord, source, page_no, pos, source_id, {q.employment('employment_type')} as employment_type,
          {q.canonical()} as canonical_job_id, {q.content_hash()} as content_hash from un""",
)
def union_feeds(spark, sf_dir):
    landed = feed_pages(spark, sf_dir).unionByName(payloads(spark, sf_dir))
    out = feeds.union_feeds(landed, configs(spark, sf_dir))
    return out.select(
        "source_ord",
        "source",
        "page_no",
        F.col("pos").cast("bigint").alias("pos"),
        "source_id",
        "employment_type",
        "canonical_job_id",
        "content_hash",
    )


@query(
    "dispatch_sources",
    f"""with reg as ({views.duck(views.REGISTRY_SQL)}), r2 as (select source_id, case when source_type = 'CUSTOM_API' and source_id like '%9' then 'FTP' else source_type end as source_type from reg)
        select source_id, case when source_type = 'CUSTOM_API' then 'custom'
          when coalesce(source_type, 'BUILTIN') = 'BUILTIN' and source_id in ('src1', 'src2') then source_id end as adapter from r2""",
)
def dispatch_sources(spark, sf_dir):
    registry = views.registry(spark, sf_dir)
    odd = (F.col("source_type") == "CUSTOM_API") & F.col("source_id").endswith("9")
    registry = registry.withColumn("source_type", F.when(odd, F.lit("FTP")).otherwise(F.col("source_type")))
    known = {name: feeds.BUILTIN["jobicy"] for name in ("src1", "src2")}
    return feeds.dispatch(registry, known).select("source_id", "adapter")


@query(
    "unknown_payloads",
    f"""with reg as ({views.duck(views.REGISTRY_SQL)})
        select concat('src', user_id % 25) as source_id, event_id as page_no,
          case when reg.source_type is null then 'unknown_source' else 'unsupported_source_type' end as reason
        from events left join reg on reg.source_id = concat('src', user_id % 25)""",
)
def unknown_payloads(spark, sf_dir):
    events = views.load(spark, sf_dir, "events")
    landed = events.select(
        F.concat(F.lit("src"), (F.col("user_id") % 25).cast("string")).alias("source_id"),
        F.col("event_id").alias("page_no"),
    )
    return feeds.unknown_payloads(landed, views.registry(spark, sf_dir))


@query(
    "payload_bodies",
    """with d as (select doc_id, case when doc_id % 2 = 0 then text
             else cast(json_object('text', text, 'n', n_chars) as varchar) end as payload from documents)
       select doc_id, case when payload is null then 'no_body' when not json_valid(payload) then 'not_json' end as reject,
         cast(json_extract(case when json_valid(payload) then payload end, '$.n') as bigint) as n from d""",
)
def payload_bodies(spark, sf_dir):
    """Whole documents as bodies: half of them plain text, half JSON."""
    docs = views.load(spark, sf_dir, "documents")
    payload = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(
        F.to_json(F.struct("text", F.col("n_chars").alias("n")))
    )
    bodies = parse_bodies(docs.select("doc_id", payload.alias("payload")))
    return bodies.select("doc_id", "reject", F.try_variant_get("body", "$.n", "bigint").alias("n"))


@query(
    "pipeline_rejects",
    f"""with reg as ({views.duck(views.REGISTRY_SQL)}), d as (
          select doc_id as page_no, case doc_id % 4 when 0 then 'himalayas' when 1 then 'custom-1' when 2 then 'nowhere' else 'remoteok' end as source_id,
            case doc_id % 3 when 0 then text when 1 then '{{"jobs":7}}' else '{{"jobs":[]}}' end as payload from documents)
        select source_id, page_no, case when source_id = 'nowhere' then 'unknown_source'
            when not json_valid(payload) then 'not_json' else 'no_record_array' end as reason from d
        where source_id = 'nowhere' or not json_valid(payload)
          or (json_type(case when json_valid(payload) then payload end, case when source_id = 'remoteok' then '$' else '$.jobs' end) <> 'ARRAY')""",
)
def pipeline_rejects(spark, sf_dir):
    """Every landed page that gives no postings, over all kinds of feeds."""
    docs = views.load(spark, sf_dir, "documents")
    to, kind = F.col("doc_id") % 4, F.col("doc_id") % 3
    landed = docs.select(
        F.when(to == 0, "himalayas").when(to == 1, "custom-1").when(to == 2, "nowhere").otherwise("remoteok").alias("source_id"),
        F.col("doc_id").alias("page_no"),
        F.when(kind == 0, F.col("text")).when(kind == 1, F.lit('{"jobs":7}')).otherwise(F.lit('{"jobs":[]}')).alias("payload"),
    )
    sources = configs(spark, sf_dir).withColumn(
        "api_config", F.col("api_config").withField("records_path", F.lit("jobs"))
    )
    return feeds.rejects(landed, sources)


@query(
    "scheduled_tick",
    f"""with {_ITEMS}, {_A}, {_B}, {_C}, {_RECORDS}, un as (select source from a union all select source from b
               union all select source from c union all select source from m)
        select source as source_id, count(*) as jobs, cast(0 as bigint) as failure_count,
          cast({views.AS_OF} + 3600 as bigint) as next_check, 'SKIPPED' as decision, 'not_due' as reason
        from un group by 1""",
)
def scheduled_tick(spark, sf_dir):
    """One run from the gate to the log; a minute later no feed is due again."""
    landed = feed_pages(spark, sf_dir).unionByName(payloads(spark, sf_dir))
    return _ticked(spark, sf_dir, landed)


def _ticked(spark, sf_dir, landed: DataFrame) -> DataFrame:
    """A run over ``landed`` and the gate a minute later, from the stored summaries."""
    from tidemark.operators.gate import gate
    from tidemark.operators.source_state import shown, summary_table
    from tidemark.plans.jobs import KEY, sync_due_feeds
    from tidemark.sources.snapshots import StateTable

    root = work_dir(spark, "tick")
    built_in = feed_pages(spark, sf_dir).select("source_id").distinct().withColumn("source_type", F.lit("BUILTIN"))
    sources = configs(spark, sf_dir).unionByName(built_in, allowMissingColumns=True).withColumns(
        {
            "status": F.lit("ACTIVE"),
            "next_check": F.lit(None).cast("bigint"),
            "crawl_interval": F.lit(3600).cast("bigint"),
            "failure_count": F.lit(0).cast("bigint"),
        }
    )
    sync_due_feeds(landed, sources, StateTable(spark, f"{root}/state", [KEY]), root, views.AS_OF, 0)
    again = gate(shown(summary_table(spark, f"{root}/summaries").read(), registry=sources), views.AS_OF + 60)
    return again.select(
        "source_id", F.col("total_jobs_processed").alias("jobs"), "failure_count", "next_check", "decision", "reason"
    )


#: Feeds whose second page does not arrive whole in ``scheduled_tick_gaps``.
_BROKEN = "source in ('jobicy', 'remoteok') or (source like 'custom-%' and try_cast(substr(source, 8) as bigint) % 3 = 1)"


@query(
    "scheduled_tick_gaps",
    f"""with {_ITEMS}, {_A}, {_B}, {_C}, {_RECORDS}, un as (select source from a union all select source from b
               union all select source from c union all select source from m)
        select source as source_id, cast(case when {_BROKEN} then 0 else count(*) end as bigint) as jobs,
          cast(case when {_BROKEN} then 1 else 0 end as bigint) as failure_count,
          case when not ({_BROKEN}) then cast({views.AS_OF} + 3600 as bigint) end as next_check,
          case when {_BROKEN} then 'QUEUED' else 'SKIPPED' end as decision, case when not ({_BROKEN}) then 'not_due' end as reason
        from un group by 1""",
)
def scheduled_tick_gaps(spark, sf_dir):
    """A page of built-in and of configured feeds is cut off: their runs fail as a whole
    and are due again, the others succeed."""
    number = F.col("source_id").substr(F.lit(8), F.length("source_id")).try_cast("bigint")
    hit = F.col("source_id").isin("jobicy", "remoteok") | (F.col("source_id").startswith("custom-") & (number % 3 == 1))
    cut = F.when(hit & (F.col("page_no") == 0), F.substring("payload", 1, 9)).otherwise(F.col("payload"))
    landed = feed_pages(spark, sf_dir).unionByName(payloads(spark, sf_dir)).withColumn("payload", cut)
    return _ticked(spark, sf_dir, landed)
