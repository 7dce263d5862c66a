"""Views that turn the given tables into the library's input shapes.

``*_SQL`` texts are read by both engines: ``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

#: Latest instant of the event log plus one day, as epoch seconds.
AS_OF = 1706659200

#: Rows of each table the postings draw on; ``kk`` postings exist in eight versions each.
_COUNTED = """(select x.*, (select greatest(cast(floor(count(*) / 8) as bigint), 1) from {documents}) as kk,
    (select count(*) from {part}) as np, (select count(*) from {supplier}) as ns, (select count(*) from {nation}) as nn
  from {documents} as x) as d"""

#: Postings: every document, with title and company noise that normalises away.
#: Their number grows with the documents.
JOBS_SQL = f"""
select doc_id as seq, source, concat('d', cast(doc_id as varchar(20))) as source_id,
  case when doc_id % 2 = 0 then concat(p_name, ' - ', lower(p_type))
       else upper(concat(p_type, ' the ', p_name)) end as title,
  case when doc_id % 3 = 0 then upper(s_name) else s_name end as company,
  n_name as location,
  case cast(floor(doc_id / (3 * kk)) as bigint) % 4 when 0 then 'Full-Time' when 1 then 'full_time'
       when 2 then 'Contractor' else 'Temp role' end as employment_type,
  case when doc_id % 5 = 0 then null else cast(p_retailprice as decimal(18,2)) end as salary_min,
  case when doc_id % 5 = 0 then null else cast(p_retailprice + 10000 as decimal(18,2)) end as salary_max,
  concat('<p>Version ', cast(cast(floor(doc_id / (3 * kk)) as bigint) as varchar(20)),
         case when doc_id % 2 = 0 then ' &amp; more</p>' else '  &  MORE ' end) as description,
  concat('https://jobs.example.com/', cast(doc_id % kk as varchar(20))) as apply_url,
  concat('2024-01-', lpad(cast(doc_id % 28 + 1 as varchar(20)), 2, '0')) as published_at
from {_COUNTED}
join {{part}}     on p_partkey   = doc_id % kk % np
join {{supplier}} on s_suppkey   = doc_id % kk % ns
join {{nation}}   on n_nationkey = doc_id % kk % nn
"""

#: Postings whose description is the whole document text.
TEXT_JOBS_SQL = f"""
select doc_id, source, p_name as title, s_name as company, n_name as location,
  case doc_id % 6 when 0 then 'Full-Time' when 1 then 'part_time' when 2 then 'Freelance'
       when 3 then 'International' when 4 then 'temp' else '' end as employment_type,
  case when doc_id % 5 = 0 then null else cast(p_retailprice as decimal(18,2)) end as salary_min,
  cast(p_size * 1000 as decimal(18,2)) as salary_max,
  text as description,
  concat('https://jobs.example.com/', cast(doc_id as varchar(20)), '?a=1&b=2') as apply_url
from {_COUNTED}
join {{part}}     on p_partkey   = doc_id % np
join {{supplier}} on s_suppkey   = doc_id % ns
join {{nation}}   on n_nationkey = doc_id % nn
"""

_LOG_SQL = """
select event_id as seq, concat('src', cast(user_id % 20 as varchar(10))) as source_id, {TS} as ts,
  case event_type when 'signup' then 'START' when 'purchase' then 'SUCCESS' when 'view' then 'SUCCESS'
                  when 'error' then 'FAILURE'
                  else case when event_id % 50 = 0 then 'DISABLE' when event_id % 50 = 1 then 'ENABLE'
                            else 'SKIP' end end as kind,
  case when event_type = 'purchase' then event_id % 3 else 0 end as n_new,
  case when event_type = 'purchase' then event_id % 5 else 0 end as n_changed,
  case when event_type in ('purchase','view') then event_id % 7 else 0 end as n_unchanged,
  case when event_id % 4 = 0 then null else event_id % 11 end as n_fetched,
  value as duration
from {events}
"""
SPARK_LOG_SQL = _LOG_SQL.replace("{TS}", "unix_seconds(cast(ts as timestamp))")
DUCK_LOG_SQL = _LOG_SQL.replace("{TS}", "cast(floor(epoch(ts)) as bigint)")

_PAYLOADS_SQL = """
select concat('custom-', cast({FEED} as varchar(20))) as source_id, {PAGE} as page_no,
  case when {EMPTY} then null else k end as k,
  concat('{{"id":"p', cast(k as varchar(20)), '","position":{{"title":"', p_name, ' &amp; co"}},"employer":',
    case when k % 13 = 0 then 'null' else concat('{{"name":"', p_brand, '"}}') end,
    ',"tags":["', lower(p_type), '","full-time"],"pay":',
    case k % 4 when 0 then '"$120,000"' when 1 then cast(k as varchar(20)) when 2 then 'null' else '"n/a"' end,
    ',"remote":', case when k % 2 = 0 then 'true' else 'false' end, '}}') as o
from (select p_partkey as k, p_name, p_brand, p_type from {part}) as x
"""


def _payloads(feed: str, page: str, empty: str) -> str:
    return _PAYLOADS_SQL.replace("{FEED}", feed).replace("{PAGE}", page).replace("{EMPTY}", empty)


#: A landed page per ten parts, a configured feed per four pages: feeds grow with the parts.
PAYLOADS_SQL = _payloads("cast(floor(k / 40) as bigint)", "cast(floor(k % 40 / 10) as bigint)", "1 = 0")
#: Feeds of fifteen pages, beyond the ten a configuration asks for; every other feed has an
#: empty page among them, which ends its run.
STOPPED_SQL = _payloads(
    "cast(floor(k / 150) as bigint)",
    "cast(floor(k % 150 / 10) as bigint)",
    "cast(floor(k / 150) as bigint) % 2 = 1 and cast(floor(k % 150 / 10) as bigint) = 6",
)

#: Feed-shaped objects of the three built-in feeds, ten per page.
FEED_ITEMS_SQL = """
select s_suppkey as k, cast(floor(s_suppkey/10) as bigint) as page_no,
  concat('{{"guid":"', case when s_suppkey % 4 = 0 then '' else concat('g', cast(s_suppkey as varchar(20))) end,
    '","title":"<b>Role</b> ', s_name, '","companyName":"', n_name, ' &amp; Sons","locationRestrictions":',
    case when s_suppkey % 3 = 0 then '"Anywhere"' else concat('["', n_name, '","', r_name, '"]') end,
    ',"employmentType":"Full Time","minSalary":', cast(s_suppkey * 10 as varchar(20)),
    ',"maxSalary":', case when s_suppkey % 2 = 0 then 'null' else cast(s_suppkey * 20 as varchar(20)) end,
    ',"description":"<p>About ', s_name, '</p>","applicationLink":"https://a.example/', cast(s_suppkey as varchar(20)),
    '","pubDate":', case when s_suppkey % 5 = 0 then 'null' else '1704067200' end, '}}') as item_a,
  concat('{{"id":', cast(s_suppkey as varchar(20)), ',"jobTitle":"', s_name, ' lead","companyName":"', n_name,
    '","jobGeo":"', r_name, '","jobType":', case when s_suppkey % 3 = 0 then '"contract"' else '["full-time","<i>part</i> time"]' end,
    ',"jobDescription":"<p>Do &amp; learn</p>","url":"https://b.example/', cast(s_suppkey as varchar(20)),
    '","pubDate":"2024-01-01"}}') as item_b,
  case when s_suppkey % 10 = 0 then '{{"legal":"notice"}}' when s_suppkey % 10 = 1 then '"text"' else
  concat('{{"id":"', cast(s_suppkey as varchar(20)), '","position":"', s_name, ' eng","company":"', n_name,
    '","location":"', r_name, '","tags":["Full Time","sql","', case when s_suppkey % 2 = 0 then 'contract' else 'x' end,
    '"],"salary_min":', cast(s_suppkey as varchar(20)), ',"salary_max":0,"description":"d","apply_url":"',
    case when s_suppkey % 3 = 0 then '' else concat('https://c.example/', cast(s_suppkey as varchar(20))) end,
    '","url":"https://u.example/', cast(s_suppkey as varchar(20)), '","date":"2024-01-01"}}') end as item_c
from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
"""

#: Source configurations, one per supplier; each rule is broken by some of them.
CONFIGS_SQL = """
select s_suppkey as k,
  case when s_suppkey % 14 = 1 then '   ' else concat(s_name, ' feed') end as source_name,
  case when s_suppkey % 14 = 2 then 'http://api.example.com/jobs'
       when s_suppkey % 14 = 3 then 'https://10.1.2.3/jobs'
       else concat('https://api', cast(s_suppkey as varchar(20)), '.example.com/jobs') end as endpoint,
  case when s_suppkey % 14 = 4 then repeat('a', 251) when s_suppkey % 2 = 0 then null else 'data.jobs' end as records_path,
  case when s_suppkey % 14 = 5 then '{{"title":"t"}}'
       when s_suppkey % 14 = 6 then '{{"title":" ","company":"c"}}'
       when s_suppkey % 14 = 7 then '{{"title":"t","company":"c","salary":"s"}}'
       when s_suppkey % 14 = 8 then concat('{{"title":"t","company":"', repeat('c', 251), '"}}')
       when s_suppkey % 14 = 9 then null
       else '{{"title":"t","company":"c","location":"l"}}' end as fields_json,
  case when s_suppkey % 14 = 10 then 'CURSOR' when s_suppkey % 3 = 0 then 'page' else null end as pagination_type,
  case when s_suppkey % 7 = 4 then '9p' else 'page' end as page_parameter,
  case when s_suppkey % 14 = 11 then 'one' when s_suppkey % 14 = 12 then '-1' else null end as start_page,
  case when s_suppkey % 5 = 0 then '11' else null end as max_pages,
  case when s_suppkey % 14 = 13 then '60' when s_suppkey % 4 = 0 then '86400' else null end as crawl_interval
from {supplier}
"""

#: Source registry, one row per supplier.
REGISTRY_SQL = """
select concat(case when s_suppkey % 3 = 0 then 'custom-' else 'src' end, cast(s_suppkey as varchar(20))) as source_id,
  case when s_suppkey % 4 = 0 then '' else s_name end as source_name,
  case when s_suppkey % 3 = 0 then 'CUSTOM_API' when s_suppkey % 7 = 1 then null else 'BUILTIN' end as source_type,
  case s_suppkey % 5 when 0 then 'DISABLED' when 1 then 'ERROR' else 'ACTIVE' end as status,
  cast(900 + 60 * s_suppkey as varchar(20)) as crawl_interval,
  case when s_suppkey % 6 = 0 then null else 1706600000 + 1000 * s_suppkey end as next_check,
  s_suppkey % 4 as failure_count
from {supplier}
"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, text: str, **extra: DataFrame) -> DataFrame:
    """A view text over the tables it names."""
    used = {t: load(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used, **extra)


def duck(text: str) -> str:
    """The same text for the SQL check, with plain table names."""
    return text.format(**{t: t for t in TABLES})


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, JOBS_SQL)


def text_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, TEXT_JOBS_SQL)


def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, SPARK_LOG_SQL)


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, CONFIGS_SQL)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, REGISTRY_SQL)
