"""Data-quality passes over pages, configurations and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quality as ql
from tidemark.plans import views
from tidemark.plans.catalogue import query

_URL = r"""u as (select page_id, url, case when page_id % 9 = 0 then regexp_replace(url, '^https?://', 'https://user:pw@')
    when page_id % 9 = 1 then regexp_replace(url, '^https?://[^/]*', 'https://10.0.0.7:8443')
    when page_id % 9 = 2 then regexp_replace(url, '^https?://[^/]*', 'https://db.internal:443')
    when page_id % 9 = 3 then regexp_replace(url, '^https?://[^/]*', 'https://8.8.8.8') else url end as v from pages),
p as (select *, regexp_extract(v, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as authority from u),
h as (select *, lower(regexp_extract(regexp_replace(authority, '^.*@', ''), '^([^:]*)', 1)) as host,
    regexp_extract(regexp_replace(authority, '^.*@', ''), ':([^:]*)$', 1) as port from p)"""


@query(
    "url_quality",
    f"""with {_URL} select page_id, array_to_string(list_filter([
          case when not starts_with(lower(v), 'https:') then 'not_https' end,
          case when authority like '%@%' then 'credentials' end,
          case when v like '%#_%' then 'fragment' end,
          case when port not in ('', '443') then 'port' end,
          case when host like '%.internal' or host like '%.local' or host like '%.lan' then 'host_not_allowed' end,
          case when host like '10.%' then 'address_not_public' end], lambda x: x is not null), ',') as violations from h""",
)
def url_quality(spark, sf_dir):
    pages = views.load(spark, sf_dir, "pages")
    kind = F.col("page_id") % 9
    changed = (
        F.when(kind == 0, F.regexp_replace("url", "^https?://", "https://user:pw@"))
        .when(kind == 1, F.regexp_replace("url", "^https?://[^/]*", "https://10.0.0.7:8443"))
        .when(kind == 2, F.regexp_replace("url", "^https?://[^/]*", "https://db.internal:443"))
        .when(kind == 3, F.regexp_replace("url", "^https?://[^/]*", "https://8.8.8.8"))
        .otherwise(F.col("url"))
    )
    return pages.select("page_id", F.array_join(ql.url_violations(changed), ",").alias("violations"))


@query(
    "config_lint",
    f"""with c as ({views.duck(views.CONFIGS_SQL)}),
        d as (select *, k % 14 as m, upper(coalesce(pagination_type, 'NONE')) = 'PAGE' as paged from c)
        select k, array_to_string(list_filter([
          case when m = 1 then 'source_name' end, case when m in (2, 3) then 'endpoint' end,
          case when m = 4 then 'records_path' end, case when m = 9 then 'fields' end,
          case when m = 6 then 'no_title_path' end, case when m = 5 then 'no_company_path' end,
          case when m = 7 then 'unknown_field' end, case when m = 8 then 'long_path' end,
          case when m = 10 then 'pagination_type' end,
          case when paged and k % 7 = 4 then 'page_parameter' end,
          case when m = 11 then 'page_numbers' end,
          case when paged and (m = 12 or k % 5 = 0) then 'page_range' end,
          case when m = 13 then 'crawl_interval' end], lambda x: x is not null), ',') as violations
        from d""",
)
def config_lint(spark, sf_dir):
    configs = views.configs(spark, sf_dir).withColumn(
        "fields", F.from_json("fields_json", "map<string,string>")
    )
    return ql.config_lint(configs).select("k", F.array_join("violations", ",").alias("violations"))


@query(
    "page_overlap",
    """with r as (select concat('feed', l_suppkey) as feed, cast(floor(l_orderkey / 500) as bigint) as page, l_partkey as record_id from lineitem)
       select feed, record_id, count(distinct page) as n_pages, min(page) as first_page, max(page) as last_page
       from r group by all having count(distinct page) > 1""",
)
def page_overlap(spark, sf_dir):
    return ql.page_overlap(_paged(spark, sf_dir), "feed", "page", "record_id")


@query(
    "page_shared_ids",
    """select distinct l_partkey as record_id from lineitem where floor(l_orderkey / 500) = 0
       intersect select l_partkey from lineitem where floor(l_orderkey / 500) = 1""",
)
def page_shared_ids(spark, sf_dir):
    return ql.shared_ids(_paged(spark, sf_dir), "page", "record_id", 0, 1)


def _paged(spark, sf_dir):
    items = views.load(spark, sf_dir, "lineitem")
    return items.select(
        F.concat(F.lit("feed"), F.col("l_suppkey").cast("string")).alias("feed"),
        F.floor(F.col("l_orderkey") / 500).cast("bigint").alias("page"),
        F.col("l_partkey").alias("record_id"),
    )


@query(
    "feed_profile",
    """with e as (select event_type, props, unnest(json_keys(props)) as field from events),
       t as (select event_type, count(*) as n_records, cast(sum(strlen(props)) as bigint) as n_bytes, 0 as n_invalid from events group by 1)
       select event_type, field, count(*) as n_with_field,
         string_agg(distinct case json_type(props, concat('$.', field)) when 'UBIGINT' then 'BIGINT' else json_type(props, concat('$.', field)) end, ',') as kinds,
         any_value(n_records) as n_records, any_value(n_bytes) as n_bytes, any_value(n_invalid) as n_invalid
       from e join t using (event_type) group by event_type, field""",
)
def feed_profile(spark, sf_dir):
    return ql.feed_profile(views.load(spark, sf_dir, "events"), ["event_type"], "props")


@query(
    "feed_schema",
    "select event_type, 'OBJECT<k: BIGINT>' as schema from events group by 1",
)
def feed_schema(spark, sf_dir):
    return ql.schema_profile(views.load(spark, sf_dir, "events"), ["event_type"], "props")


_MIXED = """select doc_id, source, case when doc_id % 2 = 0 then concat('{"id":', doc_id, ',"size":', n_chars, ',"lang":"', lang, '"}')
    else concat('{"id":', doc_id, ',"size":"', n_chars, '"}') end as body from documents"""


def mixed_bodies(spark, sf_dir):
    """Records of two shapes: the size is a number or a text, the language may be absent."""
    docs = views.load(spark, sf_dir, "documents")
    number = F.col("n_chars").cast("string")
    head = F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"))
    even = F.concat(head, F.lit(',"size":'), number, F.lit(',"lang":"'), "lang", F.lit('"}'))
    odd = F.concat(head, F.lit(',"size":"'), number, F.lit('"}'))
    return docs.select("doc_id", "source", F.when(F.col("doc_id") % 2 == 0, even).otherwise(odd).alias("body"))


@query(
    "feed_samples",
    f"""select source, arg_min(body, doc_id) as sample,
          case when min(doc_id) % 2 = 0 then 'id,size,lang' else 'id,size' end as fields from ({_MIXED}) group by 1""",
)
def feed_samples(spark, sf_dir):
    return ql.samples(mixed_bodies(spark, sf_dir), ["source"], "body", "doc_id")


@query(
    "feed_schema_merged",
    f"""select source, concat('OBJECT<id: BIGINT', case when bool_or(json_exists(body, '$.lang')) then ', lang: STRING' else '' end, ', size: ',
          case when count(distinct json_type(body, '$.size') = 'VARCHAR') = 2 then 'VARIANT'
            when bool_or(json_type(body, '$.size') = 'VARCHAR') then 'STRING' else 'BIGINT' end, '>') as schema
        from ({_MIXED}) group by 1""",
)
def feed_schema_merged(spark, sf_dir):
    return ql.schema_profile(mixed_bodies(spark, sf_dir), ["source"], "body")
