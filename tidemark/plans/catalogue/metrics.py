"""Distributions, shares and reports over postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import metrics as mt
from tidemark.plans import views
from tidemark.plans.catalogue import browse, query


@query(
    "source_distribution",
    """select case when doc_id % 40 = 0 then 'UNKNOWN' else source end as source, count(*) as n,
         cast(sum(count(*)) over () as bigint) as total from documents group by 1""",
)
def source_distribution(spark, sf_dir):
    return mt.source_distribution(_with_gaps(spark, sf_dir))


@query(
    "source_share",
    """with d as (select case when doc_id % 40 = 0 then null else source end as source from documents)
       select source, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 1) as share
       from d where source is not null group by 1""",
)
def source_share(spark, sf_dir):
    return mt.source_share(_with_gaps(spark, sf_dir))


@query(
    "distinct_sources",
    """with d as (select case when doc_id % 40 = 0 then null else source end as source from documents)
       select distinct source from d where source is not null""",
)
def distinct_sources(spark, sf_dir):
    return mt.distinct_sources(_with_gaps(spark, sf_dir))


def _with_gaps(spark, sf_dir):
    """Documents as postings; some lack the feed name."""
    docs = views.load(spark, sf_dir, "documents")
    return docs.select(F.when(F.col("doc_id") % 40 != 0, F.col("source")).alias("source"))


@query(
    "source_report",
    """with d as (select source, case when doc_id % 10 = 0 then null else 'OPEN' end as status,
           case when doc_id % 30 = 0 then null else concat('d', doc_id % 50) end as source_id from documents),
       ids as (select source, count(distinct source_id) + max(case when source_id is null then 1 else 0 end) as distinct_ids from d group by 1)
       select source, coalesce(status, 'UNKNOWN') as status, count(*) as n,
         cast(sum(count(*)) over (partition by source) as bigint) as records, any_value(distinct_ids) as distinct_ids
       from d join ids using (source) group by source, coalesce(status, 'UNKNOWN')""",
)
def source_report(spark, sf_dir):
    docs = views.load(spark, sf_dir, "documents")
    k = F.col("doc_id")
    postings = docs.select(
        "source",
        F.when(k % 10 != 0, F.lit("OPEN")).alias("status"),
        F.when(k % 30 != 0, F.concat(F.lit("d"), (k % 50).cast("string"))).alias("source_id"),
    )
    return mt.source_report(postings)


@query(
    "first_seen_listing",
    f"""with {browse._FINAL[5:]} select first_seen, canonical_job_id, source_id, company, title, status from s""",
)
def first_seen_listing(spark, sf_dir):
    return mt.first_seen_listing(browse.stored(spark, sf_dir))
