"""Catalog search, paging and lookup over the stored postings."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tidemark.operators import catalog as ct
from tidemark.operators import maintenance as mn
from tidemark.operators import page_directory, text_index
from tidemark.plans import views
from tidemark.plans.catalogue import query
from tidemark.plans.catalogue import sqltext as q
from tidemark.session import work_dir
from tidemark.sources.snapshots import StateTable
from tidemark.plans.catalogue.sync import final_postings
from tidemark.session import written

_FINAL = f"""{q.sync_cte()},
s as (select canonical_job_id, source, source_id, title, company, location, employment_type, description, first_seen, last_changed,
        case when last_changed % 3 = 0 then 'CLOSED' else 'OPEN' end as status
      from f where written qualify row_number() over (partition by canonical_job_id order by seq desc) = 1)"""


def stored(spark, sf_dir):
    """Stored postings; a third of them was closed by hand."""
    closed = F.when(F.col("last_changed") % 3 == 0, F.lit("CLOSED")).otherwise(F.lit("OPEN"))
    return written(final_postings(spark, sf_dir).withColumn("status", closed), "stored")


_HAYSTACK = "lower(concat_ws(' ', nullif(title, ''), nullif(company, ''), nullif(location, ''), nullif(description, ''), nullif(employment_type, '')))"


@query(
    "faceted_search",
    f"""with v as ({views.duck(views.TEXT_JOBS_SQL)}) select doc_id, title, source from v
        where source = 'src7' and contains({_HAYSTACK}, 'the') and contains(lower(location), 'a')
          and {q.employment('employment_type')} in ('PART_TIME')
          and not regexp_matches(lower(concat_ws(' ', location, description, title)), 'remote|work from home|work-from-home|fully distributed|hybrid|flexible location|partial remote')""",
)
def faceted_search(spark, sf_dir):
    found = ct.search(
        views.text_jobs(spark, sf_dir),
        query="THE",
        source="src7",
        location=" A ",
        work_mode="On-site",
        employment_type="PART_TIME",
    )
    return found.select("doc_id", "title", "source")


@query(
    "text_search",
    f"with v as ({views.duck(views.TEXT_JOBS_SQL)}) select doc_id, source, employment_type from v where contains({_HAYSTACK}, 'fre')",
)
def text_search(spark, sf_dir):
    found = ct.search(views.text_jobs(spark, sf_dir), query="Fre")
    return found.select("doc_id", "source", "employment_type")


@query(
    "saved_jobs",
    f"""with v as ({views.duck(views.TEXT_JOBS_SQL)}) select doc_id, apply_url from v
        where apply_url in (select concat('https://jobs.example.com/', doc_id, '?a=1&b=2') from labels where quality = 1)""",
)
def saved_jobs(spark, sf_dir):
    labels = views.load(spark, sf_dir, "labels").filter("quality = 1")
    saved = labels.select(
        F.concat(F.lit("https://jobs.example.com/"), F.col("doc_id").cast("string"), F.lit("?a=1&b=2")).alias("id")
    )
    jobs = views.text_jobs(spark, sf_dir).withColumn("canonical_job_id", F.lit(None).cast("string"))
    return ct.search(jobs, saved=saved).select("doc_id", "apply_url")


@query(
    "list_page",
    f"""with {_FINAL[5:]}, hit as (select * from s where lower(status) = 'open' and canonical_job_id > '4'),
        ranked as (select canonical_job_id, title, status, row_number() over (order by canonical_job_id) as rn, count(*) over () as n from hit),
        page as (select * from ranked where rn <= 25)
        select canonical_job_id, title, status, n > 25 as has_more, case when n > 25 then max(canonical_job_id) over () end as next_key from page""",
)
def list_page(spark, sf_dir):
    got = ct.page(stored(spark, sf_dir), limit="25", after="4", status="open")
    return got.select("canonical_job_id", "title", "status", "has_more", "next_key")


@query(
    "page_numbers",
    f"""with {_FINAL[5:]} select canonical_job_id, row_number() over (order by canonical_job_id) as row_no,
          cast(ceil(row_number() over (order by canonical_job_id) / 25.0) as bigint) as page_no from s""",
)
def page_numbers(spark, sf_dir):
    got = ct.page_numbers(stored(spark, sf_dir), size=25)
    return got.select("canonical_job_id", "row_no", "page_no")


_SEARCHES = ("Fre", "ea", "ing the", "is and re", "worthless")


@query(
    "indexed_search",
    f"""with v as ({views.duck(views.TEXT_JOBS_SQL)}) select asked, doc_id, title
        from (select unnest({[s.lower() for s in _SEARCHES]}) as asked) join v on contains({_HAYSTACK}, asked)""",
)
def indexed_search(spark, sf_dir):
    """Postings indexed in two batches, then asked for a short, some common and some rare texts."""
    path = work_dir(spark, "text-index")
    jobs = views.text_jobs(spark, sf_dir)
    for batch in range(2):
        text_index.add(jobs.filter(F.col("doc_id") % 2 == batch), path, batch, ["doc_id"])
    found = [
        text_index.search(spark, path, s).select(F.lit(s.lower()).alias("asked"), "doc_id", "title") for s in _SEARCHES
    ]
    return functools.reduce(lambda a, b: a.unionByName(b), found)


@query(
    "page_at",
    f"""with {_FINAL[5:]}, numbered as (select canonical_job_id, title, row_number() over (order by canonical_job_id) as row_no,
            cast(ceil(count(*) over () / 25.0) as bigint) as n from s)
        select canonical_job_id, title, row_no, cast(ceil(row_no / 25.0) as bigint) as page_no from numbered
        where cast(ceil(row_no / 25.0) as bigint) in (1, n // 2, n)""",
)
def page_at(spark, sf_dir):
    """The first, a middle and the last page, and the empty one after it."""
    path = work_dir(spark, "pages")
    page_directory.store(stored(spark, sf_dir).select("canonical_job_id", "title"), path, range_rows=1_000)
    last = page_directory.pages_in(spark, path, 25)
    pages = [page_directory.read_page(spark, path, n, 25) for n in (1, last // 2, last, last + 1)]
    return functools.reduce(lambda a, b: a.unionByName(b), pages)


@query(
    "lookup_keys",
    f"""with {_FINAL[5:]}, ask as (select seq, case when seq % 7 = 0 then '' when seq % 5 = 0 then concat('x', canonical_job_id) else canonical_job_id end as k from j)
        select seq, nullif(k, '') as canonical_job_id, case when k = '' then 400 when s.canonical_job_id is null then 404 else 200 end as outcome, s.title
        from ask left join s on s.canonical_job_id = k""",
)
def lookup_keys(spark, sf_dir):
    from tidemark.plans.catalogue.sync import postings

    seq = F.col("seq")
    asked = postings(spark, sf_dir).select(
        "seq",
        F.when(seq % 7 == 0, F.lit(""))
        .when(seq % 5 == 0, F.concat(F.lit("x"), "canonical_job_id"))
        .otherwise(F.col("canonical_job_id"))
        .alias("canonical_job_id"),
    )
    found = stored(spark, sf_dir).select("canonical_job_id", "title")
    return ct.lookup(asked, found).select("seq", "canonical_job_id", "outcome", "title")


@query(
    "recent_and_open",
    f"""with {_FINAL[5:]} select count(*) as loaded, count(*) filter (status = 'OPEN') as open_jobs,
          count(*) filter (last_changed <> 0 and 172800000 - last_changed * 1000 <= 86400000) as recently_changed from s""",
)
def recent_and_open(spark, sf_dir):
    return ct.overview(stored(spark, sf_dir), as_of_ms=172_800_000)


@query(
    "recently_changed_orders",
    """select o_orderkey from orders
       where (select epoch(max(o_orderdate)) from orders) * 1000 - floor(epoch(o_orderdate)) * 1000 <= 86400000""",
)
def recently_changed_orders(spark, sf_dir):
    """Seconds and milliseconds side by side: even orders carry milliseconds."""
    orders = views.load(spark, sf_dir, "orders")
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    stamped = orders.withColumn(
        "last_changed", F.when(F.col("o_orderkey") % 2 == 0, seconds * 1000).otherwise(seconds)
    )
    last = orders.agg(F.max("o_orderdate")).first()[0]
    as_of_ms = int((last - __import__("datetime").datetime(1970, 1, 1)).total_seconds() * 1000)
    return stamped.filter(ct.recently_changed(as_of_ms)).select("o_orderkey")


@query(
    "backfill_employment",
    f"""with v as ({views.duck(views.TEXT_JOBS_SQL)}) select doc_id, employment_type as old_employment_type, kind as employment_type
        from (select doc_id, employment_type, {q.employment('employment_type')} as kind from v) where kind <> employment_type""",
)
def backfill_employment(spark, sf_dir):
    fixed = mn.employment_backfill(views.text_jobs(spark, sf_dir))
    return fixed.select("doc_id", "old_employment_type", "employment_type")


@query(
    "backfill_counts",
    """select count(*) filter (k <> 'OPEN') as updated, count(*) filter (k = 'OPEN') as unchanged from (
         select case when o_orderstatus = 'O' then 'OPEN' else 'x' end as k from orders)""",
)
def backfill_counts(spark, sf_dir):
    orders = views.load(spark, sf_dir, "orders")
    done = F.when(F.col("o_orderstatus") == "O", F.lit("FULL_TIME")).otherwise(F.lit("full-time"))
    return mn.backfill_counts(orders.select(done.alias("employment_type")))


@query(
    "backfill_written",
    f"""with v as ({views.duck(views.TEXT_JOBS_SQL)}), k as (select *, {q.employment('employment_type')} as kind from v)
        select doc_id, title, kind as employment_type, (select count(*) filter (kind <> employment_type) from k) as updated,
          (select count(*) filter (kind = employment_type) from k) as unchanged, 0 as updated_again from k""",
)
def backfill_written(spark, sf_dir):
    """Postings stored as they came, back-filled in the table, and once more."""
    table = StateTable(spark, work_dir(spark, "backfill"), ["doc_id"])
    table.upsert(views.text_jobs(spark, sf_dir).select("doc_id", "title", "employment_type"))
    first, second = mn.write_backfill(table), mn.write_backfill(table)
    counts = {"updated": first["updated"], "unchanged": first["unchanged"], "updated_again": second["updated"]}
    return table.read().withColumns({name: F.lit(n).cast("bigint") for name, n in counts.items()})


@query(
    "delete_keys",
    f"with {_FINAL[5:]} select canonical_job_id, title from s where canonical_job_id not in (select canonical_job_id from j where source = 'src3')",
)
def delete_keys(spark, sf_dir):
    from tidemark.plans.catalogue.sync import postings

    gone = postings(spark, sf_dir).filter("source = 'src3'").select("canonical_job_id")
    return mn.without_keys(stored(spark, sf_dir), gone).select("canonical_job_id", "title")
