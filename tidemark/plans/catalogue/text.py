"""Scalar functions over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.identity import WORDS, canonical_id, comparable, comparison_hash, content_hash, storage_id
from tidemark.functions.values import hit_rate, number_or_none, shown_time
from tidemark.operators.catalog import display
from tidemark.operators.metrics import cross_source_duplicates
from tidemark.plans import views
from tidemark.plans.catalogue import query
from tidemark.plans.catalogue import sqltext as q
from tidemark.plans.jobs import clean_postings


@query("clean_html_pages", f"select page_id, {q.clean('html')} as clean from pages")
def clean_html_pages(spark, sf_dir):
    pages = views.load(spark, sf_dir, "pages")
    return tx.cleaned(pages.select("page_id", "html"), {"clean": "html"}, exact=True).drop("html")


@query("normalize_text_docs", f"select doc_id, {q.norm('text')} as normal from documents")
def normalize_text_docs(spark, sf_dir):
    docs = views.load(spark, sf_dir, "documents")
    clean = tx.cleaned(docs.select("doc_id", "text"), ["text"], exact=True)
    return clean.select("doc_id", tx.fold_words(F.col("text")).alias("normal"))


@query(
    "paragraphs",
    r"""select doc_id, generate_subscripts(p, 1) - 1 as pos, unnest(p) as paragraph
        from (select doc_id, regexp_split_to_array(text, '\n+') as p from documents)""",
)
def paragraphs(spark, sf_dir):
    docs = views.load(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.posexplode(tx.paragraphs("text")).alias("pos", "paragraph")
    ).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "employment_type_norm",
    f"""with v as ({views.duck(views.TEXT_JOBS_SQL)})
        select doc_id, kind, {q.label('kind')} as label
        from (select doc_id, {q.employment('employment_type')} as kind from v)""",
)
def employment_type_norm(spark, sf_dir):
    jobs = views.text_jobs(spark, sf_dir)
    kinds = jobs.select("doc_id", tx.employment_type("employment_type").alias("kind"))
    return kinds.withColumn("label", tx.employment_label("kind"))


@query(
    "normalize_location_title",
    f"""with v as ({views.duck(views.JOBS_SQL)}),
        w as (select seq, title, case when seq % 4 = 0 then concat('Bengaluru, ', location)
                when seq % 4 = 1 then concat('Old Madras & ', location) else location end as location from v)
        select seq, {q.title('title')} as title_key, {q.location('location')} as place from w""",
)
def normalize_location_title(spark, sf_dir):
    old_names = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("Bengaluru, "), "location")).when(
        F.col("seq") % 4 == 1, F.concat(F.lit("Old Madras & "), "location")
    )
    jobs = views.jobs(spark, sf_dir).withColumn("location", F.coalesce(old_names, "location"))
    return jobs.select(
        "seq", tx.normalize_title("title").alias("title_key"), tx.normalize_location("location").alias("place")
    )


@query(
    "canonical_ids",
    f"with v as ({views.duck(views.JOBS_SQL)}) select seq, {q.canonical()} as canonical_job_id from v",
)
def canonical_ids(spark, sf_dir):
    return views.jobs(spark, sf_dir).select("seq", canonical_id(exact=True).alias("canonical_job_id"))


@query(
    "content_hashes",
    f"with v as ({views.duck(views.TEXT_JOBS_SQL)}) select doc_id, {q.content_hash()} as content_hash from v",
)
def content_hashes(spark, sf_dir):
    jobs = tx.cleaned(views.text_jobs(spark, sf_dir), (*WORDS, "employment_type"), exact=True)
    return jobs.select("doc_id", content_hash(clean=False).alias("content_hash"))


@query(
    "comparison_hashes",
    f"with v as ({views.duck(views.TEXT_JOBS_SQL)}) select doc_id, {q.comparison_hash()} as comparison_hash from v",
)
def comparison_hashes(spark, sf_dir):
    jobs = tx.cleaned(views.text_jobs(spark, sf_dir), comparable(), exact=True)
    return jobs.select("doc_id", comparison_hash(clean=False).alias("comparison_hash"))


_NOTICE = (
    "  Please mention the word **WORD** when applying to show you read the job post completely (tag)."
)


@query(
    "volatile_text_strip",
    rf"""select doc_id, source, trim(case when source = 'src7' then
           regexp_replace(t, '(?is)\s*Please mention the word\b.*?when applying to show you read the job post completely.*$', '')
           else t end, e' \n\t\r') as stable
         from (select doc_id, source, concat(text, '{_NOTICE}') as t from documents)""",
)
def volatile_text_strip(spark, sf_dir):
    docs = views.load(spark, sf_dir, "documents")
    pattern = {"src7": tx.VOLATILE_PATTERNS["remoteok"]}
    noisy = F.concat("text", F.lit(_NOTICE))
    return docs.select("doc_id", "source", tx.strip_volatile("source", noisy, pattern).alias("stable"))


@query(
    "cross_source_duplicates",
    f"""with v as ({views.duck(views.JOBS_SQL)}), k as (select {q.canonical()} as canonical_job_id, source from v)
        select canonical_job_id, count(*) as n_rows, count(distinct source) as n_sources,
          string_agg(distinct source, ',' order by source) as sources
        from k group by 1 having count(*) > 1""",
)
def duplicates(spark, sf_dir):
    jobs = views.jobs(spark, sf_dir).withColumn("canonical_job_id", canonical_id())
    return cross_source_duplicates(jobs)


_SALARY = """case when salary_min is null and salary_max is null then 'Salary not specified'
  when salary_max is null then concat({a}, '+') when salary_min is null then concat('Up to ', {b})
  else concat({a}, ' - ', {b}) end"""


def _grouped(x: str) -> str:
    whole = f"cast(floor({x}) as bigint)"
    fraction = rf"regexp_replace(printf('%.3f', cast({x} - {whole} as double)), '^0|\.?0+$', '', 'g')"
    return f"concat(format('{{:,}}', {whole}), {fraction})"


_MODE = """case when regexp_matches(t, 'remote|work from home|work-from-home|fully distributed') then 'Remote'
  when regexp_matches(t, 'hybrid|flexible location|partial remote') then 'Hybrid' else 'On-site' end"""


@query(
    "display_fields",
    f"""with v as ({views.duck(views.TEXT_JOBS_SQL)})
        select doc_id, {_SALARY.format(a=_grouped('salary_min'), b=_grouped('salary_max'))} as salary_text,
          case when length(description) > 240 then concat(substr(description, 1, 240), '...') else description end as preview,
          {q.label(q.employment('employment_type'))} as employment_label,
          (select {_MODE} from (select lower(concat_ws(' ', location, description, title)) as t)) as work_mode,
          apply_url as storage_id
        from v""",
)
def display_fields(spark, sf_dir):
    jobs = views.text_jobs(spark, sf_dir).withColumn("canonical_job_id", F.lit(None).cast("string"))
    return display(jobs, extra=["doc_id"])


@query(
    "storage_ids",
    f"""with v as ({views.duck(views.TEXT_JOBS_SQL)})
        select doc_id, case when doc_id % 3 = 0 then {q.canonical()} when doc_id % 3 = 1 then apply_url
          else concat(source, ':', title, ':', company) end as storage_id from v""",
)
def storage_ids(spark, sf_dir):
    jobs = views.text_jobs(spark, sf_dir)
    third = F.col("doc_id") % 3
    jobs = jobs.withColumn("canonical_job_id", F.when(third == 0, canonical_id())).withColumn(
        "apply_url", F.when(third < 2, F.col("apply_url"))
    )
    return jobs.select("doc_id", storage_id().alias("storage_id"))


@query(
    "storage_ids_job",
    f"""with v as ({views.duck(views.TEXT_JOBS_SQL)})
        select doc_id, case doc_id % 4 when 0 then {q.canonical()} when 1 then concat('job-', doc_id) when 2 then apply_url
          else concat(source, ':', title, ':', company) end as storage_id from v""",
)
def storage_ids_job(spark, sf_dir):
    """Rows with a canonical id and a job id, a job id, a URL, or none of them."""
    jobs = views.text_jobs(spark, sf_dir)
    fourth = F.col("doc_id") % 4
    jobs = jobs.withColumns(
        {
            "canonical_job_id": F.when(fourth == 0, canonical_id()).when(fourth == 1, F.lit("")),
            "job_id": F.when(fourth < 2, F.concat(F.lit("job-"), F.col("doc_id").cast("string"))),
            "apply_url": F.when(fourth < 3, F.col("apply_url")),
        }
    )
    return jobs.select("doc_id", storage_id("job_id").alias("storage_id"))


@query(
    "event_values",
    r"""select event_id,
          case when try_cast(regexp_replace(props, '[^0-9.+-]', '', 'g') as double) >= 0
            then try_cast(regexp_replace(props, '[^0-9.+-]', '', 'g') as double) end as number,
          case when length(g) <= 3 then g else concat(ltrim(reverse(regexp_replace(
            reverse(left(g, length(g) - 3)), '(\d\d)', '\1,', 'g')), ','), ',', right(g, 3)) end as grouped,
          strftime(to_timestamp(1704067200 + event_id) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as shown,
          round(100.0 * (event_id % 7) / nullif(event_id % 7 + event_id % 3, 0), 1) as raw_rate
        from (select *, cast(user_id * 100003 as varchar) as g from events)""",
)
def event_values(spark, sf_dir):
    events = views.load(spark, sf_dir, "events")
    misses, hits = F.col("event_id") % 3, F.col("event_id") % 7
    return events.select(
        "event_id",
        number_or_none("props").alias("number"),
        tx.grouped_number(F.col("user_id") * 100003).alias("grouped"),
        shown_time(F.lit(1704067200) + F.col("event_id")).alias("shown"),
        F.when(hits + misses > 0, hit_rate(hits, misses)).alias("raw_rate"),
    )


def cleaned_jobs(spark, sf_dir):
    return clean_postings(views.jobs(spark, sf_dir))
