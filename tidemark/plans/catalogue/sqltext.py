"""SQL fragments of the check queries (DuckDB dialect)."""

from __future__ import annotations

from tidemark.functions import text as tx
from tidemark.plans.views import JOBS_SQL, duck

_MARKUP = (
    r"(?is)<!--.*?-->|<![^>]*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|</?[a-z][^>]*>"
)


def clean(x: str) -> str:
    out = f"regexp_replace(coalesce({x}, ''), '{_MARKUP}', ' ', 'g')"
    for ref, char in tx.ENTITIES:
        if ref in ("&quot;", "&copy;", "&middot;", "&amp;"):
            out = f"replace({out}, '{ref}', '{char}')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def words(x: str) -> str:
    return rf"trim(regexp_replace(replace(lower({x}), '&', ' and '), '[^\p{{L}}\p{{N}}_+#.]+', ' ', 'g'))"


def norm(x: str) -> str:
    return words(clean(x))


def title(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in tx.TITLE_STOP_WORDS)
    kept = f"list_filter(string_split({norm(x)}, ' '), lambda w: w not in ({stop}) and w <> '')"
    return f"array_to_string(list_sort({kept}), ' ')"


def location(x: str) -> str:
    out = norm(x)
    for old, new in tx.CITY_ALIASES.items():
        out = rf"regexp_replace({out}, '\b{old}\b', '{new}', 'g')"
    return out


def employment(x: str) -> str:
    t = rf"regexp_replace(replace(replace(lower({clean(x)}), '-', ' '), '_', ' '), '\s+', ' ', 'g')"
    cases = " ".join(
        f"when regexp_matches(t, '{pattern}') then '{value}'" for value, pattern in tx.EMPLOYMENT_RULES
    )
    return f"(select case {cases} else 'OTHER' end from (select {t} as t))"


def label(x: str) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in tx.EMPLOYMENT_LABELS.items())
    return f"case {x} {cases} else 'Other' end"


def decimal_text(x: str) -> str:
    return rf"regexp_replace(cast(cast({x} as decimal(18,4)) as varchar), '\.?0+$', '')"


def canonical(company: str = "company", title_: str = "title", place: str = "location") -> str:
    return (
        f"substr(sha256(concat({norm(company)}, '|', {title(title_)}, '|', {location(place)})), 1, 16)"
    )


def content_hash() -> str:
    return (
        f"sha256(concat('company=', {norm('company')}, '|description=', {norm('description')}, "
        f"'|employment_type=', {employment('employment_type')}, '|location=', {location('location')}, "
        f"'|salary_max=', coalesce({decimal_text('salary_max')}, 'None'), "
        f"'|salary_min=', coalesce({decimal_text('salary_min')}, 'None'), "
        f"'|title=', {title('title')}))"
    )


def comparison_hash() -> str:
    salary = [words(f"coalesce({decimal_text(c)}, '')") for c in ("salary_min", "salary_max")]
    parts = [norm(c) for c in ("title", "company", "location", "employment_type")]
    parts += salary + [norm("description"), words("coalesce(apply_url, '')")]
    return f"sha256(concat({', chr(124), '.join(parts)}))"


#: Cleaned and derived postings of the jobs view: CTE ``j``.
JOBS = f"""
v_jobs as ({duck(JOBS_SQL)}),
c as (select seq, source, source_id, {clean('title')} as title, {clean('company')} as company,
        {clean('location')} as location, {employment('employment_type')} as employment_type,
        salary_min, salary_max, {clean('description')} as description, apply_url, published_at
      from v_jobs),
j as (select c.*, {canonical()} as canonical_job_id, {comparison_hash()} as chash from c)"""

TRACKED = (
    "title",
    "company",
    "location",
    "employment_type",
    "salary_min",
    "salary_max",
    "description",
    "apply_url",
)


def fold(rows: str, key: str, order: str, tracked: tuple[str, ...], at: str, chash: str = "chash") -> str:
    """CTEs ending in ``f``: the fold of ``rows`` with the values each row replaces."""
    w = f"(partition by {key} order by {order}"
    # The replaced row is found by number, so a null value is compared as a null.
    olds = (
        f"last_value(case when written then wn end ignore nulls) over {w} "
        "rows between unbounded preceding and 1 preceding) as old_wn"
    )
    names = ", ".join(
        f"case when o.{c} is distinct from p.{c} then '{c}' end" for c in tracked
    )
    return f"""
f1 as (select *, lag({chash}) over {w}) as prev from {rows}),
f2 as (select *, case when prev is null then 'NEW' when prev = {chash} then 'UNCHANGED'
         else 'CHANGED' end as change_type, prev is null or prev <> {chash} as written,
         row_number() over {w}) as wn, cast({at} as bigint) as at_ from f1),
f3 as (select *, {olds},
         first_value(at_) over {w} rows unbounded preceding) as first_seen,
         last_value(case when written then at_ end ignore nulls) over {w} rows unbounded preceding) as last_changed,
         cast(sum(case when change_type = 'CHANGED' then 1 else 0 end) over {w} rows unbounded preceding) as bigint) as change_count
       from f2),
f as (select p.*, case when p.change_type = 'CHANGED' then
         array_to_string(list_filter([{names}], lambda x: x is not null), ',') else '' end as changed_fields
       from f3 p left join f3 o on o.{key} = p.{key} and o.wn = p.old_wn)"""


def sync_cte() -> str:
    return f"with {JOBS}, {fold('j', 'canonical_job_id', 'seq', TRACKED, 'seq')}"
