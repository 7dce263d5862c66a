"""Catalog queries over stored postings: search, paging, lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.identity import KEY, storage_id
from tidemark.functions.values import epoch_ms
from tidemark.operators.ordered import HOT_ROWS, row_numbers

MAX_PAGE = 100
DAY_MS = 86_400_000


# --------------------------------------------------------------- predicates


def equals_ignoring_case(column: str, value: str) -> Column:
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))) == F.lit(value.lower())


def matches_text(query: str) -> Column:
    haystack = tx.search_text("title", "company", "location", "description", "employment_type")
    return haystack.contains(query.lower())


def matches_location(place: str) -> Column:
    return F.lower(F.coalesce("location", F.lit(""))).contains(place.strip().lower())


def recently_changed(as_of_ms: int, column: str = "last_changed") -> Column:
    """Changed within the last day; missing, zero or non-numeric is false."""
    ms = epoch_ms(column)
    return F.coalesce((ms != 0) & (F.lit(as_of_ms) - ms <= DAY_MS), F.lit(False))


def is_open() -> Column:
    return F.coalesce(F.col("status") == "OPEN", F.lit(False))


# ------------------------------------------------------------------- search


def search(
    jobs: DataFrame,
    query: str = "",
    source: str = "all",
    location: str = "",
    work_mode: str = "all",
    employment_type: str = "all",
    saved: DataFrame | None = None,
) -> DataFrame:
    """Faceted search; every blank or ``all`` facet is left out of the plan.

    Cheap predicates come first and plain column predicates reach the scan.
    ``saved`` is a table of storage ids; membership is a semi-join.
    """
    out = jobs
    if source != "all":
        out = out.filter(F.col("source") == source)
    if employment_type != "all":
        out = out.filter(tx.employment_type("employment_type", clean=False) == employment_type)
    if location.strip():
        out = out.filter(matches_location(location))
    if query:
        out = out.filter(matches_text(query))
    if work_mode != "all":
        out = out.filter(tx.work_mode("location", "description", "title") == work_mode)
    if saved is not None:
        ids = saved.select(F.col(saved.columns[0]).alias("__storage_id")).distinct()
        out = out.withColumn("__storage_id", storage_id())
        out = out.join(ids, "__storage_id", "left_semi").drop("__storage_id")
    return out


# ------------------------------------------------------------------- paging


def page_size(wanted: object = None, most: int = MAX_PAGE) -> int:
    """Rows of a page; ``most`` if none are named.  Anything but a whole number from
    1 to ``most`` is refused."""
    if wanted is None:
        return most
    try:
        size = int(str(wanted))
    except ValueError:
        raise ValueError(f"a page size is a whole number, not {wanted!r}") from None
    if not 1 <= size <= most:
        raise ValueError(f"a page holds 1 to {most} rows, not {size}")
    return size


def page(
    jobs: DataFrame,
    limit: object = None,
    after: str | None = None,
    source: str | None = None,
    status: str | None = None,
    key: str = KEY,
) -> DataFrame:
    """One keyset page: filters first, then the rows after ``after`` in key order.

    Adds ``has_more`` and ``next_key`` (the key to continue from, null at the
    end).  One row beyond the page is read to know whether more follow.
    """
    size = page_size(limit)
    out = jobs
    if source:
        out = out.filter(equals_ignoring_case("source", source))
    if status:
        out = out.filter(equals_ignoring_case("status", status))
    if after is not None:
        out = out.filter(F.col(key) > after)
    head = out.orderBy(key).limit(size + 1)
    # One row more than a page from here on.
    whole = Window.partitionBy(F.lit(0))
    ranked = head.withColumns(
        {
            "__rn": F.row_number().over(whole.orderBy(key)),
            "__n": F.count(F.lit(1)).over(whole),
        }
    )
    has_more = F.col("__n") > size
    kept = ranked.filter(F.col("__rn") <= size).withColumn("has_more", has_more)
    last = F.max(key).over(whole)
    return kept.withColumn("next_key", F.when(F.col("has_more"), last)).drop("__rn", "__n")


def page_numbers(
    jobs: DataFrame, size: int = MAX_PAGE, key: str = KEY, slice_rows: int = HOT_ROWS
) -> DataFrame:
    """Every row with its page number in key order, without a global sort.

    Rows are numbered inside key ranges of about ``slice_rows`` rows; only the row
    counts of the ranges are ordered globally.
    """
    numbered = row_numbers(jobs, [key], hot_rows=slice_rows)
    return numbered.withColumn("page_no", F.ceil(F.col("row_no") / size).cast("bigint"))


# ------------------------------------------------------------------- lookup


def lookup(requests: DataFrame, jobs: DataFrame, key: str = KEY) -> DataFrame:
    """Requested keys with outcome 200, 404 or 400 (no key) and the found row."""
    asked = requests.withColumn("__key", F.nullif(F.col(key), F.lit(""))).drop(key)
    found = jobs.withColumn("__found", F.lit(True)).withColumnRenamed(key, "__key")
    joined = asked.join(found, "__key", "left")
    outcome = (
        F.when(F.col("__key").isNull(), F.lit(400)).when(F.col("__found"), F.lit(200)).otherwise(F.lit(404))
    )
    return joined.withColumn("outcome", outcome).withColumnRenamed("__key", key).drop("__found")


# ------------------------------------------------------------------ overview


def overview(jobs: DataFrame, as_of_ms: int) -> DataFrame:
    """Loaded, open and recently changed rows in one pass."""
    return jobs.agg(
        F.count(F.lit(1)).alias("loaded"),
        F.count_if(is_open()).alias("open_jobs"),
        F.count_if(recently_changed(as_of_ms)).alias("recently_changed"),
    )


def display(jobs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Derived display columns of each posting."""
    return jobs.select(
        *extra,
        tx.salary_text("salary_min", "salary_max").alias("salary_text"),
        tx.preview("description").alias("preview"),
        tx.employment_label(tx.employment_type("employment_type", clean=False)).alias("employment_label"),
        tx.work_mode("location", "description", "title").alias("work_mode"),
        storage_id().alias("storage_id"),
    )
