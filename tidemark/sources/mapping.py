"""Landed pages to posting rows, for every kind of feed in one pass.

How a feed is read is data.  A settings row has ``source_id``, ``adapter``
(``custom`` or a built-in name), ``source_ord``, ``records_path``, ``fields`` (posting
column to dotted path), ``others`` (a second path where the first gives nothing),
``lists`` (how a column that holds a list is read: ``join``, ``clean`` or ``tags``),
``required`` (records without a title value are metadata) and the paging of
configured feeds.  Payloads join their settings once, and one projection maps them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.paths import as_text, get_path, number_at
from tidemark.functions.values import MONEY, first_filled
from tidemark.sources.landed import is_object, parse_bodies, record_list

CUSTOM = "custom"

# The columns of a posting that a feed fills.
FIELDS = (
    "source_id",
    "title",
    "company",
    "location",
    "employment_type",
    "salary_min",
    "salary_max",
    "description",
    "apply_url",
    "published_at",
)

# Tags that name an employment type.
EMPLOYMENT_TAGS = (
    "full time",
    "full-time",
    "part time",
    "part-time",
    "contract",
    "contractor",
    "freelance",
    "internship",
    "intern",
    "temporary",
    "temp",
)

#: Columns in which a built-in feed may hold a list.
LISTS = ("location", "employment_type")
#: Columns that configured feeds clean and built-in feeds take as they are.
PLAIN = ("source_id", "apply_url", "published_at")
SALARIES = ("salary_min", "salary_max")


@dataclass(frozen=True)
class Adapter:
    """How a built-in feed is read; see the module for the meaning of the parts."""

    records: str
    fields: Mapping[str, str]
    others: Mapping[str, str] = field(default_factory=dict)
    lists: Mapping[str, str] = field(default_factory=dict)
    required: bool = False


def text_map(pairs: Mapping[str, str]) -> Column:
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def builtin_settings(spark: SparkSession, adapters: Mapping[str, Adapter]) -> DataFrame:
    """One settings row per built-in adapter."""
    rows = [
        F.struct(
            F.lit(name).alias("source_id"),
            F.lit(name).alias("adapter"),
            F.lit(at).alias("source_ord"),
            F.lit(a.records).alias("records_path"),
            text_map(a.fields).alias("fields"),
            text_map(a.others).alias("others"),
            text_map(a.lists).alias("lists"),
            F.lit(a.required).alias("required"),
            F.lit("NONE").alias("__paging"),
            F.lit(None).cast("bigint").alias("__start"),
            F.lit(None).cast("bigint").alias("__pages"),
        )
        for at, (name, a) in enumerate(adapters.items())
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def with_records(landed: DataFrame, settings: DataFrame, max_bytes: int | None = None, how: str = "inner") -> DataFrame:
    """Parsed pages with their settings and the array of records, or a reject reason.

    The pages are dealt out after the join, whichever side Spark sends around in it: else
    the few rows of the settings may decide how many tasks parse and map all pages.
    """
    joined = landed.join(settings, "source_id", how).repartition("source_id", "page_no")
    joined = parse_bodies(joined, max_bytes)
    joined = joined.withColumn("records", record_list(F.col("body"), F.col("records_path")))
    missing = F.when(F.col("records").isNull(), F.lit("no_record_array"))
    return joined.withColumn("reject", F.coalesce("reject", missing))


def _run(pages: DataFrame) -> DataFrame:
    """Pages that belong to the run of their feed, with ``__bad`` where a page of the same
    run was rejected.

    Pages of a paged feed lie in the configured range and before the first empty page;
    a feed without paging lands a single page.  All pages of a built-in feed belong to
    its run.  Two numbers per source are computed; no page is ordered against another.
    """
    paged = F.col("__paging") == "PAGE"
    since_start = F.col("page_no") - F.col("__start")
    beyond = F.col("__pages").isNotNull() & (since_start >= F.col("__pages"))
    in_range = pages.filter(~paged | ((since_start >= 0) & ~beyond))
    empty = (F.col("adapter") == CUSTOM) & (F.size("records") == 0)
    marks = in_range.groupBy("source_id").agg(
        F.min(F.when(empty, F.col("page_no"))).alias("__stop"),
        F.min(F.when(F.col("reject").isNotNull(), F.col("page_no"))).alias("__broken"),
    )
    run = in_range.join(marks, "source_id").filter(F.col("__stop").isNull() | (F.col("page_no") < F.col("__stop")))
    broken = F.col("__broken").isNotNull() & (F.col("__stop").isNull() | (F.col("__broken") < F.col("__stop")))
    return run.withColumn("__bad", broken).drop("__stop", "__broken")


def readable_pages(pages: DataFrame) -> DataFrame:
    """Pages of the feeds whose run is complete.

    A rejected page fails the run of its feed: a feed with a gap would pass for a
    complete one.
    """
    return _run(pages).filter(~F.col("__bad")).drop("__bad")


def _list_text(name: str, value: Column, plain: Column, tags: Sequence[str]) -> Column:
    """Text of a value that some feeds give as a list; ``plain`` is its text as one value."""
    how = F.col("lists")[name]
    elements = F.try_variant_get(value, "$", "array<variant>")
    if name == "employment_type":
        # Elements are cleaned natively here; the joined text is cleaned once more below.
        clean = F.transform(elements, lambda t: F.coalesce(tx.clean_text(as_text(t)), F.lit("")))
        kept = F.filter(F.transform(clean, lambda t: F.lower(t)), lambda t: t.isin(*tags))
        return (
            F.when(how == "clean", F.coalesce(F.array_join(clean, ", "), plain))
            .when(how == "tags", F.coalesce(F.array_join(kept, ", "), F.lit("")))
            .otherwise(plain)
        )
    joined = F.array_join(F.transform(elements, as_text), ", ")
    return F.when(how == "join", F.coalesce(joined, plain)).otherwise(plain)


def mapped(pages: DataFrame, exact: bool = True, tags: Sequence[str] = EMPLOYMENT_TAGS) -> DataFrame:
    """Posting rows of the valid records of all feeds.

    A record is an object; one of a configured feed has a title and a company.
    """
    records = pages.select(
        "source_id", "page_no", "adapter", "source_ord", "fields", "others", "lists", "required",
        F.posexplode_outer("records").alias("pos", "record"),
    ).filter(is_object("record"))
    paths = F.array(*[F.col("fields")[n] for n in FIELDS], *[F.col("others")[n] for n in PLAIN])
    # Extracted, read as text and cleaned in projections of their own: each step is one
    # expression over an array of the columns, and its result is used several times.
    kept = ("page_no", "pos", "adapter", "source_ord", "lists", "required")
    values = records.select(
        F.col("source_id").alias("source"), *kept, F.transform(paths, lambda p: get_path(F.col("record"), p)).alias("__values")
    )
    at = {name: i for i, name in enumerate([*FIELDS, *[f"__other_{name}" for name in PLAIN]])}
    values = values.filter(~F.col("required") | F.col("__values")[at["title"]].isNotNull())
    texts = values.withColumn("__texts", F.transform("__values", as_text))
    configured = F.col("adapter") == CUSTOM
    salary = {
        name: F.when(configured, number_at(F.col("__values")[at[name]]))
        .otherwise(F.try_variant_get(F.col("__values")[at[name]], "$", "double"))
        .try_cast(MONEY)
        for name in SALARIES
    }
    plain = [name for name in at if name not in (*SALARIES, *LISTS)]
    read = texts.select(
        "source",
        *kept,
        *[F.col("__texts")[at[name]].alias(name) for name in plain],
        *[_list_text(name, F.col("__values")[at[name]], F.col("__texts")[at[name]], tags).alias(name) for name in LISTS],
        *[c.alias(name) for name, c in salary.items()],
    )
    texts = {name: F.col(name) for name in FIELDS if name not in (*SALARIES, *PLAIN)}
    texts |= {f"__{name}": F.when(configured, F.col(name)) for name in PLAIN}
    rows = tx.cleaned(read, texts, exact)
    # A plain filter would be pushed below the cleaning and repeat all of it there.
    valid = ~configured | ((F.col("title") != "") & (F.col("company") != ""))
    rows = rows.withColumn("__valid", F.explode_outer(F.array(valid))).filter("__valid")
    taken = {
        name: F.when(configured, F.col(f"__{name}")).otherwise(
            F.coalesce(F.nullif(F.col(name), F.lit("")), F.col(f"__other_{name}"), F.lit(""))
        )
        for name in PLAIN
    }
    rows = rows.withColumns(taken)
    fallback = F.concat_ws("|", "company", "title", "location")
    own = F.when(configured, F.coalesce(first_filled("source_id", "apply_url"), fallback)).otherwise(F.col("source_id"))
    return rows.withColumn("source_id", own).select("source", "page_no", "pos", *FIELDS, "adapter", "source_ord")
