"""Feeds described by configuration rows instead of code.

A configuration row has ``source_id`` and ``api_config`` with ``records_path``,
``fields`` (map of posting column to dotted path) and ``pagination``.  It becomes a
settings row of :mod:`tidemark.sources.mapping`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import employment_type
from tidemark.sources import mapping
from tidemark.sources.mapping import CUSTOM, FIELDS, readable_pages  # noqa: F401

CONFIG_TYPE = (
    "struct<endpoint:string,records_path:string,fields:map<string,string>,"
    "pagination:struct<type:string,page_parameter:string,start_page:bigint,max_pages:bigint>>"
)
#: Pages a configuration may ask for (checked by ``quality.config_lint``, never clamped here).
MAX_PAGES = 10
PREVIEW_ROWS = 3


def clean_mapping(fields: Column) -> Column:
    """Field map with trimmed paths and without empty ones."""
    trimmed = F.transform_values(fields, lambda _, path: F.trim(path))
    return F.map_filter(trimmed, lambda _, path: F.coalesce(path, F.lit("")) != "")


def settings(configs: DataFrame, source_ord: int = 0) -> DataFrame:
    """Settings rows of configured feeds; a paged feed that names no limit has none."""
    empty = mapping.text_map({})
    return configs.select(
        "source_id",
        F.lit(CUSTOM).alias("adapter"),
        F.lit(source_ord).alias("source_ord"),
        F.trim(F.coalesce("api_config.records_path", F.lit("jobs"))).alias("records_path"),
        clean_mapping(F.col("api_config.fields")).alias("fields"),
        empty.alias("others"),
        empty.alias("lists"),
        F.lit(False).alias("required"),
        F.upper(F.coalesce("api_config.pagination.type", F.lit("NONE"))).alias("__paging"),
        F.coalesce("api_config.pagination.start_page", F.lit(1)).cast("bigint").alias("__start"),
        F.col("api_config.pagination.max_pages").cast("bigint").alias("__pages"),
    )


def with_records(landed: DataFrame, configs: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Parsed pages with their settings and the array of records, or a reject reason."""
    return mapping.with_records(landed, settings(configs), max_bytes)


def mapped(pages: DataFrame, exact: bool = True) -> DataFrame:
    """Posting rows of the valid records: objects with a title and a company."""
    return mapping.mapped(pages, exact).drop("adapter", "source_ord")


def capped(postings: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` valid records of each source; the rank filter becomes a
    group limit before the shuffle."""
    order = Window.partitionBy("source").orderBy("page_no", "pos")
    ranked = postings.withColumn("__rank", F.row_number().over(order))
    return ranked.filter(F.col("__rank") <= limit).drop("__rank")


def map_records(
    landed: DataFrame,
    configs: DataFrame,
    limit: int | None = None,
    exact: bool = True,
    max_bytes: int | None = None,
) -> DataFrame:
    """Pages -> stop rule -> mapped valid records; ``limit`` records per source if asked for."""
    rows = mapped(readable_pages(with_records(landed, configs, max_bytes)), exact)
    return rows if limit is None else capped(rows, limit)


def rejected_pages(
    landed: DataFrame, configs: DataFrame, max_bytes: int | None = None
) -> DataFrame:
    """Pages that could not be read, with the reason."""
    pages = with_records(landed, configs, max_bytes)
    return pages.filter("reject is not null").select("source_id", "page_no", "reject")


def preview(
    landed: DataFrame,
    configs: DataFrame,
    rows: int = PREVIEW_ROWS,
    exact: bool = True,
    max_bytes: int | None = None,
) -> DataFrame:
    """First page of each source: the first valid rows, how many, and how many
    records the page holds."""
    pages = with_records(landed, configs, max_bytes)
    paged = F.col("__paging") == "PAGE"
    first = pages.filter(F.col("reject").isNull() & (~paged | (F.col("page_no") == F.col("__start"))))
    seen = first.groupBy("source_id").agg(F.sum(F.size("records")).alias("records_seen"))
    sample = capped(mapped(first, exact), rows)
    sizes = sample.groupBy("source").agg(F.count(F.lit(1)).alias("sample_count"))
    return (
        sample.join(sizes, "source")
        .join(seen.withColumnRenamed("source_id", "source"), "source")
        .select(
            "source",
            "pos",
            "title",
            "company",
            "location",
            employment_type("employment_type", clean=False).alias("employment_type"),
            "apply_url",
            "sample_count",
            "records_seen",
        )
    )
