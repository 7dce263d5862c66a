"""Built-in feeds, dispatch by source type, and all feeds in one table.

Built-in feeds are described by data like configured ones (see ``mapping``); all
landed payloads ``(source_id, page_no, payload)`` are mapped by one scan and one
projection.  Text columns are cleaned, derived columns are added by ``finalize``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.identity import finalize
from tidemark.sources import custom, mapping
from tidemark.sources.mapping import Adapter

#: Columns every adapter yields, in order.
POSTING = ("source", "page_no", "pos", *mapping.FIELDS)

# Where each built-in feed keeps its records and their parts.
BUILTIN: dict[str, Adapter] = {
    "himalayas": Adapter(
        records="jobs",
        fields={
            "source_id": "guid",
            "title": "title",
            "company": "companyName",
            "location": "locationRestrictions",
            "employment_type": "employmentType",
            "salary_min": "minSalary",
            "salary_max": "maxSalary",
            "description": "description",
            "apply_url": "applicationLink",
            "published_at": "pubDate",
        },
        others={"source_id": "applicationLink"},
        lists={"location": "join"},
    ),
    "jobicy": Adapter(
        records="jobs",
        fields={
            "source_id": "id",
            "title": "jobTitle",
            "company": "companyName",
            "location": "jobGeo",
            "employment_type": "jobType",
            "description": "jobDescription",
            "apply_url": "url",
            "published_at": "pubDate",
        },
        lists={"employment_type": "clean"},
    ),
    "remoteok": Adapter(
        records="$",
        fields={
            "source_id": "id",
            "title": "position",
            "company": "company",
            "location": "location",
            "employment_type": "tags",
            "salary_min": "salary_min",
            "salary_max": "salary_max",
            "description": "description",
            "apply_url": "apply_url",
            "published_at": "date",
        },
        others={"apply_url": "url"},
        lists={"employment_type": "tags"},
        required=True,
    ),
}


def adapt(landed: DataFrame, name: str, exact: bool = True, adapters: Mapping[str, Adapter] = BUILTIN) -> DataFrame:
    """Posting rows of one built-in feed: every readable page, whatever the others hold."""
    known = mapping.builtin_settings(landed.sparkSession, {name: adapters[name]})
    pages = mapping.with_records(landed, known).filter("reject is null")
    return mapping.mapped(pages, exact).select(*POSTING)


def dispatch(sources: DataFrame, adapters: Mapping[str, Adapter] = BUILTIN) -> DataFrame:
    """Adds ``adapter`` to each source: a built-in name, ``custom`` or null (unknown)."""
    kind = F.upper(F.coalesce(F.nullif(F.col("source_type"), F.lit("")), F.lit("BUILTIN")))
    built_in = kind.isin("BUILTIN", "NONE") & F.col("source_id").isin(*adapters)
    return sources.withColumn(
        "adapter",
        F.when(kind == "CUSTOM_API", F.lit("custom")).when(built_in, F.col("source_id")),
    )


def settings(landed: DataFrame, sources: DataFrame, adapters: Mapping[str, Adapter] = BUILTIN) -> DataFrame:
    """Settings of all feeds: built-in ones, unless the registry gives their id another
    type, and configured ones.  Built-in feeds need no registry row."""
    out = mapping.builtin_settings(landed.sparkSession, adapters)
    if "source_type" not in sources.columns:
        return out
    known = dispatch(sources, adapters)
    other = known.filter(F.col("source_id").isin(*adapters) & ~F.col("adapter").eqNullSafe(F.col("source_id")))
    out = out.join(other.select("source_id"), "source_id", "left_anti")
    if "api_config" in sources.columns:
        out = out.unionByName(custom.settings(known.filter(F.col("adapter") == mapping.CUSTOM), len(adapters)))
    return out


def union_feeds(
    landed: DataFrame,
    sources: DataFrame,
    adapters: Mapping[str, Adapter] = BUILTIN,
    exact: bool = True,
    derive: bool = True,
) -> DataFrame:
    """Postings of all feeds whose run is complete, in one table, with ``source_ord`` in
    feed order.  :func:`rejects` has the pages that could not be read."""
    pages = mapping.with_records(landed, settings(landed, sources, adapters))
    out = mapping.mapped(mapping.readable_pages(pages), exact).drop("adapter")
    return finalize(out) if derive else out


def rejects(landed: DataFrame, sources: DataFrame, adapters: Mapping[str, Adapter] = BUILTIN) -> DataFrame:
    """``(source_id, page_no, reason)`` of every landed page that gives no postings:
    unreadable bodies of built-in and configured feeds, and pages no adapter serves."""
    pages = mapping.with_records(landed, settings(landed, sources, adapters), how="left")
    types = F.lit(None).cast("string") if "source_type" not in sources.columns else F.col("source_type")
    known = sources.groupBy("source_id").agg(F.max(types).alias("__type"))
    unserved = F.when(F.col("__type").isNull(), F.lit("unknown_source")).otherwise(F.lit("unsupported_source_type"))
    reason = F.when(F.col("adapter").isNull(), unserved).otherwise(F.col("reject"))
    narrow = pages.select("source_id", "page_no", "adapter", "reject").filter("adapter is null or reject is not null")
    judged = narrow.join(known, "source_id", "left")
    return judged.select("source_id", "page_no", reason.alias("reason"))


def unknown_payloads(
    landed: DataFrame, sources: DataFrame, adapters: Mapping[str, Adapter] = BUILTIN
) -> DataFrame:
    """Landed payloads no adapter serves, with the reason."""
    known = dispatch(sources, adapters).select("source_id", "source_type", "adapter")
    joined = landed.join(known, "source_id", "left").filter("adapter is null")
    reason = F.when(F.col("source_type").isNull(), F.lit("unknown_source")).otherwise(
        F.lit("unsupported_source_type")
    )
    return joined.select("source_id", "page_no", reason.alias("reason"))
