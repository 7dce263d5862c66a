"""Change feed and business events, derived from written verdicts only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.fold import LIFECYCLE, FoldSpec, touched

#: Columns of a stored posting shown in before and after images.
IMAGE = (
    "source",
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
    "status",
)


def change_feed(
    batch: DataFrame,
    verdicts: DataFrame,
    spec: FoldSpec,
    image: Sequence[str],
    state: DataFrame | None = None,
) -> DataFrame:
    """INSERT and MODIFY events with before and after images.

    UNCHANGED rows emit nothing.  Both image joins are on key and order, so the
    rows of a hot key spread over all tasks.
    """
    key, order = list(spec.key), list(spec.order)
    columns = [c for c in image if c in batch.columns]
    written = verdicts.filter("written")
    after = batch.select(*key, *order, *columns).join(written, [*key, *order])
    images = batch.select(
        *key, *[F.col(c).alias(f"__{c}") for c in order], F.struct(*columns).alias("before")
    )
    if state is not None:
        kinds = {f.name: f.dataType for f in batch.schema.fields}
        stored = touched(state, batch, key).select(
            *key,
            *[F.lit(None).cast(kinds[c]).alias(f"__{c}") for c in order],
            F.struct(
                *[
                    (F.col(c) if c in state.columns else F.lit(None)).cast(kinds[c]).alias(c)
                    for c in columns
                ]
            ).alias("before"),
        )
        images = images.unionByName(stored)
    images = images.select(
        *[F.col(c).alias(f"__k_{c}") for c in key], *[f"__{c}" for c in order], "before"
    )
    same: Column = F.lit(True)
    for c in key:
        same = same & (F.col(c) == F.col(f"__k_{c}"))
    for c in order:
        same = same & F.col(f"replaces.{c}").eqNullSafe(F.col(f"__{c}"))
    # A NEW row has no stored row, hence no image with null order columns.
    joined = after.join(images, same, "left")
    return joined.select(
        *key,
        *order,
        event_id(key, order).alias("event_id"),
        F.when(F.col("change_type") == "NEW", F.lit("INSERT")).otherwise(F.lit("MODIFY")).alias("event_name"),
        "changed_fields",
        "before",
        F.struct(*columns, *LIFECYCLE).alias("after"),
    )


def event_id(key: Sequence[str], order: Sequence[str]) -> Column:
    """Repeatable id: re-delivery of a row yields the same event."""
    parts = [F.col(c).cast("string") for c in (*key, *order)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def business_events(feed: DataFrame, key: Sequence[str]) -> DataFrame:
    """One event per change: what changed, for which record.

    One changed field gives ``<FIELD>_CHANGED``, several ``MULTIPLE_CHANGED``, an
    insert ``NEW_JOB``.
    """
    change_type = (
        F.when(F.col("event_name") == "INSERT", F.lit("NEW_JOB"))
        .when(
            F.size("changed_fields") == 1,
            F.concat(F.upper(F.col("changed_fields")[0]), F.lit("_CHANGED")),
        )
        .otherwise(F.lit("MULTIPLE_CHANGED"))
    )
    shown = [c for c in ("company", "title", "location", "status") if c in _fields(feed, "after")]
    return feed.select(
        *key,
        change_type.alias("change_type"),
        "changed_fields",
        *[F.col(f"after.{c}").alias(c) for c in shown],
        F.col("event_id").alias("source_event_id"),
    )


def as_messages(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Events as JSON text; null attributes are left out."""
    return df.select(*key, F.to_json(F.struct(*df.columns)).alias("message"))


def _fields(df: DataFrame, struct: str) -> list[str]:
    return [f.name for f in df.schema[struct].dataType.fields]
