"""Maintenance of stored postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions.identity import KEY
from tidemark.functions.text import employment_type
from tidemark.sources.snapshots import StateTable


def employment_backfill(jobs: DataFrame) -> DataFrame:
    """Rows whose stored employment type is not normalised, with old and new value.

    Only these rows need writing; their hash and ``last_changed`` stay as they are.
    """
    fixed = employment_type("employment_type", clean=False)
    renamed = jobs.withColumns({"old_employment_type": F.col("employment_type"), "employment_type": fixed})
    return renamed.filter(~F.col("employment_type").eqNullSafe(F.col("old_employment_type")))


def backfill_counts(jobs: DataFrame) -> DataFrame:
    """How many rows a back-fill updates and leaves, in one pass."""
    same = employment_type("employment_type", clean=False).eqNullSafe(F.col("employment_type"))
    return jobs.agg(F.count_if(~same).alias("updated"), F.count_if(same).alias("unchanged"))


def write_backfill(table: StateTable) -> dict[str, int]:
    """Stores the normalised employment type of every row that lacks it; all other columns,
    hash and lifecycle included, stay.  Returns how many rows were updated and left.

    The counts are observed on the pass that writes.  A second run updates nothing, so
    a run repeated after a failure does no harm.
    """
    stored = table.read()
    if stored is None:
        return {"updated": 0, "unchanged": 0}
    seen = Observation("backfill")
    same = employment_type("employment_type", clean=False).eqNullSafe(F.col("employment_type"))
    counted = stored.observe(seen, F.count_if(~same).alias("updated"), F.count_if(same).alias("unchanged"))
    table.upsert(employment_backfill(counted).drop("old_employment_type"))
    return {name: int(n) for name, n in seen.get.items()}


def without_keys(jobs: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    """Rows whose key is not listed."""
    return jobs.join(keys.select(key).distinct(), key, "left_anti")
