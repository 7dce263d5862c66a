"""Numbered pages of a stored table, read without numbering its rows.

The table is stored in ranges of its key order, with the place of each row in its
range, and a directory says how many rows lie before each range.  Page ``n`` is then a
few comparisons on range and place, which the scan tests against the bounds of files
and Parquet pages.  Keys that repeat keep the order they were stored in.  An empty
table has no pages, and a page beyond the last one is empty.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.identity import KEY
from tidemark.operators.catalog import MAX_PAGE, page_size
from tidemark.operators.ordered import AT, SLICE, in_ranges

#: Rows of a range, and rows between two places the scan can start at.
RANGE_ROWS = 200_000
STEP_ROWS = 1_000


def store(rows: DataFrame, path: str, key: Sequence[str] = (KEY,), range_rows: int = RANGE_ROWS) -> None:
    """Stores ``rows`` under ``path`` for :func:`read_page`."""
    pages = {"parquet.page.row.count.limit": str(STEP_ROWS)}
    ranged = in_ranges(rows, key, range_rows, path=f"{path}/rows", **pages)
    parts = ranged.groupBy(SLICE).agg(F.count(F.lit(1)).alias("rows"))
    # One row per range.
    before = Window.partitionBy(F.lit(0)).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    directory = parts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    directory.write.mode("overwrite").parquet(f"{path}/directory")


def pages_in(spark: SparkSession, path: str, size: object = MAX_PAGE) -> int:
    """How many pages the stored table has."""
    rows = spark.read.parquet(f"{path}/directory").agg(F.sum("rows")).first()[0] or 0
    return -(-rows // page_size(size))


def read_page(spark: SparkSession, path: str, number: int, size: object = MAX_PAGE) -> DataFrame:
    """The rows of page ``number`` (from 1) with ``row_no`` and ``page_no``."""
    size = page_size(size)
    if number < 1:
        raise ValueError(f"pages are numbered from 1, not {number}")
    first, last = (number - 1) * size, number * size - 1
    directory = spark.read.parquet(f"{path}/directory")
    # No range is empty, so a page touches at most as many ranges as it has rows.
    touched = directory.filter((F.col("before") <= last) & (F.col("before") + F.col("rows") > first)).collect()
    rows = spark.read.parquet(f"{path}/rows")
    columns = [c for c in rows.columns if c not in (SLICE, AT)]
    inside = [
        (F.col(SLICE) == r[SLICE]) & F.col(AT).between(max(first - r["before"], 0), last - r["before"]) for r in touched
    ]
    kept = rows.filter(functools.reduce(operator.or_, inside, F.lit(False)))
    before = functools.reduce(
        lambda out, r: F.when(F.col(SLICE) == r[SLICE], F.lit(r["before"])).otherwise(out), touched, F.lit(0)
    )
    return kept.select(
        *columns,
        (before + F.col(AT) + 1).cast("bigint").alias("row_no"),
        F.lit(number).cast("bigint").alias("page_no"),
    )
