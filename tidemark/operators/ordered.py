"""Ordered per-key work that survives hot keys.

A window partitioned by a key puts all rows of the key into one task.  The
helpers here bound that: the rows of keys with more than ``hot_rows`` rows are
dealt into ranges of their full order (key and every order column) and written
once, so each range has a fixed number and at most ``hot_rows`` rows.  Spark's range
partitioning deals them to tasks by rows and bytes, and each task cuts its sorted rows
into ranges, so small ranges need no more tasks, files or samples.  Windows then run over ``(key, range)``, and what one range
leaves behind is carried along the key as one row per range.  Cold keys stay in
one range and need no carry.  The number of ranges follows the rows, and rows with
equal order columns, or equal in all columns, are dealt like others.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

#: Rows one window group may hold before its key is dealt into ranges.
HOT_ROWS = 1_000_000
#: Rows a task sorts where ranges are smaller, and stored bytes where rows are wide.
TASK_ROWS = 100_000
TASK_BYTES = 32 * 2**20
SLICE = "__slice"
#: Row number inside a range, from 0.
AT = "__at_row"
#: Range of every row of a cold key; also sorts before each real range.
WHOLE = -(2**62)
#: Bits that hold the row number inside a partition in ``monotonically_increasing_id``.
_ROW_BITS = 33


def in_ranges(
    df: DataFrame, order: Sequence[str], rows: int = HOT_ROWS, name: str = "ranges", path: str | None = None, **options: str
) -> DataFrame:
    """``df`` written in ranges of ``order`` (nulls first) of at most ``rows`` rows, with
    ``SLICE`` (rising with the order) and ``AT`` (row number inside the range).

    A task holds several small ranges, or a part of what would be one range of wide rows.

    The rows are written as they are first: they are computed once, although range
    partitioning reads its input twice, and their place in that table orders rows with
    equal order columns, which may lie in several ranges.  The second writing fixes the
    ranges: every later use sees the same ones.  ``path`` names the folder of the second
    one, with ``options`` of the Parquet writer, for ranges that are kept.
    """
    fixed = written(df.withColumn("__tie", F.monotonically_increasing_id()), name)
    by = [F.col(c).asc_nulls_first() for c in (*order, "__tie")]
    cut = fixed.repartitionByRange(_tasks(fixed, rows), *by).sortWithinPartitions(*by)
    # The id is documented as the partition above and the row number below these bits.
    place = F.col("__id").bitwiseAND(F.lit(2**_ROW_BITS - 1))
    numbered = cut.withColumn("__id", F.monotonically_increasing_id()).withColumn(AT, place % max(rows, 1))
    numbered = numbered.withColumn(SLICE, F.col("__id") - F.col(AT)).select(*fixed.columns, SLICE, AT, "__id")
    numbered = numbered.drop("__id", "__tie")
    if path is None:
        return written(numbered, name)
    numbered.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(numbered.schema).parquet(path)


def _tasks(stored: DataFrame, rows: int) -> int:
    """Tasks that put stored rows in order, by their number and the size of their files."""
    files = stored.groupBy("_metadata.file_path").agg(
        F.count(F.lit(1)).alias("__n"), F.max("_metadata.file_size").alias("__bytes")
    )
    n, size = files.agg(F.sum("__n"), F.sum("__bytes")).first()
    return max(1, -(-(n or 0) // max(rows, TASK_ROWS)), -(-(size or 0) // TASK_BYTES))


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows; at most ``count / hot_rows`` of them."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return counted.filter(F.col("__n") > hot_rows).select(*keys)


def find_hot(
    df: DataFrame, keys: Sequence[str], hot_rows: int | None = HOT_ROWS
) -> DataFrame | None:
    """The hot keys, or ``None`` when there are none.

    One narrow aggregation over the keys, written once.  ``hot_rows=None`` skips it
    for tables whose keys are known to be small.
    """
    if hot_rows is None:
        return None
    hot = written(hot_keys(df, keys, hot_rows), "hot-keys")
    return None if hot.isEmpty() else hot


def mark_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame | None) -> DataFrame:
    """Adds ``__hot``; a null key can be hot like any other.

    The list is joined without a hint: Spark broadcasts it where its size allows.
    """
    if hot is None:
        return df.withColumn("__hot", F.lit(False))
    marked = null_safe_join(df, hot.select(*keys).withColumn("__hot", F.lit(True)), keys, "left")
    return marked.withColumn("__hot", F.coalesce("__hot", F.lit(False)))


def split_hot(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: DataFrame | None, hot_rows: int | None
) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with ``SLICE`` and ``__hot``, whole keys where they are cold; and the written
    ranges of the hot rows apart, or ``None``."""
    if hot is None:
        return df.withColumns({"__hot": F.lit(False), SLICE: F.lit(WHOLE).cast("bigint")}), None
    marked = mark_hot(df, keys, hot)
    ranged = in_ranges(marked.filter("__hot"), [*keys, *order], hot_rows, "hot-ranges").drop(AT)
    cold = marked.filter(~F.col("__hot")).withColumn(SLICE, F.lit(WHOLE).cast("bigint"))
    return cold.unionByName(ranged), ranged


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right``, where null keys are equal to each other."""
    named = {k: f"__right_{k}" for k in keys}
    other = right.withColumnsRenamed(named)
    match = functools.reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[n]) for k, n in named.items()])
    return left.join(other, match, how).drop(*named.values())


def _rising(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


def row_numbers(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
    name: str = "row_no",
    total: str | None = None,
) -> DataFrame:
    """Row number per key (or over the whole table) without one-task windows.

    Rows of the whole table, or of hot keys, are numbered by their place in a written
    range, shifted by the rows of earlier ranges; only one row per range is ordered
    along the key.  ``total`` names an optional column with the number of rows of the key.
    """
    keys = list(keys)
    if not keys:
        return _numbered(in_ranges(df, order, hot_rows), [], name, total)
    hot = find_hot(df, keys, hot_rows)
    marked = mark_hot(df, keys, hot)
    inside = Window.partitionBy(*keys)
    cold = marked.filter(~F.col("__hot")).drop("__hot")
    cold = cold.withColumn(name, F.row_number().over(inside.orderBy(*_rising(order))).cast("bigint"))
    if total:
        cold = cold.withColumn(total, F.count(F.lit(1)).over(inside))
    if hot is None:
        return cold
    ranged = in_ranges(marked.filter("__hot").drop("__hot"), [*keys, *order], hot_rows, "hot-ranges")
    return cold.unionByName(_numbered(ranged, keys, name, total))


def _numbered(ranged: DataFrame, keys: list[str], name: str, total: str | None) -> DataFrame:
    group = [*keys, SLICE]
    parts = ranged.groupBy(*group).agg(F.min(AT).alias("__first"), F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = along.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *group,
        "__first",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(along).alias("__total"),
    )
    placed = null_safe_join(ranged, offsets, group)
    extra = {name: F.col("__before") + F.col(AT) - F.col("__first") + 1}
    if total:
        extra[total] = F.col("__total")
    return placed.withColumns(extra).drop(SLICE, AT, "__first", "__before", "__total")


def last_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Adds the last non-null ``value`` of earlier rows of the same key."""
    keys = list(keys)
    group = [*keys, SLICE]
    hot = find_hot(df, keys, hot_rows)
    rows, ranged = split_hot(df.withColumn("__value", value), keys, order, hot, hot_rows)
    inside = Window.partitionBy(*group).orderBy(*_rising(order))
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(name, F.last("__value", True).over(prior))
    if ranged is not None:
        # The last value of each range, one row per range, carried along the key.
        last = F.max_by("__value", F.struct(*order)).alias("__left")
        ends = ranged.filter(F.col("__value").isNotNull()).groupBy(*group).agg(last)
        ends = null_safe_join(ranged.select(*group).distinct(), ends, group, "left")
        along = Window.partitionBy(*keys).orderBy(SLICE)
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*group, F.last("__left", True).over(before).alias("__carry"))
        rows = null_safe_join(rows, carried, group, "left").withColumn(name, F.coalesce(name, "__carry"))
        rows = rows.drop("__carry")
    return rows.drop("__value", "__hot", SLICE)
