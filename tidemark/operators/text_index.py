"""A trigram index for substring search over stored postings.

Rows are stored in key order and dealt into blocks of ``BLOCK_ROWS`` rows.  A second
table lists the distinct trigrams of each block, sorted by trigram.  A search reads the
rows of its own trigrams there, keeps the blocks that hold all of them, and tests the
whole text of the rows of those blocks, so it returns what a scan returns.

A trigram names a block at most once, however many rows hold it, and the rows of one
frequent trigram are dealt into ranges like others.  Searches of fewer than three
characters have no trigram and scan.  Null and empty texts have no trigrams and are
found by the empty search alone.

Layout under ``path``: ``rows/v=N`` and ``grams/v=N`` for batch ``N``.  A repeated batch
rewrites its own folders.  The index grows by new rows; rows that change need a new one.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.identity import KEY
from tidemark.operators.ordered import AT, HOT_ROWS, SLICE, in_ranges
from tidemark.session import written

GRAM = 3
#: Rows of a block: fewer give a finer and larger index.
BLOCK_ROWS = 256
#: Candidate blocks that are named in the scan itself; more are joined only.
NAMED_BLOCKS = 64
_BLOCK = "__block"
_VERSION = "v"


def posting_text() -> Column:
    """The text that a search over postings looks into."""
    return tx.search_text("title", "company", "location", "description", "employment_type")


def grams(text: Column) -> Column:
    """The distinct runs of three characters, in one pass over the text."""
    every = F.regexp_extract_all(text, F.lit("(?s)(?=(" + "." * GRAM + "))"), F.lit(1))
    return F.array_distinct(every)


def add(
    rows: DataFrame,
    path: str,
    batch: int,
    key: Sequence[str] = (KEY,),
    text: Column | None = None,
    block_rows: int = BLOCK_ROWS,
    range_rows: int = HOT_ROWS,
) -> None:
    """Adds ``rows`` to the index as batch ``batch``."""
    text = posting_text() if text is None else text
    at = f"{path}/rows/{_VERSION}={batch}"
    # Small Parquet pages, so that a scan for one block reads little more than the block.
    pages = {"parquet.page.row.count.limit": str(block_rows)}
    ranged = in_ranges(rows, key, range_rows, path=at, **pages)
    found = ranged.select(SLICE, _block(block_rows), F.explode(grams(text)).alias("gram")).distinct()
    # Written first: range partitioning reads its input twice.
    found = written(found, "grams").repartitionByRange("gram", SLICE, _BLOCK).sortWithinPartitions("gram", SLICE, _BLOCK)
    found.write.mode("overwrite").option("parquet.bloom.filter.enabled#gram", "true").parquet(
        f"{path}/grams/{_VERSION}={batch}"
    )


def _block(block_rows: int) -> Column:
    return F.floor(F.col(AT) / block_rows).cast("bigint").alias(_BLOCK)


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Blocks ``(v, range, block)`` that hold every trigram of a query of three characters or more."""
    wanted = query.lower()
    asked = sorted({wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)})
    place = [_VERSION, SLICE, _BLOCK]
    held = spark.read.parquet(f"{path}/grams").filter(F.col("gram").isin(asked))
    counted = held.groupBy(*place).agg(F.count(F.lit(1)).alias("__n"))
    return counted.filter(F.col("__n") == len(asked)).select(*place)


def search(
    spark: SparkSession, path: str, query: str, text: Column | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The stored rows whose text contains ``query``, letters in either case.

    ``text`` and ``block_rows`` are those the index was built with.
    """
    text = posting_text() if text is None else text
    rows = spark.read.parquet(f"{path}/rows")
    columns = [c for c in rows.columns if c not in (_VERSION, SLICE, AT)]
    if len(query) >= GRAM:
        found = written(candidates(spark, path, query), "candidates")
        named = found.limit(NAMED_BLOCKS + 1).collect()
        if len(named) <= NAMED_BLOCKS:
            rows = rows.filter(_inside(named, block_rows))
        rows = rows.withColumn(_BLOCK, _block(block_rows)).join(found, [_VERSION, SLICE, _BLOCK], "left_semi")
    return rows.filter(text.contains(query.lower())).select(*columns)


def _inside(blocks: Sequence, block_rows: int) -> Column:
    """Plain comparisons that the scan can test against the bounds of its pages."""
    each = [
        (F.col(_VERSION) == b[_VERSION])
        & (F.col(SLICE) == b[SLICE])
        & F.col(AT).between(b[_BLOCK] * block_rows, (b[_BLOCK] + 1) * block_rows - 1)
        for b in blocks
    ]
    return functools.reduce(operator.or_, each, F.lit(False))
