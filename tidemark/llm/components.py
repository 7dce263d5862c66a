"""Connected components of links by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise


def _lower(edges: DataFrame) -> DataFrame:
    """Links with the larger end in ``u``, once each, without loops."""
    return edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node it is linked with, for nodes of ``edges`` (``u``, ``v``) but the roots.

    Each round links all larger neighbours of a node to its least neighbour and
    then all smaller ones; the links end as stars around the roots.  Rounds are
    written tables, so nothing of the graph meets the driver but two checksums.
    """
    now = materialise(_lower(edges), "links")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(_lower(large), "links-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(_lower(small.union(least.select("u", F.col("m").alias("v")))), "links")
