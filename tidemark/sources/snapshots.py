"""State tables on plain Parquet: a base, written deltas and a commit marker.

Layout under ``root``::

    base/v=N/p=<key prefix>/    whole table as of version N
    delta/__version=N/          rows written by version N (upserts, tombstones)
    commit/v=N/                 one row: the base, the first delta to read, and
                                the stream and batch the version was made from

A version exists once its commit directory has a ``_SUCCESS`` marker: data is
written first, the marker last, and nothing is ever overwritten in place.  A
sync writes only the rows that changed; ``compact`` folds deltas into a base.
Files are sorted by key and carry a Bloom filter on it, so a read for a short list
of keys skips the row groups that cannot hold them.
Versions count writes of the table; batches are known by ``(stream, batch)``, so
a compaction between two micro-batches takes no number from them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_VERSION = "__version"
_GONE = "__gone"
#: Keys that a read may name; longer lists are read by a whole scan and a join.
MOST_KEYS = 1_000


class StateTable:
    """A keyed table with whole-row upserts, deletes and versioned reads."""

    def __init__(
        self, spark: SparkSession, root: str, key: Sequence[str], prefix: int = 2, compact_after: int | None = 100
    ) -> None:
        """``compact_after`` deltas are folded into a new base by the next write."""
        self.spark, self.root, self.key, self.prefix = spark, root.rstrip("/"), list(key), prefix
        self.compact_after = compact_after

    # ------------------------------------------------------------- versions

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/commit")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = []
        for entry in fs.listStatus(folder):
            name = entry.getPath().getName()
            done = jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
            if name.startswith("v=") and fs.exists(done):
                found.append(int(name[2:]))
        return sorted(found)

    def next_version(self) -> int:
        """The number the next write gets; a failed write leaves it as it was."""
        versions = self.versions()
        return versions[-1] + 1 if versions else 0

    def applied(self, batch: int, stream: str = "") -> bool:
        """Whether the batch is in the table.

        Only the last batch of a stream is ever delivered again.  An older one
        means that the stream began anew, and raises instead of being skipped.
        """
        if not self.versions():
            return False
        commits = self.spark.read.parquet(f"{self.root}/commit")
        newest = commits.filter(F.col("stream") == stream).agg(F.max("batch")).first()[0]
        if newest is None or batch > newest:
            return False
        if batch == newest:
            return True
        raise ValueError(f"batch {batch} of stream {stream!r} is older than its last one, {newest}")

    def _last(self):
        versions = self.versions()
        if not versions:
            return None
        return self.spark.read.parquet(f"{self.root}/commit/v={versions[-1]}").withColumn("v", F.lit(versions[-1])).first()

    # ---------------------------------------------------------------- write

    def upsert(self, rows: DataFrame, batch: int | None = None, stream: str = "") -> bool:
        """Replaces whole rows by key; False when the batch was written before."""
        return self._write_delta(rows.withColumn(_GONE, F.lit(False)), batch, stream)

    def delete(self, keys: DataFrame, batch: int | None = None, stream: str = "") -> bool:
        """Removes the listed keys."""
        gone = keys.select(*self.key).distinct().withColumn(_GONE, F.lit(True))
        return self._write_delta(gone, batch, stream)

    def compact(self) -> int:
        """Writes the merged table as a new base; older deltas are no longer read."""
        version = self.next_version()
        # Rebalancing sizes the files of each prefix and splits large prefixes.
        merged = self.read().withColumn("p", self._prefix()).hint("rebalance", "p")
        merged = merged.sortWithinPartitions("p", *self.key)
        self._filtered(merged).partitionBy("p").parquet(f"{self.root}/base/v={version}")
        self._commit(version, version, version + 1, None, None)
        return version

    def _write_delta(self, rows: DataFrame, batch: int | None, stream: str) -> bool:
        if batch is not None and self.applied(batch, stream):
            return False
        last = self._last()
        if last is not None and self.compact_after is not None and last.v - last.first_delta + 1 >= self.compact_after:
            self.compact()
            last = self._last()
        version = 0 if last is None else last.v + 1
        base, first = (-1, version) if last is None else (last.base, min(last.first_delta, version))
        # Only this uncommitted version is overwritten, when a run is repeated.
        ordered = rows.sortWithinPartitions(*self.key)
        self._filtered(ordered).parquet(f"{self.root}/delta/{_VERSION}={version}")
        self._commit(version, base, first, batch, stream)
        return True

    def _filtered(self, rows: DataFrame):
        """A writer that adds a Bloom filter on the first key column to each row group."""
        return rows.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{self.key[0]}", "true")

    def _commit(self, version: int, base: int, first_delta: int, batch: int | None, stream: str | None) -> None:
        marker = self.spark.range(1).select(
            F.lit(base).cast("bigint").alias("base"),
            F.lit(first_delta).cast("bigint").alias("first_delta"),
            F.lit(batch).cast("bigint").alias("batch"),
            F.lit(stream if batch is not None else None).cast("string").alias("stream"),
        )
        marker.write.mode("overwrite").parquet(f"{self.root}/commit/v={version}")

    # ----------------------------------------------------------------- read

    def read(self, keys: Sequence[str] | None = None) -> DataFrame | None:
        """The current table, or None before the first version.

        ``keys`` is a short list of key values to look up: their prefixes prune
        the partitions of the base.
        """
        last = self._last()
        if last is None:
            return None
        base = None if last.base < 0 else self._looked_up(f"base/v={last.base}", keys)
        if last.v < last.first_delta:
            return base
        # One scan over all deltas since the base; their versions are a partition column.
        deltas = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/delta")
        deltas = deltas.filter(F.col(_VERSION).between(last.first_delta, last.v))
        if keys is not None:
            deltas = deltas.filter(F.col(self.key[0]).isin(*list(keys)))
        # A key occurs once per version, so a group holds one row per delta.
        newest = Window.partitionBy(*self.key).orderBy(F.desc(_VERSION))
        changed = deltas.withColumn("__rn", F.row_number().over(newest)).filter("__rn = 1").drop("__rn")
        live = changed.filter(~F.col(_GONE)).drop(_GONE, _VERSION)
        if base is None:
            return live
        kept = base.join(changed.select(*self.key), self.key, "left_anti")
        return kept.unionByName(live, allowMissingColumns=True)

    def read_for(self, keys: DataFrame, most: int = MOST_KEYS) -> DataFrame | None:
        """Rows whose key may occur in ``keys``: row groups without one of them are skipped
        where there are at most ``most`` texts or whole numbers; else the whole table.

        A plan never names more than ``MOST_KEYS``: it would grow with the list, on the driver."""
        if self._last() is None:
            return None
        most = min(most, MOST_KEYS)
        asked = [r[0] for r in keys.select(self.key[0]).distinct().limit(most + 1).collect()]
        plain = all(isinstance(k, (str, int)) and not isinstance(k, bool) for k in asked)
        if len(asked) > most or not plain:
            return self.read()
        return self.read(keys=asked)

    def lookup(self, keys: DataFrame, most: int = MOST_KEYS) -> DataFrame | None:
        """The stored rows of the listed keys."""
        found = self.read_for(keys, most)
        return None if found is None else found.join(keys.select(*self.key).distinct(), self.key, "left_semi")

    def _looked_up(self, part: str, keys: Sequence[str] | None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{part}")
        if keys is not None:
            df = df.filter(F.col(self.key[0]).isin(*list(keys)))
            df = df.filter(F.col("p").isin(*sorted({"k" + str(k)[: self.prefix] for k in keys})))
        return df.drop("p")

    def _prefix(self) -> Column:
        # The letter keeps all-digit prefixes from being read back as numbers.
        head = F.substring(F.col(self.key[0]).cast("string"), 1, self.prefix)
        return F.concat(F.lit("k"), head)


def stored_posting(jobs: DataFrame, comparison: Column) -> DataFrame:
    """Posting rows as they are stored: comparison hash kept, status OPEN."""
    return jobs.withColumns({"content_hash": comparison, "status": F.lit("OPEN")})
