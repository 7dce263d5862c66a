"""A change feed as a stream source of its own, read by version.

``spark.dataSource.register(ChangeFeed)``, then::

    spark.readStream.format("change_feed").schema(schema)
        .option("path", feed).option("startingVersion", "latest")
        .option("keyColumn", key).option("keyValue", value).load()

The feed folder holds one finished folder ``v=N`` per batch, or ``v=<stream>-N`` where
a stream wrote it (option ``stream`` picks one of several).  An offset is the number
of the first version that was not read yet, so a micro-batch is a range of versions,
and a restarted query reads exactly the versions it has not committed.  Unfinished
folders are not seen.  ``startingVersion`` is a number, ``earliest`` (the default) or
``latest``: only what is written after the query starts.  With ``keyColumn`` and
``keyValue`` row groups that cannot hold the key are not read, and only events of
the key leave the source.  ``versionsPerBatch`` bounds a micro-batch; a run that ends
when its input is used up (``availableNow``) asks for one bound, so it takes that many
versions and the next run goes on.

Every file is one task; a task holds one record batch of it.  Files are opened
through Arrow's file systems, so ``path`` is a local path or a URI that these know.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# The source travels by value, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a file that a task holds at once.
BATCH_ROWS = 10_000


def _opened(path: str):
    """The Arrow file system of a path and the path inside it."""
    from pyarrow import fs

    if re.match(r"^file:/", path):
        path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def finished_versions(path: str, stream: str | None = None) -> dict[int, str]:
    """Folder of each finished version below ``path``, of one stream."""
    from pyarrow import fs

    system, root = _opened(path)
    if system.get_file_info(root).type != fs.FileType.Directory:
        return {}
    found: dict[str, dict[int, str]] = {}
    for entry in system.get_file_info(fs.FileSelector(root)):
        number = re.fullmatch(r"v=(?:(\w+)-)?(\d+)", entry.base_name)
        if number and system.get_file_info(f"{entry.path}/_SUCCESS").type == fs.FileType.File:
            found.setdefault(number.group(1) or "", {})[int(number.group(2))] = entry.path
    if stream is None and len(found) > 1:
        raise ValueError(f"name one of the streams {sorted(found)} of the feed")
    return found.get(stream, {}) if stream is not None else next(iter(found.values()), {})


class FeedFile(InputPartition):
    """One data file of a version."""

    def __init__(self, version: int, path: str) -> None:
        self.version, self.path = version, path


class FeedReader(DataSourceStreamReader):
    """Reads ranges of versions."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema = schema
        self.path = options["path"].rstrip("/")
        self.start = options.get("startingversion", "earliest")
        self.key = (options["keycolumn"], options["keyvalue"]) if "keycolumn" in options else None
        self.most = int(options.get("versionsperbatch", 0))
        self.stream = options.get("stream")
        self.read_to: int | None = None

    def _versions(self) -> dict[int, str]:
        return finished_versions(self.path, self.stream)

    def initialOffset(self) -> dict:
        if self.start == "latest":
            return {"version": max(self._versions(), default=-1) + 1}
        return {"version": 0 if self.start == "earliest" else int(self.start)}

    def latestOffset(self) -> dict:
        versions = self._versions()
        newest = max(versions, default=-1) + 1
        if self.read_to is None:
            # The first call of a run: the bound holds from the next micro-batch on.
            self.read_to = self.initialOffset()["version"]
        if self.most:
            pending = sorted(v for v in versions if v >= self.read_to)
            if pending:
                newest = pending[: self.most][-1] + 1
        self.read_to = max(newest, self.read_to)
        return {"version": self.read_to}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, _ = _opened(self.path)
        self.read_to = max(end["version"], self.read_to or 0)
        files = []
        for version, folder in sorted(self._versions().items()):
            if start["version"] <= version < end["version"]:
                entries = system.get_file_info(fs.FileSelector(folder, recursive=True))
                files += [FeedFile(version, e.path) for e in entries if e.path.endswith(".parquet")]
        return files

    def read(self, partition: FeedFile) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        system, _ = _opened(self.path)
        arrow = to_arrow_schema(self.schema)
        condition = None if self.key is None else ds.field(self.key[0]) == self.key[1]
        data = ds.dataset(partition.path, filesystem=system, format="parquet")
        columns = [n for n in arrow.names if n in data.schema.names]
        for batch in data.to_batches(columns=columns, filter=condition, batch_size=BATCH_ROWS):
            if batch.num_rows:
                made = [
                    batch.column(f.name).cast(f.type) if f.name in columns else pa.nulls(batch.num_rows, f.type)
                    for f in arrow
                ]
                yield pa.RecordBatch.from_arrays(made, schema=arrow)

    def commit(self, end: dict) -> None:
        pass


class ChangeFeed(DataSource):
    """The data source ``change_feed``."""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self):
        raise ValueError("give the schema of the feed")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FeedReader(schema, {k.lower(): v for k, v in self.options.items()})
