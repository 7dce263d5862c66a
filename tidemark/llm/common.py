"""What the operators share: row-wise Arrow passes and written intermediate tables."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.session import checkpoint_dir

#: Text bytes turned into Python objects at once inside a task.
SLICE_BYTES = 4_000_000
#: Spark's switch for deleting shuffle files at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What separates words: space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only on a local master without the setting."""
    named = checkpoint_dir(spark)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="tidemark-llm-")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    return _written(df, scratch_path(df.sparkSession, label))


def short_lived(df: DataFrame, label: str) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as by :func:`materialise`, and a function that deletes its files.

    It may be called once all that was made of the table is itself written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)

    def discard() -> None:
        context = spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)

    return _written(df, path), discard


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that ends inside go at once, not when the driver collects its garbage.

    For queries that are run once, such as written tables; Spark would make the files
    again for a second run of the same DataFrame.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, for loaded vocabularies."""
    name = "_tidemark_llm_worker"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def slices(batch: pa.RecordBatch, by: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``SLICE_BYTES``, one row at least."""
    if batch.num_rows == 0:
        return
    size = batch.nbytes if by is None else batch.column(by).nbytes
    step = max(1, int(batch.num_rows * SLICE_BYTES / max(size, 1)))
    for low in range(0, batch.num_rows, step):
        yield batch.slice(low, step)


def map_rows(
    df: DataFrame,
    inputs: Sequence[str],
    keep: Sequence[str],
    fields: T.StructType,
    start: Callable[[], Callable[..., tuple | None]],
) -> DataFrame:
    """Columns ``keep`` of ``df`` and the tuple that a row function makes of ``inputs``.

    ``start`` runs once a task and returns the row function.  Rows stay where
    they are: no shuffle, and memory is bounded by one slice of a batch.
    """
    keep = list(keep)
    used = df.select(*dict.fromkeys([*keep, *inputs]))
    out = T.StructType([used.schema[c] for c in keep] + list(fields.fields))
    arrow = to_arrow_schema(out)
    names = [f.name for f in fields.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in batches:
            for part in slices(batch):
                columns = [part.column(c).to_pylist() for c in inputs]
                rows = [each(*values) for values in zip(*columns)]
                made = [
                    pa.array([r[i] for r in rows], type=arrow.field(name).type)
                    for i, name in enumerate(names)
                ]
                kept = [part.column(c).cast(arrow.field(c).type) for c in keep]
                yield pa.RecordBatch.from_arrays(kept + made, schema=arrow)

    return used.mapInArrow(run, out)


def span_list(spans: Column, kinds: Sequence[str] | None = None) -> Column:
    """``kind:start:end`` of spans in order, comma-joined; only ``kinds`` if given."""
    if kinds is not None:
        wanted = list(kinds)
        spans = F.filter(spans, lambda s: s["kind"].isin(*wanted))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


SPAN = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)
