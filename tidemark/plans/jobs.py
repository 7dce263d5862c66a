"""The postings preset: landed payloads to verdicts, feed and stored state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.identity import KEY, TRACKED, comparison_hash, finalize
from tidemark.operators.changes import IMAGE
from tidemark.operators.fold import FoldSpec
from tidemark.operators.gate import due_payloads, gate
from tidemark.operators.ordered import HOT_ROWS
from tidemark.operators.source_state import advance, run_log, summary_table
from tidemark.sources.feeds import BUILTIN, rejects, union_feeds
from tidemark.sources.snapshots import StateTable, stored_posting
from tidemark.streaming.sync import batch_folder, sync_batch


def posting_spec(
    at: Column | None = None,
    hot_rows: int | None = HOT_ROWS,
    exact: bool = False,
    keep: Sequence[str] = (),
    order: Sequence[str] = ("seq",),
    landed_hash: Column | None = None,
) -> FoldSpec:
    """Fold of postings: canonical id, landing order, eight tracked columns."""
    return FoldSpec(
        key=[KEY],
        order=list(order),
        tracked=TRACKED,
        hash=comparison_hash(exact),
        at=at if at is not None else F.unix_timestamp(),
        hot_rows=hot_rows,
        keep=keep,
        landed_hash=landed_hash,
    )


def clean_postings(rows: DataFrame, exact: bool = False) -> DataFrame:
    """Cleaned text columns, then the derived columns of a posting."""
    return finalize(tx.cleaned(rows, ("title", "company", "location", "description"), exact), exact)


#: Order of a landed batch: built-in feeds in turn, then configured feeds one after
#: another (in the order of a hash, as their own order has no meaning).
LANDING_ORDER = ("source_ord", "source_rank", "page_no", "pos")


def with_landing_order(postings: DataFrame, n_builtin: int = len(BUILTIN)) -> DataFrame:
    rank = F.when(F.col("source_ord") < n_builtin, F.lit(0)).otherwise(F.xxhash64("source"))
    return postings.withColumn("source_rank", rank.cast("bigint"))


def sync_due_feeds(
    landed: DataFrame,
    sources: DataFrame,
    table: StateTable,
    out: str,
    as_of: int,
    version: int,
    hot_rows: int | None = HOT_ROWS,
) -> bool:
    """One scheduled run: gate, map due payloads, fold, write what changed and the log.

    ``out`` gets ``rejects`` (pages that gave nothing), ``results``, ``feed``, ``log``
    and ``summaries``: the source state, advanced by the rows of this run only, tells
    the next run which feeds are due.  A feed with a page that cannot be read fails as
    a whole.  The mapped batch is written once and read back with its comparison hash,
    so parsing and cleaning are not repeated by the fold, the feed and the upsert.  The
    summaries are written last: a run repeated after a failure does what is missing.
    """
    summaries = summary_table(table.spark, f"{out}/summaries")
    if summaries.applied(version):
        return False
    spark = landed.sparkSession
    gated = gate(sources, as_of)
    batch_path, rejects_path = f"{out}/batch/v={version}", f"{out}/rejects/v={version}"
    if not table.applied(version):
        due = due_payloads(landed, gated)
        mapped = with_landing_order(union_feeds(due, sources))
        rejects(due, sources).write.mode("overwrite").parquet(rejects_path)
        stored_posting(mapped, comparison_hash()).write.mode("overwrite").parquet(batch_path)
        spec = posting_spec(F.lit(as_of), hot_rows, order=LANDING_ORDER, landed_hash=F.col("content_hash"))
        sync_batch(spark.read.parquet(batch_path), version, spec, table, out, IMAGE)
    batch, refused = spark.read.parquet(batch_path), spark.read.parquet(rejects_path)
    verdicts = spark.read.parquet(f"{out}/results/{batch_folder(version)}")
    # Verdicts carry key and order only; the batch knows the source of a row.
    row = [KEY, *LANDING_ORDER]
    verdicts = verdicts.select(*row, "change_type").join(batch.select(*row, "source"), row)
    log_path = f"{out}/log/v={version}"
    run_log(gated, verdicts, refused, as_of).write.mode("overwrite").parquet(log_path)
    rows = spark.read.parquet(log_path)
    # Earlier runs are read only where an hour given to this one lies before theirs.
    earlier = spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{out}/log")
    earlier = earlier.filter(~F.input_file_name().contains(f"/v={version}/"))
    return advance(summaries, rows, version, earlier)
