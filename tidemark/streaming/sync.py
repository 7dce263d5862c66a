"""The sync fold over a stream of landed rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.changes import change_feed
from tidemark.operators.fold import FoldSpec, fold, written_rows
from tidemark.sources.snapshots import StateTable


def batch_folder(batch_id: int, stream: str = "") -> str:
    """Folder of what one batch wrote; streams never share one."""
    return f"v={stream[:8] + '-' if stream else ''}{batch_id}"


def sync_batch(
    batch: DataFrame,
    batch_id: int,
    spec: FoldSpec,
    table: StateTable,
    out: str,
    image: Sequence[str] = (),
    stream: str = "",
) -> bool:
    """Folds one batch into ``table``; False when it was done before.

    Verdicts are written and read back, which cuts the lineage once for the feed
    and the state.  The state commit comes last: a run repeated after a failure
    sees the same state and rewrites only its own folders.
    """
    if table.applied(batch_id, stream):
        return False
    spark = batch.sparkSession
    # A small batch reads only the row groups that may hold its keys.
    state = table.read_for(batch)
    own = batch_folder(batch_id, stream)
    results = f"{out}/results/{own}"
    fold(batch, spec, state).write.mode("overwrite").parquet(results)
    verdicts = spark.read.parquet(results)
    if image:
        feed = change_feed(batch, verdicts, spec, image, state)
        feed.write.mode("overwrite").parquet(f"{out}/feed/{own}")
    return table.upsert(written_rows(batch, verdicts, spec), batch_id, stream)


def sync_stream(
    landed: DataFrame,
    spec: FoldSpec,
    table: StateTable,
    out: str,
    checkpoint: str,
    image: Sequence[str] = (),
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Runs :func:`sync_batch` on each micro-batch until the input is used up.

    A batch is known by its number and the id in the stream's checkpoint, so a
    re-delivered micro-batch is skipped and one of a fresh checkpoint is not.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        stream = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        sync_batch(rows, batch_id, spec, table, out, image, stream)

    return (
        landed.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
