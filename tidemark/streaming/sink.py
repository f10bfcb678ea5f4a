"""Micro-batches as publications."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..dataset import Dataset, require_quiescent
from ..sources import publish


def sink(
    dataset: Dataset,
    partition_by: list[str] | None = None,
    file: str = "batch",
    *,
    query: str | None = None,
    quiescent: bool,
) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that adds each micro-batch as new files.

    The stream's id and the batch's number are part of the file names and of the
    metadata (``batches``: the last number of each stream), in one commit with the files;
    a batch that is delivered again is known by them and skipped. The id is the one that
    Spark keeps in the checkpoint, or ``query``: a stream with a new checkpoint counts
    anew. ``quiescent=True`` is the caller's promise, for as long as the stream runs,
    that no one reads while files move.
    """
    require_quiescent(quiescent)

    def write(df: DataFrame, batch_id: int) -> None:
        spark, state = df.sparkSession, dataset.current()
        own = query or spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not own:
            raise ValueError("outside a stream name it by query=")
        done = state.metadata.get("batches", {})
        if done.get(own, -1) >= batch_id:
            return
        metadata = {**state.metadata, "batches": {**done, own: batch_id}}
        publish(
            spark,
            dataset,
            df,
            metadata=metadata,
            quiescent=quiescent,
            partition_by=partition_by,
            expected_revision=state.revision,
            file=f"{file}-{own}-{batch_id:010}",
        )

    return write
