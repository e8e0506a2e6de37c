"""Versions from a stream: each micro-batch of changes becomes one version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from versograph.sources.store import Archive


def stream_writer(archive: Archive, first: int | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: batch b becomes version ``first`` + b.

    The version follows from the batch alone and an append of the same changes to the
    same version has no effect, so a batch that is tried again after a failure changes
    nothing.
    """
    start = archive.max_version() + 1 if first is None else first

    def write(batch: DataFrame, number: int) -> None:
        version = start + number
        if version < archive.max_version():
            return
        if "seq" not in batch.columns:
            batch = batch.withColumn("seq", F.lit(0))
        archive.append(batch.select("s", "p", "o", "op", "seq"), version, check_uniqueness=False)

    return write


def start(changes: DataFrame, archive: Archive, checkpoint: str, first: int | None = None, **trigger) -> StreamingQuery:
    """Starts writing a streaming DataFrame of changes (s, p, o, op and perhaps seq) into an archive."""
    writer = changes.writeStream.foreachBatch(stream_writer(archive, first)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
