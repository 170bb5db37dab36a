"""Continuous ingest: live traces, and posting batches merged per micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from rolegrid.operators import slots
from rolegrid.sources.lines import tail_lines
from rolegrid.sources.traces import parse_trace_lines, run_of_path


def tail_traces(spark: SparkSession, path: str, suffix: str = "", run: Column | None = None) -> DataFrame:
    """Trace events as they are written, append output: (run_id, seq, event, ...) of every finished line, ``seq`` in the
    order of the file. Files may grow; a stream that is started again goes on where it stopped inside each. ``run``
    reads the run off ``path`` where files are not named by it."""
    text = tail_lines(spark, path, suffix).select((run_of_path("path") if run is None else run).alias("run_id"), "seq", "value")
    return parse_trace_lines(text)


def start_posting_merge(batches: DataFrame, table: slots.SlotTable, checkpoint: str, now, scope: list[str] | None = None):
    """Upsert and staleness per micro-batch into a slot table that has a version 0. Batch n reads the newest version
    up to n and writes n + 1, so a batch run again writes the same version; what it reads and writes follows the
    batch's keys and the scopes it shows, not the table.

    ``batches`` carries the content columns plus ``ordinal``; the batch itself is the seen set.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        base = table.latest(below=batch_id + 1)
        if base < 0:
            raise ValueError(f"no version under {table.root}: create the table first")
        instant = now(batch_id) if callable(now) else now
        # The batch is read several times: its keys, its seen set, its content.
        kept = batch.persist()
        try:
            slots.merge_postings(table, kept, instant, scope=scope, base=base, version=batch_id + 1)
        finally:
            kept.unpersist()

    return batches.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
