"""Continuous log jobs. Each works on a stream or, unchanged, on a batch: the batch is its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.operators.logs import collect, notable

LATENESS = "10 minutes"


def _watermarked(df: DataFrame, ts: str = "ts") -> DataFrame:
    """A watermark where there is a stream to bound; a batch needs none."""
    return df.withWatermark(ts, LATENESS) if df.isStreaming else df


def windowed_counts(lines: DataFrame, label: str, duration: str, slide: str | None = None) -> DataFrame:
    """Lines per label value and event-time window. Rows later than the watermark are dropped."""
    win = F.window("ts", duration, slide) if slide else F.window("ts", duration)
    counts = _watermarked(lines).groupBy(win.alias("w"), label).agg(F.count("*").alias("n"))
    return counts.select(label, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def collector(lines: DataFrame, projects: list[str], project: str = "project", line: str = "line") -> DataFrame:
    return collect(lines, projects, project, line)


def start_collector(lines: DataFrame, projects: list[str], path: str, checkpoint: str, project: str = "project", line: str = "line"):
    """Streaming collector: positions are the checkpoint's, the label columns partition the sink."""
    out = collector(lines, projects, project, line)
    return (
        out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .partitionBy("level", "app", "svc").outputMode("append").trigger(availableNow=True).start()
    )


def notable_stream(requests: DataFrame) -> DataFrame:
    """Stateless reduction at ingest."""
    return notable(requests)


def run_sessions(lines: DataFrame, gap: str = "20 minutes") -> DataFrame:
    """Facts per run session: lines of one run no further apart than the gap. A stream and a batch take
    the same plan, so the batch is the stream's oracle; ``run_facts`` gives the whole run's facts."""
    msg = F.col("msg")
    return _watermarked(lines).groupBy(F.session_window("ts", gap).alias("s"), "run_id").agg(
        F.count("*").alias("lines"), F.count_if(msg == "agent step").alias("agent_steps"), F.count_if(msg == "listing stored").alias("listings_stored"),
        F.coalesce(F.bool_or(msg == "agent failed"), F.lit(False)).alias("agent_failed"), F.coalesce(F.bool_or(msg == "summary"), F.lit(False)).alias("finished"),
    ).select("run_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "lines", "agent_steps", "listings_stored", "agent_failed", "finished")
