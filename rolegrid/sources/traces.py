"""Trace files (one JSON object per line, one file per run) and plain-text run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrid.functions.base import ColumnOrName, attach_row, c
from rolegrid.functions.text import log_int
from rolegrid.functions.times import parse_instant
from rolegrid.sources.lines import read_lines

TRACE_SCHEMA = (
    "event string, step bigint, url string, thinking string, evaluation_previous_goal string, memory string, "
    "next_goal string, actions array<map<string,variant>>, ts string, success boolean, steps bigint, final_result string, company string"
)


def run_of_path(path: ColumnOrName) -> Column:
    """Run id from ``.../<id>.jsonl`` or ``.../<id>.log``."""
    return F.regexp_extract(c(path), r"([0-9]+)\.[A-Za-z]+$", 1).try_cast("bigint")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(run_id) of every file, empty ones included: this is what tells empty from missing. Scans skip
    empty files, so the names come from the file index, which the driver holds anyway."""
    names = spark.read.text(path).inputFiles()
    files = spark.createDataFrame([(n,) for n in names], "path string")
    return files.select(run_of_path("path").alias("run_id")).filter(F.col("run_id").isNotNull())


def parse_trace_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Events of trace lines; blank and invalid lines are skipped. ``ts_text`` is the stamp as written, also where it
    is no instant."""
    others = [x for x in lines.columns if x != line]
    valid = lines.filter((F.trim(line) != "") & F.try_parse_json(line).isNotNull())
    return valid.select(*others, F.from_json(line, TRACE_SCHEMA).alias("e")).select(*others, "e.*").withColumns({"ts": parse_instant("ts"), "ts_text": F.col("ts")})


def read_traces(spark: SparkSession, path: str, run: Column | None = None) -> DataFrame:
    """(run_id, seq, event, ...) of every trace file; seq is the line's number. ``run`` reads the run off ``path``
    where files are not named by it."""
    lines = read_lines(spark, path).select((run_of_path("path") if run is None else run).alias("run_id"), F.col("line_no").alias("seq"), "value")
    return parse_trace_lines(lines)


def read_log_lines(spark: SparkSession, path: str, run: Column | None = None) -> DataFrame:
    """(run_id, line_no, line) of run log files."""
    return read_lines(spark, path).select((run_of_path("path") if run is None else run).alias("run_id"), "line_no", F.col("value").alias("line"))


def grep_log(lines: DataFrame, grep: str | None = None, max_lines: int | None = None) -> DataFrame:
    """Non-blank lines (with ``max_lines`` the first ones) (matching the pattern, whatever the case), each with the
    total and whether it was cut."""
    out = lines.filter(F.trim("line") != "")
    if grep:
        out = out.filter(F.regexp_like("line", F.lit(f"(?i){grep}")))
    total = out.agg(F.count("*").alias("total_lines"))
    if max_lines is None:
        return attach_row(out, total).withColumn("truncated", F.lit(False))
    return attach_row(out.orderBy("line_no").limit(max_lines), total).withColumn("truncated", F.col("total_lines") > max_lines)


def attribute_logs(lines: DataFrame, runs: DataFrame, sweeps: DataFrame) -> DataFrame:
    """(run_id, line_no, line, origin) for the asked runs: their own log, else the lines tagged
    ``run_id=N`` in the newest sweep log that has any, else one row ``not_found``.

    runs(run_id), sweeps(run_id) = the runs that are sweeps.
    """
    text = lines.filter(F.trim("line") != "")
    own_runs = text.select("run_id").distinct()
    own = text.join(runs, "run_id", "left_semi").withColumn("origin", F.lit("own"))
    orphan = runs.join(own_runs, "run_id", "left_anti")
    tagged = text.join(sweeps.select("run_id"), "run_id", "left_semi").select(
        F.col("run_id").alias("parent"), "line_no", "line", log_int("line", "run_id").alias("run_id")
    ).join(orphan, "run_id", "left_semi")
    newest = tagged.groupBy("run_id").agg(F.max("parent").alias("parent"))
    inherited = tagged.join(newest, ["run_id", "parent"]).select(
        "run_id", "line_no", "line", F.concat(F.lit("parent_batch:"), F.col("parent").cast("string")).alias("origin")
    )
    lost = orphan.join(newest, "run_id", "left_anti").select(
        "run_id", F.lit(None).cast("bigint").alias("line_no"), F.lit(None).cast("string").alias("line"), F.lit("not_found").alias("origin")
    )
    return own.select("run_id", "line_no", "line", "origin").unionByName(inherited).unionByName(lost)
