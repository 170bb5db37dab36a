"""Raw captures: one immutable body per source and UTC day, first write wins; evidence files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegrid.functions import urls as U
from rolegrid.functions.base import ColumnOrName, c
from rolegrid.operators.ranking import first_per_group


def capture_day(started_at: ColumnOrName) -> Column:
    """UTC calendar day."""
    return F.date_format(F.to_utc_timestamp(c(started_at), F.current_timezone()), "yyyy-MM-dd")


def capture_name(source: ColumnOrName, ext: ColumnOrName, started_at: ColumnOrName) -> Column:
    """``<source>-YYYY-MM-DD.<ext>``"""
    return F.concat(c(source), F.lit("-"), capture_day(started_at), F.lit("."), c(ext))


def split_captures(captures: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """captures(source, ext, started_at, body, ...) with ``capture_date`` and ``raw_state``: written for
    the first of a source and day that is not stored yet, existing for every other one."""
    dated = captures.withColumn("capture_date", capture_day("started_at"))
    ident = F.struct("started_at", F.xxhash64("body"))
    firsts = dated.groupBy("source", "capture_date").agg(F.min(ident).alias("__first"))
    j = dated.join(firsts, ["source", "capture_date"]).withColumn("__lead", ident.eqNullSafe(F.col("__first"))).drop("__first")
    # Equal captures tie for the first place; only they are numbered, and one of them is written.
    tied = Window.partitionBy("source", "capture_date").orderBy(*sorted(set(captures.columns) - {"source", "started_at", "body"}), F.lit(0))
    j = j.filter("__lead").withColumn("__n", F.row_number().over(tied)).unionByName(j.filter(~F.col("__lead")).withColumn("__n", F.lit(0)))
    fresh = F.col("__n") == 1
    if existing is not None:
        have = existing.select("source", F.col("capture_date").cast("string").alias("capture_date"), F.lit(True).alias("__have")).distinct()
        j = j.join(have, ["source", "capture_date"], "left")
        fresh = fresh & F.col("__have").isNull()
    return j.withColumn("raw_state", F.when(fresh, "written").otherwise("existing")).drop("__n", "__lead", "__have")


def write_captures(captures: DataFrame, path: str, existing: DataFrame | None = None) -> DataFrame:
    """Append the new captures under source and day; returns every capture with its state."""
    blank = captures.filter((F.coalesce(F.col("source"), F.lit("")) == "") | (F.coalesce(F.col("ext"), F.lit("")) == ""))
    if not blank.isEmpty():
        raise ValueError("raw payload: source name or extension is empty")
    states = split_captures(captures, existing)
    new = first_per_group(states.filter("raw_state = 'written'"), ["source", "capture_date"], ["started_at"])
    new.drop("raw_state").write.mode("append").partitionBy("source", "capture_date").parquet(path)
    return states.withColumn("raw_name", capture_name("source", "ext", "started_at"))


def safe_path_part(text: ColumnOrName) -> Column:
    """Lower-case file-name part; anything unusual becomes '-'; 'unknown' when nothing is left."""
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(c(text)), r"[^a-z0-9\-._]", "-"), r"^[-.]+|[-.]+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("unknown"))


def extension_for(content_type: ColumnOrName) -> Column:
    return F.when(F.contains(F.lower(F.coalesce(c(content_type), F.lit(""))), F.lit("json")), "json").otherwise("html")


def evidence_path(slug: ColumnOrName, run: ColumnOrName, index: ColumnOrName, url: ColumnOrName, content_type: ColumnOrName) -> Column:
    """``raw/careers/<slug>/<run>/<idx>-<host>.<ext>``"""
    host = F.coalesce(F.nullif(U.host(url), F.lit("")), F.lit("unknown"))
    return F.concat(
        F.lit("raw/careers/"), safe_path_part(slug), F.lit("/"), c(run).cast("string"), F.lit("/"),
        c(index).cast("string"), F.lit("-"), safe_path_part(host), F.lit("."), extension_for(content_type),
    )


def evidence_rows(attempts: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to write, occupied slots). attempts(slug, run_id, attempt_index, candidate_url,
    content_type, body); an occupied slot is an error, never overwritten."""
    rows = attempts.filter(F.octet_length("body") > 0).withColumn(
        "evidence_path", evidence_path("slug", "run_id", "attempt_index", "candidate_url", "content_type")
    )
    twice = rows.groupBy("evidence_path").agg(F.count("*").alias("n")).filter("n > 1").select("evidence_path")
    taken = twice if existing is None else twice.unionByName(existing.select("evidence_path")).distinct()
    return rows.join(taken, "evidence_path", "left_anti"), rows.join(taken, "evidence_path", "left_semi")


def write_evidence(rows: DataFrame, path: str) -> None:
    """Bodies land partitioned by run, keyed by their evidence path."""
    rows.select("evidence_path", "run_id", "body").write.mode("append").partitionBy("run_id").parquet(path)
