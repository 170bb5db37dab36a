"""Seed tables: source registry and vendor playbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrid import vocab

PLATFORM_SCHEMA = "platform_id bigint, name string, platform_type string, base_url_pattern string"
PLAYBOOK_SCHEMA = "vendor string, routing string, careers_pattern string, api_hint string, external_id_pattern string"


def platforms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(vocab.PLATFORM_SEED, PLATFORM_SCHEMA)


def seed_platforms(existing: DataFrame) -> DataFrame:
    """The registry with missing seed rows added; rows already there win."""
    seeds = platforms(existing.sparkSession)
    fresh = seeds.join(existing.select("platform_id"), "platform_id", "left_anti").join(existing.select("name"), "name", "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def read_playbooks(spark: SparkSession, path: str) -> DataFrame:
    """One row per vendor; a vendor without an id pattern keys postings by URL."""
    return spark.read.schema(PLAYBOOK_SCHEMA).option("multiLine", "true").json(path)


def with_pattern(df: DataFrame, playbooks: DataFrame, vendor: str = "vendor") -> DataFrame:
    p = playbooks.select(F.col("vendor").alias(vendor), F.coalesce("external_id_pattern", F.lit("")).alias("pattern"))
    return df.join(p, vendor, "left").fillna("", ["pattern"])
