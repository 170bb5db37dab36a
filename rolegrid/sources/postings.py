"""Extractor output files: ``{listings_url, jobs: [...]}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrid.functions.base import blank_to_null
from rolegrid.functions.jsonld import parse_posting
from rolegrid.functions.urls import external_id
from rolegrid.operators.reads import us_only

POSTINGS_SCHEMA = (
    "listings_url string, total_links bigint, blocked boolean, block_reason string, jobs array<struct<url:string,title:string,"
    "description:string,raw_data:string,location_text:string,country:string,is_us:boolean,error:string,block_reason:string>>"
)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """One row per posting of every extractor file, with its position."""
    files = spark.read.schema(POSTINGS_SCHEMA).option("multiLine", "true").json(path)
    return explode_postings(files)


def explode_postings(files: DataFrame) -> DataFrame:
    keep = [x for x in files.columns if x not in ("jobs", "blocked", "block_reason")]
    return files.select(*keep, F.posexplode("jobs").alias("ordinal", "j")).select(*keep, F.col("ordinal").cast("bigint").alias("ordinal"), "j.*")


def posting_batch(postings: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Upsert batch of readable US postings: keyed by the vendor's id pattern, typed by their JSON."""
    rows = us_only(postings).withColumn("__p", parse_posting("raw_data"))
    others = [x for x in ("company_id", "discovery_platform_id", "scrape_run_id") if x in postings.columns]
    return rows.select(
        *others, external_id("url", pattern).alias("external_id"), F.col("url").alias("listing_url"),
        F.coalesce("title", F.lit("")).alias("title"), blank_to_null("description").alias("description"),
        blank_to_null("location_text").alias("location_text"), blank_to_null("country").alias("country"), "is_us",
        F.lit(True).alias("is_remote"), blank_to_null("__p.employment_type").alias("employment_type"), F.col("__p.posted_at").alias("posted_at"),
        blank_to_null("raw_data").alias("raw_data"), "ordinal",
    )
