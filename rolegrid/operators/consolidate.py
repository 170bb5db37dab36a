"""Bringing two stores together: insert-only, foreign-key remap, survivorship, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.operators.merge import assign_ids, membership_platform

RUN_ID_OFFSET = 1000
# Which store wins a column when both know the company.
REPLACED = [
    "career_site_url", "career_site_url_source", "career_site_url_checked_at", "career_site_url_http_status",
    "career_site_url_title", "verdict", "verdict_at", "verdict_url", "verdict_run_id",
]
FILLED = [
    "website", "website_source", "article_title", "ticker", "cik", "gics_sub_industry",
    "headquarters_location", "index_membership",
]


def insert_new(state: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the other store whose key is not there yet."""
    return other.join(state.select(*key), key, "left_anti")


def remap_runs(other: DataFrame, run: str, offset: int = RUN_ID_OFFSET) -> DataFrame:
    """Run ids of the other store moved out of the way; NULL stays NULL."""
    return other.withColumn(run, F.col(run) + F.lit(offset))


def id_map(state: DataFrame, other: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """(old_id, new_id) by natural key."""
    return other.select(*key, F.col(id_col).alias("old_id")).join(state.select(*key, F.col(id_col).alias("new_id")), key).select("old_id", "new_id")


def survive(state: DataFrame, other: DataFrame, key: list[str], replaced: list[str], filled: list[str]) -> DataFrame:
    """On overlap the other store replaces some columns outright and fills others where it knows more."""
    cols = [x for x in [*replaced, *filled] if x in other.columns]
    r = other.select(*key, *[F.col(x).alias(f"__{x}") for x in cols], F.lit(True).alias("__hit"))
    j = state.join(r, key, "left")
    hit = F.col("__hit").isNotNull()
    out: dict[str, Column] = {}
    for col in cols:
        winner = F.col(f"__{col}") if col in replaced else F.coalesce(F.col(f"__{col}"), F.col(col))
        out[col] = F.when(hit, winner).otherwise(F.col(col))
    return j.withColumns(out).select(*state.columns)


def consolidate_companies(state: DataFrame, other: DataFrame, offset: int = RUN_ID_OFFSET) -> DataFrame:
    """Both stores' companies by slug. Running it again with the same other store changes nothing."""
    moved = remap_runs(other, "verdict_run_id", offset) if "verdict_run_id" in other.columns else other
    kept = survive(state, moved, ["slug"], REPLACED, FILLED)
    fresh = insert_new(state, moved, ["slug"]).drop("company_id")
    return kept.unionByName(assign_ids(fresh, state, ["slug"], "company_id"), allowMissingColumns=True)


def consolidate_attempts(state: DataFrame, other: DataFrame, company_map: DataFrame, offset: int = RUN_ID_OFFSET) -> DataFrame:
    """The other store's attempts under the new company and run ids, slots already there left out."""
    moved = (
        remap_runs(other, "run_id", offset)
        .join(company_map, F.col("company_id") == F.col("old_id"))
        .withColumn("company_id", F.col("new_id"))
        .drop("old_id", "new_id")
    )
    fresh = insert_new(state, moved, ["company_id", "run_id", "attempt_index"])
    return state.unionByName(fresh.select(*[x for x in state.columns if x in fresh.columns]), allowMissingColumns=True)


def provenance(companies: DataFrame, jobs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """company_sources: index memberships and job-board contributions, one row per (company,
    platform, source key); rows already there are left alone."""
    index_rows = companies.filter(F.col("index_membership").isin("sp500", "sp400", "sp600")).select(
        "company_id", membership_platform("index_membership").alias("platform_id"),
        F.coalesce("ticker", F.lit("")).alias("source_key"),
        F.col("created_at").alias("first_seen_at"), F.col("updated_at").alias("last_seen_at"),
    )
    board_rows = (
        jobs.filter(F.col("discovery_platform_id").isNotNull())
        .groupBy("company_id", F.col("discovery_platform_id").alias("platform_id"))
        .agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
        .select("company_id", "platform_id", F.lit("").alias("source_key"), "first_seen_at", "last_seen_at")
    )
    key = ["company_id", "platform_id", "source_key"]
    fresh = index_rows.unionByName(board_rows).dropDuplicates(key)
    return existing.unionByName(insert_new(existing, fresh, key)) if existing is not None else fresh
