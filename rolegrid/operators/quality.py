"""Data-quality checks and outcome reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid import vocab
from rolegrid.functions.base import ColumnOrName, attach_row, c
from rolegrid.functions.text import slugify


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, child_name: str, parent_name: str) -> DataFrame:
    """One row (child, parent, orphans): non-NULL foreign keys without a parent. Keys are counted
    before the join, so a hot key costs one row."""
    keys = child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("__k")).agg(F.count("*").alias("n"))
    lost = keys.join(parent.select(F.col(pk).alias("__k")), "__k", "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")).select(
        F.lit(child_name).alias("child"), F.lit(parent_name).alias("parent"), "orphans"
    )


def duplicates(df: DataFrame, key: list[str], partial: bool = True) -> DataFrame:
    """Keys held by more than one row; a partial key counts only rows where every part is there."""
    rows = df
    if partial:
        for k in key:
            rows = rows.filter(F.col(k).isNotNull())
    return rows.groupBy(*key).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def rule_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, broken, checked) of CHECK-style rules in one pass. As in SQL, NULL passes a rule."""
    wide = df.agg(
        F.count("*").alias("checked"), *[F.count_if(~F.coalesce(cond, F.lit(True))).alias(f"r{i}") for i, cond in enumerate(rules.values())]
    )
    pairs = [F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("broken")) for i, name in enumerate(rules)]
    return wide.select("checked", F.explode(F.array(*pairs)).alias("x")).select("x.rule", "x.broken", "checked")


def json_valid(text: ColumnOrName) -> Column:
    return F.try_parse_json(c(text)).isNotNull()




def job_rules() -> dict[str, Column]:
    return {
        "status_declared": F.col("status").isin(vocab.JOB_STATUSES),
        "employment_type_declared": F.col("employment_type").isin(vocab.EMPLOYMENT_TYPES),
        "salary_period_declared": F.col("salary_period").isin(vocab.SALARY_PERIODS),
        "raw_data_is_json": F.when(F.col("raw_data").isNotNull(), json_valid("raw_data")),
    }


def attempt_rules() -> dict[str, Column]:
    accepted = F.col("validation_status") == "accepted"
    return {
        "kind_declared": F.col("candidate_kind").isin(vocab.CANDIDATE_KINDS),
        "status_declared": F.col("validation_status").isin(vocab.ATTEMPT_STATUSES),
        "accepted_iff_no_reason": accepted == F.col("rejection_reason").isNull(),
    }


def slug_collisions(names: DataFrame, name: str) -> DataFrame:
    """Slugs shared by two or more distinct names."""
    pairs = names.select(slugify(name).alias("slug"), F.col(name).alias("name")).distinct()
    return pairs.groupBy("slug").agg(F.count("*").alias("names")).filter(F.col("names") > 1)


def share_classes(rows: DataFrame, name: str = "name") -> DataFrame:
    """Rows of one index whose names collapse to one slug (share classes of one company)."""
    return rows.groupBy(slugify(name).alias("slug")).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def worst_exit(codes: DataFrame, keys: list[str], code: str = "code", ordinal: str = "ordinal", collision: int = 5) -> DataFrame:
    """Exit code of several runs: the first real failure, else a collision, else 0."""
    real = ~F.col(code).isin(0, collision)
    first = F.min_by(F.when(real, F.col(code)), F.when(real, F.col(ordinal)))
    other = F.max(F.when(F.col(code) == collision, F.lit(collision)))
    return codes.groupBy(*keys).agg(F.coalesce(first, other, F.lit(0)).cast("bigint").alias("exit_code"))


def exit_class(failed: ColumnOrName, good: ColumnOrName) -> Column:
    """1 with failures, 0 with any result, 4 when the run produced nothing."""
    return F.when(c(failed) > 0, 1).when(c(good) > 0, 0).otherwise(4).cast("bigint")


def lost_evidence(attempts: DataFrame, root: str = "/tmp/") -> DataFrame:
    """Attempts whose evidence sits under a vanished root."""
    return attempts.agg(F.count_if(F.col("evidence_path").startswith(root)).alias("lost"))


def noise_share(attempts: DataFrame) -> DataFrame:
    """Per source: attempts, those with an empty final URL, and their share in per mille."""
    empty = F.count_if(F.coalesce(F.col("final_url"), F.lit("")) == "")
    return attempts.groupBy("source").agg(
        F.count("*").alias("attempts"), empty.alias("empty"), F.floor(empty * 1000 / F.count("*")).cast("bigint").alias("empty_per_mille")
    )


def reason_tally(attempts: DataFrame) -> DataFrame:
    """What failed and why."""
    return attempts.filter(F.col("rejection_reason").isNotNull()).groupBy("rejection_reason").agg(F.count("*").alias("n"))


BUCKETS = ["resolved", "no_homepage", "blocked", "policy", "no_careers", "untouched"]
POLICY_REASONS = ["product_or_investor_path", "locale_only_path", "generic_title_without_company", "unverifiable_ats_title"]


def failure_buckets(companies: DataFrame, attempts: DataFrame) -> DataFrame:
    """Every company in exactly one bucket, by priority, with its share in per cent."""
    tried = attempts.filter(F.col("source") != "robots_sitemap").groupBy("company_id").agg(
        F.bool_or(F.coalesce(F.col("rejection_reason").isin(vocab.BLOCKED_REASONS), F.lit(False))).alias("blocked"),
        F.bool_or(F.coalesce(F.col("rejection_reason").isin(POLICY_REASONS), F.lit(False))).alias("policy"),
    )
    j = companies.join(tried, "company_id", "left")
    bucket = (
        F.when(F.coalesce(F.col("career_site_url"), F.lit("")) != "", "resolved")
        .when(F.col("blocked").isNull(), "untouched")
        .when(F.coalesce(F.col("website"), F.lit("")) == "", "no_homepage")
        .when(F.col("blocked"), "blocked")
        .when(F.col("policy"), "policy")
        .otherwise("no_careers")
    )
    counts = j.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("companies"))
    size = companies.agg(F.count("*").alias("__all"))
    return attach_row(counts, size).select(
        "bucket", "companies", F.round(F.col("companies") * 100 / F.col("__all"), 1).alias("share_pct")
    )


def verdict_rollup(rows: DataFrame, verdict: str = "verdict", reason: str = "reason") -> DataFrame:
    """Counts per (verdict, reason), per verdict and overall; ``level`` tells totals from NULLs."""
    return rows.rollup(verdict, reason).agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))


def census(rows: DataFrame, url: str, klass: str, words: tuple[str, ...] = ("career", "job")) -> DataFrame:
    """URL names careers or not × class, with the margins."""
    named = F.when(F.lower(url).rlike("|".join(words)), F.lit("careers word")).otherwise("neither word")
    return rows.select(named.alias("url_contains"), F.col(klass).alias("class")).cube("url_contains", "class").agg(
        F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level")
    )
