"""Read side: projections, filters and joins over companies, postings, runs and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid import vocab
from rolegrid.functions.base import ColumnOrName, attach_row, c
from rolegrid.functions.text import literal_search
from rolegrid.functions.times import rfc3339
from rolegrid.operators.ranking import latest_run

UNKNOWN_COMPANY = "Unknown company"
# The public columns of a posting.
JOB_COLUMNS = [
    "job_id", "title", "company_name", "status", "employment_type", "location_text", "country",
    "is_remote", "salary_min_cents", "salary_max_cents", "salary_currency", "salary_period",
    "posted_at", "first_seen_at", "last_seen_at", "description", "listing_url", "application_url",
    "discovery_url", "scrape_run_id",
]
MAX_LIMIT, DEFAULT_LIMIT = 100, 25


def page_bounds(limit: int | str | None = None, offset: int | str | None = None) -> tuple[int, int]:
    """Checked (limit, offset): limit 1..100 (default 25), offset >= 0."""

    def integer(name: str, value, default: int) -> int:
        if value is None or value == "":
            return default
        try:
            return int(value)
        except (TypeError, ValueError):
            raise ValueError(f"{name} must be an integer") from None

    size, start = integer("limit", limit, DEFAULT_LIMIT), integer("offset", offset, 0)
    if not 1 <= size <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    if start < 0:
        raise ValueError("offset must not be negative")
    return size, start


def with_company(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Postings with their company name (left outer). Spark broadcasts companies only when they fit."""
    return jobs.join(companies.select("company_id", F.col("name").alias("company_name")), "company_id", "left")


def job_rows(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """The public posting projection."""
    return with_company(jobs, companies).select(*JOB_COLUMNS)


def job_status_filter(jobs: DataFrame, status: str | None = None) -> DataFrame:
    """``open`` unless told otherwise; ``all`` keeps everything; anything undeclared is an error."""
    wanted = (status or "").strip().lower() or vocab.DEFAULT_JOB_STATUS
    if wanted == "all":
        return jobs
    if wanted not in vocab.JOB_STATUSES:
        raise ValueError("status must be one of open, closed, filled, unknown, or all")
    return jobs.filter(F.col("status") == wanted)


def job_page(jobs: DataFrame, companies: DataFrame, status: str | None, limit: int, offset: int = 0) -> DataFrame:
    """One page of postings, newest first. The cut happens before the company join."""
    kept = job_status_filter(jobs, status)
    cut = kept.orderBy(F.coalesce("posted_at", "first_seen_at").desc(), F.desc("job_id")).offset(offset).limit(limit)
    return job_rows(cut, companies)


def flag01(value: ColumnOrName, label: str) -> Column:
    """Boolean of a 0/1 column; any other value fails the job."""
    v = c(value)
    message = F.concat(F.lit(f"{label} = "), F.coalesce(v.cast("string"), F.lit("NULL")), F.lit(", want 0 or 1"))
    return F.when(v == 1, F.lit(True)).when(v == 0, F.lit(False)).otherwise(F.raise_error(message).cast("boolean"))


def wire_instant(text: ColumnOrName, label: str, nullable: bool = False) -> Column:
    """Canonical UTC text of an RFC 3339 text; anything else fails the job."""
    from rolegrid.functions.times import parse_instant

    t = c(text)
    parsed = F.when(t.rlike(r"T\d{2}:\d{2}:\d{2}.*(Z|[+-]\d{2}:\d{2})$"), parse_instant(t))
    bad = F.raise_error(F.concat(F.lit(f"{label} is not RFC3339: "), F.coalesce(t, F.lit("NULL"))))
    shown = F.when(parsed.isNotNull(), rfc3339(parsed)).otherwise(bad.cast("string"))
    return F.when(t.isNull(), F.lit(None).cast("string")).otherwise(shown) if nullable else shown


def job_wire(rows: DataFrame, remote_flag: str = "is_remote") -> DataFrame:
    """Outward posting rows: nested salary, fallback company name, checked flag and timestamps."""
    return rows.select(
        "job_id", "title", F.coalesce("company_name", F.lit(UNKNOWN_COMPANY)).alias("company_name"), "status",
        "employment_type", "location_text", "country", flag01(remote_flag, "is_remote").alias("is_remote"),
        F.struct(
            F.col("salary_min_cents").alias("min_cents"), F.col("salary_max_cents").alias("max_cents"),
            F.col("salary_currency").alias("currency"), F.col("salary_period").alias("period"),
        ).alias("salary"),
        wire_instant("posted_at", "posted_at", nullable=True).alias("posted_at"),
        wire_instant("first_seen_at", "first_seen_at").alias("first_seen_at"),
        wire_instant("last_seen_at", "last_seen_at").alias("last_seen_at"),
    )


def company_filter(
    companies: DataFrame, attempts: DataFrame, membership: str | None = None, resolution: str | None = None, search: str | None = None
) -> DataFrame:
    """Companies by index membership, resolution state and literal search."""
    if membership and membership not in vocab.INDEX_MEMBERSHIPS:
        raise ValueError(f"index must be one of sp500, sp400, sp600; got {membership!r}")
    if resolution not in (None, "", "resolved", "unresolved", "unattempted"):
        raise ValueError(f"resolution must be resolved, unresolved or unattempted; got {resolution!r}")
    out = companies
    if membership:
        out = out.filter(F.col("index_membership") == membership)
    if resolution == "resolved":
        out = out.filter(F.col("career_site_url").isNotNull())
    elif resolution == "unresolved":
        out = attempted(out.filter(F.col("career_site_url").isNull()), attempts)
    elif resolution == "unattempted":
        out = unattempted(out.filter(F.col("career_site_url").isNull()), attempts)
    if search and search.strip():
        out = out.filter(literal_search(["name", "slug"], search))
    return out


def attempted(companies: DataFrame, attempts: DataFrame) -> DataFrame:
    """Companies with at least one attempt. Keys are made distinct on the map side first."""
    return companies.join(attempts.select("company_id").distinct(), "company_id", "left_semi")


def unattempted(companies: DataFrame, attempts: DataFrame) -> DataFrame:
    """Companies with no attempt."""
    return companies.join(attempts.select("company_id").distinct(), "company_id", "left_anti")


def with_attempt_count(companies: DataFrame, attempts: DataFrame) -> DataFrame:
    counts = attempts.groupBy("company_id").agg(F.count("*").alias("attempt_count"))
    return companies.join(counts, "company_id", "left").fillna(0, ["attempt_count"])


def company_wire(companies: DataFrame, attempts: DataFrame) -> DataFrame:
    """Outward company rows: NULL stays NULL, the attempt count is 0 when there is none."""
    return with_attempt_count(companies, attempts).select(
        "company_id", "slug", "name", "industry", "index_membership", "website", "career_site_url",
        F.col("verdict").alias("career_site_url_verdict"), "attempt_count", "updated_at",
    )


def company_page(companies: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return companies.orderBy(F.lower("name"), "company_id").offset(offset).limit(limit)


def attempt_wire(attempts: DataFrame) -> DataFrame:
    return attempts.select(
        "id", "run_id", "attempt_index", "source", "candidate_url", "candidate_kind", "http_status",
        "final_url", "title", "validation_status", "rejection_reason", "evidence_path", "created_at",
    )


def run_wire(runs: DataFrame) -> DataFrame:
    """Outward run rows with checked dry-run flag and timestamps (RFC 3339 text in)."""
    return runs.select(
        "id", "platform", "status",
        wire_instant("started_at", "started_at").alias("started_at"),
        wire_instant("finished_at", "finished_at", nullable=True).alias("finished_at"),
        "items_found", "items_inserted", "items_updated", "items_wrong", "items_unverifiable",
        flag01("dry_run", "dry_run").alias("dry_run"), "error_text",
    )


def runs_with_platform(runs: DataFrame, platforms: DataFrame, tolerant: bool = False) -> DataFrame:
    """Runs with their platform name; the tolerant form keeps runs of an unknown platform as ''."""
    names = platforms.select("platform_id", F.col("name").alias("platform"))
    joined = runs.join(names, "platform_id", "left" if tolerant else "inner")
    return joined.withColumn("platform", F.coalesce("platform", F.lit(""))) if tolerant else joined


def run_search(runs: DataFrame, search: str | None) -> DataFrame:
    """Literal, case-insensitive match on platform or status."""
    return runs.filter(literal_search(["platform", "status"], search)) if search and search.strip() else runs


def run_page(runs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("id")).offset(offset).limit(limit)


def production_runs(runs: DataFrame) -> DataFrame:
    """Runs that count: dry runs are out of every production report."""
    return runs.filter(~F.col("dry_run"))


def production_attempts(attempts: DataFrame, runs: DataFrame) -> DataFrame:
    """Attempts that do not belong to a dry run (attempts without a run stay)."""
    dry = runs.filter(F.col("dry_run")).select(F.col("id").alias("run_id"))
    return attempts.join(dry, "run_id", "left_anti")


def lookup(df: DataFrame, key: str, values: list) -> DataFrame:
    """Rows by key; a missing key is an empty result, not an error."""
    return df.filter(F.col(key).isin(values)) if values else df.limit(0)


def scrape_inputs(companies: DataFrame) -> DataFrame:
    """What a listings run needs to know about a company."""
    blank = F.lit("")
    return companies.select(
        "company_id", "slug", "name",
        F.coalesce("career_site_url", blank).alias("career_site_url"),
        F.coalesce("listings_url", blank).alias("listings_url"),
        F.coalesce("listings_url_resolved_at", blank).alias("listings_url_resolved_at"),
        "listings_url_remote_confirmed",
    )


def scrape_targets(companies: DataFrame, company_platforms: DataFrame, platforms: DataFrame, runs: DataFrame) -> DataFrame:
    """Companies with a careers URL and a vendor, with their latest run."""
    last = latest_run(runs).select("company_id", F.col("id").alias("last_run_id"), F.col("status").alias("last_run_status"))
    return (
        companies.filter(F.col("career_site_url") != "")
        .select("company_id", "slug", "name")
        .join(company_platforms.select("company_id", "platform_id"), "company_id")
        .join(platforms.select("platform_id", F.col("name").alias("vendor")), "platform_id")
        .join(last, "company_id", "left")
        .select("company_id", "slug", "name", "vendor", "last_run_id", "last_run_status")
    )


def company_detail(companies: DataFrame, attempts: DataFrame, company_platforms: DataFrame, platforms: DataFrame) -> DataFrame:
    """Company facts, vendor and the attempt trail as rows (one per attempt, one bare row without)."""
    vendor = company_platforms.join(platforms.select("platform_id", F.col("name").alias("vendor")), "platform_id").select("company_id", "vendor")
    trail = attempts.select("company_id", F.col("id").alias("attempt_id"), "run_id", "attempt_index", "validation_status")
    return (
        with_attempt_count(companies, attempts).select("company_id", "slug", "name", "attempt_count")
        .join(vendor, "company_id", "left")
        .join(trail, "company_id", "left")
    )


def churn_filter(changes: DataFrame, membership: str | None = None, search: str | None = None) -> DataFrame:
    out = changes
    if membership:
        out = out.filter(F.col("index_membership") == membership)
    if search and search.strip():
        out = out.filter(literal_search(["name", "slug"], search))
    return out


# --- work selection -----------------------------------------------------------------------------


def verdict_not_current() -> Column:
    """No verdict, or one about another URL than the stored one."""
    return F.col("verdict").isNull() | F.col("verdict_url").isNull() | (F.col("verdict_url") != F.col("career_site_url"))


def stored_urls(companies: DataFrame, slugs: list[str] | None = None, skip_validated: bool = False, cutoff: ColumnOrName | None = None) -> DataFrame:
    """Companies whose stored URL is worth judging."""
    out = companies.filter(F.trim("career_site_url") != "")
    if slugs:
        out = out.filter(F.col("slug").isin([s.strip() for s in slugs]))
    if skip_validated:
        out = out.filter(verdict_not_current())
    if cutoff is not None:
        out = out.filter(verdict_not_current() | F.col("verdict_at").isNull() | (F.col("verdict_at") < c(cutoff)))
    return out.select("company_id", "slug", "name", "career_site_url")


def resolution_work(
    companies: DataFrame, slugs: list[str] | None = None, refresh: bool = False, refresh_failed: bool = False
) -> DataFrame:
    """companies with ``skip_reason`` (NULL = work on it)."""
    has_url = F.coalesce(F.col("career_site_url"), F.lit("")) != ""
    wanted = F.col("slug").isin([s.strip() for s in slugs if s.strip()]) if slugs and any(s.strip() for s in slugs) else F.lit(True)
    reason = (
        F.when(~wanted, F.lit("not_selected"))
        .when(F.lit(refresh_failed) & has_url, F.lit("already_resolved"))
        .when(has_url & F.lit(not refresh and not refresh_failed), F.lit("already_resolved"))
    )
    return companies.withColumn("skip_reason", reason)


def select_work(companies: DataFrame, limit: int = 0, **options) -> DataFrame:
    """The companies to resolve, in slug order, up to the limit (0 = no limit)."""
    work = resolution_work(companies, **options).filter(F.col("skip_reason").isNull()).drop("skip_reason")
    return work.orderBy("slug").limit(limit) if limit > 0 else work


def select_validation(companies: DataFrame, slugs: list[str] | None = None, limit: int = 0) -> DataFrame:
    allowed = [s.strip() for s in slugs or [] if s.strip()]
    out = companies.filter(F.col("slug").isin(allowed)) if allowed else companies
    return out.orderBy("slug").limit(limit) if limit > 0 else out


def load_companies(companies: DataFrame) -> DataFrame:
    """Companies with defaults: NULL text as '', the article falling back to the name."""
    blank = F.lit("")
    return companies.select(
        "company_id", "slug", "name",
        F.coalesce("career_site_url", blank).alias("career_site_url"),
        F.coalesce("website", blank).alias("website"),
        F.coalesce(F.nullif("article_title", blank), F.col("name")).alias("article"),
    )


def cached_listings(companies: DataFrame, now: ColumnOrName, ttl_seconds: int, refresh: bool = False) -> DataFrame:
    """Adds ``cache_usable``: a listings URL whose parseable age is within the ttl."""
    from rolegrid.functions.times import parse_instant

    resolved = F.when(
        F.col("listings_url_resolved_at").rlike(r"T\d{2}:\d{2}:\d{2}.*(Z|[+-]\d{2}:\d{2})$"),
        parse_instant("listings_url_resolved_at"),
    )
    age = F.unix_micros(c(now)) - F.unix_micros(resolved)
    fresh = (F.col("listings_url") != "") & (age <= ttl_seconds * 1_000_000)
    usable = F.lit(False) if refresh or ttl_seconds <= 0 else F.coalesce(fresh, F.lit(False))
    return companies.withColumn("cache_usable", usable)


def us_only(postings: DataFrame) -> DataFrame:
    """Readable US postings. Unknown is not US; rows with an error or no URL are out before counting."""
    return readable(postings).filter(F.col("is_us").eqNullSafe(True))


def readable(postings: DataFrame) -> DataFrame:
    return postings.filter((F.coalesce(F.col("url"), F.lit("")) != "") & (F.coalesce(F.col("error"), F.lit("")) == ""))


def us_counts(postings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    us = F.col("is_us").eqNullSafe(True)
    return readable(postings).groupBy(*(keys or [])).agg(F.count_if(us).alias("kept"), F.count_if(~us).alias("skipped_non_us"))


# --- status counts ------------------------------------------------------------------------------


def total(df: DataFrame) -> DataFrame:
    """The filtered total that accompanies a page."""
    return df.agg(F.count("*").alias("total"))


def pipeline_status(companies: DataFrame, company_platforms: DataFrame, jobs: DataFrame) -> DataFrame:
    """Eight counts in one row; each input is scanned once."""
    has_url = F.col("career_site_url") != ""
    vendors = company_platforms.groupBy("company_id").agg(F.count("*").alias("vendors"))
    c_row = companies.join(vendors, "company_id", "left").agg(
        F.count("*").alias("companies"),
        F.count_if(has_url).alias("career_site_urls"),
        F.coalesce(F.sum(F.when(has_url, F.col("vendors"))), F.lit(0)).alias("scrape_targets"),
        F.count_if(F.col("listings_url").isNotNull()).alias("cached_listings_urls"),
        F.count_if(F.col("listings_url_remote_confirmed")).alias("confirmed_remote_roles"),
    )
    j_row = jobs.agg(
        F.count("*").alias("jobs"),
        F.count_if(F.col("status") == "open").alias("open_jobs"),
        F.countDistinct("company_id").alias("companies_with_jobs"),
    )
    return attach_row(c_row, j_row)


def next_step(status: DataFrame) -> DataFrame:
    """First step that is not done and ready (0 = none) and how warm the listings cache is."""
    step = (
        F.when(F.col("companies") == 0, 1)
        .when((F.col("career_site_urls") == 0) & (F.col("companies") > 0), 2)
        .when((F.col("scrape_targets") == 0) & (F.col("career_site_urls") > 0), 3)
        .otherwise(0)
    )
    warm = F.floor(F.col("cached_listings_urls") * 100 / F.nullif(F.col("scrape_targets"), F.lit(0)) + 0.5)
    state = (
        F.when(F.col("scrape_targets") == 0, "nothing")
        .when(F.col("cached_listings_urls") == 0, "cold")
        .when(F.col("cached_listings_urls") >= F.col("scrape_targets"), "warm")
        .otherwise("partly")
    )
    return status.select(step.cast("bigint").alias("next_step"), warm.cast("bigint").alias("warm_pct"), state.alias("cache_state"))


def source_contribution(jobs: DataFrame) -> DataFrame:
    """First and last sighting per (company, platform)."""
    return (
        jobs.filter(F.col("discovery_platform_id").isNotNull())
        .groupBy("company_id", F.col("discovery_platform_id").alias("platform_id"))
        .agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
    )
