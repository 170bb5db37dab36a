"""Registered queries: projections, filters, joins, pages and status counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolegrid.catalog.registry import Tables, query
from rolegrid.functions import times
from rolegrid.operators import ranking, reads

_JOBSEL = """j.job_id, j.title, c.name AS company_name, j.status, j.employment_type, j.location_text, j.country, j.is_remote,
j.salary_min_cents, j.salary_max_cents, j.salary_currency, j.salary_period, epoch_us(j.posted_at) AS posted_at,
epoch_us(j.first_seen_at) AS first_seen_at, epoch_us(j.last_seen_at) AS last_seen_at, j.description, j.listing_url,
j.application_url, j.discovery_url, j.scrape_run_id"""


def _micros(df, *names):
    return df.withColumns({n: F.unix_micros(n) for n in names})


@query("p1_j1_job_projection", f"SELECT {_JOBSEL} FROM jobs j LEFT JOIN companies c USING (company_id)")
def _p1(t: Tables):
    return _micros(reads.job_rows(t.jobs, t.companies), "posted_at", "first_seen_at", "last_seen_at")


@query("p2_job_wire_rows", """
SELECT j.job_id, coalesce(c.name, 'Unknown company') AS company_name, (j.is_remote = 1) AS is_remote,
       salary_min_cents AS min_cents, salary_max_cents AS max_cents, salary_currency AS currency, salary_period AS period,
       strftime(posted_at, '%Y-%m-%dT%H:%M:%SZ') AS posted_at, strftime(first_seen_at, '%Y-%m-%dT%H:%M:%SZ') AS first_seen_at,
       strftime(last_seen_at, '%Y-%m-%dT%H:%M:%SZ') AS last_seen_at
  FROM jobs j LEFT JOIN companies c USING (company_id)""")
def _p2(t: Tables):
    text = {n: F.date_format(n, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") for n in ("posted_at", "first_seen_at", "last_seen_at")}
    wire = reads.job_wire(reads.job_rows(t.jobs, t.companies).withColumns(text))
    return wire.select("job_id", "company_name", "is_remote", "salary.*", "posted_at", "first_seen_at", "last_seen_at")


@query("p3_job_status_default_open", "SELECT job_id, title FROM jobs WHERE status = 'open'")
def _p3(t: Tables):
    return reads.job_status_filter(t.jobs, None).select("job_id", "title")


@query("a1_filtered_total", "SELECT CAST(count(*) AS BIGINT) AS total FROM jobs WHERE status = 'closed'")
def _a1(t: Tables):
    return reads.total(reads.job_status_filter(t.jobs, "Closed "))


@query("o1_jobs_page", f"""
SELECT {_JOBSEL} FROM jobs j LEFT JOIN companies c USING (company_id) WHERE j.status = 'open'
 ORDER BY coalesce(j.posted_at, j.first_seen_at) DESC, j.job_id DESC LIMIT 50 OFFSET 100""")
def _o1(t: Tables):
    return _micros(reads.job_page(t.jobs, t.companies, "open", 50, 100), "posted_at", "first_seen_at", "last_seen_at")


@query("p4_company_filter_resolved", """
SELECT company_id, slug FROM companies WHERE index_membership = 'sp400' AND career_site_url IS NOT NULL
   AND (contains(lower(name), '#0000000') OR contains(lower(slug), '#0000000'))""")
def _p4(t: Tables):
    return reads.company_filter(t.companies, t.attempts, "sp400", "resolved", "#0000000").select("company_id", "slug")


@query("p4_j3_companies_unresolved", """
SELECT company_id, slug FROM companies c WHERE career_site_url IS NULL AND EXISTS (SELECT 1 FROM attempts a WHERE a.company_id = c.company_id)""")
def _j3(t: Tables):
    return reads.company_filter(t.companies, t.attempts, resolution="unresolved").select("company_id", "slug")


@query("p4_j4_companies_unattempted", """
SELECT company_id, slug FROM companies c WHERE career_site_url IS NULL AND NOT EXISTS (SELECT 1 FROM attempts a WHERE a.company_id = c.company_id)""")
def _j4(t: Tables):
    return reads.company_filter(t.companies, t.attempts, resolution="unattempted").select("company_id", "slug")


@query("f22_literal_search", r"SELECT company_id FROM companies WHERE contains(lower(name), 'r#00') OR contains(lower(slug), 'r#00')")
def _f22(t: Tables):
    return reads.company_filter(t.companies, t.attempts, search="R#00").select("company_id")


@query("j2_runs_with_platform", "SELECT r.id, p.name AS platform, r.status, r.items_found FROM runs r JOIN platforms p USING (platform_id)")
def _j2(t: Tables):
    return reads.runs_with_platform(t.runs, t.platforms).select("id", "platform", "status", "items_found")


@query("j2_runs_with_platform_tolerant", """
SELECT r.id, coalesce(p.name, '') AS platform FROM runs r
  LEFT JOIN (SELECT * FROM platforms WHERE platform_type = 'application_system') p USING (platform_id)""")
def _j2t(t: Tables):
    known = t.platforms.filter("platform_type = 'application_system'")
    return reads.runs_with_platform(t.runs, known, tolerant=True).select("id", "platform")


@query("p5_run_search", """
SELECT r.id, p.name AS platform, r.status FROM runs r JOIN platforms p USING (platform_id)
 WHERE instr(lower(p.name), 'n_2') > 0 OR instr(lower(r.status), 'n_2') > 0""")
def _p5(t: Tables):
    return reads.run_search(reads.runs_with_platform(t.runs, t.platforms), "N_2").select("id", "platform", "status")


@query("p5_run_search_status", "SELECT r.id FROM runs r JOIN platforms p USING (platform_id) WHERE contains(lower(status), 'run') OR contains(lower(p.name), 'run')")
def _p5b(t: Tables):
    return reads.run_search(reads.runs_with_platform(t.runs, t.platforms), "Run").select("id")


@query("o3_runs_page", """
SELECT r.id, p.name AS platform, epoch_us(r.started_at) AS started_at FROM runs r JOIN platforms p USING (platform_id)
 ORDER BY r.started_at DESC, r.id DESC LIMIT 25 OFFSET 25""")
def _o3(t: Tables):
    return _micros(reads.run_page(reads.runs_with_platform(t.runs, t.platforms), 25, 25).select("id", "platform", "started_at"), "started_at")


@query("o2_j5_companies_page", """
SELECT c.company_id, c.slug, c.name, c.index_membership, CAST(coalesce(a.n, 0) AS BIGINT) AS attempt_count, epoch_us(c.updated_at) AS updated_at
  FROM companies c LEFT JOIN (SELECT company_id, count(*) AS n FROM attempts GROUP BY 1) a USING (company_id)
 ORDER BY lower(c.name), c.company_id LIMIT 60 OFFSET 120""")
def _o2(t: Tables):
    wire = reads.company_wire(reads.company_page(t.companies, 60, 120), t.attempts)
    return _micros(wire.select("company_id", "slug", "name", "index_membership", "attempt_count", "updated_at"), "updated_at")


@query("p24_company_wire_rows", """
SELECT c.company_id, c.slug, c.name, c.industry, c.index_membership, c.website, c.career_site_url, c.verdict AS career_site_url_verdict,
       CAST(coalesce(a.n, 0) AS BIGINT) AS attempt_count, epoch_us(c.updated_at) AS updated_at
  FROM companies c LEFT JOIN (SELECT company_id, count(*) AS n FROM attempts GROUP BY 1) a USING (company_id)""")
def _p24(t: Tables):
    return _micros(reads.company_wire(t.companies, t.attempts), "updated_at")


@query("p24_run_wire_rows", """
SELECT id, CAST(platform_id AS STRING) AS platform, status, strftime(started_at, '%Y-%m-%dT%H:%M:%SZ') AS started_at,
       strftime(finished_at, '%Y-%m-%dT%H:%M:%SZ') AS finished_at, items_found, dry_run, error_text FROM runs""")
def _p24r(t: Tables):
    text = {n: F.date_format(n, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") for n in ("started_at", "finished_at")}
    runs = t.runs.withColumns(text).withColumns({
        "platform": F.col("platform_id").cast("string"), "dry_run": F.col("dry_run").cast("int"),
        "items_wrong": F.lit(0), "items_unverifiable": F.lit(0)})
    return reads.run_wire(runs).select("id", "platform", "status", "started_at", "finished_at", "items_found", "dry_run", "error_text")


@query("p24_attempt_wire_rows", """
SELECT id, run_id, attempt_index, source, candidate_url, candidate_kind, http_status, final_url, title, validation_status,
       rejection_reason, evidence_path, epoch_us(created_at) AS created_at FROM attempts""")
def _p24a(t: Tables):
    return _micros(reads.attempt_wire(t.attempts), "created_at")


@query("p16_production_runs", "SELECT id, status FROM runs WHERE NOT dry_run")
def _p16(t: Tables):
    return reads.production_runs(t.runs).select("id", "status")


@query("p23_point_lookups", "SELECT job_id, title, status FROM jobs WHERE job_id IN (1, 77, 14999, -5)")
def _p23(t: Tables):
    return reads.lookup(t.jobs, "job_id", [1, 77, 14999, -5]).select("job_id", "title", "status")


@query("p23_company_by_slug", "SELECT company_id, slug, name FROM companies WHERE slug IN ('customer-000000007', 'nobody')")
def _p23c(t: Tables):
    return reads.lookup(t.companies, "slug", ["customer-000000007", "nobody"]).select("company_id", "slug", "name")


@query("p23_scrape_inputs", """
SELECT company_id, slug, name, coalesce(career_site_url, '') AS career_site_url, coalesce(listings_url, '') AS listings_url,
       coalesce(listings_url_resolved_at, '') AS listings_url_resolved_at, listings_url_remote_confirmed FROM companies""")
def _p23s(t: Tables):
    return reads.scrape_inputs(t.companies)


@query("j6_scrape_targets", """
SELECT c.company_id, c.slug, p.name AS vendor, r.id AS last_run_id, r.status AS last_run_status
  FROM companies c JOIN company_platforms USING (company_id) JOIN platforms p USING (platform_id)
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY started_at DESC, id DESC) AS rn FROM runs) WHERE rn = 1) r
    USING (company_id)
 WHERE c.career_site_url IS NOT NULL AND c.career_site_url <> ''""")
def _j6(t: Tables):
    return reads.scrape_targets(t.companies, t.company_platforms, t.platforms, t.runs).drop("name")


@query("j7_company_detail", """
SELECT c.company_id, c.slug, CAST(coalesce(n.n, 0) AS BIGINT) AS attempt_count, p.name AS vendor, a.id AS attempt_id, a.run_id, a.attempt_index, a.validation_status
  FROM companies c LEFT JOIN (SELECT company_id, count(*) AS n FROM attempts GROUP BY 1) n USING (company_id)
  LEFT JOIN company_platforms cp USING (company_id) LEFT JOIN platforms p USING (platform_id)
  LEFT JOIN attempts a USING (company_id)""")
def _j7(t: Tables):
    return reads.company_detail(t.companies, t.attempts, t.company_platforms, t.platforms).drop("name")


@query("p7_stored_urls_skip_validated", """
SELECT company_id, slug, career_site_url FROM companies
 WHERE career_site_url IS NOT NULL AND trim(career_site_url) <> ''
   AND (verdict IS NULL OR verdict_url IS NULL OR verdict_url <> career_site_url)""")
def _p7(t: Tables):
    return reads.stored_urls(t.companies, skip_validated=True).drop("name")


@query("p8_stale_verdicts", """
SELECT company_id, slug FROM companies
 WHERE career_site_url IS NOT NULL AND trim(career_site_url) <> ''
   AND ((verdict IS NULL OR verdict_url IS NULL OR verdict_url <> career_site_url)
        OR verdict_at IS NULL OR verdict_at < TIMESTAMP '2023-11-18 00:00:00')""")
def _p8(t: Tables):
    return reads.stored_urls(t.companies, cutoff=F.lit("2023-11-18 00:00:00").cast("timestamp")).select("company_id", "slug")


@query("p9_resolution_work", """
SELECT company_id, CASE WHEN coalesce(career_site_url, '') <> '' THEN 'already_resolved' END AS skip_reason FROM companies""")
def _p9(t: Tables):
    return reads.resolution_work(t.companies).select("company_id", "skip_reason")


@query("p9_p10_work_with_limit", "SELECT company_id, slug FROM companies WHERE coalesce(career_site_url, '') = '' ORDER BY slug LIMIT 40")
def _p9l(t: Tables):
    return reads.select_work(t.companies, 40, refresh_failed=True).select("company_id", "slug")


@query("p11_company_load", """
SELECT company_id, slug, name, coalesce(career_site_url, '') AS career_site_url, coalesce(website, '') AS website,
       coalesce(nullif(article_title, ''), name) AS article FROM companies""")
def _p11(t: Tables):
    return reads.load_companies(t.companies)


@query("p12_listings_cache_reuse", """
SELECT company_id, coalesce(listings_url <> '' AND epoch_us(TIMESTAMP '2024-01-20 00:00:00')
         - epoch_us(TRY_CAST(replace(replace(listings_url_resolved_at, 'T', ' '), 'Z', '') AS TIMESTAMP)) <= 864000000000, false) AS cache_usable
  FROM companies""")
def _p12(t: Tables):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return reads.cached_listings(t.companies, now, 10 * 86400).select("company_id", "cache_usable")


_POSTINGS = """SELECT job_id, company_id, CASE WHEN status = 'filled' AND employment_type = 'contract' THEN '' ELSE listing_url END AS url,
  CASE WHEN country = 'CA' AND status = 'closed' THEN 'TimeoutError: too slow' END AS error, is_us FROM jobs"""


def postings(t: Tables):
    return t.jobs.select(
        "job_id", "company_id",
        F.expr("CASE WHEN status = 'filled' AND employment_type = 'contract' THEN '' ELSE listing_url END").alias("url"),
        F.expr("CASE WHEN country = 'CA' AND status = 'closed' THEN 'TimeoutError: too slow' END").alias("error"), "is_us")


@query("p15_us_only_postings", f"SELECT job_id, url FROM ({_POSTINGS}) WHERE url <> '' AND error IS NULL AND is_us")
def _p15(t: Tables):
    return reads.us_only(postings(t)).select("job_id", "url")


@query("p15_us_counts", f"""
SELECT company_id, CAST(count(*) FILTER (is_us) AS BIGINT) AS kept, CAST(count(*) FILTER (is_us IS NULL OR NOT is_us) AS BIGINT) AS skipped_non_us
  FROM ({_POSTINGS}) WHERE url <> '' AND error IS NULL GROUP BY company_id""")
def _p15c(t: Tables):
    return reads.us_counts(postings(t), ["company_id"])


_STATUS = """SELECT
 (SELECT count(*) FROM companies) AS companies,
 (SELECT count(*) FROM companies WHERE career_site_url IS NOT NULL AND career_site_url <> '') AS career_site_urls,
 (SELECT count(*) FROM companies JOIN company_platforms USING (company_id) WHERE career_site_url IS NOT NULL AND career_site_url <> '') AS scrape_targets,
 (SELECT count(*) FROM companies WHERE listings_url IS NOT NULL) AS cached_listings_urls,
 (SELECT count(*) FROM companies WHERE listings_url_remote_confirmed) AS confirmed_remote_roles,
 (SELECT count(*) FROM jobs) AS jobs, (SELECT count(*) FROM jobs WHERE status = 'open') AS open_jobs,
 (SELECT count(DISTINCT company_id) FROM jobs) AS companies_with_jobs"""


@query("a2_pipeline_status", _STATUS)
def _a2(t: Tables):
    return reads.pipeline_status(t.companies, t.company_platforms, t.jobs)


@query("a3_next_step_and_warmth", f"""
WITH s AS ({_STATUS})
SELECT CAST(CASE WHEN companies = 0 THEN 1 WHEN career_site_urls = 0 THEN 2 WHEN scrape_targets = 0 THEN 3 ELSE 0 END AS BIGINT) AS next_step,
       CAST(floor(cached_listings_urls * 100 / scrape_targets + 0.5) AS BIGINT) AS warm_pct,
       CASE WHEN scrape_targets = 0 THEN 'nothing' WHEN cached_listings_urls = 0 THEN 'cold' WHEN cached_listings_urls >= scrape_targets THEN 'warm' ELSE 'partly' END AS cache_state
  FROM s""")
def _a3(t: Tables):
    return reads.next_step(reads.pipeline_status(t.companies, t.company_platforms, t.jobs))


@query("a4_source_contribution", """
SELECT company_id, discovery_platform_id AS platform_id, epoch_us(min(first_seen_at)) AS first_seen_at, epoch_us(max(last_seen_at)) AS last_seen_at
  FROM jobs WHERE discovery_platform_id IS NOT NULL GROUP BY 1, 2""")
def _a4(t: Tables):
    return _micros(reads.source_contribution(t.jobs), "first_seen_at", "last_seen_at")


@query("f47_run_duration", "SELECT id, (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 AS duration_s FROM runs")
def _f47(t: Tables):
    return t.runs.select("id", times.duration_seconds("started_at", "finished_at").alias("duration_s"))


@query("o2_company_order", """
SELECT company_id, CAST(row_number() OVER (ORDER BY lower(name), company_id) AS BIGINT) AS place FROM companies ORDER BY place LIMIT 200""")
def _o2o(t: Tables):
    return ranking.top_k(reads.company_page(t.companies, 200).select("company_id", "name").withColumn("g", F.lit(1)), ["g"], [F.lower("name"), "company_id"], 200, "place").select("company_id", "place")
