"""Registered queries: keyed writes, staleness, ledgers, backfills."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolegrid.catalog.reads import postings
from rolegrid.catalog.registry import Tables, query
from rolegrid.operators import merge



def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


_NOW_US = "epoch_us(TIMESTAMP '2024-06-01 00:00:00')"

# The stored snapshot holds the postings first seen before mid-1999; the batch re-observes those
# first seen from mid-1998 on, under changed titles, and brings the rest as new.
_STATE = "state AS (SELECT *, first_seen_at AS created_at, last_seen_at AS updated_at FROM jobs WHERE first_seen_at < TIMESTAMP '1999-06-01 00:00:00')"
_BATCH = "batch AS (SELECT * REPLACE (title || ' v2' AS title, 'raw ' || title AS raw_data), job_id AS ordinal FROM jobs WHERE first_seen_at >= TIMESTAMP '1998-06-01 00:00:00' AND discovery_platform_id IS NOT NULL AND external_id IS NOT NULL)"


def job_state(t: Tables):
    old = t.jobs.filter(F.col("first_seen_at") < F.lit("1999-06-01 00:00:00").cast("timestamp"))
    return old.withColumns({"created_at": F.col("first_seen_at"), "updated_at": F.col("last_seen_at")})


def job_batch(t: Tables):
    new = t.jobs.filter(F.col("first_seen_at") >= F.lit("1998-06-01 00:00:00").cast("timestamp"))
    new = new.filter(F.col("discovery_platform_id").isNotNull() & F.col("external_id").isNotNull())
    return new.select(
        *[x for x in new.columns if x not in ("job_id", "status", "first_seen_at", "last_seen_at", "title", "raw_data")],
        F.concat("title", F.lit(" v2")).alias("title"), F.concat(F.lit("raw "), "title").alias("raw_data"),
        F.col("job_id").alias("ordinal"))


@query("d1_posting_upsert", f"""
WITH {_STATE}, {_BATCH}
SELECT CASE WHEN s.job_id IS NOT NULL THEN s.job_id END AS kept_id,
       coalesce(s.external_id, b.external_id) AS external_id, coalesce(s.discovery_platform_id, b.discovery_platform_id) AS platform_id,
       CASE WHEN b.ordinal IS NOT NULL THEN b.title ELSE s.title END AS title,
       CASE WHEN b.ordinal IS NOT NULL THEN 'open' ELSE s.status END AS status,
       CASE WHEN s.job_id IS NOT NULL THEN s.raw_data ELSE b.raw_data END AS raw_data,
       CASE WHEN s.job_id IS NOT NULL THEN epoch_us(s.first_seen_at) ELSE {_NOW_US} END AS first_seen_at,
       CASE WHEN b.ordinal IS NOT NULL THEN {_NOW_US} ELSE epoch_us(s.last_seen_at) END AS last_seen_at,
       CASE WHEN b.ordinal IS NOT NULL AND s.job_id IS NOT NULL THEN 'updated' WHEN b.ordinal IS NOT NULL THEN 'inserted' ELSE 'kept' END AS merge_action
  FROM state s FULL OUTER JOIN batch b ON s.discovery_platform_id = b.discovery_platform_id AND s.external_id = b.external_id""")
def _d1(t: Tables):
    out = merge.upsert_jobs(job_state(t), job_batch(t), now())
    return out.select(
        F.when(F.col("merge_action") != "inserted", F.col("job_id")).alias("kept_id"), "external_id",
        F.col("discovery_platform_id").alias("platform_id"), "title", "status", "raw_data",
        F.unix_micros("first_seen_at").alias("first_seen_at"), F.unix_micros("last_seen_at").alias("last_seen_at"), "merge_action")


@query("d1_upsert_new_ids_are_dense", f"""
WITH {_STATE}, {_BATCH}, n AS (SELECT count(*) AS n FROM batch b WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.discovery_platform_id = b.discovery_platform_id AND s.external_id = b.external_id)),
m AS (SELECT max(job_id) AS top FROM state)
SELECT n AS inserted, top + 1 AS first_id, top + n AS last_id, n AS distinct_ids FROM n, m""")
def _d1_ids(t: Tables):
    new = merge.upsert_jobs(job_state(t), job_batch(t), now()).filter("merge_action = 'inserted'")
    return new.agg(F.count("*").alias("inserted"), F.min("job_id").alias("first_id"), F.max("job_id").alias("last_id"), F.countDistinct("job_id").alias("distinct_ids"))


@query("d2_browser_upsert", f"""
WITH {_STATE}, {_BATCH}
SELECT coalesce(s.external_id, b.external_id) AS external_id,
       CASE WHEN b.ordinal IS NOT NULL THEN nullif(trim(b.location_text), '') ELSE s.location_text END AS location_text,
       CASE WHEN b.ordinal IS NOT NULL THEN NULL ELSE s.salary_min_cents END AS salary_min_cents,
       CASE WHEN b.ordinal IS NOT NULL THEN 9001 ELSE s.scrape_run_id END AS scrape_run_id
  FROM state s FULL OUTER JOIN batch b ON s.discovery_platform_id = b.discovery_platform_id AND s.external_id = b.external_id""")
def _d2(t: Tables):
    narrow = job_batch(t).select(
        "discovery_platform_id", "external_id", "company_id", "listing_url", "title", "description", "location_text",
        "employment_type", "country", "is_us", "is_remote", "posted_at", "raw_data", "ordinal", F.lit(9001).cast("bigint").alias("scrape_run_id"))
    out = merge.upsert_jobs(job_state(t), merge.browser_batch(narrow), now())
    return out.select("external_id", "location_text", "salary_min_cents", "scrape_run_id")


_SEEN = "seen AS (SELECT discovery_platform_id, company_id, external_id FROM jobs WHERE salary_max_cents > 20000000 AND discovery_platform_id IN (1, 10, 12))"


def seen_keys(t: Tables):
    return t.jobs.filter("salary_max_cents > 20000000 AND discovery_platform_id IN (1, 10, 12)").select("discovery_platform_id", "company_id", "external_id")


@query("d3_mark_stale_platform_scope", f"""
WITH {_SEEN}
SELECT job_id, CASE WHEN c THEN 'closed' ELSE status END AS status, c AS newly_closed FROM (
  SELECT j.*, (status = 'open' AND external_id IS NOT NULL AND discovery_platform_id IN (SELECT discovery_platform_id FROM seen WHERE external_id IS NOT NULL)
     AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.discovery_platform_id = j.discovery_platform_id AND s.external_id = j.external_id)) IS TRUE AS c FROM jobs j)""")
def _d3(t: Tables):
    state = t.jobs.withColumn("updated_at", F.col("last_seen_at"))
    return merge.mark_stale(state, seen_keys(t), ["discovery_platform_id"], now()).select("job_id", "status", "newly_closed")


@query("d4_mark_stale_company_scope", f"""
WITH {_SEEN}
SELECT job_id, (status = 'open' AND external_id IS NOT NULL
     AND EXISTS (SELECT 1 FROM seen s WHERE s.discovery_platform_id = j.discovery_platform_id AND s.company_id = j.company_id AND s.external_id IS NOT NULL)
     AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.discovery_platform_id = j.discovery_platform_id AND s.company_id = j.company_id AND s.external_id = j.external_id)) IS TRUE AS newly_closed
  FROM jobs j""")
def _d4(t: Tables):
    state = t.jobs.withColumn("updated_at", F.col("last_seen_at"))
    return merge.mark_stale(state, seen_keys(t), ["discovery_platform_id", "company_id"], now()).select("job_id", "newly_closed")


@query("u4_stale_set_difference", f"""
WITH {_SEEN}
SELECT job_id FROM jobs j WHERE status = 'open' AND external_id IS NOT NULL
   AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.discovery_platform_id = j.discovery_platform_id AND s.external_id = j.external_id)""")
def _u4(t: Tables):
    return merge.stale_difference(t.jobs, seen_keys(t), ["discovery_platform_id"]).select("job_id")


@query("u5_observed_before_filters", "SELECT DISTINCT company_id, external_id FROM jobs WHERE external_id IS NOT NULL AND external_id <> ''")
def _u5(t: Tables):
    return merge.observed_keys(t.jobs, ["company_id"])


_POSTED = """SELECT company_id, CASE WHEN status = 'filled' AND employment_type = 'contract' THEN '' ELSE listing_url END AS url FROM jobs"""


@query("d5_closure_guards", f"""
SELECT company_id, count(*) AS fetched, count(*) FILTER (url <> '') AS observed,
       CASE WHEN count(*) FILTER (url <> '') = 0 THEN 'none_observed' WHEN count(*) >= 15 THEN 'truncated_at_max_jobs=15' ELSE '' END AS stale_note
  FROM ({_POSTED}) GROUP BY company_id""")
def _d5(t: Tables):
    return merge.closure_notes(postings(t), ["company_id"], 15).select("company_id", "fetched", "observed", "stale_note")


@query("d5_seen_of_safe_scopes", f"""
WITH n AS (SELECT company_id, count(*) AS k FROM jobs GROUP BY 1)
SELECT DISTINCT company_id, external_id FROM jobs WHERE external_id <> '' AND company_id NOT IN (SELECT company_id FROM n WHERE k >= 15)""")
def _d5s(t: Tables):
    notes = merge.closure_notes(postings(t).withColumn("url", F.lit("u")), ["company_id"], 15)
    return merge.safe_seen(merge.observed_keys(t.jobs, ["company_id"]), notes, ["company_id"])


@query("d6_resolve_or_create_companies", """
WITH n AS (SELECT trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug, p_name || ' ' || p_type AS name, p_partkey AS ord FROM part)
SELECT slug, arg_min(name, ord) AS name FROM n WHERE slug <> '' AND slug NOT IN (SELECT 'red-widget-' || lower(p_type) FROM part) GROUP BY slug""")
def _d6(t: Tables):
    known = t.part.select(F.concat(F.lit("red-widget-"), F.lower("p_type")).alias("slug")).distinct()
    names = t.part.select(F.concat_ws(" ", "p_name", "p_type").alias("name"), F.col("p_partkey").alias("ordinal"))
    return merge.resolve_companies(known, names)[0]


@query("d7_index_upsert", """
WITH b AS (SELECT *, CASE WHEN company_id < 700 THEN name ELSE name || ' Inc' END AS new_name, CASE WHEN industry = 'BUILDING' THEN NULL ELSE industry END AS new_industry
             FROM companies WHERE index_membership IS NOT NULL OR industry = 'HOUSEHOLD'),
s AS (SELECT * FROM companies WHERE industry <> 'FURNITURE')
SELECT coalesce(s.slug, b.slug) AS slug, CASE WHEN b.slug IS NOT NULL THEN b.new_name ELSE s.name END AS name,
       CASE WHEN b.slug IS NOT NULL THEN b.new_industry ELSE s.industry END AS industry,
       CASE WHEN b.slug IS NULL THEN 'kept' WHEN s.slug IS NULL THEN 'created'
            WHEN s.name IS DISTINCT FROM b.new_name OR s.industry IS DISTINCT FROM b.new_industry THEN 'changed' ELSE 'same' END AS merge_action
  FROM s FULL OUTER JOIN b ON s.slug = b.slug""")
def _d7(t: Tables):
    batch = t.companies.filter("index_membership IS NOT NULL OR industry = 'HOUSEHOLD'").select(
        "slug", F.expr("CASE WHEN company_id < 700 THEN name ELSE name || ' Inc' END").alias("name"),
        F.expr("CASE WHEN industry = 'BUILDING' THEN NULL ELSE industry END").alias("industry"))
    state = t.companies.filter("industry <> 'FURNITURE'").select("slug", "name", "industry", "created_at", "updated_at")
    return merge.index_upsert(state, batch, now(), ["name", "industry"]).select("slug", "name", "industry", "merge_action")


_ANS = """ans AS (SELECT o_custkey AS company_id, arg_max(o_orderstatus, o_orderkey) AS st FROM orders GROUP BY 1)"""


def answers(t: Tables):
    return t.orders.groupBy(F.col("o_custkey").alias("company_id")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("st"))


@query("d8_listings_cache_write_and_clear", f"""
WITH {_ANS}
SELECT c.company_id, CASE WHEN st = 'P' THEN NULL WHEN st = 'F' THEN 'https://new.example.com' ELSE listings_url END AS listings_url,
       CASE WHEN st = 'P' THEN NULL WHEN st = 'F' THEN c.company_id < 500 ELSE listings_url_remote_confirmed END AS confirmed
  FROM companies c LEFT JOIN ans USING (company_id)""")
def _d8(t: Tables):
    writes = answers(t).filter("st <> 'O'").select(
        "company_id", F.when(F.col("st") == "F", "https://new.example.com").alias("new_url"), (F.col("company_id") < 500).alias("new_confirmed"))
    return merge.set_listings(t.companies.drop("listings_url_resolved_at").withColumn("listings_url_resolved_at", F.lit(None).cast("timestamp")), writes, now()).select(
        "company_id", "listings_url", F.col("listings_url_remote_confirmed").alias("confirmed"))


@query("p13_cacheable_answers", f"WITH {_ANS} SELECT company_id, 'https://new.example.com' AS new_url, st = 'F' AS new_confirmed FROM ans WHERE st <> 'P'")
def _p13(t: Tables):
    a = answers(t).select("company_id", (F.col("st") == "P").alias("blocked"), F.lit("https://new.example.com").alias("listings_url"), (F.col("st") == "F").alias("has_remote"))
    return merge.cacheable_answers(a)


@query("p14_fetch_gate", "SELECT company_id FROM companies WHERE coalesce(listings_url_remote_confirmed, false)")
def _p14(t: Tables):
    return merge.fetchable(t.companies, "listings_url_remote_confirmed").select("company_id")


_VENDOR = "SELECT company_id, platform_id, base_url || '/new' AS base_url FROM (SELECT CASE WHEN platform_id % 2 = 0 THEN company_id + 1000000 ELSE company_id END AS company_id, platform_id, base_url FROM company_platforms)"


def _vendor_batch(t: Tables):
    """The whole table again: known pairs with a new address, and, for even platforms, pairs of other companies."""
    moved = F.when(F.col("platform_id") % 2 == 0, F.col("company_id") + 1000000).otherwise(F.col("company_id"))
    return t.company_platforms.withColumns({"company_id": moved, "base_url": F.concat("base_url", F.lit("/new"))})


@query("d9_vendor_upsert", f"""
WITH s AS (SELECT * FROM company_platforms),
b AS (SELECT v.* FROM ({_VENDOR}) v JOIN platforms p USING (platform_id) WHERE platform_type = 'application_system')
SELECT coalesce(s.company_id, b.company_id) AS company_id, coalesce(s.platform_id, b.platform_id) AS platform_id, coalesce(b.base_url, s.base_url) AS base_url
  FROM s FULL OUTER JOIN b ON s.company_id = b.company_id AND s.platform_id = b.platform_id""")
def _d9(t: Tables):
    return merge.vendor_upsert(t.company_platforms, _vendor_batch(t), t.platforms)[0].drop("merge_action")


@query("d9_vendor_rejects", f"SELECT company_id, platform_id, platform_type FROM ({_VENDOR}) JOIN platforms USING (platform_id) WHERE platform_type <> 'application_system'")
def _d9r(t: Tables):
    return merge.vendor_upsert(t.company_platforms, _vendor_batch(t), t.platforms)[1]


_RES = """res AS (SELECT o_custkey AS company_id, arg_max(o_orderpriority, o_orderkey) AS pr FROM orders GROUP BY 1)"""


def resolutions(t: Tables):
    last = t.orders.groupBy(F.col("o_custkey").alias("company_id")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("pr"))
    return last.select(
        "company_id",
        F.expr("CASE pr WHEN '1-URGENT' THEN 'https://careers.found.example.com/' WHEN '2-HIGH' THEN ' ' END").alias("new_url"),
        F.expr("CASE pr WHEN '1-URGENT' THEN 'anchor_scan' WHEN '2-HIGH' THEN 'sitemap' END").alias("new_url_source"),
        F.expr("CASE pr WHEN '3-MEDIUM' THEN 'https://home.example.com/' END").alias("new_website"),
        F.expr("CASE pr WHEN '3-MEDIUM' THEN 'guess' END").alias("new_website_source"),
        F.expr("CASE pr WHEN '5-LOW' THEN 'wrong' WHEN '1-URGENT' THEN '' END").alias("new_verdict"),
        F.expr("CASE pr WHEN '5-LOW' THEN 'https://judged.example.com/' END").alias("new_verdict_url"),
        F.lit(77).cast("bigint").alias("new_run_id"), F.expr("pr = '4-NOT SPECIFIED'").alias("dry_run"))


@query("d10_resolution_write", f"""
WITH {_RES}
SELECT c.company_id, CASE WHEN pr = '1-URGENT' THEN 'https://careers.found.example.com/' ELSE career_site_url END AS career_site_url,
       CASE WHEN pr = '3-MEDIUM' THEN 'https://home.example.com/' ELSE website END AS website,
       CASE WHEN pr IS NULL THEN NULL WHEN pr = '1-URGENT' AND career_site_url IS NULL THEN 'inserted' WHEN pr = '1-URGENT' THEN 'updated' ELSE 'none' END AS resolution_action
  FROM companies c LEFT JOIN res USING (company_id)""")
def _d10(t: Tables):
    return merge.write_resolutions(t.companies, resolutions(t), now()).select("company_id", "career_site_url", "website", "resolution_action")


@query("d11_verdict_write", f"""
WITH {_RES}
SELECT c.company_id, CASE WHEN pr = '5-LOW' THEN 'wrong' ELSE verdict END AS verdict,
       CASE WHEN pr = '5-LOW' THEN 'https://judged.example.com/' ELSE verdict_url END AS verdict_url,
       CASE WHEN pr = '5-LOW' THEN 77 ELSE verdict_run_id END AS verdict_run_id
  FROM companies c LEFT JOIN res USING (company_id)""")
def _d11(t: Tables):
    return merge.write_verdicts(t.companies, resolutions(t), now()).select("company_id", "verdict", "verdict_url", "verdict_run_id")


@query("d12_write_validation", f"""
WITH {_RES}
SELECT company_id, CASE WHEN company_id = 0 THEN 'company id is zero' WHEN pr = '2-HIGH' THEN NULL WHEN pr = '3-MEDIUM' THEN 'website source is not declared' END AS problem FROM res""")
def _d12(t: Tables):
    trimmed = resolutions(t)
    return merge.check_resolutions(trimmed).select("company_id", "problem")


@query("d12_attempt_validation", """
WITH a AS (SELECT *, CASE WHEN attempt_index < 10 THEN 'because' WHEN attempt_index < 20 THEN NULL WHEN attempt_index < 25 THEN 'http_418' ELSE rejection_reason END AS r,
                  CASE WHEN attempt_index > 95 THEN '' ELSE validation_status END AS v FROM attempts)
SELECT id, CASE WHEN v = '' THEN 'validation state is empty' WHEN v = 'accepted' AND r IS NOT NULL THEN 'accepted attempt carries a reason'
  WHEN v <> 'accepted' AND r IS NULL THEN 'attempt has no reason' WHEN v <> 'accepted' AND r = 'because' THEN 'reason is not declared' END AS problem FROM a""")
def _d12a(t: Tables):
    a = t.attempts.withColumns({
        "rejection_reason": F.expr("CASE WHEN attempt_index < 10 THEN 'because' WHEN attempt_index < 20 THEN NULL WHEN attempt_index < 25 THEN 'http_418' ELSE rejection_reason END"),
        "validation_status": F.expr("CASE WHEN attempt_index > 95 THEN '' ELSE validation_status END")})
    return merge.check_attempts(a).select("id", "problem")



@query("d13_run_ledger_fold", """
WITH ev AS (SELECT user_id AS run_id, event_type = 'signup' AS s, ts AS at_, event_id AS seq, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k
              FROM events WHERE event_type IN ('signup', 'purchase'))
SELECT run_id, arg_min(k, (at_, seq)) FILTER (s) AS platform_id, epoch_us(min(at_) FILTER (s)) AS started_at, epoch_us(max(at_) FILTER (NOT s)) AS finished_at,
       coalesce(arg_max(CASE WHEN k < 50 THEN 'ok' ELSE 'error' END, (at_, seq)) FILTER (NOT s), 'running') AS status,
       CAST(coalesce(arg_max(k, (at_, seq)) FILTER (NOT s), 0) AS BIGINT) AS items_found
  FROM ev GROUP BY run_id""")
def _d13(t: Tables):
    out = merge.fold_runs(run_events(t).filter("kind <> 'cancel'"))
    return out.select("run_id", "platform_id", F.unix_micros("started_at").alias("started_at"), F.unix_micros("finished_at").alias("finished_at"), "status", "items_found")


def run_events(t: Tables):
    """Signups start a run, purchases finish it, errors are cancels."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "cancel").otherwise("finish")
    return t.events.filter("event_type IN ('signup', 'purchase', 'error')").select(
        F.col("user_id").alias("run_id"), kind.alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        k.alias("platform_id"), F.lit(None).cast("bigint").alias("company_id"), F.when(k < 50, "ok").otherwise("error").alias("status"),
        k.alias("items_found"), *[F.lit(0).alias(n) for n in ("items_inserted", "items_updated", "items_wrong", "items_unverifiable")],
        F.lit(None).cast("string").alias("error_text"), F.lit(False).alias("dry_run"))


# Runs of a quarter of the users and hours never see their finish, so that cancels and deadlines decide some.
@query("t5_run_ledger_batch_twin", """
WITH ev AS (SELECT user_id AS run_id, event_type AS e, epoch_us(ts) AS at_, event_id AS seq, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k
              FROM events WHERE event_type IN ('signup', 'error') OR (event_type = 'purchase' AND user_id % 4 > 0)),
r AS (SELECT run_id, arg_min(k, (at_, seq)) FILTER (e = 'signup') AS platform_id, min(at_) FILTER (e = 'signup') AS started, max(at_) FILTER (e = 'purchase') AS done,
             arg_max(CASE WHEN k < 50 THEN 'ok' ELSE 'error' END, (at_, seq)) FILTER (e = 'purchase') AS status, arg_max(k, (at_, seq)) FILTER (e = 'purchase') AS found,
             min(at_) FILTER (e = 'error') AS cancelled FROM ev GROUP BY run_id),
d AS (SELECT *, started + 6 * 3600000000 AS due, (SELECT max(at_) - 600000000 FROM ev) AS mark FROM r),
c AS (SELECT *, CASE WHEN done IS NOT NULL THEN 'finish' WHEN started IS NULL THEN 'running' WHEN cancelled < due THEN 'cancel'
                     WHEN cancelled >= due OR due <= mark THEN 'late' ELSE 'running' END AS how FROM d)
SELECT run_id, platform_id, started AS started_at, CASE how WHEN 'finish' THEN done WHEN 'cancel' THEN cancelled WHEN 'late' THEN due END AS finished_at,
       CASE how WHEN 'finish' THEN status WHEN 'running' THEN 'running' ELSE 'error' END AS status, coalesce(found, 0) AS items_found,
       CASE how WHEN 'cancel' THEN 'cancelled by user' WHEN 'late' THEN 'interrupted by restart' END AS error_text
  FROM c""")
def _t5(t: Tables):
    from rolegrid.streaming.stateful import run_ledger_batch

    events = run_events(t).filter("kind <> 'finish' OR run_id % 4 > 0")
    mark = events.agg(F.max("at") - F.expr("INTERVAL 10 MINUTES")).scalar()
    out = run_ledger_batch(events, mark)
    return out.select("run_id", "platform_id", F.unix_micros("started_at").alias("started_at"), F.unix_micros("finished_at").alias("finished_at"), "status", "items_found", "error_text")


@query("d14_cancel_running_only", """
SELECT id, (status = 'running' AND id IN (2, 3, 4, 5, 6, 7, 8, 9)) AS stopped,
       CASE WHEN status = 'running' AND id IN (2, 3, 4, 5, 6, 7, 8, 9) THEN 'error' ELSE status END AS status FROM runs""")
def _d14(t: Tables):
    return merge.cancel_runs(t.runs, list(range(2, 10)), now()).select("id", "stopped", "status")


@query("d14_reconcile_stale_runs", """
SELECT id, CASE WHEN status = 'running' THEN 'error' ELSE status END AS status,
       CASE WHEN status = 'running' THEN 'interrupted by restart' ELSE error_text END AS error_text FROM runs""")
def _d14r(t: Tables):
    return merge.reconcile_runs(t.runs, now()).select("id", "status", "error_text")


_BACKFILL = """
WITH p AS (SELECT *, TRY_CAST(raw_data AS JSON) AS j FROM jobs),
q AS (SELECT *, CASE json_extract_string(j, '$.employmentType') WHEN 'FULL-TIME' THEN 'full_time' WHEN 'contractor' THEN 'contract' WHEN 'INTERN' THEN 'intern' END AS new_type,
             TRY_CAST(json_extract_string(j, '$.datePosted') AS TIMESTAMP) AS new_time FROM p)
"""


@query("d15_posting_backfill", _BACKFILL + """
SELECT job_id, coalesce(new_type, employment_type) AS employment_type, epoch_us(coalesce(new_time, posted_at)) AS posted_at,
       coalesce((new_type IS NOT NULL AND new_type IS DISTINCT FROM employment_type) OR (new_time IS NOT NULL AND new_time IS DISTINCT FROM posted_at), false) AS backfilled
  FROM q""")
def _d15(t: Tables):
    return merge.posting_backfill(t.jobs, now()).select("job_id", "employment_type", F.unix_micros("posted_at").alias("posted_at"), "backfilled")


@query("d15_backfill_dry_run", _BACKFILL + """
SELECT count(*) FILTER (raw_data IS NOT NULL) AS scanned, count(*) FILTER (j IS NOT NULL) AS parsed,
       count(*) FILTER (json_extract_string(j, '$.jobLocationType') = 'TELECOMMUTE') AS remote_declared,
       count(*) FILTER ((new_type IS NOT NULL AND new_type IS DISTINCT FROM employment_type) OR (new_time IS NOT NULL AND new_time IS DISTINCT FROM posted_at)) AS to_write FROM q""")
def _d15c(t: Tables):
    return merge.backfill_counts(t.jobs, now())


@query("d15_backfill_in_slots", _BACKFILL + """,
r AS (SELECT job_id, coalesce(new_type, employment_type) AS employment_type, epoch_us(coalesce(new_time, posted_at)) AS posted_at FROM q)
SELECT *, CAST(0 AS BIGINT) AS second_pass FROM r""")
def _d15s(t: Tables):
    from rolegrid.catalog.jobs import few_slots, slot_table
    from rolegrid.operators import slots

    table = slot_table(t, t.jobs, few_slots(slots.POSTINGS))
    backfill = lambda df: merge.posting_backfill(df, now())
    slots.maintain(table, backfill, ["employment_type", "posted_at"])
    again = slots.maintain(table, backfill, ["employment_type", "posted_at"])[1]
    return table.rows().select("job_id", "employment_type", F.unix_micros("posted_at").alias("posted_at"), F.lit(len(again)).cast("bigint").alias("second_pass"))


@query("d16_column_backfills", """
SELECT company_id, CAST(CASE index_membership WHEN 'sp500' THEN 20 WHEN 'sp400' THEN 21 WHEN 'sp600' THEN 22 END AS BIGINT) AS platform_id,
       CASE WHEN listings_url IS NOT NULL THEN true ELSE listings_url_remote_confirmed END AS confirmed FROM companies""")
def _d16(t: Tables):
    return merge.confirm_cached(t.companies).select(
        "company_id", merge.membership_platform("index_membership").alias("platform_id"), F.col("listings_url_remote_confirmed").alias("confirmed"))


@query("d26_attempt_sink", """
WITH cand AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag,
                     row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate, l_quantity) - 1 AS slot FROM lineitem),
taken AS (SELECT o_orderkey AS run_id, o_custkey AS company_id, CAST(substring(o_orderpriority, 1, 1) AS BIGINT) + 1 AS first_free FROM orders)
SELECT c.l_suppkey AS company_id, c.l_orderkey AS run_id, CAST(coalesce(t.first_free, 0) + slot AS BIGINT) AS attempt_index,
       CASE l_returnflag WHEN 'A' THEN NULL WHEN 'N' THEN CAST(404 AS BIGINT) ELSE 500 END AS http_status,
       CASE l_returnflag WHEN 'A' THEN 'accepted' ELSE 'rejected' END AS validation_status,
       CASE l_returnflag WHEN 'A' THEN NULL WHEN 'N' THEN 'http_404' ELSE 'http_500' END AS rejection_reason
  FROM cand c LEFT JOIN taken t ON t.run_id = c.l_orderkey AND t.company_id = c.l_suppkey""")
def _d26(t: Tables):
    cand = t.lineitem.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("company_id"),
        F.struct("l_linenumber", "l_partkey", "l_shipdate", "l_quantity").alias("position"), F.lit("sitemap").alias("source"),
        F.lit("https://x.example.com/").alias("candidate_url"), F.lit("career_site").alias("candidate_kind"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 404 ELSE 500 END").alias("http_status"),
        F.lit("").alias("final_url"), F.lit(" ").alias("title"), F.lit("").alias("evidence"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'accepted' ELSE 'rejected' END").alias("validation_status"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'html_careers' WHEN 'N' THEN 'http_404' ELSE 'http_500' END").alias("rejection_reason"))
    taken = t.orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("company_id"), F.expr("CAST(substring(o_orderpriority, 1, 1) AS BIGINT)").alias("attempt_index"))
    return merge.attempt_rows(cand, taken, by=F.col("position.l_linenumber").cast("bigint")).select("company_id", "run_id", "attempt_index", "http_status", "validation_status", "rejection_reason")
