"""Registered queries: consolidation, constraints and outcome reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolegrid.catalog.registry import Tables, query
from rolegrid.operators import consolidate, quality, reads

# Two whole stores to consolidate: customers as one, suppliers as the other, sharing part of their slugs.
_SLUG = "CASE WHEN s_acctbal < 1500 THEN 'supplier-' ELSE 'customer-' END || substring(s_name, 10)"
_OTHER = f"""other AS (SELECT CAST(s_suppkey AS BIGINT) AS company_id, {_SLUG} AS slug, s_name AS name,
  CASE WHEN s_acctbal > 3000 THEN 'https://o.example.com/' || CAST(s_suppkey AS STRING) END AS career_site_url,
  CASE WHEN s_acctbal > 6000 THEN 'https://w.example.com/' END AS website,
  CASE WHEN s_nationkey < 12 THEN CAST(s_nationkey AS BIGINT) END AS verdict_run_id FROM supplier),
mine AS (SELECT company_id, slug, name, career_site_url, website, verdict_run_id FROM companies)"""
_COLS = ["company_id", "slug", "name", "career_site_url", "website", "verdict_run_id"]


def other_store(t: Tables):
    return t.supplier.selectExpr(
        "CAST(s_suppkey AS BIGINT) AS company_id", f"{_SLUG} AS slug", "s_name AS name",
        "CASE WHEN s_acctbal > 3000 THEN 'https://o.example.com/' || CAST(s_suppkey AS STRING) END AS career_site_url",
        "CASE WHEN s_acctbal > 6000 THEN 'https://w.example.com/' END AS website",
        "CASE WHEN s_nationkey < 12 THEN CAST(s_nationkey AS BIGINT) END AS verdict_run_id")


def my_store(t: Tables):
    return t.companies.select(*_COLS)


@query("j9_insert_only_new", f"WITH {_OTHER} SELECT slug, name FROM other o WHERE NOT EXISTS (SELECT 1 FROM mine m WHERE m.slug = o.slug)")
def _j9(t: Tables):
    return consolidate.insert_new(my_store(t), other_store(t), ["slug"]).select("slug", "name")


@query("j10_id_remap", f"""WITH {_OTHER}
SELECT o.company_id AS old_id, m.company_id AS new_id, o.verdict_run_id + 1000 AS run_id FROM other o JOIN mine m USING (slug)""")
def _j10(t: Tables):
    mapping = consolidate.id_map(my_store(t), other_store(t), ["slug"], "company_id")
    moved = consolidate.remap_runs(other_store(t), "verdict_run_id")
    return moved.join(mapping, F.col("company_id") == F.col("old_id")).select("old_id", "new_id", F.col("verdict_run_id").alias("run_id"))


_MERGED = """SELECT m.slug, CASE WHEN o.slug IS NOT NULL THEN o.career_site_url ELSE m.career_site_url END AS career_site_url,
  coalesce(o.website, m.website) AS website, CASE WHEN o.slug IS NOT NULL THEN o.verdict_run_id + 1000 ELSE m.verdict_run_id END AS verdict_run_id
  FROM mine m LEFT JOIN other o USING (slug)"""


@query("j11_survivorship", f"WITH {_OTHER} {_MERGED}")
def _j11(t: Tables):
    moved = consolidate.remap_runs(other_store(t), "verdict_run_id")
    return consolidate.survive(my_store(t), moved, ["slug"], consolidate.REPLACED, consolidate.FILLED).select("slug", "career_site_url", "website", "verdict_run_id")


@query("u3_consolidated_companies", f"""WITH {_OTHER} {_MERGED}
UNION ALL SELECT slug, career_site_url, website, verdict_run_id + 1000 FROM other o WHERE NOT EXISTS (SELECT 1 FROM mine m WHERE m.slug = o.slug)""")
def _u3(t: Tables):
    return consolidate.consolidate_companies(my_store(t), other_store(t)).select("slug", "career_site_url", "website", "verdict_run_id")


@query("u2_provenance_union", """
WITH a AS (SELECT company_id, CASE index_membership WHEN 'sp500' THEN 20 WHEN 'sp400' THEN 21 ELSE 22 END AS platform_id, coalesce(ticker, '') AS source_key,
                  created_at AS f, updated_at AS l FROM companies WHERE index_membership IS NOT NULL),
b AS (SELECT company_id, discovery_platform_id AS platform_id, '' AS source_key, min(first_seen_at) AS f, max(last_seen_at) AS l FROM jobs WHERE discovery_platform_id IS NOT NULL GROUP BY 1, 2)
SELECT company_id, CAST(platform_id AS BIGINT) AS platform_id, source_key, epoch_us(f) AS first_seen_at, epoch_us(l) AS last_seen_at FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def _u2(t: Tables):
    out = consolidate.provenance(t.companies, t.jobs)
    return out.withColumns({n: F.unix_micros(n) for n in ("first_seen_at", "last_seen_at")})


@query("d17_foreign_keys", """
SELECT 'jobs' AS child, 'companies' AS parent, count(*) AS orphans FROM jobs j WHERE company_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM companies c WHERE c.company_id = j.company_id)
UNION ALL SELECT 'jobs', 'platforms', count(*) FROM jobs j WHERE discovery_platform_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM platforms p WHERE p.platform_id = j.discovery_platform_id)
UNION ALL SELECT 'lineitem', 'orders', count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL SELECT 'labels', 'benchmark', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = l.doc_id)""")
def _d17(t: Tables):
    parts = [
        quality.orphans(t.jobs, "company_id", t.companies, "company_id", "jobs", "companies"),
        quality.orphans(t.jobs, "discovery_platform_id", t.platforms, "platform_id", "jobs", "platforms"),
        quality.orphans(t.lineitem, "l_orderkey", t.orders, "o_orderkey", "lineitem", "orders"),
        quality.orphans(t.labels, "doc_id", t.benchmark, "item_id", "labels", "benchmark"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("d18_uniqueness_partial_key", """
SELECT discovery_platform_id, company_id, count(*) AS rows FROM jobs WHERE discovery_platform_id IS NOT NULL AND company_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def _d18(t: Tables):
    return quality.duplicates(t.jobs, ["discovery_platform_id", "company_id"])


@query("d18_line_slots", "SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _d18l(t: Tables):
    return quality.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("d19_check_rules", """
SELECT 'status_declared' AS rule, count(*) FILTER (NOT status IN ('open', 'closed', 'filled', 'unknown')) AS broken, count(*) AS checked FROM jobs
UNION ALL SELECT 'employment_type_declared', count(*) FILTER (NOT employment_type IN ('full_time', 'part_time', 'contract', 'intern', 'temporary', 'unknown')), count(*) FROM jobs
UNION ALL SELECT 'salary_period_declared', count(*) FILTER (NOT salary_period IN ('year', 'month', 'hour')), count(*) FROM jobs
UNION ALL SELECT 'raw_data_is_json', count(*) FILTER (raw_data IS NOT NULL AND NOT json_valid(raw_data)), count(*) FROM jobs""")
def _d19(t: Tables):
    return quality.rule_report(t.jobs, quality.job_rules())


@query("d19_attempt_rules", """
SELECT 'kind_declared' AS rule, count(*) FILTER (NOT candidate_kind IN ('website', 'career_site', 'ats_board')) AS broken, count(*) AS checked FROM attempts
UNION ALL SELECT 'status_declared', count(*) FILTER (NOT validation_status IN ('accepted', 'rejected', 'error')), count(*) FROM attempts
UNION ALL SELECT 'accepted_iff_no_reason', count(*) FILTER ((validation_status = 'accepted') <> (rejection_reason IS NULL)), count(*) FROM attempts""")
def _d19a(t: Tables):
    return quality.rule_report(t.attempts, quality.attempt_rules())


@query("a19_attempt_reasons", """
SELECT rejection_reason, count(*) AS n FROM attempts a WHERE rejection_reason IS NOT NULL
   AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.dry_run AND r.id = a.run_id - 19700) GROUP BY 1""")
def _a19(t: Tables):
    runs = t.runs.withColumn("id", F.col("id") + 19700)
    return quality.reason_tally(reads.production_attempts(t.attempts, runs))


@query("a20_failure_buckets", """
WITH tried AS (SELECT company_id, bool_or(coalesce(rejection_reason IN ('forbidden', 'rate_limited', 'timeout', 'bot_challenge'), false)) AS blocked,
                      bool_or(coalesce(rejection_reason IN ('product_or_investor_path', 'locale_only_path', 'generic_title_without_company', 'unverifiable_ats_title'), false)) AS policy
                 FROM attempts WHERE source <> 'robots_sitemap' GROUP BY 1),
b AS (SELECT CASE WHEN coalesce(career_site_url, '') <> '' THEN 'resolved' WHEN blocked IS NULL THEN 'untouched' WHEN coalesce(website, '') = '' THEN 'no_homepage'
             WHEN blocked THEN 'blocked' WHEN policy THEN 'policy' ELSE 'no_careers' END AS bucket FROM companies LEFT JOIN tried USING (company_id))
SELECT bucket, count(*) AS companies, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM companies), 1) AS share_pct FROM b GROUP BY 1""")
def _a20(t: Tables):
    return quality.failure_buckets(t.companies, t.attempts)


@query("a21_verdict_rollup", """
WITH v AS (SELECT CASE WHEN validation_status = 'accepted' THEN 'confirmed' WHEN rejection_reason IN ('no_careers_signal', 'locale_only_path') THEN 'wrong' ELSE 'unverifiable' END AS verdict,
                  coalesce(rejection_reason, 'accepted') AS reason FROM attempts)
SELECT verdict, reason, count(*) AS n, CAST(grouping_id(verdict, reason) AS BIGINT) AS level FROM v GROUP BY ROLLUP (verdict, reason)""")
def _a21(t: Tables):
    from rolegrid.operators.gate import category

    v = t.attempts.select(category("validation_status", "rejection_reason").alias("verdict"), F.coalesce("rejection_reason", F.lit("accepted")).alias("reason"))
    return quality.verdict_rollup(v)


@query("a22_url_census", """
WITH c AS (SELECT CASE WHEN regexp_matches(lower(url), 'career|job|en/') THEN 'careers word' ELSE 'neither word' END AS url_contains,
                  CASE WHEN contains(html, '<h1>') THEN 'valid' ELSE 'wrong' END AS class FROM pages)
SELECT url_contains, class, count(*) AS n, CAST(grouping_id(url_contains, class) AS BIGINT) AS level FROM c GROUP BY CUBE (url_contains, class)""")
def _a22(t: Tables):
    rows = t.pages.select("url", F.when(F.col("html").contains("<h1>"), "valid").otherwise("wrong").alias("class"))
    return quality.census(rows, "url", "class", ("career", "job", "en/"))


@query("a31_slug_collisions", """
WITH n AS (SELECT DISTINCT trim(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '-') AS slug, x AS name
             FROM (SELECT CASE WHEN p_size > 25 THEN p_name ELSE upper(p_name) || '!' END AS x FROM part))
SELECT slug, count(*) AS names FROM n GROUP BY 1 HAVING count(*) > 1""")
def _a31(t: Tables):
    names = t.part.select(F.expr("CASE WHEN p_size > 25 THEN p_name ELSE upper(p_name) || '!' END").alias("x"))
    return quality.slug_collisions(names, "x")


@query("a31_share_classes", "SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, count(*) AS rows FROM part GROUP BY 1 HAVING count(*) > 1")
def _a31s(t: Tables):
    return quality.share_classes(t.part, "p_name")


@query("a32_worst_exit", """
WITH c AS (SELECT l_orderkey AS g, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 5 ELSE l_linenumber END AS code, (l_shipdate, l_partkey, l_suppkey, l_linenumber) AS ord FROM lineitem)
SELECT g, CAST(coalesce(arg_min(code, ord) FILTER (code NOT IN (0, 5)), max(5) FILTER (code = 5), 0) AS BIGINT) AS exit_code FROM c GROUP BY g""")
def _a32(t: Tables):
    codes = t.lineitem.select(
        F.col("l_orderkey").alias("g"), F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 5 ELSE l_linenumber END").alias("code"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber").alias("ordinal"))
    return quality.worst_exit(codes, ["g"])


@query("a33_lost_evidence", "SELECT count(*) FILTER (starts_with(evidence_path, '/tmp/')) AS lost FROM attempts")
def _a33(t: Tables):
    return quality.lost_evidence(t.attempts)


@query("a34_noise_share", """
SELECT source, count(*) AS attempts, count(*) FILTER (coalesce(final_url, '') = '') AS empty,
       CAST(floor(count(*) FILTER (coalesce(final_url, '') = '') * 1000 / count(*)) AS BIGINT) AS empty_per_mille FROM attempts GROUP BY source""")
def _a34(t: Tables):
    return quality.noise_share(t.attempts)


@query("a35_exit_class", """
SELECT company_id, CAST(CASE WHEN count(*) FILTER (validation_status = 'error') > 0 THEN 1 WHEN count(*) FILTER (validation_status = 'accepted') > 0 THEN 0 ELSE 4 END AS BIGINT) AS exit_code
  FROM attempts GROUP BY company_id""")
def _a35(t: Tables):
    sums = t.attempts.groupBy("company_id").agg(
        F.count_if(F.col("validation_status") == "error").alias("failed"), F.count_if(F.col("validation_status") == "accepted").alias("good"))
    return sums.select("company_id", quality.exit_class("failed", "good").alias("exit_code"))
