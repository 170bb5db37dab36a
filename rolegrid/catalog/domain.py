"""Domain tables derived from the driver tables, one expression list for both engines.

The expressions are plain SQL that Spark and DuckDB read alike. Two macros hide what they spell
differently: EP[ts] is microseconds since the epoch, TSU[n] the timestamp of such a number.
"""

from __future__ import annotations

_SLUG = "lower(replace(c_name, '#', '-'))"
_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"
_HOST = f"'https://careers.' || {_SLUG} || '.example.com/jobs'"

DERIVED: dict[str, tuple[str, dict[str, str]]] = {
    "companies": ("customer", {
        "company_id": "CAST(c_custkey AS BIGINT)",
        "slug": _SLUG,
        "name": "c_name",
        "industry": "c_mktsegment",
        "index_membership": "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'sp500' WHEN 'BUILDING' THEN 'sp400' WHEN 'FURNITURE' THEN 'sp600' END",
        "ticker": "CASE WHEN c_mktsegment <> 'BUILDING' THEN 'T' || CAST(c_custkey AS STRING) END",
        "website": f"CASE WHEN c_acctbal >= 1000 THEN 'https://www.' || {_SLUG} || '.example.com/' END",
        "article_title": "CASE WHEN c_mktsegment = 'FURNITURE' THEN '' WHEN c_nationkey < 10 THEN c_name || ' (company)' END",
        "career_site_url": f"CASE WHEN c_acctbal < 0 THEN NULL WHEN c_mktsegment = 'HOUSEHOLD' AND c_acctbal < 3000 THEN '' ELSE {_HOST} END",
        "verdict": "CASE WHEN c_nationkey < 8 THEN 'confirmed' WHEN c_nationkey < 12 THEN 'wrong' WHEN c_nationkey < 16 THEN 'unverifiable' END",
        "verdict_url": f"CASE WHEN c_nationkey < 14 THEN {_HOST} WHEN c_nationkey < 16 THEN 'https://old.example.com/' END",
        "verdict_at": "CASE WHEN c_nationkey < 13 THEN TSU[(1700000000 + c_custkey * 600) * 1000000] END",
        "verdict_run_id": "CASE WHEN c_nationkey < 20 THEN CAST(19723 + c_nationkey AS BIGINT) END",
        "listings_url": f"CASE WHEN c_acctbal > 4000 THEN {_HOST} || '/all' END",
        "listings_url_resolved_at": "CASE WHEN c_acctbal <= 4000 THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 'not-a-time' ELSE '2024-01-' || lpad(CAST(c_nationkey + 1 AS STRING), 2, '0') || 'T06:30:00.000Z' END",
        "listings_url_remote_confirmed": "CASE WHEN c_acctbal > 7000 THEN true WHEN c_acctbal > 4000 THEN false END",
        "created_at": "TSU[(1600000000 + c_custkey * 60) * 1000000]",
        "updated_at": "TSU[(1650000000 + c_custkey * 90) * 1000000]",
    }),
    "platforms": ("nation", {
        "platform_id": "CAST(n_nationkey AS BIGINT)",
        "name": "lower(n_name)",
        "platform_type": "CASE n_regionkey WHEN 0 THEN 'job_board' WHEN 1 THEN 'reference' ELSE 'application_system' END",
    }),
    "company_platforms": ("customer", {
        "company_id": "CAST(c_custkey AS BIGINT)",
        "platform_id": "CAST(c_nationkey AS BIGINT)",
        "base_url": _HOST,
    }),
    "jobs": ("orders", {
        "job_id": "CAST(o_orderkey AS BIGINT)",
        "company_id": "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN -1 ELSE CAST(o_custkey AS BIGINT) END",
        "discovery_platform_id": "CASE o_orderpriority WHEN '1-URGENT' THEN CAST(1 AS BIGINT) WHEN '2-HIGH' THEN 10 WHEN '3-MEDIUM' THEN 11 WHEN '5-LOW' THEN 12 END",
        "external_id": "CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN NULL ELSE 'job-' || CAST(o_orderkey AS STRING) END",
        "title": "'Engineer ' || CAST(o_orderkey AS STRING)",
        "status": "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'closed' END",
        "employment_type": "CASE o_orderpriority WHEN '1-URGENT' THEN 'full_time' WHEN '2-HIGH' THEN 'contract' WHEN '5-LOW' THEN 'apprentice' END",
        "is_remote": "CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END",
        "location_text": "CASE WHEN o_totalprice > 400000 THEN 'Berlin, Germany' WHEN o_totalprice > 300000 THEN '' END",
        "country": "CASE WHEN o_totalprice > 200000 THEN 'US' WHEN o_totalprice > 100000 THEN 'CA' END",
        "is_us": "CASE WHEN o_totalprice > 200000 THEN true WHEN o_totalprice > 100000 THEN false END",
        "description": "'Order text ' || o_orderpriority",
        "salary_min_cents": "CASE WHEN o_orderstatus <> 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT) END",
        "salary_max_cents": "CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(round(o_totalprice * 100) AS BIGINT) + 50000 END",
        "salary_currency": "CASE o_orderpriority WHEN '1-URGENT' THEN 'USD' WHEN '2-HIGH' THEN 'EUR' WHEN '3-MEDIUM' THEN 'XAU' END",
        "salary_period": "CASE o_orderstatus WHEN 'O' THEN 'year' WHEN 'F' THEN 'hour' END",
        "posted_at": "CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderdate END",
        "first_seen_at": "o_orderdate",
        "last_seen_at": "TSU[EP[o_orderdate] + CAST(round(o_totalprice * 100) AS BIGINT) * 10000]",
        "listing_url": "'https://jobs.example.com/careers/job/' || CAST(o_orderkey AS STRING) || '?ref=feed'",
        "application_url": "CASE WHEN o_orderstatus = 'O' THEN 'https://apply.example.com/' || CAST(o_orderkey AS STRING) END",
        "discovery_url": "CAST(NULL AS STRING)",
        "scrape_run_id": "CAST(o_orderkey AS BIGINT)",
        "raw_data": "CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN NULL WHEN '5-LOW' THEN 'not json' ELSE '{\"@type\":\"JobPosting\",\"jobLocationType\":\"' || CASE o_orderstatus WHEN 'O' THEN 'TELECOMMUTE' ELSE 'ONSITE' END || '\",\"employmentType\":\"' || CASE o_orderpriority WHEN '1-URGENT' THEN 'FULL-TIME' WHEN '2-HIGH' THEN 'contractor' ELSE 'INTERN' END || '\",\"datePosted\":\"2024-02-1' || substring(CAST(o_orderkey AS STRING), 1, 1) || '\"}' END",
    }),
    "runs": ("orders", {
        "id": "CAST(o_orderkey AS BIGINT)",
        "platform_id": "CAST(substring(o_orderpriority, 1, 1) AS BIGINT)",
        "company_id": "CAST(o_custkey AS BIGINT)",
        "status": "CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'P' THEN 'error' ELSE 'running' END",
        "started_at": "o_orderdate",
        "finished_at": "CASE WHEN o_orderstatus <> 'O' THEN TSU[EP[o_orderdate] + CAST(round(o_totalprice * 100) AS BIGINT) * 100] END",
        "items_found": "CAST(floor(o_totalprice / 10000) AS BIGINT)",
        "items_inserted": "CAST(floor(o_totalprice / 50000) AS BIGINT)",
        "items_updated": "CAST(floor(o_totalprice / 25000) AS BIGINT)",
        "dry_run": "(o_orderpriority = '5-LOW')",
        "error_text": "CASE WHEN o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT' THEN 'fetch: the remote side closed the connection while the body was being read ' || o_orderpriority END",
    }),
    "attempts": ("events", {
        "id": "CAST(event_id AS BIGINT)",
        "company_id": "CAST(user_id AS BIGINT)",
        "run_id": "CAST(floor(EP[ts] / 86400000000) AS BIGINT)",
        "attempt_index": _K,
        "source": "CASE event_type WHEN 'signup' THEN 'nav_anchor' WHEN 'view' THEN 'sitemap' WHEN 'click' THEN 'robots_path' WHEN 'purchase' THEN 'ats_api' ELSE 'browser_use' END",
        "candidate_url": f"'https://site.example.com/c/' || CAST({_K} AS STRING)",
        "candidate_kind": "CASE event_type WHEN 'signup' THEN 'website' WHEN 'purchase' THEN 'ats_board' ELSE 'career_site' END",
        "http_status": f"CASE WHEN event_type = 'error' THEN NULL WHEN {_K} < 10 THEN CAST(404 AS BIGINT) ELSE 200 END",
        "final_url": f"CASE WHEN value > 5 THEN 'https://site.example.com/jobs/' || CAST({_K} AS STRING) ELSE '' END",
        "title": f"'Page ' || CAST({_K} AS STRING)",
        "validation_status": f"CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' AND {_K} < 50 THEN 'rejected' ELSE 'accepted' END",
        "rejection_reason": f"CASE WHEN event_type = 'error' THEN CASE WHEN {_K} < 40 THEN 'timeout' WHEN {_K} < 70 THEN 'forbidden' ELSE 'transport_error' END WHEN event_type = 'view' AND {_K} < 50 THEN CASE WHEN {_K} < 20 THEN 'no_careers_signal' WHEN {_K} < 35 THEN 'locale_only_path' ELSE 'rate_limited' END END",
        "evidence_path": f"CASE WHEN {_K} < 30 THEN '/tmp/e/' || CAST({_K} AS STRING) WHEN {_K} < 60 THEN 'data/e/' || CAST({_K} AS STRING) END",
        "created_at": "ts",
    }),
    "trace_events": ("events", {
        "run_id": "CAST(user_id AS BIGINT)",
        "seq": "CAST(event_id AS BIGINT)",
        "event": "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'resolution' ELSE 'step' END",
        "step": "CAST(event_id AS BIGINT)",
        "url": f"CASE WHEN {_K} < 90 THEN 'https://site.example.com/' || CAST({_K} AS STRING) END",
        "thinking": "CASE WHEN value > 30 THEN 'Look at ' || event_type END",
        "evaluation_previous_goal": "CASE WHEN value > 10 THEN 'went well' END",
        "memory": f"'saw ' || CAST({_K} AS STRING)",
        "next_goal": "CASE WHEN value <= 60 THEN 'Open ' || event_type || ' page' END",
        "action": "event_type",
        "ts": "CASE WHEN value >= 1 THEN ts END",
        "success": "(event_type = 'purchase' AND value > 20)",
        "final_result": f"CASE WHEN event_type = 'purchase' THEN 'answer ' || CAST({_K} AS STRING) END",
    }),
    "log_lines": ("events", {
        "seq": "CAST(event_id AS BIGINT)",
        "ts": "ts",
        "container": f"'box' || CAST(CAST(floor({_K} / 4) AS BIGINT) AS STRING)",
        "level": f"CASE WHEN event_type = 'error' THEN CASE WHEN {_K} < 20 THEN 'fatal' ELSE 'error' END WHEN event_type = 'purchase' AND {_K} < 40 THEN 'warn' WHEN event_type = 'view' THEN 'debug' ELSE 'info' END",
        "app": f"CASE WHEN {_K} < 50 THEN 'crawler' ELSE 'applier' END",
        "svc": f"CASE WHEN {_K} < 30 THEN 'fetch' WHEN {_K} < 80 THEN 'store' END",
        "span": f"CASE WHEN {_K} < 70 THEN event_type END",
        "msg": f"CASE event_type WHEN 'signup' THEN CASE WHEN {_K} < 50 THEN 'start' ELSE 'agent decided' END WHEN 'click' THEN 'agent step' WHEN 'view' THEN CASE WHEN {_K} < 60 THEN 'listing stored' ELSE 'fetch' END WHEN 'purchase' THEN CASE WHEN {_K} < 50 THEN 'summary' ELSE 'stale' END ELSE CASE WHEN {_K} < 30 THEN 'agent failed' WHEN {_K} < 60 THEN 'skip' ELSE 'listings page blocked' END END",
        "run_id": "CAST(user_id AS STRING)",
        "sweep_id": "CAST(floor(user_id / 10) AS BIGINT) + 1",
        "company": "'company-' || CAST(user_id AS STRING)",
        "trace_id": f"CASE WHEN {_K} < 95 THEN lpad(CAST(user_id AS STRING), 32, '0') END",
        "method": "CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'HEAD' ELSE 'GET' END",
        "status": f"CASE WHEN event_type = 'error' THEN CAST(500 AS BIGINT) WHEN {_K} < 5 THEN 404 ELSE 200 END",
        "duration_ms": "CAST(floor(value * 10) AS BIGINT)",
        "n": _K,
        "line": f"CASE WHEN {_K} < 3 THEN 'panic: index out of range ' || CAST({_K} AS STRING) WHEN {_K} < 6 THEN '[1, 2]' ELSE '{{\"level\":\"' || event_type || '\",\"app\":\"crawler\",\"svc\":\"\",\"msg\":\"m\",\"run_id\":' || CAST(CASE WHEN {_K} < 20 THEN 0 ELSE user_id END AS STRING) || ',\"duration_ms\":0,\"status\":' || CAST({_K} AS STRING) || ',\"extra\":\"x' || CAST({_K} AS STRING) || '\",\"blank\":\"\"}}' END",
    }),
}
