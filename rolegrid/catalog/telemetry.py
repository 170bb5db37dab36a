"""Registered queries: runs, traces, logs, sweeps, feeds, posting JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolegrid.catalog.registry import Tables, query
from rolegrid.functions import jsonld, times
from rolegrid.operators import logs, ranking, runs
from rolegrid.sources import captures, feed

# --- runs ---------------------------------------------------------------------------------------

_RUNS = "r AS (SELECT *, CAST(platform_id AS STRING) AS platform, (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 AS duration_s, 'company-' || company_id AS company FROM runs)"


def my_runs(t: Tables):
    return t.runs.withColumns({"platform": F.col("platform_id").cast("string"), "company": F.concat(F.lit("company-"), F.col("company_id").cast("string"))})


@query("p6_run_filters", f"""WITH {_RUNS}
SELECT id, status, duration_s FROM r WHERE status = 'error' AND contains(lower(coalesce(error_text, '')), 'closed the connection') AND duration_s >= 1000 AND duration_s <= 4000
   AND started_at >= TIMESTAMP '1996-01-01' AND started_at <= TIMESTAMP '2000-12-31' AND id >= 100 AND contains(company, 'y-1')
   AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = r.id)""")
def _p6(t: Tables):
    traced = t.lineitem.select(F.col("l_orderkey").alias("run_id"))
    out = runs.query_runs(my_runs(t), traced, status="error", error_contains="CLOSED the connection", min_duration_s=1000, max_duration_s=4000,
                          since="1996-01-01", until="2000-12-31", min_id=100, company="Y-1", has_trace=True)
    return out.select("id", "status", "duration_s")


@query("o5_slowest_runs", f"WITH {_RUNS} SELECT id, duration_s FROM r ORDER BY duration_s DESC NULLS LAST, id LIMIT 40 OFFSET 20")
def _o5(t: Tables):
    return runs.query_runs(my_runs(t), sort="duration_desc", limit=40, offset=20).select("id", "duration_s")


@query("o5_fastest_runs", f"WITH {_RUNS} SELECT id, duration_s FROM r WHERE platform = '4' ORDER BY duration_s NULLS LAST, id LIMIT 30")
def _o5b(t: Tables):
    return runs.query_runs(my_runs(t), platform="4", sort="duration_asc", limit=30).select("id", "duration_s")


@query("a5_run_stats", f"""WITH {_RUNS}, d AS (SELECT duration_s AS x, row_number() OVER (ORDER BY duration_s) - 1 AS pos, count(*) OVER () AS n FROM r WHERE duration_s IS NOT NULL)
SELECT (SELECT count(*) FROM r) AS runs, (SELECT round(sum(epoch_us(finished_at) - epoch_us(started_at))::DOUBLE / 3.6e9, 1) FROM r) AS total_wall_hours,
       (SELECT count(*) FROM r WHERE duration_s IS NULL) AS runs_without_duration, max(n) AS timed_runs, min(x) AS min,
       min(x) FILTER (pos = least(n - 1, floor(n * 0.25::DOUBLE))) AS p25, median(x) AS median, min(x) FILTER (pos = least(n - 1, floor(n * 0.75::DOUBLE))) AS p75,
       min(x) FILTER (pos = least(n - 1, floor(n * 0.90::DOUBLE))) AS p90, max(x) AS max,
       (SELECT count(*) FROM r WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = r.id)) AS traced FROM d""")
def _a5(t: Tables):
    traced = t.lineitem.select(F.col("l_orderkey").alias("run_id"))
    return runs.run_stats(my_runs(t), traced, digits=None)


@query("a5_run_tallies", f"""WITH {_RUNS}
SELECT 'status' AS kind, status AS label, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'platform', platform, count(*) FROM r GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'error', left(coalesce(error_text, '(no error text)'), 70), count(*) FROM r WHERE status = 'error' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""")
def _a5t(t: Tables):
    return runs.run_tallies(my_runs(t), errors=10, prefix=70)


@query("s11_run_list_merge", """
SELECT id, status, coalesce(error_text, '') AS error_text, CAST(CASE WHEN status = 'ok' THEN 0 ELSE items_found END AS BIGINT) AS items_found, CASE WHEN status = 'ok' THEN '' ELSE 'c' END AS company FROM runs""")
def _s11(t: Tables):
    local = t.runs.filter("status <> 'ok'").select("id", "status", "error_text", "items_found", F.lit("c").alias("company"))
    remote = t.runs.filter("status = 'ok'").select("id", "status", "error_text")
    return runs.normalise_runs(local, remote).select("id", "status", "error_text", "items_found", "company")


# --- traces -------------------------------------------------------------------------------------


@query("a7_step_stats", """
WITH s AS (SELECT run_id, count(*) FILTER (event = 'step') AS x FROM trace_events GROUP BY 1),
o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS pos, count(*) OVER () AS n FROM s)
SELECT max(n) AS n, CAST(min(x) AS BIGINT) AS min, CAST(min(x) FILTER (pos = least(n - 1, floor(n * 0.25::DOUBLE))) AS BIGINT) AS p25, median(x) AS median,
       CAST(min(x) FILTER (pos = least(n - 1, floor(n * 0.75::DOUBLE))) AS BIGINT) AS p75, CAST(min(x) FILTER (pos = least(n - 1, floor(n * 0.90::DOUBLE))) AS BIGINT) AS p90, CAST(max(x) AS BIGINT) AS max FROM o""")
def _a7(t: Tables):
    return ranking.percentiles(runs.steps_per_run(t.trace_events), "steps", digits=None)


@query("a7_action_counts", "SELECT action, count(*) AS n FROM trace_events WHERE event = 'step' GROUP BY 1")
def _a7a(t: Tables):
    return runs.action_counts(t.trace_events)


@query("a7_done_counts", "SELECT count(*) AS with_done_event, count(*) FILTER (success) AS done_successful FROM trace_events WHERE event = 'done'")
def _a7d(t: Tables):
    return runs.done_counts(t.trace_events)


@query("a8_step_histogram", """
WITH s AS (SELECT CAST(l_orderkey AS BIGINT) AS run_id, count(*) FILTER (l_returnflag = 'A') AS n FROM lineitem GROUP BY 1),
b AS (SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 3 THEN '1-3' WHEN n <= 8 THEN '4-8' WHEN n <= 15 THEN '9-15' WHEN n <= 25 THEN '16-25' ELSE '26+' END AS bucket FROM s)
SELECT d.bucket, count(b.bucket) AS runs FROM (VALUES ('0'), ('1-3'), ('4-8'), ('9-15'), ('16-25'), ('26+')) d(bucket) LEFT JOIN b USING (bucket) GROUP BY 1""")
def _a8(t: Tables):
    ev = t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") == "A", "step").otherwise("done").alias("event"))
    return runs.step_histogram(runs.steps_per_run(ev))


@query("a9_trace_digest", """
SELECT run_id, count(*) AS events, count(*) FILTER (event = 'step') AS steps, coalesce(arg_min(url, seq) FILTER (event = 'step' AND url <> ''), '') AS first_url,
       coalesce(arg_max(url, seq) FILTER (event = 'step' AND url <> ''), '') AS last_url, bool_or(event = 'done') AS has_done_event,
       arg_min(success, seq) FILTER (event = 'done') AS done_success, coalesce(arg_min(final_result, seq) FILTER (event = 'done'), '') AS final_result,
       count(DISTINCT url) FILTER (event = 'step' AND url <> '') AS distinct_urls FROM trace_events GROUP BY run_id""")
def _a9(t: Tables):
    return runs.trace_digest(t.trace_events)


@query("a9_digest_first_steps", """
SELECT run_id, CAST(place AS BIGINT) AS place, step, url, left(coalesce(next_goal, evaluation_previous_goal), 200) AS goal FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS place FROM trace_events WHERE event = 'step') WHERE place <= 40""")
def _a9s(t: Tables):
    return runs.digest_steps(t.trace_events, max_steps=40, goal_chars=200).select("run_id", "place", "step", "url", "goal")


@query("a9_digest_all_steps", """
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY seq) AS BIGINT) AS place, step, url, coalesce(next_goal, evaluation_previous_goal) AS goal
  FROM trace_events WHERE event = 'step'""")
def _a9w(t: Tables):
    return runs.digest_steps(t.trace_events).select("run_id", "place", "step", "url", "goal")


@query("w9_step_latency_percentiles", """
WITH l AS (SELECT run_id, step, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run_id ORDER BY seq))) / 1e6 AS x FROM trace_events WHERE event = 'step' AND ts IS NOT NULL),
o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS pos, count(*) OVER () AS n FROM l WHERE x IS NOT NULL)
SELECT max(n) AS n, min(x) AS min, min(x) FILTER (pos = least(n - 1, floor(n * 0.25::DOUBLE))) AS p25, median(x) AS median,
       min(x) FILTER (pos = least(n - 1, floor(n * 0.75::DOUBLE))) AS p75, min(x) FILTER (pos = least(n - 1, floor(n * 0.90::DOUBLE))) AS p90, max(x) AS max FROM o""")
def _w9(t: Tables):
    return ranking.percentiles(runs.step_latency(t.trace_events), "latency_s", digits=None)


@query("w9_o7_slowest_steps", """
WITH l AS (SELECT run_id, step, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run_id ORDER BY seq))) / 1e6 AS latency_s FROM trace_events WHERE event = 'step' AND ts IS NOT NULL)
SELECT * FROM l WHERE latency_s IS NOT NULL ORDER BY latency_s DESC, run_id DESC, step DESC LIMIT 10""")
def _w9s(t: Tables):
    return runs.slowest_steps(runs.step_latency(t.trace_events))


@query("p20_step_search", """
WITH h AS (SELECT run_id, step, url, CASE WHEN regexp_matches(url, '(?i)com/1') THEN 'url' WHEN regexp_matches(thinking, '(?i)at CLICK') THEN 'thinking' END AS f0, url AS u, thinking FROM trace_events WHERE event = 'step'),
g AS (SELECT run_id, step, coalesce(url, '') AS url, CASE WHEN regexp_matches(u, '(?i)com/1|at click') THEN 'url' WHEN regexp_matches(thinking, '(?i)com/1|at click') THEN 'thinking' END AS field,
             CASE WHEN regexp_matches(u, '(?i)com/1|at click') THEN u WHEN regexp_matches(thinking, '(?i)com/1|at click') THEN thinking END AS text FROM h)
SELECT run_id, step, field, url, text AS snippet FROM g WHERE field IS NOT NULL""")
def _p20(t: Tables):
    return runs.search_steps(t.trace_events, "com/1|at CLICK", ["url", "thinking"], limit=None).select("run_id", "step", "field", "url", "snippet")


@query("p20_search_scanned", "SELECT count(DISTINCT run_id) AS scanned_runs, count(*) FILTER (event = 'step') AS scanned_steps FROM trace_events")
def _p20s(t: Tables):
    return runs.search_scanned(t.trace_events)


@query("j20_trace_coverage", """
WITH f AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS id FROM events WHERE event_type <> 'view' OR value > 100), e AS (SELECT user_id AS id, count(*) AS n FROM events WHERE event_type = 'signup' AND value > 60 GROUP BY 1)
SELECT r.id, CASE WHEN f.id IS NULL AND e.n IS NULL THEN 'missing' WHEN e.n > 0 THEN 'present' ELSE 'empty' END AS trace_state, CAST(coalesce(e.n, 0) AS BIGINT) AS trace_events
  FROM runs r LEFT JOIN f USING (id) LEFT JOIN e USING (id)""")
def _j20(t: Tables):
    files = t.events.filter("event_type <> 'view' OR value > 100").select(F.col("user_id").alias("run_id"))
    ev = t.events.filter("event_type = 'signup' AND value > 60").select(F.col("user_id").alias("run_id"))
    return runs.trace_state(t.runs, files, ev).select("id", "trace_state", "trace_events")


@query("j19_job_run_trace", """
WITH d AS (SELECT run_id, count(*) FILTER (event = 'step') AS steps, coalesce(arg_max(url, seq) FILTER (event = 'step' AND url <> ''), '') AS last_url FROM trace_events GROUP BY 1)
SELECT j.job_id, r.status AS run_status, d.steps, d.last_url FROM jobs j LEFT JOIN runs r ON r.id = j.scrape_run_id LEFT JOIN d ON d.run_id = j.scrape_run_id""")
def _j19(t: Tables):
    return runs.job_story(t.jobs, t.runs, runs.trace_digest(t.trace_events)).select("job_id", "run_status", "steps", "last_url")


# --- sweeps -------------------------------------------------------------------------------------

_TARGETS = """tg AS (SELECT company_id AS pos, slug, CASE WHEN verdict = 'confirmed' THEN 'ok' WHEN verdict = 'wrong' THEN 'error' END AS last_run_status, index_membership = 'sp500' AS has_trace FROM companies),
j AS (SELECT *, CASE WHEN last_run_status = 'ok' AND has_trace THEN 'browser-use trace present' END AS reason FROM tg WHERE lower(slug) >= 'customer-000000100'),
k AS (SELECT *, sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS kept FROM j)"""


def targets(t: Tables):
    return t.companies.select(
        F.col("company_id").alias("pos"), "slug", F.expr("CASE WHEN verdict = 'confirmed' THEN 'ok' WHEN verdict = 'wrong' THEN 'error' END").alias("last_run_status"),
        (F.col("index_membership") == "sp500").alias("has_trace"))


@query("w5_w6_sweep_plan", f"""WITH {_TARGETS}
SELECT pos, slug, CASE WHEN reason IS NULL THEN 'planned' ELSE 'skipped' END AS decision, reason FROM k WHERE (reason IS NULL AND kept <= 300) OR (reason IS NOT NULL AND kept < 300)""")
def _w5(t: Tables):
    plan = runs.plan_sweep(targets(t), runs.skip_rule(False, True), from_slug=" CUSTOMER-000000100", limit=300, by=F.floor(F.col("pos") / 256))
    return plan.select("pos", "slug", "decision", "reason")


@query("w6_skip_rule", """
SELECT company_id AS pos, CASE WHEN verdict = 'confirmed' THEN 'last run ok' END AS reason FROM companies""")
def _w6(t: Tables):
    return targets(t).select("pos", runs.skip_rule(True, True).alias("reason"))


@query("w7_failure_streak_stop", """
WITH e AS (SELECT user_id AS sweep, event_id AS pos, event_type NOT IN ('error', 'view') AS ok, event_type = 'error' AND value > 150 AS down FROM events),
g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY sweep ORDER BY pos) AS island FROM e),
s AS (SELECT *, CASE WHEN NOT ok THEN sum(CASE WHEN NOT ok THEN 1 ELSE 0 END) OVER (PARTITION BY sweep, island ORDER BY pos) END AS streak FROM g)
SELECT sweep, min(pos) FILTER (streak >= 5 OR down) AS stop_at FROM s GROUP BY sweep""")
def _w7(t: Tables):
    o = t.events.select(F.col("user_id").alias("sweep"), F.col("event_id").alias("pos"), (~F.col("event_type").isin("error", "view")).alias("ok"),
                        ((F.col("event_type") == "error") & (F.col("value") > 150)).alias("host_down"))
    return runs.stop_point(o, "sweep", "pos", 5, F.floor(F.col("pos") / 1000))


@query("t6_failure_breaker_batch_twin", """
WITH e AS (SELECT user_id AS sweep_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_type NOT IN ('error', 'view') AS ok,
                  event_type = 'error' AND value > 150 AS down FROM events),
g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY sweep_id ORDER BY seq) AS island FROM e),
s AS (SELECT *, CASE WHEN NOT ok THEN sum(CASE WHEN NOT ok THEN 1 ELSE 0 END) OVER (PARTITION BY sweep_id, island ORDER BY seq) END AS streak FROM g),
x AS (SELECT sweep_id, min(seq) AS stop_at, arg_min(down, seq) AS down FROM s WHERE streak >= 5 OR down GROUP BY sweep_id)
SELECT sweep_id, stop_at, CASE WHEN down THEN 'host_down' ELSE 'failures' END AS reason FROM x""")
def _t6(t: Tables):
    from rolegrid.operators.scans import number_rows
    from rolegrid.streaming.stateful import failure_breaker_batch

    e = t.events.select(F.col("user_id").alias("sweep_id"), F.col("event_id").alias("at"), (~F.col("event_type").isin("error", "view")).alias("ok"),
                        ((F.col("event_type") == "error") & (F.col("value") > 150)).alias("host_down"))
    numbered = number_rows(e, ["sweep_id"], ["at"], F.floor(F.col("at") / 1000), "seq").drop("at")
    return failure_breaker_batch(numbered, 5, F.floor(F.col("seq") / 1000))


@query("w7_companies_not_run", """
WITH e AS (SELECT user_id AS sweep, event_id AS pos, event_type NOT IN ('error', 'view') AS ok FROM events),
g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY sweep ORDER BY pos) AS island FROM e),
s AS (SELECT *, CASE WHEN NOT ok THEN sum(CASE WHEN NOT ok THEN 1 ELSE 0 END) OVER (PARTITION BY sweep, island ORDER BY pos) END AS streak FROM g),
x AS (SELECT sweep, min(pos) FILTER (streak >= 4) AS stop_at FROM s GROUP BY sweep)
SELECT e.sweep, e.pos FROM e JOIN x ON e.sweep = x.sweep WHERE e.pos > x.stop_at""")
def _w7n(t: Tables):
    o = t.events.select(F.col("user_id").alias("sweep"), F.col("event_id").alias("pos"), (~F.col("event_type").isin("error", "view")).alias("ok"), F.lit(False).alias("host_down"))
    return runs.not_run(o, runs.stop_point(o, "sweep", "pos", 4), "sweep", "pos").select("sweep", "pos")


@query("w10_resume_point", """
SELECT user_id AS sweep_id, CASE WHEN NOT bool_or(event_type = 'error' AND value > 120) THEN arg_max(props, event_id) FILTER (event_type = 'signup') END AS resume_from FROM events GROUP BY 1""")
def _w10(t: Tables):
    msg = F.when(F.col("event_type") == "signup", "company started").when((F.col("event_type") == "error") & (F.col("value") > 120), "sweep finished")
    ev = t.events.select(F.col("user_id").alias("sweep_id"), F.col("event_id").alias("seq"), msg.alias("msg"), F.col("props").alias("company"), F.lit(False).alias("stopped_early"))
    return runs.resume_point(ev)


_LOG_LINES = """CASE WHEN event_type = 'signup' THEN '[' || event_id || '/150] company=co-' || user_id || ' vendor=lever' WHEN event_type = 'error' THEN 'run_id=' || user_id || ' agent_failed=1'
  WHEN event_type = 'view' THEN 'run_id=' || user_id || ' no_remote_roles=true' WHEN event_type = 'click' THEN 'x found=' || CAST(regexp_extract(props, '[0-9]+', 0) AS STRING) || ' inserted=2' ELSE 'noise' END"""


@query("a18_f49_sweep_text_log", f"""
WITH l AS (SELECT CAST(floor(event_id / 2500) AS BIGINT) AS run_id, event_id AS line_no, event_type, {_LOG_LINES.replace("event_id ||", "CAST(event_id AS STRING) ||").replace("user_id ||", "CAST(user_id AS STRING) ||")} AS line FROM events),
b AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY line_no) AS block FROM l)
SELECT run_id, CAST(block AS BIGINT) AS block, max(regexp_extract(line, 'company=([^ ]+)', 1)) AS company,
  CASE WHEN bool_or(event_type = 'error') THEN 'agent_failed' WHEN bool_or(event_type = 'view') THEN 'no_remote_roles' WHEN bool_or(event_type = 'click') THEN 'fetched' ELSE 'incomplete' END AS outcome,
  CAST(coalesce(arg_min(TRY_CAST(regexp_extract(line, 'found=([0-9]+)', 1) AS BIGINT), line_no) FILTER (event_type = 'click'), 0) AS BIGINT) AS found
  FROM b WHERE block > 0 GROUP BY 1, 2""")
def _a18(t: Tables):
    expr = _LOG_LINES.replace("event_id ||", "CAST(event_id AS STRING) ||").replace("user_id ||", "CAST(user_id AS STRING) ||")
    lines = t.events.select(F.floor(F.col("event_id") / 2500).cast("bigint").alias("run_id"), F.col("event_id").alias("line_no"), F.expr(expr).alias("line"))
    blocks = runs.sweep_blocks(lines, by=F.floor(F.col("line_no") / 500))
    return blocks.select("run_id", "block", "company", "outcome", "found")


# --- logs ---------------------------------------------------------------------------------------


@query("p17_t7_notable_requests", """
SELECT seq, CASE WHEN method NOT IN ('GET', 'HEAD') THEN 'state-changing' WHEN status >= 400 THEN 'failed' WHEN duration_ms >= 500 THEN 'slow' END AS why
  FROM log_lines WHERE method NOT IN ('GET', 'HEAD') OR status >= 400 OR duration_ms >= 500""")
def _p17(t: Tables):
    return logs.notable(t.log_lines).select("seq", "why")


@query("p18_raw_log_search", "SELECT seq, level, line FROM log_lines WHERE app = 'crawler' AND regexp_matches(line, 'panic|x4') ORDER BY ts DESC, seq DESC LIMIT 200")
def _p18(t: Tables):
    return logs.search(t.log_lines, {"app": "crawler"}, "panic|x4", limit=200).select("seq", "level", "line")


@query("p18_raw_log_search_all", "SELECT seq, level, line FROM log_lines WHERE app = 'crawler' AND regexp_matches(line, 'panic|x4')")
def _p18w(t: Tables):
    return logs.search(t.log_lines, {"app": "crawler"}, "panic|x4").select("seq", "level", "line")


@query("p19_keyed_lookup", "SELECT seq, msg, level FROM log_lines WHERE run_id = '7'")
def _p19(t: Tables):
    return logs.lookup(t.log_lines, "run_id", 7).select("seq", "msg", "level")


@query("p19_lookup_company_in_window", "SELECT seq, msg FROM log_lines WHERE company = 'company-12' AND ts >= TIMESTAMP '2024-01-20' ORDER BY ts, seq LIMIT 500")
def _p19c(t: Tables):
    return logs.lookup(t.log_lines, "company", "company-12", F.lit("2024-01-20").cast("timestamp"), 500).select("seq", "msg")


@query("a10_label_counts", "SELECT level AS value, count(*) AS n FROM log_lines WHERE ts >= TIMESTAMP '2024-01-24' AND ts <= TIMESTAMP '2024-01-31' GROUP BY 1")
def _a10(t: Tables):
    return logs.label_counts(logs.in_window(t.log_lines, "7d", F.lit("2024-01-31").cast("timestamp")), "level")


@query("a11_error_summary", """
WITH g AS (SELECT app, coalesce(svc, '') AS svc, msg, count(*) AS n FROM log_lines WHERE level IN ('error', 'warn') GROUP BY 1, 2, 3)
SELECT *, (SELECT count(*) FROM g) AS groups, (SELECT CAST(sum(n) AS BIGINT) FROM g) AS total FROM g ORDER BY n DESC, app, svc, msg LIMIT 5""")
def _a11(t: Tables):
    return logs.error_summary(t.log_lines, "error|warn", limit=5)


@query("a12_container_health", """
WITH c AS (SELECT container, count(*) AS lines, count(*) FILTER (regexp_matches(line, '(?i)panic|fatal|oomkill|out of memory|traceback|exit status|unhandled')) AS problem_lines FROM log_lines GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12)
SELECT *, round(problem_lines / lines * 1000, 1) AS problem_per_1k FROM c""")
def _a12(t: Tables):
    return logs.container_health(t.log_lines, limit=12)


@query("a13_trace_timeline", """
SELECT trace_id, count(*) AS lines, count(*) FILTER (level IN ('error', 'warn', 'fatal')) AS errors, epoch_us(min(ts)) AS first_at, epoch_us(max(ts)) AS last_at FROM log_lines WHERE trace_id IS NOT NULL GROUP BY 1""")
def _a13(t: Tables):
    out = logs.trace_summary(t.log_lines)
    return out.withColumns({n: F.unix_micros(n) for n in ("first_at", "last_at")})


@query("a13_trace_spans", "SELECT coalesce(span, '-') AS span, count(*) AS n FROM log_lines WHERE trace_id = lpad('9', 32, '0') GROUP BY 1")
def _a13s(t: Tables):
    return logs.trace_spans(t.log_lines, "9".rjust(32, "0"))


@query("s8_log_line_parse", """
WITH j AS (SELECT seq, line, CASE WHEN starts_with(line, '{') THEN CAST(line AS JSON) END AS b FROM log_lines)
SELECT seq, b->>'$.level' AS level, nullif(b->>'$.svc', '') AS svc, nullif(b->>'$.run_id', '0') AS run_id, CAST(b->>'$.duration_ms' AS BIGINT) AS duration_ms,
       CAST(b->>'$.status' AS BIGINT) AS status, b->>'$.extra' AS extra, CASE WHEN b IS NULL THEN line END AS raw FROM j""")
def _s8(t: Tables):
    out = logs.parse_lines(t.log_lines.select("seq", "line"), raw_limit=2000)
    return out.select("seq", "level", "svc", "run_id", "duration_ms", "status", F.try_element_at("fields", F.lit("extra")).alias("extra"), "raw")


@query("s9_t3_collector_extract", """
SELECT seq, container, line, CASE WHEN starts_with(line, '{') THEN CAST(line AS JSON)->>'$.level' END AS level, CASE WHEN starts_with(line, '{') THEN CAST(line AS JSON)->>'$.run_id' END AS run_id
  FROM log_lines WHERE container IN ('box1', 'box3', 'box20')""")
def _s9(t: Tables):
    out = logs.collect(t.log_lines.select("seq", "container", "line"), ["box1", "box3", "box20"], "container")
    return out.select("seq", "container", "line", "level", "run_id")


def _n(name: str):
    """Fields of the derived log lines come from their number column."""
    return {"blocked": (F.col("n") > 45).cast("string"), "reason": F.when(F.col("n") < 45, "no_remote_roles"),
            "block_reason": F.concat(F.lit("r"), F.col("n").cast("string")), "listing_id": F.col("n").cast("string")}.get(name, F.col("n").cast("string"))


_FIRST = "arg_min({v}, (ts, seq)) FILTER (msg = '{m}')"


@query("a14_run_facts", f"""
WITH f AS (SELECT run_id, count(*) AS lines, coalesce(bool_or(msg = 'agent failed'), false) AS af, coalesce(bool_or(msg = 'listings page blocked'), false) AS bl, coalesce(bool_or(msg = 'skip'), false) AS sk,
  coalesce(bool_or(msg = 'listing stored'), false) AS st, coalesce(bool_or(msg = 'summary'), false) AS su, {_FIRST.format(v='n', m='summary')} AS sn, arg_min(coalesce(n, -1), (ts, seq)) FILTER (msg = 'skip') AS kn,
  count(*) FILTER (msg = 'agent step') AS steps, {_FIRST.format(v='n', m='agent decided')} AS dn, {_FIRST.format(v='n', m='agent failed')} AS fn, {_FIRST.format(v='n', m='listings page blocked')} AS bn,
  count(*) FILTER (msg = 'listing stored') AS listings_stored, count(*) FILTER (level IN ('error', 'fatal')) AS errors, count(*) FILTER (level = 'warn') AS warnings FROM log_lines GROUP BY 1)
SELECT run_id, lines, CASE WHEN af THEN 'agent_failed' WHEN bl OR coalesce(sn > 45, false) THEN 'blocked' WHEN sk THEN CASE WHEN kn < 45 THEN 'no_remote_roles' ELSE 'skipped' END WHEN st THEN 'stored' WHEN su THEN 'completed' ELSE 'in_progress' END AS outcome,
  CAST(coalesce(nullif(steps, 0), dn, fn) AS BIGINT) AS agent_steps, CAST(coalesce(sn, dn) AS STRING) AS agent_s, coalesce('r' || CAST(bn AS STRING), 'r' || CAST(sn AS STRING)) AS block_reason,
  listings_stored, errors, warnings FROM f""")
def _a14(t: Tables):
    out = logs.run_facts(t.log_lines, ["run_id"], _n)
    return out.select("run_id", "lines", "outcome", "agent_steps", "agent_s", "block_reason", "listings_stored", "errors", "warnings")


@query("a17_company_history", f"""
WITH m AS (SELECT *, CASE WHEN msg = 'fetch' THEN 'company skipped' ELSE msg END AS said FROM log_lines),
f AS (SELECT company, run_id, min(ts) AS first_ts, coalesce(bool_or(msg = 'agent failed'), false) AS af, coalesce(bool_or(msg = 'listings page blocked'), false) AS bl, coalesce(bool_or(msg = 'skip'), false) AS sk,
  coalesce(bool_or(msg = 'listing stored'), false) AS st, coalesce(bool_or(msg = 'summary'), false) AS su, {_FIRST.format(v='n', m='summary')} AS sn, arg_min(coalesce(n, -1), (ts, seq)) FILTER (msg = 'skip') AS kn FROM log_lines GROUP BY 1, 2)
SELECT company, run_id, epoch_us(first_ts) AS seen_at, NULL AS reason, CASE WHEN af THEN 'agent_failed' WHEN bl OR coalesce(sn > 45, false) THEN 'blocked' WHEN sk THEN CASE WHEN kn < 45 THEN 'no_remote_roles' ELSE 'skipped' END WHEN st THEN 'stored' WHEN su THEN 'completed' ELSE 'in_progress' END AS outcome FROM f
UNION ALL SELECT company, NULL, epoch_us(ts), CASE WHEN n < 45 THEN 'no_remote_roles' END, 'skipped_before_running' FROM m WHERE said = 'company skipped'""")
def _a17(t: Tables):
    lines = t.log_lines.withColumn("msg", F.when(F.col("msg") == "fetch", "company skipped").otherwise(F.col("msg")))
    return logs.company_history(lines, _n).select("company", "run_id", F.unix_micros("at").alias("seen_at"), "reason", "outcome")


@query("a15_run_summary", f"""
SELECT run_id, CAST({_FIRST.format(v='n', m='agent decided')} AS STRING) AS listings_url_d, CAST({_FIRST.format(v='n', m='fetch')} AS BIGINT) AS extracted,
  CAST({_FIRST.format(v='n', m='summary')} AS BIGINT) AS inserted, CAST({_FIRST.format(v='n', m='stale')} AS BIGINT) AS closed, {_FIRST.format(v='company', m='start')} AS c0, arg_min(company, (ts, seq)) AS c1 FROM log_lines GROUP BY run_id""".replace("SELECT run_id, CAST(", "SELECT run_id, coalesce(CAST(", 1).replace(" AS STRING) AS listings_url_d", f" AS STRING), CAST({_FIRST.format(v='n', m='start')} AS STRING)) AS listings_url").replace(
    f"{_FIRST.format(v='company', m='start')} AS c0, arg_min(company, (ts, seq)) AS c1", f"coalesce({_FIRST.format(v='company', m='start')}, arg_min(company, (ts, seq))) AS company"))
def _a15(t: Tables):
    return logs.run_summary(t.log_lines.withColumn("error", F.col("line")), ["run_id"], _n).select("run_id", "listings_url", "extracted", "inserted", "closed", "company")


@query("a16_sweep_outcomes", f"""
WITH f AS (SELECT sweep_id, run_id, coalesce(bool_or(msg = 'agent failed'), false) AS af, coalesce(bool_or(msg = 'listings page blocked'), false) AS bl, coalesce(bool_or(msg = 'skip'), false) AS sk,
  coalesce(bool_or(msg = 'listing stored'), false) AS st, coalesce(bool_or(msg = 'summary'), false) AS su, {_FIRST.format(v='n', m='summary')} AS sn, arg_min(coalesce(n, -1), (ts, seq)) FILTER (msg = 'skip') AS kn FROM log_lines GROUP BY 1, 2),
o AS (SELECT sweep_id, CASE WHEN af THEN 'agent_failed' WHEN bl OR coalesce(sn > 45, false) THEN 'blocked' WHEN sk THEN CASE WHEN kn < 45 THEN 'no_remote_roles' ELSE 'skipped' END WHEN st THEN 'stored' WHEN su THEN 'completed' ELSE 'in_progress' END AS outcome FROM f)
SELECT sweep_id, outcome, count(*) AS n FROM o GROUP BY 1, 2""")
def _a16(t: Tables):
    return logs.outcome_tally(logs.sweep_rows(t.log_lines, _n), ["sweep_id"])


@query("j18_listing_story", """
SELECT n AS listing_id, count(*) AS lines, count(*) FILTER (msg = 'listing stored') AS stored, count(*) FILTER (msg <> 'listing stored') AS applications,
       coalesce(arg_min(company, (ts, seq)) FILTER (msg = 'listing stored'), arg_min(company, (ts, seq))) AS company, epoch_us(min(ts) FILTER (msg = 'listing stored')) AS first_stored_at FROM log_lines GROUP BY n""")
def _j18(t: Tables):
    out = logs.listing_story(t.log_lines, "n")
    return out.select("listing_id", "lines", "stored", "applications", "company", F.unix_micros("first_stored_at").alias("first_stored_at"))


@query("t1_windowed_counts_batch_twin", """
SELECT level, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) * 3600000000 AS window_start, count(*) AS n FROM log_lines GROUP BY 1, 2""")
def _t1(t: Tables):
    from rolegrid.streaming.logs import windowed_counts

    out = windowed_counts(t.log_lines, "level", "1 hour")
    return out.select("level", F.unix_micros("window_start").alias("window_start"), "n")


# --- counters -----------------------------------------------------------------------------------

_OUT = "o AS (SELECT user_id AS g, event_id AS ordinal, 'slug-' || event_id AS slug, CASE event_type WHEN 'click' THEN 'confirmed' WHEN 'view' THEN 'wrong' ELSE 'unverifiable' END AS category, value > 100 AS escalated, CASE WHEN event_type = 'error' AND value > 60 THEN 'render: ' || props END AS error FROM events)"


def outcomes(t: Tables):
    return t.events.select(
        F.col("user_id").alias("g"), F.col("event_id").alias("ordinal"), F.concat(F.lit("slug-"), F.col("event_id").cast("string")).alias("slug"),
        F.expr("CASE event_type WHEN 'click' THEN 'confirmed' WHEN 'view' THEN 'wrong' ELSE 'unverifiable' END").alias("category"), (F.col("value") > 100).alias("escalated"),
        F.expr("CASE WHEN event_type = 'error' AND value > 60 THEN 'render: ' || props END").alias("error"))


@query("a23_validation_summary", f"""WITH {_OUT}
SELECT g, count(*) AS found, count(*) FILTER (error IS NULL AND category = 'confirmed') AS confirmed, count(*) FILTER (error IS NULL AND category = 'wrong') AS wrong,
       count(*) FILTER (error IS NULL AND category = 'unverifiable') AS unverifiable, count(*) FILTER (escalated) AS escalated, count(*) FILTER (error IS NOT NULL) AS failed,
       coalesce(arg_min(slug || ': ' || error, ordinal) FILTER (error IS NOT NULL), '') AS first_error FROM o GROUP BY g""")
def _a23(t: Tables):
    return runs.validation_summary(outcomes(t), ["g"])


@query("a24_resolution_summary", f"""WITH {_OUT}, p AS (SELECT *, category = 'wrong' AND NOT escalated AS skipped, category = 'confirmed' AS resolved FROM o)
SELECT g, count(*) FILTER (NOT skipped) AS found, count(*) FILTER (NOT skipped AND error IS NULL AND resolved) AS inserted, count(*) FILTER (NOT skipped AND error IS NULL AND resolved) AS resolved,
       count(*) FILTER (NOT skipped AND (error IS NOT NULL OR NOT resolved)) AS unresolved, count(*) FILTER (skipped) AS skipped, count(*) FILTER (NOT skipped AND error IS NOT NULL) AS failed,
       CASE WHEN count(*) FILTER (NOT skipped AND error IS NULL AND resolved) = 0 AND count(*) FILTER (NOT skipped) > 0 THEN 'no companies resolved' || coalesce('; first failure: ' || arg_min(slug || ': ' || error, ordinal) FILTER (NOT skipped AND error IS NOT NULL), '') END AS error_text
  FROM p GROUP BY g""")
def _a24(t: Tables):
    o = outcomes(t).withColumns({"skipped": (F.col("category") == "wrong") & ~F.col("escalated"), "resolved": F.col("category") == "confirmed", "resolution_action": F.when(F.col("category") == "confirmed", "inserted")})
    return runs.resolution_summary(o, ["g"]).drop("updated", "first_error")


@query("a25_unresolved_reason", """
WITH s AS (SELECT company_id, source, min((attempt_index, id)) AS at_ FROM attempts GROUP BY 1, 2), sl AS (SELECT company_id, string_agg(source, ',' ORDER BY at_) AS sources FROM s GROUP BY 1),
l AS (SELECT company_id, count(*) AS attempts, (list(rejection_reason ORDER BY attempt_index DESC, id DESC))[1] AS last_reason FROM attempts GROUP BY 1)
SELECT c.company_id, CAST(coalesce(l.attempts, 0) AS BIGINT) AS attempts, CASE WHEN l.attempts IS NULL THEN 'no_candidates' ELSE coalesce(l.last_reason, 'no_acceptable_candidate') END AS reason, coalesce(sl.sources, '') AS sources
  FROM companies c LEFT JOIN l USING (company_id) LEFT JOIN sl USING (company_id)""")
def _a25(t: Tables):
    return runs.unresolved_reason(t.attempts, t.companies)


@query("a26_a28_scrape_counters_and_quality", """
WITH c AS (SELECT company_id, count(*) AS found, count(*) FILTER (is_us AND salary_currency IS NOT NULL) AS accepted, count(*) FILTER ((is_us IS NULL OR NOT is_us) AND salary_currency IS NOT NULL) AS skipped_non_us, count(*) FILTER (is_remote = 1) AS remote_evidence
             FROM jobs GROUP BY 1)
SELECT *, CASE WHEN found > 0 AND accepted = 0 AND skipped_non_us > 0 THEN 'agent_confirmed_remote_but_all_postings_non_us' WHEN found > 0 AND accepted = 0 THEN 'agent_confirmed_remote_but_nothing_stored' ELSE '' END AS quality FROM c""")
def _a26(t: Tables):
    f = t.jobs.select("company_id", F.when(F.col("salary_currency").isNotNull(), F.col("listing_url")).alias("url"), F.lit(None).cast("string").alias("error"), "is_us", (F.col("is_remote") == 1).alias("remote"))
    out = runs.scrape_counters(f, ["company_id"])
    return out.withColumn("quality", runs.quality_note(F.lit("agent"), F.lit(True), "found", "accepted", "skipped_non_us"))


@query("a27_unreadable_postings", r"""
WITH p AS (SELECT CASE WHEN source IN ('src1', 'src2') THEN lang END AS block_reason, CASE WHEN source IN ('src2', 'src3') THEN text END AS error FROM documents)
SELECT 'blocked' AS kind, block_reason AS label, count(*) AS n FROM p WHERE block_reason <> '' GROUP BY 2
UNION ALL SELECT 'errored', array_to_string(list_filter(regexp_split_to_array(error, '\s+'), lambda w: w <> '')[1:6], ' '), count(*) FROM p WHERE error <> '' GROUP BY 2""")
def _a27(t: Tables):
    p = t.documents.select(F.when(F.col("source").isin("src1", "src2"), F.col("lang")).alias("block_reason"), F.when(F.col("source").isin("src2", "src3"), F.col("text")).alias("error"))
    return runs.unreadable_tally(p, words=6)


# --- feeds and posting JSON ---------------------------------------------------------------------

_ELEMENT = """(CASE WHEN k < 3 THEN '{"last_updated":1,"legal":"notice"}' WHEN k < 6 THEN '{"position":"P","company":"C"}' WHEN k < 9 THEN '{"id":"","position":"P"}' WHEN k < 12 THEN '[1]' WHEN k < 15 THEN '{"id":' || CAST(event_id AS STRING) || ',"position":7}'
  ELSE '{"id":' || CASE WHEN event_type = 'click' THEN CAST(event_id AS STRING) ELSE '"' || CAST(event_id AS STRING) || '"' END || ',"company":"Co ' || CAST(user_id AS STRING) || '","position":"Dev ' || CAST(k AS STRING) || '","location":"' || CASE WHEN k < 40 THEN '' ELSE 'Remote' END
  || '","tags":[' || CASE WHEN event_type = 'view' THEN '' ELSE '"' || event_type || '","t' || CAST(k AS STRING) || '"' END || '],"epoch":' || CAST(1700000000 + event_id AS STRING) || ',"salary_min":' || CASE WHEN k < 30 THEN '0' WHEN k < 35 THEN '"60k"' WHEN k < 38 THEN '1.5' ELSE CAST(k AS STRING) END || ',"salary_max":null}' END)"""
_EL = f"el AS (SELECT event_id, event_type, k, user_id, {_ELEMENT} AS element FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events))"


def elements(t: Tables):
    k = t.events.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("bigint"))
    return k.select("event_id", F.expr(_ELEMENT).alias("element"))


@query("f34_feed_normalise", f"""WITH {_EL}
SELECT event_id, CASE WHEN k >= 12 THEN CAST(event_id AS STRING) END AS external_id,
       CASE WHEN k < 3 THEN 'notice' WHEN k < 9 THEN 'missing_id' WHEN k < 15 THEN 'unmarshal_failed' WHEN k >= 30 AND k < 38 THEN 'salary_min_not_integer' END AS reason,
       CASE WHEN k >= 38 THEN CAST(k * 100 AS BIGINT) END AS salary_min_cents, CASE WHEN k >= 40 THEN 'Remote' END AS location_text,
       CASE WHEN k >= 15 AND event_type <> 'view' THEN event_type || ',t' || k ELSE '' END AS tags, CASE WHEN k >= 15 THEN (1700000000 + event_id) * 1000000 ELSE 0 END AS posted_at FROM el""")
def _f34(t: Tables):
    out = feed.normalise_feed(elements(t))
    return out.select("event_id", "external_id", "reason", "salary_min_cents", "location_text", F.array_join("tags", ",").alias("tags"), F.unix_micros("posted_at").alias("posted_at"))


@query("a29_feed_profile", f"""WITH {_EL}, ok AS (SELECT element FROM el WHERE json_type(element) = 'OBJECT'),
kv AS (SELECT unnest(json_keys(element)) AS key, element FROM ok), v AS (SELECT key, json_type(element, '$.' || key) AS jt, json_extract_string(element, '$.' || key) AS value FROM kv)
SELECT key, CASE WHEN jt IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' WHEN jt = 'VARCHAR' THEN 'STRING' WHEN jt = 'NULL' THEN 'VOID' WHEN jt = 'DOUBLE' THEN 'DECIMAL' ELSE jt END AS type,
       count(*) AS present, count(*) FILTER (coalesce(value, '') IN ('', '0', '[]')) AS empty, CAST(min(length(value)) AS BIGINT) AS min_len, CAST(max(length(value)) AS BIGINT) AS max_len FROM v GROUP BY 1, 2""")
def _a29(t: Tables):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
    el = t.events.withColumn("k", k).select(F.expr(_ELEMENT).alias("element"))
    return feed.feed_profile(el)


@query("a30_tag_profile", """
WITH j AS (SELECT event_id, CASE WHEN event_type = 'view' THEN [] ELSE [event_type, props] END AS tags FROM events)
SELECT count(*) AS jobs, CAST(min(len(tags)) AS BIGINT) AS min_tags, CAST(max(len(tags)) AS BIGINT) AS max_tags, CAST(sum(len(tags)) AS BIGINT) AS total_tags, count(*) FILTER (len(tags) = 0) AS untagged,
       (SELECT count(DISTINCT x) FROM (SELECT unnest(tags) AS x FROM j)) AS distinct_tags FROM j""")
def _a30(t: Tables):
    tags = F.when(F.col("event_type") == "view", F.array().cast("array<string>")).otherwise(F.array("event_type", "props"))
    return feed.tag_profile(t.events.select("event_id", tags.alias("tags")))


@query("a30_top_tags", "WITH x AS (SELECT unnest([event_type, props]) AS tag FROM events) SELECT tag, count(*) AS n FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _a30t(t: Tables):
    return feed.top_tags(t.events.select(F.array("event_type", "props").alias("tags")))


@query("s2_s3_capture_first_wins", """
WITH c AS (SELECT event_type AS source, ts, event_id, strftime(ts, '%Y-%m-%d') AS d FROM events)
SELECT event_id, source || '-' || d || '.json' AS raw_name, CASE WHEN row_number() OVER (PARTITION BY source, d ORDER BY ts) = 1 AND NOT (source = 'click' AND d < '2024-01-10') THEN 'written' ELSE 'existing' END AS raw_state FROM c""")
def _s2(t: Tables):
    rows = t.events.select("event_id", F.col("event_type").alias("source"), F.lit("json").alias("ext"), F.col("ts").alias("started_at"), F.col("props").alias("body"))
    have = rows.filter("source = 'click'").select("source", captures.capture_day("started_at").alias("capture_date")).filter("capture_date < '2024-01-10'").distinct()
    out = captures.split_captures(rows, have)
    return out.select("event_id", captures.capture_name("source", "ext", "started_at").alias("raw_name"), "raw_state")


@query("f31_parse_instant", """
SELECT o_orderkey, epoch_us(CASE o_orderpriority WHEN '1-URGENT' THEN o_orderdate WHEN '2-HIGH' THEN o_orderdate WHEN '3-MEDIUM' THEN o_orderdate - INTERVAL 2 HOUR WHEN '5-LOW' THEN o_orderdate + INTERVAL 15 MINUTE END) AS at_us FROM orders""")
def _f31(t: Tables):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit(" "), day, F.lit(" "))).when(F.col("o_orderpriority") == "2-HIGH", F.concat(day, F.lit("T00:00:00.000")))
            .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(day, F.lit("T00:00:00+02:00"))).when(F.col("o_orderpriority") == "5-LOW", F.concat(day, F.lit("T00:15")))
            .otherwise(F.date_format("o_orderdate", "yyyy-M-d'T'HH")))
    return t.orders.select("o_orderkey", F.unix_micros(times.parse_instant(text)).alias("at_us"))


_POST = """('{"@type":"' || CASE WHEN k < 20 THEN 'Thing' ELSE 'jobPosting' END || '","jobLocationType":' || CASE event_type WHEN 'click' THEN '["","TELECOMMUTE"]' WHEN 'view' THEN '"TELECOMMUTE"' ELSE 'null' END
  || ',"employmentType":"' || CASE WHEN k < 50 THEN 'part time' ELSE 'odd' END || '","applicantLocationRequirements":' || CASE event_type WHEN 'click' THEN '[{"name":"USA"},{"name":"Canada"}]' WHEN 'view' THEN '{"name":"germany"}' ELSE '[]' END
  || ',"jobLocation":{"address":{"addressCountry":' || CASE WHEN k < 30 THEN '{"name":"CA"}' WHEN k < 60 THEN '"Nowhere"' ELSE '""' END || ',"addressRegion":"R' || CAST(k AS STRING) || '"}}}')"""


def posting_json(t: Tables):
    return t.events.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("bigint")).select("event_id", F.expr(_POST).alias("raw"))


_KE = "ke AS (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events)"


@query("f30_posting_parse", f"WITH {_KE} SELECT event_id, true AS is_posting, CASE WHEN event_type IN ('click', 'view') THEN true END AS remote, CASE WHEN k < 50 THEN 'part_time' END AS employment_type FROM ke")
def _f30(t: Tables):
    return posting_json(t).withColumn("p", jsonld.parse_posting("raw")).select("event_id", "p.is_posting", "p.remote", "p.employment_type")


@query("f32_location_classify", f"""WITH {_KE}
SELECT event_id, CASE WHEN event_type = 'click' THEN 'US' WHEN event_type = 'view' THEN CASE WHEN k < 30 THEN NULL ELSE 'DE' END WHEN k < 30 THEN 'CA' END AS country,
       CASE WHEN event_type = 'click' THEN true WHEN event_type = 'view' OR k < 30 THEN false END AS is_us,
       CASE event_type WHEN 'click' THEN 'USA, Canada, ' WHEN 'view' THEN 'germany, ' ELSE '' END || CASE WHEN k < 30 THEN 'CA, ' WHEN k < 60 THEN 'Nowhere, ' ELSE '' END || 'R' || k AS location_text FROM ke""")
def _f32(t: Tables):
    return posting_json(t).withColumn("l", jsonld.classify_location("raw")).select("event_id", "l.*")


@query("f29_posting_record_from_page", f"""WITH {_KE}
SELECT event_id, CASE WHEN k < 50 THEN 'T' || k ELSE 'link text' END AS title, 'Do  it now' AS d0, CASE WHEN k < 50 THEN 'A b' || k ELSE 'only text' END AS description FROM ke""".replace("'Do  it now' AS d0, ", ""))
def _f29(t: Tables):
    k = t.events.withColumn("k", F.regexp_extract("props", "[0-9]+", 0))
    page = F.when(F.col("k").cast("int") < 50, F.concat(
        F.lit("<script type=\"application/ld+json\">{bad</script><script type='application/ld+json'>[{\"@type\":\"Org\"},{\"@type\":\"JobPosting\",\"title\":\"T"), "k",
        F.lit("\",\"description\":\"<p>A</p>&nbsp;<b>b"), "k", F.lit("</b>\"}]</script>"))).otherwise(F.lit("<html><p>only <i>text</i></p></html>"))
    return k.withColumn("r", jsonld.posting_record(page, F.lit("link text"), max_bytes=200_000)).select("event_id", "r.title", "r.description")
