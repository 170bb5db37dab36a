"""Registered queries: ranking, change detection, percentiles, scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolegrid.catalog.registry import Tables, query
from rolegrid.operators import ranking, reads, scans

_ACCEPTED = """
accepted AS (
  SELECT *, row_number() OVER (PARTITION BY company_id, run_id ORDER BY attempt_index DESC, id DESC) AS rn
    FROM attempts
   WHERE validation_status = 'accepted' AND candidate_kind IN ('career_site', 'ats_board')
     AND final_url IS NOT NULL AND final_url <> '' AND run_id IS NOT NULL),
per_run AS (SELECT company_id, run_id, final_url, title, created_at FROM accepted WHERE rn = 1),
compared AS (
  SELECT *, lag(run_id) OVER w AS prev_run, lag(final_url) OVER w AS prev_url, lag(title) OVER w AS prev_title
    FROM per_run WINDOW w AS (PARTITION BY company_id ORDER BY run_id))
"""


@query("w1_accepted_answer_per_run", f"WITH {_ACCEPTED} SELECT company_id, run_id, final_url, title FROM per_run")
def _w1(t: Tables):
    return ranking.accepted_per_run(t.attempts).select("company_id", "run_id", "final_url", "title")


@query("w2_j8_churn_with_company", f"""WITH {_ACCEPTED}
SELECT c.company_id, c.slug, prev_run AS from_run_id, prev_url AS from_url, prev_title AS from_title,
       x.run_id AS to_run_id, x.final_url AS to_url, x.title AS to_title
  FROM compared x JOIN companies c USING (company_id) WHERE prev_url IS NOT NULL AND prev_url <> final_url""")
def _w2(t: Tables):
    return ranking.churn(t.attempts, t.companies).select(
        "company_id", "slug", "from_run_id", "from_url", "from_title", "to_run_id", "to_url", "to_title")


@query("j8_churn_filtered", f"""WITH {_ACCEPTED}
SELECT c.company_id, c.index_membership, x.run_id AS to_run_id, x.final_url AS to_url
  FROM compared x JOIN companies c USING (company_id)
 WHERE prev_url IS NOT NULL AND prev_url <> final_url AND index_membership = 'sp500'
   AND (contains(lower(name), 'customer#') OR contains(lower(slug), 'customer#'))""")
def _j8(t: Tables):
    moved = reads.churn_filter(ranking.churn(t.attempts, t.companies), "sp500", " CUSTOMER# ")
    return moved.select("company_id", "index_membership", "to_run_id", "to_url")


@query("o4_churn_page", f"""WITH {_ACCEPTED}
SELECT c.company_id, c.name, prev_url AS from_url, x.run_id AS to_run_id, x.final_url AS to_url
  FROM compared x JOIN companies c USING (company_id) WHERE prev_url IS NOT NULL AND prev_url <> final_url
 ORDER BY x.run_id DESC, lower(c.name), c.company_id LIMIT 25 OFFSET 10""")
def _o4(t: Tables):
    return ranking.churn_page(t.attempts, t.companies, 25, 10).select("company_id", "name", "from_url", "to_run_id", "to_url")


@query("w2_event_type_changes", """
WITH d AS (SELECT user_id, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS run, event_type, event_id,
                  row_number() OVER (PARTITION BY user_id, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) ORDER BY event_id DESC) AS rn
             FROM events WHERE event_type <> 'error'),
x AS (SELECT user_id, run, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY run) AS prev_event_type,
             lag(run) OVER (PARTITION BY user_id ORDER BY run) AS prev_run FROM d WHERE rn = 1)
SELECT user_id, prev_run, prev_event_type, run, event_type FROM x WHERE prev_event_type IS NOT NULL AND prev_event_type <> event_type""")
def _w2_events(t: Tables):
    run = F.floor(F.unix_micros("ts") / 86_400_000_000).cast("bigint")
    daily = t.events.filter("event_type <> 'error'").withColumn("run", run)
    last = ranking.first_per_group(daily, ["user_id", "run"], [F.desc("event_id")]).select("user_id", "run", "event_type")
    return ranking.changes(last, "user_id", "run", "event_type", [], scans.bucket("run", 7)).select(
        "user_id", "prev_run", "prev_event_type", "run", "event_type")


@query("w3_latest_run_per_company", """
SELECT company_id, id AS run_id, status FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY started_at DESC, id DESC) AS rn FROM runs) WHERE rn = 1""")
def _w3(t: Tables):
    return ranking.latest_run(t.runs).select("company_id", F.col("id").alias("run_id"), "status")


@query("w4_first_verdict_url", """
SELECT c.company_id, c.verdict, CASE WHEN verdict IS NOT NULL AND verdict_run_id IS NOT NULL THEN
   (SELECT arg_min(a.candidate_url, (a.attempt_index, a.id)) FROM attempts a
     WHERE a.company_id = c.company_id AND a.run_id = c.verdict_run_id AND a.source = 'browser_use') END AS verdict_url
  FROM companies c""")
def _w4(t: Tables):
    return ranking.first_verdict_url(t.companies, t.attempts).select("company_id", "verdict", "verdict_url")


@query("w8_attempt_trail", """
SELECT company_id, id, CAST(row_number() OVER (PARTITION BY company_id ORDER BY run_id DESC NULLS LAST, attempt_index, id) AS BIGINT) AS place
  FROM attempts""")
def _w8(t: Tables):
    # newest run first: number the runs backwards so that the scan order is ascending
    a = t.attempts.withColumn("__run", -F.col("run_id"))
    placed = scans.number_rows(a, ["company_id"], ["__run", "attempt_index", "id"], scans.bucket("__run", 7), "place")
    return placed.select("company_id", "id", "place")


@query("w11_first_wins_dedupe", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def _w11(t: Tables):
    first = ranking.first_per_group(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    return first.select("l_orderkey", F.col("l_linenumber").cast("int"), "l_partkey", "l_suppkey")


@query("w12_last_wins_in_batch", """
SELECT l_orderkey, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1""")
def _w12(t: Tables):
    batch = t.lineitem.withColumn("ord", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"))
    return ranking.last_wins(batch, ["l_orderkey"], "ord").select("l_orderkey", "l_partkey", "l_suppkey")


@query("w12_insert_update_counts", """
WITH b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
j AS (SELECT b.*, o.o_orderkey FROM b LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON o.o_orderkey = b.k)
SELECT CAST(count(*) FILTER (o_orderkey IS NULL) AS BIGINT) AS inserted,
       CAST(sum(n) - count(*) FILTER (o_orderkey IS NULL) AS BIGINT) AS updated FROM j""")
def _w12_counts(t: Tables):
    known = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return ranking.last_wins_counts(t.lineitem, ["l_orderkey"], known)


@query("w17_status_behind_answer", """
WITH a AS (SELECT *, 'https://site.example.com/c/50' AS answer FROM attempts WHERE validation_status = 'accepted')
SELECT company_id, CAST(coalesce(arg_min(http_status, (candidate_url <> answer, attempt_index, id)), 0) AS BIGINT) AS answer_status
  FROM a GROUP BY company_id""")
def _w17(t: Tables):
    return ranking.accepted_status(t.attempts.withColumn("answer", F.lit("https://site.example.com/c/50")), ["company_id"], "answer")


_PCT = """
CAST(max(n) AS BIGINT) AS n, min(x) AS min, min(x) FILTER (pos = least(n - 1, floor(n * 0.25::DOUBLE))) AS p25,
median(x) AS median, min(x) FILTER (pos = least(n - 1, floor(n * 0.75::DOUBLE))) AS p75,
min(x) FILTER (pos = least(n - 1, floor(n * 0.90::DOUBLE))) AS p90, max(x) AS max"""


@query("a6_x5_nearest_index_percentiles", f"""
WITH o AS (SELECT event_type, CAST(value AS DOUBLE) AS x, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos,
                  count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, {_PCT} FROM o GROUP BY event_type""")
def _a6(t: Tables):
    return ranking.percentiles(t.events, "value", ["event_type"], digits=None)


@query("a6_run_duration_percentiles", f"""
WITH d AS (SELECT (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 AS x FROM runs WHERE finished_at IS NOT NULL),
o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS pos, count(*) OVER () AS n FROM d)
SELECT {_PCT} FROM o""")
def _a6_runs(t: Tables):
    from rolegrid.functions.times import duration_seconds

    runs = t.runs.withColumn("duration_s", duration_seconds("started_at", "finished_at"))
    return ranking.percentiles(runs, "duration_s", digits=None)


@query("o7_top_items_per_group", """
SELECT l_suppkey, l_orderkey, l_linenumber, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 25""")
def _o7(t: Tables):
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"]
    return ranking.top_k(t.lineitem, ["l_suppkey"], order, 25, "rank").select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("o7_top_tallies", """
SELECT o_orderpriority || '/' || o_orderstatus AS label, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _o7_tally(t: Tables):
    return ranking.tally(t.orders, F.concat_ws("/", "o_orderpriority", "o_orderstatus"), "label", 10)
