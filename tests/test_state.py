"""Keyed state: idempotence, guards, tri-states; consolidation; selection semantics."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rolegrid.operators import consolidate, merge, ranking, reads, runs, scans

T0, T1, T2 = datetime(2026, 1, 1), datetime(2026, 1, 2), datetime(2026, 1, 3)
STATE = ("job_id bigint, company_id bigint, discovery_platform_id bigint, external_id string, title string, status string, raw_data string, "
         "first_seen_at timestamp, last_seen_at timestamp, created_at timestamp, updated_at timestamp")
BATCH = "company_id bigint, discovery_platform_id bigint, external_id string, title string, raw_data string, ordinal bigint"


def state(spark, rows):
    return spark.createDataFrame([(i, c, p, x, t, s, "old", T0, T0, T0, T0) for i, c, p, x, t, s in rows], STATE)


def now():
    return F.lit("2026-01-02 00:00:00").cast("timestamp")


def test_upsert_reopens_keeps_and_is_idempotent(spark):
    old = state(spark, [(5, 1, 1, "a", "A", "closed"), (6, 1, 1, "b", "B", "open"), (7, 1, 1, None, "N", "open")])
    batch = spark.createDataFrame([(1, 1, "a", "A1", "new", 1), (1, 1, "a", "A2", "new2", 2), (2, 1, "c", "C", "rc", 3)], BATCH)
    out = merge.upsert_jobs(old, batch, now())
    rows = {r["external_id"]: r for r in out.collect()}
    a = rows["a"]
    assert (a["job_id"], a["title"], a["status"], a["raw_data"], a["first_seen_at"], a["last_seen_at"], a["merge_action"]) == (5, "A2", "open", "old", T0, T1, "updated")
    c = rows["c"]
    assert (c["job_id"], c["status"], c["raw_data"], c["first_seen_at"], c["merge_action"]) == (8, "open", "rc", T1, "inserted")
    assert rows["b"]["merge_action"] == "kept" and rows[None]["job_id"] == 7
    counts = ranking.last_wins_counts(batch, merge.JOB_KEY, old).collect()[0]
    assert (counts["inserted"], counts["updated"]) == (1, 2)
    again = merge.upsert_jobs(out.drop("merge_action"), batch, now())
    assert again.filter("merge_action = 'inserted'").count() == 0
    assert sorted(again.drop("merge_action").collect(), key=repr) == sorted(out.drop("merge_action").collect(), key=repr)


def test_upsert_sets_null_keys_aside_and_joins_once(spark):
    old = state(spark, [(5, 1, 1, "a", "A", "open")] + [(k, 1, 1, None, "N", "open") for k in range(10, 20)])
    batch = spark.createDataFrame([(1, 1, "a", "A2", "r", 1), (1, 1, None, "X", "r", 2), (1, 1, None, "Y", "r", 3), (1, 1, "b", "B", "r", 4)], BATCH)
    out = merge.upsert_jobs(old, batch, now(), ordinal=None)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join FullOuter") == 1
    rows = out.collect()
    assert sorted(r["job_id"] for r in rows) == [5, *range(10, 20), 20, 21, 22]
    fresh = [r for r in rows if r["merge_action"] == "inserted"]
    assert sorted((r["external_id"] or "", r["title"], r["status"]) for r in fresh) == [("", "X", "open"), ("", "Y", "open"), ("b", "B", "open")]
    assert {r["first_seen_at"] for r in fresh} == {T1} and sum(r["merge_action"] == "kept" for r in rows) == 10


def closed(df):
    return sorted(r["job_id"] for r in df.filter("newly_closed").collect())


def test_staleness_guards(spark):
    old = state(spark, [(1, 1, 1, "a", "", "open"), (2, 1, 1, "b", "", "open"), (3, 2, 1, "c", "", "open"), (4, 1, 1, None, "", "open"), (5, 1, 1, "d", "", "filled"), (6, 1, 2, "e", "", "open")])
    seen = spark.createDataFrame([(1, 1, "a")], "discovery_platform_id bigint, company_id bigint, external_id string")
    by_platform = merge.mark_stale(old, seen, ["discovery_platform_id"], now())
    assert closed(by_platform) == [2, 3]
    assert closed(merge.mark_stale(old, seen, ["discovery_platform_id", "company_id"], now())) == [2]
    assert closed(merge.mark_stale(old, seen.limit(0), ["discovery_platform_id"], now())) == []
    assert closed(merge.mark_stale(by_platform.drop("newly_closed"), seen, ["discovery_platform_id"], now())) == []
    assert {r["updated_at"] for r in by_platform.filter("newly_closed").collect()} == {T1}


def test_closure_notes(spark):
    rows = [(1, "u", True)] * 3 + [(2, "", True)] + [(3, "u", False)] + [(4, "u", True)]
    got = {r["k"]: r["stale_note"] for r in merge.closure_notes(spark.createDataFrame(rows, "k int, url string, ok boolean"), ["k"], 3, accepted="ok").collect()}
    assert got == {1: "truncated_at_max_jobs=3", 2: "none_observed", 3: "none_accepted", 4: ""}


COMPANY = "company_id bigint, slug string, name string, industry string, created_at timestamp, updated_at timestamp"


def test_index_upsert_is_a_no_op_when_nothing_differs(spark):
    old = spark.createDataFrame([(1, "a", "A", None, T0, T0), (2, "b", "B", "x", T0, T0)], COMPANY)
    batch = spark.createDataFrame([("a", "A", None), ("b", "B", None), ("c", "C", "y")], "slug string, name string, industry string")
    out = merge.index_upsert(old, batch, now(), ["name", "industry"])
    got = {r["slug"]: r for r in out.collect()}
    assert {s: r["merge_action"] for s, r in got.items()} == {"a": "same", "b": "changed", "c": "created"}
    assert got["a"]["updated_at"] == T0 and got["b"]["updated_at"] == T1 and got["b"]["created_at"] == T0
    again = merge.index_upsert(out.drop("merge_action"), batch, now(), ["name", "industry"])
    assert {r["merge_action"] for r in again.collect()} == {"same"}


def test_index_batch_first_share_class_and_errors(spark):
    schema = "ordinal int, name string, industry string, sub_industry string, headquarters string, cik bigint, raw_cik string, article string"
    rows = [(1, "Alphabet", "it", "", "x", 7, "07", "Alphabet"), (2, "ALPHABET!", "no", "", "", 8, "8", ""), (3, " ", "", "", "", 0, "", ""), (4, "---", "", "", "", 0, "", ""), (5, "Tick", "", "", "", 0, " abc ", "")]
    good, bad = merge.index_batch(spark.createDataFrame(rows, schema), "sp500")
    got = {r["slug"]: r for r in good.collect()}
    assert set(got) == {"alphabet", "tick"} and got["alphabet"]["industry"] == "it" and got["alphabet"]["cik"] == "7"
    assert got["tick"]["cik"] == "abc" and got["tick"]["gics_sub_industry"] is None
    assert sorted(r["ordinal"] for r in bad.collect()) == [3, 4]


def test_resolve_companies(spark):
    have = spark.createDataFrame([("acme",)], "slug string")
    names = spark.createDataFrame([("ACME", 1), ("New Co", 2), ("NEW-CO", 1), ("!!", 3)], "name string, ordinal int")
    fresh, bad = merge.resolve_companies(have, names)
    assert [(r["slug"], r["name"]) for r in fresh.collect()] == [("new-co", "NEW-CO")]
    assert [r["name"] for r in bad.collect()] == ["!!"]


def test_listings_cache_tri_state(spark):
    c = spark.createDataFrame([(1, "u1", "t", None, T0), (2, "u2", "t", True, T0), (3, None, None, None, T0)],
                              "company_id bigint, listings_url string, listings_url_resolved_at string, listings_url_remote_confirmed boolean, updated_at timestamp")
    answers = spark.createDataFrame([(1, "n1", False), (2, None, None)], "company_id bigint, new_url string, new_confirmed boolean")
    got = {r["company_id"]: r for r in merge.set_listings(c, answers, F.lit("now")).collect()}
    assert (got[1]["listings_url"], got[1]["listings_url_remote_confirmed"]) == ("n1", False)
    assert (got[2]["listings_url"], got[2]["listings_url_resolved_at"], got[2]["listings_url_remote_confirmed"]) == (None, None, None)
    assert got[3]["listings_url_remote_confirmed"] is None
    confirmed = {r["company_id"]: r["listings_url_remote_confirmed"] for r in merge.confirm_cached(c).collect()}
    assert confirmed == {1: True, 2: True, 3: None}


def test_cache_ttl(spark):
    rows = [(1, "u", "2026-01-01T00:00:00.000Z"), (2, "u", "bad"), (3, "", "2026-01-01T00:00:00Z"), (4, "u", "2025-12-01T00:00:00Z"), (5, "u", None), (6, "u", "2026-01-01")]
    c = spark.createDataFrame(rows, "company_id bigint, listings_url string, listings_url_resolved_at string")
    usable = lambda **k: sorted(r["company_id"] for r in reads.cached_listings(c, now(), **k).filter("cache_usable").collect())
    assert usable(ttl_seconds=86400) == [1] and usable(ttl_seconds=0) == [] and usable(ttl_seconds=86400, refresh=True) == []


def test_resolution_write_and_checks(spark):
    c = spark.createDataFrame([(1, None, "w"), (2, "old", None), (3, "old", None)], "company_id bigint, career_site_url string, website string")
    schema = "company_id bigint, new_url string, new_url_source string, new_website string, new_website_source string, new_verdict string, new_verdict_url string, dry_run boolean"
    r = spark.createDataFrame([(1, "n", "sitemap", None, None, None, None, False), (2, " ", None, "site", "sec_10k", None, None, False), (3, "n", "sitemap", None, None, None, None, True)], schema)
    got = {x["company_id"]: x for x in merge.write_resolutions(c, r, now()).collect()}
    assert [got[i]["resolution_action"] for i in (1, 2, 3)] == ["inserted", "none", "none"]
    assert (got[1]["career_site_url"], got[1]["website"], got[2]["career_site_url"], got[2]["website"], got[3]["career_site_url"]) == ("n", "w", "old", "site", "old")
    bad = spark.createDataFrame([
        (0, None, None, None, None, None, None, False), (1, "u", "guess", None, None, None, None, False), (2, None, "sitemap", None, None, None, None, False), (3, None, None, "w", None, None, None, False),
        (4, None, None, None, "sec_10k", None, None, False), (5, None, None, None, None, "maybe", "u", False), (6, None, None, None, None, "wrong", " ", False), (7, None, None, None, None, None, "u", False), (8, "u", "ats_api", "w", "wikidata_p856", "wrong", "u", False)], schema)
    problems = [x["problem"] for x in merge.check_resolutions(bad).orderBy("company_id").collect()]
    assert all(problems[:8]) and problems[8] is None and len(set(problems[:8])) == 8


def test_attempt_rows_continue_slots(spark):
    cand = spark.createDataFrame([(9, 1, i, "s", "u", "website", 0, "", " ", "accepted" if i else "rejected", "empty_body", "") for i in range(2)],
                                 "run_id bigint, company_id bigint, position int, source string, candidate_url string, candidate_kind string, http_status int, final_url string, title string, validation_status string, rejection_reason string, evidence string")
    have = spark.createDataFrame([(9, 1, 0), (9, 1, 3)], "run_id bigint, company_id bigint, attempt_index bigint")
    got = merge.attempt_rows(cand, have).orderBy("attempt_index").collect()
    assert [(r["attempt_index"], r["http_status"], r["title"], r["rejection_reason"]) for r in got] == [(4, None, None, "empty_body"), (5, None, None, None)]


def test_ledger(spark):
    schema = "run_id bigint, kind string, at timestamp, seq int, platform_id bigint, company_id bigint, status string, items_found bigint, items_inserted bigint, items_updated bigint, items_wrong bigint, items_unverifiable bigint, error_text string, dry_run boolean"
    z = (0, 0, 0, 0)
    rows = [(1, "start", T0, 1, 3, 4, None, 0, *z, None, True), (1, "finish", T1, 2, None, None, "error", 9, *z, "bad", None), (2, "start", T0, 3, 3, None, None, 0, *z, None, False)]
    got = {r["run_id"]: r for r in merge.fold_runs(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1]["status"], got[1]["items_found"], got[1]["dry_run"], got[1]["company_id"], got[1]["finished_at"]) == ("error", 9, True, 4, T1)
    assert (got[2]["status"], got[2]["finished_at"]) == ("running", None)
    r = spark.createDataFrame([(1, "running", None, None), (2, "ok", T0, None)], "id bigint, status string, finished_at timestamp, error_text string")
    assert [x["status"] for x in merge.cancel_runs(r, [1, 2], now()).orderBy("id").collect()] == ["error", "ok"]
    twice = merge.reconcile_runs(merge.reconcile_runs(r, now()).drop("stopped"), now())
    assert twice.filter("stopped").count() == 0


def test_backfill_is_idempotent(spark):
    raw = '{"@type":"JobPosting","employmentType":"CONTRACTOR","datePosted":"2026-01-01"}'
    jobs = spark.createDataFrame([(1, raw, None, None, T0), (2, raw, "contract", T0, T0), (3, "{}", "intern", None, T0), (4, None, None, None, T0)], "job_id bigint, raw_data string, employment_type string, posted_at timestamp, updated_at timestamp")
    once = merge.posting_backfill(jobs, now())
    got = {r["job_id"]: r for r in once.collect()}
    assert [got[i]["backfilled"] for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert (got[1]["employment_type"], got[1]["posted_at"], got[1]["updated_at"], got[2]["updated_at"]) == ("contract", T0, T1, T0)
    assert merge.posting_backfill(once.drop("backfilled"), now()).filter("backfilled").count() == 0
    counts = merge.backfill_counts(jobs, now()).collect()[0]
    assert (counts["scanned"], counts["parsed"], counts["to_write"]) == (3, 2, 1)


def test_consolidation_is_idempotent(spark):
    schema = "company_id bigint, slug string, name string, career_site_url string, website string, verdict_run_id bigint"
    mine = spark.createDataFrame([(1, "a", "A", "mine", "w", None), (2, "b", "B", "mine", None, 5)], schema)
    other = spark.createDataFrame([(1, "b", "B2", None, "ow", 7), (9, "z", "Z", "oz", None, None)], schema)
    once = consolidate.consolidate_companies(mine, other)
    got = {r["slug"]: r for r in once.collect()}
    assert (got["b"]["career_site_url"], got["b"]["website"], got["b"]["verdict_run_id"], got["b"]["name"]) == (None, "ow", 1007, "B")
    assert got["z"]["company_id"] == 3 and got["a"]["career_site_url"] == "mine"
    twice = consolidate.consolidate_companies(once, other)
    assert sorted(twice.select(*schema_names(schema)).collect()) == sorted(once.select(*schema_names(schema)).collect()) or rows_equal(once, twice)
    a = "company_id bigint, run_id bigint, attempt_index bigint, source string"
    have, theirs = spark.createDataFrame([(2, 1001, 0, "x")], a), spark.createDataFrame([(1, 1, 0, "dup"), (1, 1, 1, "new")], a)
    mapping = consolidate.id_map(once, other, ["slug"], "company_id")
    merged = consolidate.consolidate_attempts(have, theirs, mapping)
    assert sorted((r["company_id"], r["run_id"], r["attempt_index"], r["source"]) for r in merged.collect()) == [(2, 1001, 0, "x"), (2, 1001, 1, "new")]
    assert consolidate.consolidate_attempts(merged, theirs, mapping).count() == 2


def schema_names(schema):
    return [x.split()[0] for x in schema.split(", ")]


def rows_equal(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


def test_page_bounds():
    assert reads.page_bounds() == (25, 0) and reads.page_bounds("100", "7") == (100, 7)
    for bad in [(0, 0), (101, 0), ("x", 0), (1, -1)]:
        with pytest.raises(ValueError):
            reads.page_bounds(*bad)


def test_status_and_filters_are_checked(spark):
    jobs = spark.createDataFrame([(1, "open"), (2, "closed")], "job_id int, status string")
    assert reads.job_status_filter(jobs).count() == 1 and reads.job_status_filter(jobs, "ALL").count() == 2
    with pytest.raises(ValueError):
        reads.job_status_filter(jobs, "gone")
    with pytest.raises(ValueError):
        reads.company_filter(jobs, jobs, membership="dax")
    with pytest.raises(ValueError):
        runs.query_runs(jobs.withColumns({"started_at": F.lit(None).cast("timestamp"), "finished_at": F.lit(None).cast("timestamp")}), colour="red")


def test_wire_rows_refuse_bad_flags(spark):
    row = spark.createDataFrame([(1, "t", None, "open", None, None, None, 2, None, None, None, None, None, "2026-01-01T00:00:00Z", "2026-01-01T00:00:00Z")],
                                "job_id int, title string, company_name string, status string, employment_type string, location_text string, country string, is_remote int, salary_min_cents bigint, salary_max_cents bigint, salary_currency string, salary_period string, posted_at string, first_seen_at string, last_seen_at string")
    with pytest.raises(Exception, match="want 0 or 1"):
        reads.job_wire(row).collect()
    ok = reads.job_wire(row.withColumn("is_remote", F.lit(1))).collect()[0]
    assert ok["company_name"] == "Unknown company" and ok["is_remote"] is True and ok["posted_at"] is None
    with pytest.raises(Exception, match="RFC3339"):
        reads.job_wire(row.withColumns({"is_remote": F.lit(1), "first_seen_at": F.lit("yesterday")})).collect()


def test_scans_match_plain_windows_on_a_hot_key(spark):
    """A third of all rows under one key: the bucketed scans give what a plain window gives."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"), "id", (F.hash("id") % 7).cast("bigint").alias("v"))
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("id")
    got = scans.running_sum(df, ["k"], ["id"], scans.bucket("id", 100), {"s": F.col("v")})
    got = scans.previous(got, ["k"], ["id"], scans.bucket("id", 100), ["v"])
    want = df.select("k", "id", "v", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.lag("v").over(w).alias("prev_v"))
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == 6000


def test_percentiles_are_nearest_index(spark):
    import statistics

    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0]
    s = sorted(values)
    r = ranking.percentiles(spark.createDataFrame([(v,) for v in values], "x double"), "x").collect()[0]
    assert (r["n"], r["min"], r["p25"], r["median"], r["p75"], r["p90"], r["max"]) == (10, 1.0, s[2], statistics.median(values), s[7], s[9], 9.0)


def test_churn_fixture(spark):
    companies = spark.createDataFrame([(1, "a", "A", "sp500"), (2, "b", "B", None)], "company_id bigint, slug string, name string, index_membership string")
    cols = "id bigint, company_id bigint, run_id bigint, attempt_index int, candidate_kind string, final_url string, title string, validation_status string, created_at timestamp"
    rows = [
        (1, 1, 4, 0, "website", "https://a", None, "accepted", T0), (2, 1, 4, 1, "career_site", "/jobs", "j", "accepted", T0), (3, 1, 5, 0, "career_site", "/old", None, "rejected", T1),
        (4, 1, 5, 1, "career_site", "/careers", "c", "accepted", T1), (5, 2, 4, 0, "ats_board", "/same", None, "accepted", T0), (6, 2, 5, 0, "ats_board", "/same", None, "accepted", T1), (7, 2, 6, 0, "career_site", "", None, "accepted", T2)]
    got = ranking.churn(spark.createDataFrame(rows, cols), companies).collect()
    assert [(r["company_id"], r["from_run_id"], r["from_url"], r["to_run_id"], r["to_url"]) for r in got] == [(1, 4, "/jobs", 5, "/careers")]


def test_sweep_plan_semantics(spark):
    t = spark.createDataFrame([(0, "a", "ok", True), (1, "b", None, False), (2, "c", "ok", False), (3, "d", "error", True), (4, "e", "ok", True)], "pos bigint, slug string, last_run_status string, has_trace boolean")
    plan = lambda skip, **k: {r["slug"]: r["decision"] for r in runs.plan_sweep(t, skip, **k).collect()}
    assert plan(runs.skip_rule(True, False), limit=2) == {"a": "skipped", "b": "planned", "c": "skipped", "d": "planned"}
    assert plan(runs.skip_rule(False, True)) == {"a": "skipped", "b": "planned", "c": "planned", "d": "planned", "e": "skipped"}
    assert plan(runs.skip_rule(False, False), from_slug=" C ", limit=1) == {"c": "planned"}
    assert plan(F.when(F.col("slug") == "b", "mine"), slugs=["b", " c "]) == {"b": "skipped", "c": "planned"}
    o = spark.createDataFrame([(1, 0, False, False), (1, 1, True, False), (1, 2, False, False), (1, 3, False, False), (1, 4, True, False), (2, 0, False, True), (3, 0, True, False)], "s int, p bigint, ok boolean, host_down boolean")
    assert {r["s"]: r["stop_at"] for r in runs.stop_point(o, "s", "p", 2).collect()} == {1: 3, 2: 0, 3: None}
