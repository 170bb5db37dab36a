"""Sources, runs, traces and logs against small fixtures."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rolegrid.operators import logs, runs
from rolegrid.sources import captures, feed, postings, registry, traces

T0 = datetime(2026, 1, 1)


# --- feed ---------------------------------------------------------------------------------------

FEED = [
    {"last_updated": 1, "legal": "notice"}, {"position": "no id", "company": "c"}, {"id": "1", "position": "Dev", "company": "Acme", "salary_min": 0, "salary_max": 120000, "location": "", "epoch": 60, "tags": ["a", "b"]},
    {"id": 2, "position": "Ops", "company": "Acme", "salary_min": None}, {"id": "3", "position": 7}, {"id": "4", "company": "X", "salary_min": "60k"}, {"id": "5", "company": "X", "salary_max": 1.5}, {"id": "", "company": "X"}, 17, {"id": "6", "company": "X", "tags": [1]}, {"id": True, "company": "x"}]


def test_feed_normalise(spark):
    body = json.dumps(FEED)[:-1] + ', {"id": 1e3, "company": "Num"}]'
    elements, rejects = feed.scan_feed(spark.createDataFrame([("r", body), ("n", "null"), ("b", '{"a":1}'), ("x", "[oops")], "source string, body string"))
    out = {r["idx"]: r for r in feed.normalise_feed(elements).collect()}
    assert [out[i]["reason"] for i in range(12)] == ["notice", "missing_id", None, None, "unmarshal_failed", "salary_min_not_integer", "salary_max_not_integer", "missing_id", "unmarshal_failed", "unmarshal_failed", "missing_id", None]
    j = out[2]
    assert (j["external_id"], j["salary_min_cents"], j["salary_max_cents"], j["location_text"], j["posted_at"], j["tags"]) == ("1", None, 12000000, None, T0.replace(year=1970) + timedelta(minutes=1), ["a", "b"])
    assert out[3]["external_id"] == "2" and out[3]["tags"] == [] and out[3]["posted_at"] == datetime(1970, 1, 1) and out[11]["external_id"] == "1e3"
    assert sorted(r["external_id"] for r in feed.feed_seen(feed.normalise_feed(elements)).collect()) == ["1", "1e3", "2", "3", "4", "5", "6"]
    assert sorted(r["source"] for r in rejects.collect()) == ["b", "x"]
    assert {r["element"] for r in elements.filter("idx = 11").collect()} == {'{"id": 1e3, "company": "Num"}'}
    assert feed.feed_skips(feed.normalise_feed(elements)).count() == 8


def test_tag_profiles(spark):
    jobs = spark.createDataFrame([(["a", "b"],), ([],), (["a"],)], "tags array<string>")
    p = feed.tag_profile(jobs).collect()[0]
    assert (p["jobs"], p["min_tags"], p["max_tags"], p["total_tags"], p["untagged"], p["distinct_tags"]) == (3, 0, 2, 3, 1, 2)
    assert {(r["tags"], r["jobs"]) for r in feed.tag_histogram(jobs).collect()} == {(2, 1), (0, 1), (1, 1)}
    assert [(r["tag"], r["n"]) for r in feed.top_tags(jobs, 1).collect()] == [("a", 2)]


# --- captures, evidence, registry ---------------------------------------------------------------


def test_capture_first_wins(spark, tmp_path):
    rows = [("feed", "json", T0 + timedelta(hours=5), "late"), ("feed", "json", T0, "first"), ("feed", "json", T0 + timedelta(days=1), "next"), ("wiki", "wiki", T0, "w")]
    df = spark.createDataFrame(rows, "source string, ext string, started_at timestamp, body string")
    path = str(tmp_path / "raw")
    got = {r["body"]: (r["raw_state"], r["raw_name"]) for r in captures.write_captures(df, path).collect()}
    assert got == {"late": ("existing", "feed-2026-01-01.json"), "first": ("written", "feed-2026-01-01.json"), "next": ("written", "feed-2026-01-02.json"), "w": ("written", "wiki-2026-01-01.wiki")}
    stored = spark.read.parquet(path)
    assert {r["body"] for r in stored.collect()} == {"first", "next", "w"}
    assert {r["raw_state"] for r in captures.split_captures(df, stored).collect()} == {"existing"}
    with pytest.raises(ValueError):
        captures.write_captures(df.withColumn("source", F.lit("")), path)


def test_evidence_paths(spark, tmp_path):
    rows = [("Acme Inc", 7, 0, "https://Jobs.Acme.com:8/x", "application/json", "b"), ("", 7, 1, "junk", "text/html", "b"), ("a", 7, 2, "https://x.com", "", ""), ("d", 1, 1, "https://d.com", "", "1"), ("d", 1, 1, "https://d.com", "", "2")]
    good, taken = captures.evidence_rows(spark.createDataFrame(rows, "slug string, run_id bigint, attempt_index bigint, candidate_url string, content_type string, body string"))
    assert sorted(r["evidence_path"] for r in good.collect()) == ["raw/careers/acme-inc/7/0-jobs.acme.com.json", "raw/careers/unknown/7/1-unknown.html"]
    assert taken.count() == 2
    captures.write_evidence(good, str(tmp_path / "e"))
    again, occupied = captures.evidence_rows(spark.createDataFrame(rows[:1], "slug string, run_id bigint, attempt_index bigint, candidate_url string, content_type string, body string"), spark.read.parquet(str(tmp_path / "e")))
    assert again.count() == 0 and occupied.count() == 1


def test_registry(spark, tmp_path):
    have = spark.createDataFrame([(10, "greenhouse", "application_system", "mine"), (99, "lever", "job_board", None)], registry.PLATFORM_SCHEMA)
    out = registry.seed_platforms(have)
    assert out.count() == 25 and out.filter("name = 'lever'").count() == 1 and out.filter("base_url_pattern = 'mine'").count() == 1
    assert registry.seed_platforms(out).count() == 25
    (tmp_path / "eightfold.json").write_text(json.dumps({"vendor": "eightfold", "routing": "html_only", "external_id_pattern": r"careers/job/(\d+)"}, indent=1))
    (tmp_path / "lever.json").write_text(json.dumps({"vendor": "lever", "routing": "json_api"}))
    p = registry.read_playbooks(spark, str(tmp_path))
    v = spark.createDataFrame([("eightfold",), ("lever",), ("new",)], "vendor string")
    assert {r["vendor"]: r["pattern"] for r in registry.with_pattern(v, p).collect()} == {"eightfold": r"careers/job/(\d+)", "lever": "", "new": ""}


def test_postings_file(spark, tmp_path):
    raw = json.dumps({"@type": "JobPosting", "employmentType": "INTERN", "datePosted": "2026-01-01"})
    jobs = [{"url": "https://x/careers/job/7", "title": "T", "is_us": True, "raw_data": raw}, {"url": "https://x/2", "is_us": None}, {"url": "", "is_us": True}, {"url": "https://x/3", "error": "boom", "is_us": True}, {"url": "https://x/4", "is_us": False}]
    (tmp_path / "f.json").write_text(json.dumps({"listings_url": "https://x", "total_links": 9, "jobs": jobs}, indent=1))
    rows = postings.read_postings(spark, str(tmp_path))
    assert rows.count() == 5
    got = postings.posting_batch(rows.withColumn("pattern", F.lit(r"job/(\d+)"))).collect()
    assert [(r["external_id"], r["employment_type"], r["posted_at"], r["description"]) for r in got] == [("7", "intern", T0, None)]


# --- traces and run logs ------------------------------------------------------------------------


@pytest.fixture
def trace_dir(tmp_path):
    lines = [
        {"event": "step", "step": 1, "url": "https://a", "actions": [{"click": {"index": 1}}], "ts": "2026-01-01T00:00:00.000Z", "next_goal": "open jobs"},
        {"event": "step", "step": 2, "url": "https://b", "actions": [{"input": {}}, {"click": {}}], "ts": "2026-01-01T00:00:20.000Z", "memory": "saw a CAPTCHA here"},
        {"event": "step", "step": 3, "url": "https://b", "actions": [], "ts": "2026-01-01T00:01:20.000Z"}, {"event": "done", "success": True, "steps": 3, "final_result": "two roles"}]
    (tmp_path / "1.jsonl").write_text("\n".join([json.dumps(x) for x in lines[:2]] + ["", "{broken"] + [json.dumps(x) for x in lines[2:]]) + "\n")
    (tmp_path / "2.jsonl").write_text("")
    return str(tmp_path)


def test_line_numbers_at_any_split_size(spark, tmp_path):
    texts = {k: [f"line {i} " + "x" * (i * k % 97) if i % 11 else "" for i in range(200 * k)] for k in (1, 2, 3)}
    for k, lines in texts.items():
        (tmp_path / f"{k}.log").write_text("\n".join(lines) + "\n")
    sizes = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for small in (True, False):
            for k, v in sizes.items():
                spark.conf.set(k, v if small else before[k])
            frame = traces.read_log_lines(spark, str(tmp_path))
            got = {}
            for r in frame.collect():
                got.setdefault(r["run_id"], []).append((r["line_no"], r["line"]))
            assert {k: sorted(v) for k, v in got.items()} == {k: list(enumerate(v, 1)) for k, v in texts.items()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_stamp_that_is_no_instant_is_not_bridged(spark, tmp_path):
    stamps = ["2026-01-01T00:00:00Z", "not a time", "2026-01-01T00:00:30Z", "", "2026-01-01T00:00:31Z"]
    (tmp_path / "4.jsonl").write_text("".join(json.dumps({"event": "step", "step": k, "ts": t}) + "\n" for k, t in enumerate(stamps, 1)))
    got = runs.step_latency(traces.read_traces(spark, str(tmp_path))).collect()
    assert [(r["step"], r["latency_s"]) for r in got] == [(5, 1.0)]


def test_traces(spark, trace_dir):
    events, files = traces.read_traces(spark, trace_dir), traces.list_files(spark, trace_dir)
    r = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    assert {x["id"]: (x["trace_state"], x["trace_events"]) for x in runs.trace_state(r, files, events).collect()} == {1: ("present", 4), 2: ("empty", 0), 3: ("missing", 0)}
    gaps = runs.step_latency(events)
    assert sorted(x["latency_s"] for x in gaps.collect()) == [20.0, 60.0]
    assert [(x["step"], x["latency_s"]) for x in runs.slowest_steps(gaps, 1).collect()] == [(3, 60.0)]
    per_run = runs.steps_per_run(events, files)
    assert {x["run_id"]: x["steps"] for x in per_run.collect()} == {1: 3, 2: 0}
    hist = {x["bucket"]: x["runs"] for x in runs.step_histogram(per_run).collect()}
    assert hist == {"0": 1, "1-3": 1, "4-8": 0, "9-15": 0, "16-25": 0, "26+": 0}
    acts = events.select("event", F.explode("actions").alias("a")).withColumn("action", runs.action_name("a"))
    assert {x["action"]: x["n"] for x in runs.action_counts(acts).collect()} == {"click": 2, "input": 1}
    d = runs.trace_digest(events).collect()[0]
    assert (d["steps"], d["events"], d["distinct_urls"], d["first_url"], d["last_url"], d["done_success"], d["final_result"]) == (3, 4, 2, "https://a", "https://b", True, "two roles")
    assert [(x["place"], x["goal"]) for x in runs.digest_steps(events, 1).collect()] == [(1, "open jobs")]
    hit = runs.search_steps(events, "captcha").collect()
    assert [(x["step"], x["field"], x["snippet"]) for x in hit] == [(2, "memory", "saw a CAPTCHA here")]
    assert [x["field"] for x in runs.search_steps(events, '"input"').collect()] == ["actions"]
    line = events.filter("step = 2").select(runs.step_line({"step": "step", "url": "url", "actions": "actions"}).alias("l")).collect()[0]["l"]
    assert (line["actions"], line["action_count"]) == (["input", "click"], 2)
    with pytest.raises(ValueError):
        runs.search_steps(events, "(")


SWEEP = """batch: 3 companies, sequential
[1/3] company=acme vendor=lever
run_id=11 company=acme listings_url=agent
run_id=11 company=acme no_remote_roles=true source=agent
[2/3] company=beta vendor=ashby
run_id=12 company=beta fetch: page_links=9 extracted=5
run_id=12 company=beta listings=https://x found=5 inserted=2 closed=1
[3/3] company=gamma vendor=lever
run_id=13 company=gamma agent_failed=1 error="x" found=9
batch done: ok=2 failed=1"""


def log_lines(spark, logs_):
    rows = [(run, i, line) for run, text in logs_.items() for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "run_id bigint, line_no bigint, line string")


def test_sweep_text_log(spark):
    blocks = runs.sweep_blocks(log_lines(spark, {10: SWEEP}))
    assert {r["company"]: r["outcome"] for r in blocks.collect()} == {"acme": "no_remote_roles", "beta": "fetched", "gamma": "agent_failed"}
    t = runs.sweep_totals(blocks).collect()[0]
    # The failed company's block carries found=9 as well: totals count every block.
    assert (t["companies_in_log"], t["sweep_size"], t["found"], t["inserted"], t["closed"]) == (3, 3, 14, 2, 1)
    assert {(r["outcome"], r["n"], r["companies"]) for r in runs.sweep_outcomes(blocks).collect()} == {("no_remote_roles", 1, "acme"), ("fetched", 1, "beta"), ("agent_failed", 1, "gamma")}


def test_log_attribution_and_grep(spark):
    lines = log_lines(spark, {10: SWEEP, 20: "batch: x\nrun_id=12 newer", 12: "  \n", 30: "own line"})
    asked = spark.createDataFrame([(11,), (12,), (30,), (77,)], "run_id bigint")
    sweeps = spark.createDataFrame([(10,), (20,)], "run_id bigint")
    got = {}
    for r in traces.attribute_logs(lines, asked, sweeps).collect():
        got.setdefault(r["run_id"], [r["origin"], 0])[1] += 1
    assert got == {11: ["parent_batch:10", 2], 12: ["parent_batch:20", 1], 30: ["own", 1], 77: ["not_found", 1]}
    out = traces.grep_log(log_lines(spark, {10: SWEEP}), "COMPANY=beta", 2).collect()
    assert len(out) == 2 and out[0]["total_lines"] == 3 and out[0]["truncated"]


def test_read_log_files(spark, tmp_path):
    (tmp_path / "5.log").write_text("a\nb")
    assert [(r["run_id"], r["line_no"], r["line"]) for r in traces.read_log_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [(5, 1, "a"), (5, 2, "b")]


# --- logs ---------------------------------------------------------------------------------------


def parsed(spark, bodies):
    rows = [(i, T0 + timedelta(seconds=i), b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return logs.parse_lines(spark.createDataFrame(rows, "seq bigint, ts timestamp, line string"))


def test_parse_lines(spark):
    out = parsed(spark, [{"level": "info", "run_id": 0, "duration_ms": 0, "new": "x", "empty": "", "list": []}, "plain text", "[1]", {"run_id": 615, "msg": "m", "ts": "t"}]).orderBy("seq").collect()
    assert (out[0]["level"], out[0]["run_id"], out[0]["duration_ms"], out[0]["fields"], out[0]["raw"]) == ("info", None, 0, {"new": "x"}, None)
    assert out[1]["raw"] == "plain text" and out[2]["raw"] == "[1]" and (out[3]["run_id"], out[3]["fields"]) == ("615", None)


def test_streams(spark):
    body = json.dumps({"data": {"result": [{"stream": {"app": "a"}, "values": [["30", "c"], ["10", "a"], ["bad", "x"], ["5"]]}, {"values": [["20", "b"], "junk"]}]}})
    got = logs.flatten_streams(spark.createDataFrame([(body,)], "body string"), limit=2).collect()
    assert [(r["ts_ns"], r["line"], r["labels"]) for r in got] == [(10, "a", {"app": "a"}), (20, "b", {})]


RUN = lambda run, company, *more: [dict(m, run_id=run, company=company, sweep_id=7) for m in more]


def test_outcome_priority(spark):
    cases = {
        "1": [{"msg": "agent failed", "agent_steps": 4}, {"msg": "listing stored"}], "2": [{"msg": "listings page blocked", "block_reason": "captcha"}, {"msg": "skip", "reason": "x"}], "3": [{"msg": "skip", "reason": "no_remote_roles"}, {"msg": "summary"}],
        "4": [{"msg": "listing stored", "listing_id": 9}, {"msg": "summary", "quality": "q"}], "5": [{"msg": "summary"}], "6": [{"msg": "start", "vendor": "lever"}], "7": [{"msg": "company failed"}, {"msg": "agent failed"}], "8": [{"msg": "summary", "blocked": True}], "9": [{"msg": "skip"}]}
    lines = [m for run, ms in cases.items() for m in RUN(run, f"c{run}", *ms)]
    df = parsed(spark, lines)
    facts = {r["run_id"]: r for r in logs.run_facts(df, ["run_id"]).collect()}
    assert [facts[str(i)]["outcome"] for i in range(1, 10)] == ["agent_failed", "blocked", "no_remote_roles", "stored", "completed", "in_progress", "failed_to_run", "blocked", "skipped"]
    assert facts["1"]["agent_steps"] == 4 and facts["2"]["block_reason"] == "captcha" and facts["4"]["quality"] == "q" and facts["6"]["vendor"] == "lever"
    assert [(r["run_id"], r["listing_id"]) for r in logs.stored_listings(df, ["run_id"]).collect()] == [("4", "9")]


SWEEP_LOG = [
    {"msg": "sweep started", "sweep_id": 7, "companies": 3, "candidates": 9, "skip_ok": True, "from_slug": ""}, {"msg": "company skipped", "sweep_id": 7, "company": "old", "reason": "last run ok"},
    {"msg": "company started", "sweep_id": 7, "company": "acme"}, {"msg": "start", "sweep_id": 7, "run_id": 1, "company": "acme", "vendor": "lever"}, {"msg": "skip", "sweep_id": 7, "run_id": 1, "company": "acme", "reason": "no_remote_roles"}, {"msg": "company finished", "sweep_id": 7, "company": "acme", "duration_ms": 1200},
    {"msg": "company started", "sweep_id": 7, "company": "beta"}, {"msg": "listing stored", "sweep_id": 7, "run_id": 2, "company": "beta", "listing_id": 5}, {"msg": "company failed", "sweep_id": 7, "company": "lost", "level": "error"}, {"msg": "sweep finished", "sweep_id": 7, "ok": 2, "failed": 1, "skipped": 1, "stopped_early": False}]


def test_sweep_story(spark):
    df = parsed(spark, SWEEP_LOG)
    rows = {r["company"]: r for r in logs.sweep_rows(df).collect()}
    assert {c: r["outcome"] for c, r in rows.items()} == {"acme": "no_remote_roles", "beta": "stored", "lost": "failed_to_run"}
    assert rows["acme"]["duration_ms"] == 1200 and rows["acme"]["vendor"] == "lever" and rows["lost"]["run_id"] is None
    plan = logs.sweep_plan(df).collect()[0]
    assert (plan["companies"], plan["candidates"], plan["skip_ok"], plan["from_slug"], plan["ok"], plan["failed"], plan["stopped_early"], plan["errors"]) == (3, 9, True, None, 2, 1, False, 1)
    assert [(r["company"], r["reason"]) for r in logs.sweep_skips(df).collect()] == [("old", "last run ok")]
    hist = logs.company_history(df.filter("company IS NOT NULL"))
    assert {(r["company"], r["outcome"]) for r in hist.collect()} == {("acme", "no_remote_roles"), ("beta", "stored"), ("old", "skipped_before_running")}
    totals = {r["company"]: (r["runs"], r["skipped"]) for r in logs.company_totals(hist).collect()}
    assert totals == {"acme": (1, 0), "beta": (1, 0), "old": (0, 1)}
    ev = df.withColumn("stopped_early", F.lit(False))
    assert [r["resume_from"] for r in runs.resume_point(ev).filter("sweep_id = 7").collect()] == [None]
    assert [r["resume_from"] for r in runs.resume_point(ev.filter("msg <> 'sweep finished'")).filter("sweep_id = 7").collect()] == ["beta"]


def test_run_summary(spark):
    lines = RUN("1", "acme", {"msg": "start", "vendor": "lever"}, {"msg": "agent decided", "listings_url": "u", "remote_confirmed": True, "role_count": 2, "agent_judged": False, "agent_steps": 6}, {"msg": "agent step", "url": "https://a"}, {"msg": "fetch", "extracted": 5}, {"msg": "stale", "closed": 1}, {"msg": "summary", "inserted": 2, "agent_s": 3.5, "total_s": 9})
    r = logs.run_summary(parsed(spark, lines), ["run_id"]).collect()[0]
    assert (r["company"], r["sweep_id"], r["listings_url"], r["remote_confirmed"], r["judged"], r["role_count"], r["extracted"], r["inserted"], r["closed"], r["agent_steps"], r["agent_s"]) == ("acme", 7, "u", True, False, 2, 5, 2, 1, 1, "3.5")
    assert [x["url"] for x in logs.step_urls(parsed(spark, lines), ["run_id"]).collect()] == ["https://a"]


def test_lookup_checks(spark):
    df = parsed(spark, [{"application_id": "a1", "msg": "x"}, {"run_id": 5, "msg": "y"}])
    assert logs.lookup(df, "application_id", "a1").count() == 1 and logs.lookup(df, "run_id", 5, limit=3).count() == 1
    for key, bad in [("run_id", 0), ("run_id", True), ("run_id", "a b"), ("colour", "x"), ("company", " ")]:
        with pytest.raises(ValueError):
            logs.lookup(df, key, bad)
    with pytest.raises(ValueError):
        logs.check_trace_id("zz")
    with pytest.raises(ValueError):
        logs.label_counts(df, "msg")


def test_container_density_ranking(spark):
    rows = [("loud", "ok")] * 100 + [("loud", "panic")] + [("quiet", "Traceback (most recent)")] + [("quiet", "x")] + [("tiny", "fatal")]
    df = spark.createDataFrame(rows, "container string, line string")
    assert [(r["container"], r["problem_per_1k"]) for r in logs.container_health(df, 2).collect()] == [("quiet", 500.0), ("loud", 9.9)]


def test_quality_notes(spark):
    df = spark.createDataFrame([("cache", True, 0, 0, 0), ("agent", True, 0, 0, 0), ("agent", True, 3, 0, 3), ("agent", True, 3, 0, 0), ("agent", True, 3, 1, 0), ("agent", False, 0, 0, 0)], "r string, c boolean, f int, i int, s int")
    got = [x["q"] for x in df.select(runs.quality_note("r", "c", "f", "i", "s").alias("q")).collect()]
    assert got == ["cached_url_yielded_nothing", "agent_confirmed_remote_but_fetch_found_nothing", "agent_confirmed_remote_but_all_postings_non_us", "agent_confirmed_remote_but_nothing_stored", "", ""]


def test_summaries(spark):
    o = spark.createDataFrame([(1, "a", "confirmed", False, None), (2, "b", None, True, "boom"), (3, "c", "wrong", False, None), (4, "d", None, False, None)], "ordinal int, slug string, category string, escalated boolean, error string")
    s = runs.validation_error_text(runs.validation_summary(o)).collect()[0]
    assert (s["found"], s["confirmed"], s["wrong"], s["unverifiable"], s["escalated"], s["failed"], s["first_error"], s["status"]) == (4, 1, 1, 1, 1, 1, "b: boom", "error")
    assert s["error_text"] == "1 companies could not be validated; first failure: b: boom"


def test_step_latency_follows_the_order_not_the_stamps(spark):
    rows = [(1, 1, "2026-01-02 00:00:10"), (1, 2, "2026-01-01 23:59:50"), (1, 3, "2026-01-02 00:00:30"), (1, 4, "2026-01-02 00:00:30"),
            (2, 1, None), (2, 100_000, "2026-01-02 00:00:00"), (2, 100_001, "2026-01-02 00:00:05"), (2, 300_000, "2026-01-02 00:01:00")]
    events = spark.createDataFrame([(r, s, s, "step", t) for r, s, t in rows], "run_id bigint, seq bigint, step bigint, event string, ts string")
    got = {(r["run_id"], r["step"]): r["latency_s"] for r in runs.step_latency(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert got == {(1, 2): -20.0, (1, 3): 40.0, (1, 4): 0.0, (2, 100_001): 5.0, (2, 300_000): 55.0}


def test_feed_elements_of_any_depth_and_size(spark):
    deep = '{"id": 1,  "a": ' + "[" * 30 + "1.50" + "]" * 30 + "}"
    wide = '{"x": "' + "y" * 30_000_000 + '"}'
    bodies = [("deep", f"[{deep}]"), ("far", "[" + "[" * 50_000 + "]" * 50_000 + "]"), ("wide", f"[{wide}, 2]"), ("bad", '[{"a":}]'), ("cut", '[1, "x]'), ("nan", "[NaN]"),
              ("comma", "[1,]"), ("mixed", "[[1}]"), ("none", None), ("null", " null\n"), ("empty", " [ ] ")]
    elements, rejects = feed.scan_feed(spark.createDataFrame(bodies, "source string, body string"))
    got = {(r["source"], r["idx"]): (r["n"], r["head"]) for r in elements.selectExpr("source", "idx", "length(element) n", "left(element, 200) head").collect()}
    assert got == {("deep", 0): (len(deep), deep), ("far", 0): (100_000, "[" * 200), ("wide", 0): (len(wide), wide[:200]), ("wide", 1): (1, "2")}
    assert sorted(r["source"] for r in rejects.select("source").collect()) == ["bad", "comma", "cut", "mixed", "nan", "none"]


def test_elements_are_verbatim(spark):
    texts = ['{"a": "x\\"}],{", "b":[1, {"c":  2.50}]}', '"plain, \\\\"', "1e3", "null", "[ 1,2 ]", "true"]
    deep = "[" * 20 + "]" * 20
    elements, _ = feed.scan_feed(spark.createDataFrame([("v", " [" + " , ".join(texts) + "]\n"), ("d", f"[{deep}, 1]"), ("e", "[]")], "source string, body string"))
    got = [r["element"] for r in elements.filter("source = 'v'").orderBy("idx").collect()]
    assert got == texts
    assert [r["element"] for r in elements.filter("source = 'd'").orderBy("idx").collect()] == [deep, "1"] and elements.filter("source = 'e'").count() == 0


def test_write_lines_makes_one_file_per_name_and_nothing_else(spark, tmp_path):
    """Spark's own writer made a folder, a file and a checksum file per run, and the reader listed each folder by a task of its own."""
    from rolegrid.sources import lines

    rows = [(n, k, None if k == 3 else "  " if k == 4 else f"é {n}-{k}") for n in range(40) for k in reversed(range(n % 7 + 1))]
    df = spark.createDataFrame(rows, "name bigint, at bigint, value string").repartition(5)
    assert lines.write_lines(df, f"file://{tmp_path}/out", ".log") == 40
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == sorted(f"{n}.log" for n in range(40))
    got = {(r["run_id"], r["line_no"]): r["line"] for r in traces.read_log_lines(spark, f"{tmp_path}/out").collect()}
    assert got == {(n, k + 1): v or "" for n, k, v in rows}
    assert lines.write_lines(df.limit(0), f"{tmp_path}/none") == 0
