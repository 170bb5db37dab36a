"""Composed jobs end to end on small corpora; every one runs twice."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from rolegrid.operators import discover
from rolegrid.plans import careers, ingest
from rolegrid.sources import registry

T0 = datetime(2026, 1, 1)
RESPONSES = "url string, final_url string, status int, content_type string, body string, truncated boolean, transport_error string, timed_out boolean"
COMPANIES = "company_id bigint, slug string, name string"
JOBS = ("job_id bigint, company_id bigint, discovery_platform_id bigint, external_id string, title string, listing_url string, description string, employment_type string, is_remote boolean, "
        "location_text string, country string, is_us boolean, salary_min_cents bigint, salary_max_cents bigint, tags array<string>, posted_at timestamp, status string, raw_data string, scrape_run_id bigint, "
        "first_seen_at timestamp, last_seen_at timestamp, created_at timestamp, updated_at timestamp")


def now():
    return F.lit("2026-01-02 00:00:00").cast("timestamp")


def page(url, body, status=200, final="", ct="text/html", err=None):
    return (url, final, status, ct, body, False, err, False)


def test_feed_ingest(spark):
    feed = [{"legal": "x"}, {"id": "1", "position": "Dev", "company": "Acme", "tags": []}, {"id": "2", "position": "Ops", "company": "New Co"}, {"id": "3", "position": 5}]
    capture = spark.createDataFrame([(json.dumps(feed),)], "body string")
    companies = spark.createDataFrame([(4, "acme", "ACME")], COMPANIES)
    jobs = spark.createDataFrame([], JOBS)
    one = ingest.feed_ingest(capture, companies, jobs, 1, now())
    r = one["report"].collect()[0]
    assert (r["outcome"], r["found"], r["accepted"], r["inserted"], r["updated"], r["closed"], r["skipped"]) == ("ok", 4, 2, 2, 0, 0, 1)
    assert {(x["slug"], x["company_id"]) for x in one["companies"].collect()} == {("acme", 4), ("new-co", 5)}
    two = ingest.feed_ingest(capture, one["companies"], one["jobs"], 1, now())
    r = two["report"].collect()[0]
    assert (r["inserted"], r["updated"], r["closed"]) == (0, 2, 0)
    less = spark.createDataFrame([(json.dumps(feed[:2] + [{"id": "2", "position": 9}]),)], "body string")
    three = ingest.feed_ingest(less, two["companies"], two["jobs"], 1, now())
    assert three["report"].collect()[0]["closed"] == 0  # the undecodable row was still observed
    gone = spark.createDataFrame([(json.dumps(feed[:2]),)], "body string")
    four = ingest.feed_ingest(gone, two["companies"], two["jobs"], 1, now())
    assert four["report"].collect()[0]["closed"] == 1 and {x["external_id"]: x["status"] for x in four["jobs"].collect()} == {"1": "open", "2": "closed"}
    none = ingest.feed_ingest(spark.createDataFrame([('[{"legal":"x"}]',)], "body string"), two["companies"], two["jobs"], 1, now())
    assert none["report"].collect()[0]["outcome"] == "no_jobs" and none["jobs"].filter("status = 'closed'").count() == 0
    bad = ingest.feed_ingest(spark.createDataFrame([('[{"id":"9","position":1}]',)], "body string"), two["companies"], two["jobs"], 1, now())
    assert bad["report"].collect()[0]["outcome"] == "normalize_failed" and bad["jobs"].filter("status = 'closed'").count() == 0


WIKI = """{|
! Symbol !! Security !! GICS Sector
|-
| {{NyseSymbol|A}} || [[Alpha]] || Tech
|-
| {{NyseSymbol|B}} || [[Beta]] || Oil
|}"""


def test_index_ingest(spark):
    schema = COMPANIES + ", industry string, cik string, gics_sub_industry string, headquarters_location string, index_membership string, article_title string, created_at timestamp, updated_at timestamp"
    companies = spark.createDataFrame([(1, "alpha", "Alpha", "Old", None, None, None, None, None, T0, T0)], schema)
    pages = spark.createDataFrame([("sp500", 1, WIKI), ("sp400", 2, WIKI.replace("Beta", "Gamma").replace("Alpha", "Delta")), ("sp600", 3, "{|\n|}"), ("bad", 4, "no")], "index string, position int, wikitext string")
    out = ingest.index_ingest(pages, companies, now())
    got = {r["slug"]: r for r in out["companies"].collect()}
    assert set(got) == {"alpha", "beta", "gamma", "delta"} and got["alpha"]["company_id"] == 1 and got["alpha"]["industry"] == "Tech" and got["gamma"]["index_membership"] == "sp400"
    assert sorted(r["company_id"] for r in got.values()) == [1, 2, 3, 4]
    rep = {r["index"]: (r["found"], r["exit_code"]) for r in out["report"].collect()}
    assert rep == {"sp500": (2, 0), "sp400": (2, 0), "sp600": (0, 4), "bad": (0, 1)}
    assert ingest.report_exit(out["report"]).collect()[0]["exit_code"] == 4
    again = ingest.index_ingest(pages, out["companies"], now())
    assert {r["merge_action"] for r in again["changes"].collect()} == {"same"}


HOME = '<title>{0}</title><nav><a href="{1}">Careers</a></nav>'
CORPUS = [
    page("https://acme.com", HOME.format("Acme", "/careers")), page("https://acme.com/careers", "<title>Careers at Acme</title>open positions"),
    page("https://beta.com", HOME.format("Beta", "https://boards.greenhouse.io/beta")), page("https://boards.greenhouse.io/beta", "<title>Jobs at Beta</title>"),
    page("https://boards-api.greenhouse.io/v1/boards/beta/jobs", '{"jobs":[{"id":1}]}', ct="application/json"),
    page("https://gone.com", HOME.format("Gone", "https://jobs.lever.co/gone")), page("https://jobs.lever.co/gone", "<title>Gone jobs</title>"), page("https://api.lever.co/v0/postings/gone?mode=json", "[]", ct="application/json"),
    page("https://blocked.com", "<title>Just a moment</title>"), page("https://blocked.com/sitemap.xml", "<urlset><loc>https://blocked.com/jobs</loc></urlset>"), page("https://blocked.com/jobs", "", 403),
    page("https://maps.com", "<title>Maps</title>"), page("https://maps.com/robots.txt", "Disallow: /hiring\n"), page("https://maps.com/hiring", "x", final="https://maps.com/hiring/us"),
]
FIRMS = [(1, "acme", "Acme", "https://acme.com"), (2, "beta", "Beta", "https://beta.com"), (3, "gone", "Gone", "https://gone.com"), (4, "blocked", "Blocked", "https://blocked.com"), (5, "nowhere", "Nowhere", None), (6, "maps", "Maps", None)]


def test_resolution_job(spark):
    companies = spark.createDataFrame(FIRMS, COMPANIES + ", website string").withColumn("career_site_url", F.lit(None).cast("string"))
    responses = spark.createDataFrame(CORPUS, RESPONSES)
    homes = spark.createDataFrame([(6, "https://maps.com", "infobox")], "company_id bigint, url string, source string")
    out = careers.resolve_careers(companies, responses, homes)
    res = {r["slug"]: r for r in out["resolutions"].collect()}
    assert (res["acme"]["new_url"], res["acme"]["new_url_source"], res["acme"]["new_status"]) == ("https://acme.com/careers", "anchor_scan", 200)
    assert (res["beta"]["new_url"], res["beta"]["new_url_source"], res["beta"]["platform_id"]) == ("https://boards.greenhouse.io/beta", "ats_api", 10)
    assert res["gone"]["new_url"] is None and not res["gone"]["resolved"]
    assert res["blocked"]["new_url"] is None and res["nowhere"]["new_url"] is None
    assert (res["maps"]["new_url"], res["maps"]["new_url_source"], res["maps"]["new_website_source"]) == ("https://maps.com/hiring/us", "robots_signal", "wikipedia_infobox")
    trail = {}
    for r in out["attempts"].orderBy("company_id", "position").collect():
        trail.setdefault(r["company_id"], []).append((r["source"], r["validation_status"], r["rejection_reason"]))
    assert trail[1] == [("homepage", "accepted", None), ("nav_anchor", "accepted", None)]
    assert trail[3] == [("homepage", "accepted", None), ("nav_anchor", "accepted", None), ("ats_api", "rejected", "ats_empty_board")]
    assert trail[4] == [("homepage", "rejected", "bot_challenge"), ("sitemap", "rejected", "forbidden")]
    assert trail[5] == [("tier1", "rejected", "no_careers_signal")]
    assert trail[6] == [("infobox", "accepted", None), ("homepage", "accepted", None), ("robots_path", "accepted", None)]
    have = spark.createDataFrame([], "run_id bigint, company_id bigint, attempt_index bigint")
    done = careers.publish(out, companies, have, 9, now())
    assert done["rejects"].count() == 0 and {r["resolution_action"] for r in done["companies"].filter("slug IN ('acme', 'beta', 'maps')").collect()} == {"inserted"}
    slots = {r["company_id"]: r["n"] for r in done["attempts"].groupBy("company_id").agg((F.max("attempt_index") + 1 - F.count("*")).alias("n")).collect()}
    assert set(slots.values()) == {0}
    dry = careers.publish(out, companies, have, 9, now(), dry_run=True)
    assert dry["companies"].filter("career_site_url IS NOT NULL").count() == 0 and dry["attempts"].count() == done["attempts"].count()


def test_validation_job(spark):
    stored = spark.createDataFrame([(1, "acme", "Acme", "https://acme.com/careers"), (2, "beta", "Beta", "https://beta.com/blog"), (3, "cold", "Cold", "https://cold.com/jobs"), (4, "warm", "Warm", "https://warm.com/jobs")], COMPANIES + ", career_site_url string")
    responses = spark.createDataFrame([page("https://acme.com/careers", "<title>Acme careers</title>"), page("https://beta.com/blog", "<title>Beta blog</title>job openings"), page("https://cold.com/jobs", "", 403), page("https://warm.com/jobs", "", 403), page("https://warm.com/careers", "<title>Warm careers</title>open roles")], RESPONSES)
    second = spark.createDataFrame([(3, "https://cold.com/jobs", True), (4, "https://warm.com/careers", True)], "company_id bigint, final_url string, ok boolean")
    out = careers.validate_stored(stored, responses, second)
    got = {r["slug"]: (r["new_verdict"], r["escalated"], r["new_verdict_url"]) for r in out["verdicts"].collect()}
    assert got == {"acme": ("confirmed", False, "https://acme.com/careers"), "beta": ("wrong", False, "https://beta.com/blog"), "cold": ("unverifiable", True, "https://cold.com/jobs"), "warm": ("confirmed", True, "https://warm.com/jobs")}
    attempts = out["attempts"].collect()
    assert len(attempts) == 5 and {a["evidence"] for a in attempts if a["company_id"] == 1} == {"verdict=html_careers;careers_landing"}
    assert all(a["evidence_body"] is None for a in attempts if a["validation_status"] == "accepted")


def test_classification_job(spark):
    companies = spark.createDataFrame([(1, "a", "A", "https://jobs.lever.co/a"), (2, "b", "B", "https://b.com/careers"), (3, "c", "C", "https://c.com/careers"), (4, "d", "D", "https://d.com")], COMPANIES + ", career_site_url string")
    responses = spark.createDataFrame([page("https://jobs.lever.co/a", "x"), page("https://b.com/careers", '<a href="/careers">Careers</a><a href="/jobs">Jobs</a>'), page("https://b.com/jobs", "<i data-ph-at-id=1>"), page("https://c.com/careers", "nothing")], RESPONSES)
    state = spark.createDataFrame([(1, 10, "old")], "company_id bigint, platform_id bigint, base_url string")
    out = careers.classify_vendors(companies, responses, registry.platforms(spark), state)
    got = {r["slug"]: (r["vendor"], r["hop"], r["board_url"], r["outcome"]) for r in out["rows"].collect()}
    assert got["a"] == ("lever", False, "https://jobs.lever.co/a", "classified") and got["b"] == ("phenom", True, "https://b.com/jobs", "classified")
    assert got["c"][3] == got["d"][3] == "unknown"
    s = out["summary"].collect()[0]
    assert (s["classified"], s["unknown"], s["failed"], s["total"]) == (2, 2, 0, 4)
    assert {(r["company_id"], r["platform_id"]) for r in out["company_platforms"].collect()} == {(1, 10), (1, 11), (2, 32)}


def ld(title, country, **extra):
    body = {"@type": "JobPosting", "title": title, "description": "<p>d</p>", "jobLocationType": "TELECOMMUTE", "jobLocation": {"address": {"addressCountry": country}}, **extra}
    return f'<script type="application/ld+json">{json.dumps(body)}</script>'


def test_listings_job(spark):
    companies = spark.createDataFrame([
        (1, "a", "A", 11, r"jobs/(\d+)", None, None, None, T0), (2, "b", "B", 11, "", "https://b.com/list", "2026-01-01T12:00:00Z", True, T0), (3, "c", "C", 11, "", None, None, None, T0), (4, "d", "D", 11, "", None, None, None, T0), (5, "e", "E", 11, "", None, None, None, T0)],
        COMPANIES + ", discovery_platform_id bigint, pattern string, listings_url string, listings_url_resolved_at string, listings_url_remote_confirmed boolean, updated_at timestamp")
    answers = spark.createDataFrame([(1, "https://a.com/list", True, False, True, None), (3, "https://c.com/list", False, False, True, None), (4, None, None, False, False, "boom"), (5, "https://e.com/list", True, True, True, None)],
                                    "company_id bigint, listings_url string, has_remote boolean, blocked boolean, ok boolean, error string")
    responses = spark.createDataFrame([
        page("https://a.com/list", '<a href="/jobs/1">One</a><a href="/jobs/2">Two</a><a href="/jobs/3">Three</a><a href="/about">x</a>'),
        page("https://a.com/jobs/1", ld("Dev", "US", employmentType="FULL_TIME", datePosted="2026-01-01")), page("https://a.com/jobs/2", ld("Ops", "DE")),
        page("https://b.com/list", "<title>Access denied</title>"), page("https://e.com/list", "<p>nothing here</p>")], RESPONSES)
    jobs = spark.createDataFrame([
        (1, 1, 11, "1", "old", "u", None, None, True, None, None, True, None, None, None, None, "closed", "r", 1, T0, T0, T0, T0), (2, 1, 11, "9", "gone", "u", None, None, True, None, None, True, None, None, None, None, "open", "r", 1, T0, T0, T0, T0),
        (3, 2, 11, "x", "kept", "u", None, None, True, None, None, True, None, None, None, None, "open", "r", 1, T0, T0, T0, T0)], JOBS)
    out = ingest.listings_job(companies, answers, responses, jobs, now(), 77)
    rep = {r["slug"]: r for r in out["report"].collect()}
    assert {s: r["outcome"] for s, r in rep.items()} == {"a": "fetched", "b": "blocked", "c": "no_remote_roles", "d": "agent_failed", "e": "fetched"}
    a = rep["a"]
    assert (a["found"], a["accepted"], a["skipped_non_us"], a["inserted"], a["refreshed"], a["closed"], a["remote_evidence"], a["stale_note"]) == (3, 1, 1, 0, 1, 1, 2, "")
    assert rep["b"]["resolution"] == "cache" and rep["e"]["stale_note"] == "none_observed" and rep["e"]["quality"] == "agent_confirmed_remote_but_fetch_found_nothing"
    got = {r["job_id"]: r for r in out["jobs"].collect()}
    assert (got[1]["status"], got[1]["title"], got[1]["employment_type"], got[1]["scrape_run_id"], got[1]["raw_data"], got[1]["first_seen_at"]) == ("open", "Dev", "full_time", 77, "r", T0)
    assert got[2]["status"] == "closed" and got[3]["status"] == "open"
    cached = {r["slug"]: (r["listings_url"], r["listings_url_remote_confirmed"]) for r in out["companies"].collect()}
    assert cached["a"] == ("https://a.com/list", True) and cached["c"] == ("https://c.com/list", False) and cached["e"] == (None, None) and cached["d"] == (None, None)
    again = ingest.listings_job(companies, answers, responses, out["jobs"], now(), 78)
    r2 = {r["slug"]: r for r in again["report"].collect()}
    assert (r2["a"]["inserted"], r2["a"]["refreshed"], r2["a"]["closed"]) == (0, 1, 0)
    rules = discover.robots_rules(spark.createDataFrame([("a.com", 200, "User-agent: *\nDisallow: /list")], "host string, status int, body string"), "bot")
    denied = ingest.listings_job(companies.filter("slug = 'a'"), answers, responses, jobs, now(), 79, robots=rules)
    assert [r["outcome"] for r in denied["report"].collect()] == ["robots_disallowed"]
