"""Scalar expressions against decision tables."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rolegrid import vocab
from rolegrid.functions import html as H
from rolegrid.functions import jsonld, present, text, times, urls
from rolegrid.functions.sql import register


def many(spark, inputs, expr, schema="x string"):
    rows = [(i, *((x,) if not isinstance(x, tuple) else x)) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    return [r["v"] for r in df.withColumn("v", expr).orderBy("i").collect()]


NORMAL = [
    ("https://a.com/x?utm_source=n&b=2&a=1#f", "https://a.com/x?a=1&b=2"),
    ("https://a.com/x?REF=1", "https://a.com/x"),
    ("https://a.com/x?", "https://a.com/x?"),
    ("HTTPS://A.com/x", "https://A.com/x"),
    ("https://a.com/x?q=a+b&q=a%20c&k", "https://a.com/x?k=&q=a+b&q=a+c"),
    ("https://a.com/x?q=~*", "https://a.com/x?q=~%2A"),
    ("https://a.com/über uns", "https://a.com/%C3%BCber%20uns"),
    ("mailto:x@y.com", "mailto:x@y.com"),
    ("not a url", "not a url"),
]


def test_normalise_url(spark):
    got = many(spark, [a for a, _ in NORMAL], urls.normalise_url("x"))
    assert got == [b for _, b in NORMAL]
    assert many(spark, got, urls.normalise_url("x")) == got


def test_sql_functions_agree_with_expressions(spark):
    register(spark)
    df = spark.createDataFrame([(a,) for a, _ in NORMAL], "x string")
    pairs = [
        ("rg_normalise_url", urls.normalise_url("x")), ("rg_slugify", text.slugify("x")),
        ("rg_distinctive_token", text.distinctive_token("x")), ("rg_parse_instant", times.parse_instant("x")),
    ]
    for name, col in pairs:
        bad = df.withColumn("a", F.expr(f"{name}(x)")).withColumn("b", col).filter(~F.col("a").eqNullSafe(F.col("b")))
        assert bad.collect() == [], name
    links = spark.sql("""SELECT * FROM rg_page_links('<a href="/a">A <b>b</b></a><a>x</a>')""").collect()
    assert [tuple(r) for r in links] == [(0, "/a", "A b"), (1, "", "x")]


def test_parse_http_url(spark):
    bad = ["", "ftp://a.com", "https://", "//a.com", "javascript:x", "https://a.com/%zz", "https:///x", None]
    assert many(spark, bad, urls.is_http_url("x")) == [False] * len(bad)
    good = ["http://a.com", " https://a.com/x ", "https://u:p@a.com:81/x", "https://a.com/a b|c", "https://a.com?x=%zz", "https://[::1]:8/x"]
    assert many(spark, good, urls.is_http_url("x")) == [True] * len(good)
    assert many(spark, good, urls.host("x")) == ["a.com", "a.com", "a.com", "a.com", "a.com", "::1"]


RESOLVE = [
    ("https://a.com/b/c?x=1", "d", "https://a.com/b/d"),
    ("https://a.com/b/c", "../../../d/./e/", "https://a.com/d/e/"),
    ("https://a.com", "careers", "https://a.com/careers"),
    ("https://a.com/b?x=1", "?y=2", "https://a.com/b?y=2"),
    ("http://a.com/b", "//c.com/d#f", "http://c.com/d"),
    ("https://a.com/b", "HTTP://C.com/../d", "http://C.com/d"),
    ("https://a.com/b", "/x/..", "https://a.com/"),
    ("https://a.com/b", "#", None),
    ("https://a.com/b", "", None),
    ("https://a.com/b", "MAILTO:x", None),
    ("https://a.com/b", " tel:1", None),
    ("/relative", "x", None),
]


def test_resolve_url(spark):
    got = many(spark, [(a, b) for a, b, _ in RESOLVE], urls.resolve_url("x", "y"), "x string, y string")
    assert got == [c for _, _, c in RESOLVE]


def test_hosts_and_sites(spark):
    pairs = [("https://jobs.a.com/x", "https://www.a.com/"), ("https://a.com", "https://b.com"), ("x", "https://b.com")]
    assert many(spark, pairs, urls.same_site("x", "y"), "x string, y string") == [True, False, False]
    assert many(spark, ["a.b.c.com", "c.com", "localhost"], urls.base_domain("x")) == ["c.com", "c.com", "localhost"]
    assert many(spark, [("https://A.com:8/x", "a.COM"), ("", "a.com"), ("https://a.com", "")], urls.same_host("x", "y"), "x string, y string") == [True, False, False]


def test_path_rules(spark):
    s = urls.path_segments("x")
    u = [f"https://x.com{p}" for p in ["/careers-hub", "/our-careers", "/join-us", "/joinville-le-pont", "/products", "/Vacancies_1", "/"]]
    assert many(spark, u, urls.has_prefix_token(s)) == [True, False, True, True, False, True, False]
    assert many(spark, u, urls.has_contained_token(s)) == [True, True, True, True, False, False, False]
    assert many(spark, u, urls.has_careers_segment(s)) == [True, False, True, False, False, True, False]
    loc = [f"https://x.com{p}" for p in ["/en", "/en-us/de", "/EN_US/", "/news", "/us-en/careers", "/"]]
    assert many(spark, loc, urls.is_locale_only_gate(s)) == [True, True, True, False, False, False]
    assert many(spark, loc, urls.is_locale_only_homepage(s)) == [True, True, True, True, False, False]
    kinds = [("https://x.com/press-kit", "sitemap"), ("https://x.com/press-kit", "nav_anchor"), ("https://authy.com/careers", "nav_anchor"), ("https://x.com/jobs", "sitemap")]
    assert many(spark, kinds, urls.is_product_or_investor("x", F.col("y")), "x string, y string") == [True, False, True, False]
    wrong = [f"https://x.com{p}" for p in ["/careers/events", "/career-events", "/blog/jobs", "/routes/a", "/jobs"]]
    assert many(spark, wrong, urls.wrong_kind_token("x")) == ["event", None, "blog", "route", None]
    assert many(spark, ["https://x.com/careers/privacy-policy", "https://x.com/careers"], urls.is_boilerplate_path(s)) == [True, False]


def test_tenants_and_vendors(spark):
    u = ["https://boards.greenhouse.io/acme/jobs/1", "https://acme.jobs.lever.co/", "https://jobs.ashbyhq.com/", "https://x.wd5.myworkdayjobs.com/y", "https://notgreenhouse.io/a", "https://evil-boards.greenhouse.io/"]
    assert many(spark, u, urls.tenant("x")["tenant"]) == ["acme", "acme", None, None, None, None]
    assert many(spark, u, urls.vendor_from_url("x")) == ["greenhouse", "lever", "ashby", "workday", None, None]
    assert many(spark, u, urls.kind_for_url("x")) == ["ats_board", "ats_board", "career_site", "career_site", "career_site", "career_site"]
    pages = ['<i data-ph-at-id="1">', "see JOBS.LEVER.CO/x", "careerSiteCompanyId", "SuccessFactors", "nothing"]
    assert many(spark, pages, text.vendor_from_html("x")) == ["phenom", "lever", "successfactors", "successfactors", None]
    hosts = ["x.icims.com", "icims.com", "noticims.com"]
    assert many(spark, hosts, urls.is_board_host(F.col("x"))) == [True, True, False]
    assert many(spark, ["boards.greenhouse.io", "x.com"], urls.platform_id_for_host(F.col("x"))) == [10, 0]


def test_external_id(spark):
    cases = [("https://x/careers/job/12", r"careers/job/(\d+)"), ("https://x/a", r"careers/job/(\d+)"), ("https://x/a", ""), ("https://x/job/3", r"job/\d+"), ("https://x/a", None)]
    assert many(spark, cases, urls.external_id("x", "y"), "x string, y string") == ["12", "https://x/a", "https://x/a", "https://x/job/3", "https://x/a"]


def test_company_names(spark):
    names = ["AT&T Inc.", "  3M Company", "O'Reilly—Automotive", "!!!", "Ünïcode"]
    assert many(spark, names, text.slugify("x")) == ["at-t-inc", "3m-company", "o-reilly-automotive", "", "n-code"]
    tok = ["The Global Group", "Bank of America", "Alpha Omega", "3M", "S&P Global"]
    assert many(spark, tok, text.distinctive_token("x")) == ["", "america", "alpha", "", ""]
    assert many(spark, [("anything", "The Group"), ("ALPHA jobs", "Alpha"), ("beta", "Alpha")], text.contains_company_token("x", "y"), "x string, y string") == [True, True, False]


def test_page_text(spark):
    pages = ["<TITLE lang=en>\n A <b>b</b>\n c</TITLE><h1>H  1</h1>", "no title"]
    assert many(spark, pages, text.document_title("x")) == ["A b c", ""]
    assert many(spark, pages, text.document_heading("x")) == ["H 1", ""]
    boards = ['{"jobs": [{"id":1},{"id": 2}]}', '[{"id":1}]', '{"postings":[]}']
    assert many(spark, boards, text.count_board_ids("x")) == [2, 0, 0]
    links = "<a href='/jobs/1'><a href=\"/careers/x\"><a href='https://jobs.x.com'><a href='/about'>"
    assert many(spark, [links], text.count_listing_links("x")) == [3]
    assert many(spark, ["x" * 5000 + "just a moment", "JUST A MOMENT", "ü" * 2040 + " parked"], text.looks_like_challenge("x", F.lit(""), 4096)) == [False, True, False]
    assert many(spark, ["ü" * 2040 + " parked", "ü" * 2060 + " parked"], text.is_parked("x", F.lit(""), 4096)) == [True, False]
    assert many(spark, [" Careers ", "Job Search | X", "Careers at X"], text.is_generic_title("x")) == [True, True, False]


BLOCKS = [
    (403, "", "", "forbidden"), (401, "", "", "login_required"), (429, "x", "y", "rate_limited"), (503, "", "", "unavailable"),
    (200, "Just a moment...", "", "challenge"), (200, "", "Please verify you are human", "captcha"), (200, "Access Denied", "", "blocked"),
    (200, "", "please sign in", "login_required"), (200, "Careers", "Open roles in Berlin", ""), (404, "Not found", "gone", ""), (None, "", "", ""),
    (200, "", "x" * 60_001 + "captcha", ""),
]


def test_block_classifier(spark):
    got = many(spark, [b[:3] for b in BLOCKS], text.block_verdict("s", "t", "b", 60_000), "s int, t string, b string")
    assert [g["reason"] for g in got] == [b[3] for b in BLOCKS]
    assert many(spark, [BLOCKS[-1][:3]], text.block_verdict("s", "t", "b"), "s int, t string, b string")[0]["reason"] == "captcha"
    assert [g["blocked"] for g in got] == [bool(b[3]) for b in BLOCKS]
    assert got[0]["evidence"] == "HTTP 403" and got[5]["evidence"] == "please verify you are human"
    answers = [(True, "captcha", "x"), (False, "junk", "hit a CAPTCHA"), (None, "junk", "three open roles")]
    b = many(spark, answers, text.answer_block("f", "r", "e"), "f boolean, r string, e string")
    assert [(x["blocked"], x["block_reason"]) for x in b] == [(True, "captcha"), (True, "captcha"), (False, "")]


def test_bounded_text(spark):
    assert many(spark, ["a\nb\tc\x01"], text.single_line("x", "feed")) == ["a\\nb\\tc "]
    assert many(spark, ["a\nb\tc\x01"], text.single_line("x", "index")) == ["a b c"]
    assert many(spark, [("parse", "bad\nline"), ("parse", None), ("", None)], text.error_text("x", "y"), "x string, y string") == ["parse: bad\\nline", "parse", None]
    assert many(spark, ["aüb", "abc"], text.truncate_bytes("x", 2)) == ["a...", "ab..."]
    notes = ['{"verdict":"","reasoning":" so  so "}', '{"score":1}', "null", "plain", '["a"]', '{"verdict":3,"error":"e"}']
    assert many(spark, notes, text.judgement_note("x")) == ["so so", '{"score":1}', "", "plain", '["a"]', "e"]
    assert many(spark, [("a", "b"), ("", "b"), ("a", " ")], text.append_evidence("x", "y"), "x string, y string") == ["a;b", "b", "a"]
    tp = ["00-" + "A" * 32 + "-1-01", "00-" + "a" * 31 + "-1", "zz", "00-" + "g" * 32]
    assert many(spark, tp, text.trace_id("x")) == ["a" * 32, None, None, None]


def test_fetch_condition(spark):
    cases = [(None, "", 0), ("unexpected_status", "", 429), ("unexpected_status", "", 502), ("unexpected_status", "", 418), ("retry_after", "", 429), ("deadline", "", 0), ("dns", "", 0), ("other", "x509: certificate", 0), ("other", "reset", 0)]
    got = many(spark, cases, text.fetch_condition("k", "m", "s"), "k string, m string, s int")
    assert got == ["", "http_429_twice", "http_5xx", "http_status", "retry_after_too_long", "timeout", "dns_failure", "tls_failure", "connection_failed"]


def test_instants(spark):
    good = {
        "2026-02-06T21:01:54Z": datetime(2026, 2, 6, 21, 1, 54), "2026-02-06T21:01:54.5+02:00": datetime(2026, 2, 6, 19, 1, 54, 500000),
        "2026-02-06T21:01:54": datetime(2026, 2, 6, 21, 1, 54), "2026-02-06T21:01": datetime(2026, 2, 6, 21, 1), " 2026-02-06 ": datetime(2026, 2, 6),
    }
    assert many(spark, list(good), times.parse_instant("x")) == list(good.values())
    bad = ["2026", "2026-2-6", "06/02/2026", "2026-13-01", "", "yesterday", "2026-02-06 21:01:54"]
    assert many(spark, bad, times.parse_instant("x")) == [None] * len(bad)


def test_windows():
    assert times.parse_window("90m") == timedelta(minutes=90)
    assert times.parse_window(None) == timedelta(hours=24)
    assert times.parse_window("1w") == timedelta(days=7)
    now = datetime(2026, 1, 2, tzinfo=timezone.utc)
    assert times.parse_window("2026-01-01T00:00:00Z", now=now) == timedelta(days=1)
    assert times.parse_window("2027-01-01", now=now) == timedelta(seconds=1)
    with pytest.raises(ValueError):
        times.parse_window("soon")


POSTING = """{"@type":"JobPosting","title":"Engineer","datePosted":"2026-02-06T21:01:54Z","validThrough":"2026-06-06T21:01:54Z","employmentType":["FULL_TIME"],
"jobLocationType":"TELECOMMUTE","description":"d","applicantLocationRequirements":[{"@type":"Country","name":"USA"}],
"jobLocation":[{"address":{"addressCountry":"US","addressRegion":"CA","addressLocality":"SF"}}]}"""


def test_posting_parse(spark, value):
    p = value(jsonld.parse_posting(F.lit(POSTING)))
    assert (p["is_posting"], p["remote"], p["employment_type"]) == (True, True, "full_time")
    assert (p["posted_at"], p["valid_through"]) == (datetime(2026, 2, 6, 21, 1, 54), datetime(2026, 6, 6, 21, 1, 54))
    cases = ['{"datePosted":"2026-01-01"}', '{"@type":"jobposting"}', '{"title":"x"}', "", "nope", "[1]", '{"validThrough":null}', '{"@type":"JobPosting","employmentType":["TEMP",1]}']
    got = many(spark, cases, jsonld.parse_posting("x"))
    assert [g["is_posting"] for g in got] == [True, True, False, False, False, False, True, True]
    assert all(g["remote"] is None for g in got) and got[-1]["employment_type"] is None


def test_posting_parse_by_parts(spark):
    """Named parts are those of the whole parse, also of texts that are no posting or no JSON."""
    cases = [POSTING, None, "not json", '\n {"@type":["JobPosting"],"employmentType":"full time","datePosted":" 2026-01-01T10:00:00,5+02:00 "}', '{"@type":"JobPosting"', '{"@type":"JobPosting","@type":"x"}',
             "{'@type':'JobPosting'}", '{"datePosted":null} rest', '{"@type":"JobPosting","employmentType":5,"datePosted":["2026-02-03"]}', '{"x":{"datePosted":"2026-01-01"}}', '[{"@type":"JobPosting"}]']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string")
    got = df.select("i", jsonld.parse_posting("x").alias("p"), jsonld.parse_posting("x", ("employment_type", "posted_at")).alias("q")).orderBy("i").collect()
    assert [(g["p"]["employment_type"], g["p"]["posted_at"]) for g in got] == [tuple(g["q"]) for g in got]
    assert [g["p"]["is_posting"] for g in got] == [True, False, False, True, False, False, False, True, True, False, False]
    assert tuple(got[3]["q"]) == ("full_time", datetime(2026, 1, 1, 8, 0, 0, 500000)) and tuple(got[8]["q"]) == (None, datetime(2026, 2, 3))


def test_locations(spark):
    cases = [POSTING, '{"applicantLocationRequirements":{"name":"Canada"}}', '{"applicantLocationRequirements":[{"name":"Canada"},{"name":"Germany"}]}',
             '{"jobLocation":{"address":{"addressCountry":{"name":"uk"},"addressRegion":"London"}}}', '{"jobLocation":{"address":{"addressRegion":"X"}}}', "{}"]
    got = many(spark, cases, jsonld.classify_location("x"))
    assert [(g["country"], g["is_us"], g["location_text"]) for g in got] == [
        ("US", True, "USA, US, CA, SF"), ("CA", False, "Canada"), (None, False, "Canada, Germany"), ("UK", False, "uk, London"), (None, None, "X"), (None, None, None)]


def test_pick_posting(spark, value):
    html = '<script type="application/ld+json">{broken</script><script type=\'application/ld+json\'>[{"@type":"Org"},{"description":"<p>A</p>&nbsp;B","title":""}]</script>'
    r = value(jsonld.posting_record(F.lit(html), F.lit("Link")))
    assert (r["title"], r["description"]) == ("Link", "A B")
    assert value(jsonld.posting_record(F.lit("<p>plain</p>"), F.lit("L")))["raw_data"] is None


def test_anchor_scores(spark):
    page = """<nav><a href="/careers">Careers</a><a href="/o">Opportunities for all</a><a href='/x'>Join the club</a><a href="#">Jobs</a></nav>
    <a href=https://boards.greenhouse.io/acme>Our open jobs</a><a href="/careers">Work</a><a href="/about">About</a>
    <footer><a href="mailto:jobs@x.com">Jobs</a><a href="/legal">Legal</a></footer>"""
    df = spark.createDataFrame([("https://acme.com/", page)], "url string, html string")
    got = {r["link"]: (r["score"], list(r["evidence"]), r["external"]) for r in df.select(F.explode(H.scored_links("url", "html")).alias("x")).select(
        "x.a.link", "x.s.score", "x.s.evidence", "x.s.external").orderBy("score").collect()}
    assert got["https://acme.com/careers"] == (140, ["text_exact:careers", "url_signal", "in_nav"], False)
    assert got["https://acme.com/o"] == (75, ["text_signal", "in_nav"], False)
    assert got["https://acme.com/x"] == (75, ["nav_text:join", "in_nav"], False)
    assert got["https://boards.greenhouse.io/acme"] == (40, ["text_signal", "external"], True)
    assert set(got) == {"https://acme.com/careers", "https://acme.com/o", "https://acme.com/x", "https://boards.greenhouse.io/acme"}


def test_posting_links(spark):
    cases = [("https://x.com/jobs/1", "Dev"), ("https://x.com/jobs/1", " "), ("#", "Dev"), ("mailto:x/job/", "Dev"), ("https://x.com/about", "Dev"), ("https://x.com/p?gh_jid=1", "Dev")]
    assert many(spark, cases, H.looks_like_posting("x", "y"), "x string, y string") == [True, False, False, False, False, False]
    assert many(spark, [("https://x.com/p?gh_jid=1", "")], H.is_posting_link("x", "y", "gh_jid="), "x string, y string") == [True]


def test_allowed_domains(spark):
    u = ["https://www.acme.com/x", "https://acme.com", "https://a.myworkdayjobs.com/", "https://jobs.lever.co/x", "https://x.jobs.lever.co/", "https://evil.com", "junk"]
    assert many(spark, u, urls.allowed_domain("x", F.lit("https://careers.acme.com/"))) == [True, True, True, True, False, False, False]


def test_presentation(spark, value):
    sal = [(120000_00, 150000_00, "USD", "year"), (5050, 5050, "EUR", "hour"), (None, 100, None, None), (100, None, "XYZ", "week"), (None, None, "USD", "year"), (-5, None, None, None)]
    assert many(spark, sal, present.salary_text("a", "b", "c", "d"), "a bigint, b bigint, c string, d string") == [
        "$120,000–$150,000 / yr", "€50.50 / hr", "up to 1", "from XYZ 1 / week", "", "from -0.05"]
    assert many(spark, ["ats_http_5xx", "no_careers_signal", ""], present.humanize("x")) == ["ATS HTTP 5xx", "No Careers Signal", ""]
    assert many(spark, ["running", "paused", None], present.run_status("x")) == ["Running", "Paused", "Unknown"]
    assert many(spark, ["confirmed", None], present.verdict("x")) == ["Confirmed", "Not validated"]
    assert many(spark, ["2026-01-02T03:04:05.6Z", "odd", None], present.utc_text("x")) == ["2026-01-02 03:04:05", "odd", "—"]
    assert many(spark, ["sp500", "other", None], present.membership("x")) == ["S&P 500", "other", ""]
    acts = ['{"click":{"url":"u"}}', '{"type":{"text":"hi"}}', '{"wait":3}', '{"done":null}', '{"a":1,"b":2}', '{"x":[1]}', "null"]
    assert many(spark, acts, present.action_text(F.parse_json("x"))) == ["click u", "type hi", "wait 3", "done", '{"a":1,"b":2}', '{"x":[1]}', ""]
    assert value(present.report_line([("run_id", F.lit(3)), ("err", F.lit(None).cast("string"))])) == "run_id=3 err=-"
    assert value(present.attempt_count(F.lit(1))) == "1 attempt" and value(present.attempt_count(F.lit(None).cast("int"))) == "0 attempts"


def test_reason_vocabulary_is_closed():
    assert len(vocab.REASON_NAMES) == 23 == len(set(vocab.REASON_NAMES))
    assert len(vocab.WRONG_REASONS) == 9 and len(vocab.ESCALATE_REASONS) == 6
