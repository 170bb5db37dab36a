"""Gate decision tables, robots, sitemaps, ladder, homepages, wikitext."""

import random

import pytest
from pyspark.sql import functions as F

from rolegrid.functions.base import let
from rolegrid.operators import discover, homepage, wikitext
from rolegrid.operators.gate import board_check, gate, reason_dimension

GATE = "i int, url string, company_name string, kind string, source string, strict boolean, status int, response_url string, content_type string, body string, transport_error string, timed_out boolean, base string, want string, why string"
JOB = '<script>{"@type": "JobPosting"}</script>'


def row(i, url, company="Acme", kind="career_site", source="sitemap", strict=False, status=200, final="", ct="text/html", body="", err=None, late=False, base=None, want="", why=""):
    return (i, url, company, kind, source, strict, status, final, ct, body, err, late, base, want, why)


CASES = [
    dict(url="https://jobs.lever.co/none", company="Nobody", kind="ats_board", body="<title>Jobs</title>x", want="rejected", why="generic_title_without_company"),
    dict(url="https://jobs.ashbyhq.com/openai", company="OpenAI", kind="ats_board", body="<title>OpenAI Jobs</title>" + JOB * 2, want="accepted", why="html_careers"),
    dict(url="https://trailhead.salesforce.com/career-path", company="Salesforce", source="nav_anchor", body="<title>Career Paths | Trailhead</title>", want="rejected", why="product_or_investor_path"),
    dict(url="https://www.pricesmart.com/jobstar-brush", company="PriceSmart", strict=True, body="<title>JobStar 2-in-1 Brush Cutter</title>", want="rejected", why="no_careers_signal"),
    dict(url="https://www.uber.com/routes/joinville-le-pont", company="Uber", strict=True, body="<title>Uber jobs</title>open roles", want="rejected", why="product_or_investor_path"),
    dict(url="https://acme.com/careers", body="<title>Just a moment...</title>", want="rejected", why="bot_challenge"),
    dict(url="https://acme.com/careers", body="<title>x</title>This domain is for sale", want="rejected", why="parked_domain"),
    dict(url="https://acme.com/careers", status=403, body="x", want="rejected", why="forbidden"),
    dict(url="https://acme.com/careers", status=429, body="x", want="rejected", why="rate_limited"),
    dict(url="https://acme.com/careers", status=418, body="x", want="rejected", why="http_418"),
    dict(url="https://acme.com/careers", status=0, want="error", why="no_status"),
    dict(url="https://acme.com/careers", err="reset", status=0, want="error", why="transport_error"),
    dict(url="https://acme.com/careers", err="late", late=True, status=0, want="error", why="timeout"),
    dict(url="https://acme.com/careers", body=" \n ", want="rejected", why="empty_body"),
    dict(url="https://acme.com/careers", status=204, body="x", want="rejected", why="empty_body"),
    dict(url="mailto:x", body="x", want="rejected", why="unparseable_final_url"),
    dict(url="https://acme.com/careers", kind="odd", body="x", want="error", why="unknown_kind"),
    dict(url="https://acme.com/", kind="website", body="<title>Acme</title>hi", want="accepted", why="html_homepage"),
    dict(url="https://acme.com/en-us", body="<title>Careers at Acme</title>", want="rejected", why="locale_only_path"),
    dict(url="https://acme.com/newsroom/jobs", body="<title>Acme jobs</title>", want="rejected", why="product_or_investor_path"),
    dict(url="https://acme.com/newsroom/jobs", source="nav_anchor", body="<title>Acme jobs</title>", want="accepted", why="html_careers"),
    dict(url="https://acme.com/about", body="<title>About</title>nothing", want="rejected", why="no_careers_signal"),
    dict(url="https://boards.greenhouse.io/acme", kind="ats_board", ct="application/json", body='{"jobs":[]}', want="rejected", why="ats_empty_board"),
    dict(url="https://boards.greenhouse.io/acme", kind="ats_board", ct="application/json", body='{"jobs":[{"id":1}]}', want="accepted", why="ats_board"),
    dict(url="https://boards.greenhouse.io/g", company="The Group", kind="ats_board", body="<title>The Group jobs</title>open roles", want="rejected", why="unverifiable_ats_title"),
    dict(url="https://acme.com/careers", body="<title>Careers</title>open positions", want="accepted", why="html_careers"),
    dict(url="https://acme.com/news", body="<title>Careers</title>open positions", want="rejected", why="generic_title_without_company"),
    dict(url="https://acme.com/careers", strict=True, body="<title>Careers at Acme</title>" + '<a href="/jobs/1">' * 5, want="accepted", why="html_careers"),
    dict(url="https://acme.com/careers", strict=True, body="<title>Acme careers</title>", want="accepted", why="html_careers"),
    dict(url="https://acme.com/careers", strict=True, body="<title>Fraud alert: Acme careers</title>open roles", want="rejected", why="product_or_investor_path"),
    dict(url="careers", base="https://acme.com/x", body="<title>Acme</title>open roles", want="accepted", why="html_careers"),
]


def test_gate_table(spark):
    rows = [row(i, **c) for i, c in enumerate(CASES)]
    got = gate(spark.createDataFrame(rows, GATE)).orderBy("i").collect()
    bad = [(r["i"], r["url"], r["gate"]["status"], r["gate"]["reason"]) for r in got if (r["gate"]["status"], r["gate"]["reason"]) != (r["want"], r["why"])]
    assert bad == []
    evidence = {r["i"]: r["gate"]["evidence"] for r in got}
    assert evidence[1] == "jobposting=2,careers_title" and evidence[27] == "job_links=5" and evidence[28] == "careers_landing"
    assert got[-1]["gate"]["final_url"] == "https://acme.com/careers"


def test_every_reason_has_a_category(spark):
    dim = reason_dimension(spark)
    assert dim.count() == 23 and dim.filter("category NOT IN ('wrong', 'unverifiable')").count() == 0


def test_board_check(spark):
    schema = "i int, tenant_url string, status int, body string, truncated boolean, transport_error string, timed_out boolean"
    u = "https://jobs.lever.co/acme"
    rows = [
        (0, u, 200, '[{"id":1},{"id":2}]', False, None, False), (1, u, 200, '{"content":[{}]}', False, None, False), (2, u, 200, '{"other":1}', False, None, False),
        (3, u, 200, '{"jobs":{}}', False, None, False), (4, u, 200, "<html>", False, None, False), (5, u, 200, "", False, None, False), (6, u, 500, "x", False, None, False),
        (7, u, 404, "x", False, None, False), (8, u, 200, "[1]", True, None, False), (9, u, 0, None, False, "x", True), (10, "https://x.com", 200, "[1]", False, None, False), (11, u, 200, '{"jobs":[]}', False, None, False),
    ]
    got = [r["board"] for r in board_check(spark.createDataFrame(rows, schema)).orderBy("i").collect()]
    assert [g["reason"] for g in got] == ["", "", "ats_empty_board", "ats_invalid_json", "ats_invalid_json", "empty_body", "ats_http_5xx", "ats_http_4xx", "ats_truncated_body", "timeout", "unknown_kind", "ats_empty_board"]
    assert got[0]["job_count"] == 2 and got[0]["evidence"] == "ats_entries=2 vendor=lever"


ROBOTS = """# c
User-agent: Other
User-agent: RoleBot   # the last stacked agent keeps the rules
Disallow: /private
Allow: /private/ok
Disallow: /*.pdf$
Crawl-delay: 2.5
Sitemap: https://a.com/s.xml

User-agent: *
Disallow: /
Allow: /careers"""


def allowed(spark, body, urls, agent="RoleBot/1.0", status=200):
    robots = spark.createDataFrame([("a.com", status, body)], "host string, status int, body string")
    rules = discover.robots_rules(robots, agent)
    u = spark.createDataFrame([(i, x, "a.com") for i, x in enumerate(urls)], "i int, url string, host string")
    return [r["allowed"] for r in discover.robots_allowed(u, rules).orderBy("i").collect()]


def test_robots(spark):
    u = [f"https://a.com{p}" for p in ["/", "/private/x", "/private/ok/1", "/a/b.pdf", "/a/b.pdfx", "/open"]]
    assert allowed(spark, ROBOTS, u) == [True, False, True, False, True, True]
    assert allowed(spark, ROBOTS, ["https://a.com/x", "https://a.com/careers"], "Nobody") == [False, True]
    # A stacked agent line opens a group of its own, so the first of the two has no rules.
    assert allowed(spark, ROBOTS, ["https://a.com/private/x"], "other") == [True]
    assert allowed(spark, "Disallow: /", ["https://a.com/x"]) == [True]
    assert allowed(spark, "", ["https://a.com/x"], status=500) == [False]
    assert allowed(spark, "", ["https://a.com/x"], status=404) == [True]
    assert allowed(spark, "User-agent: *\nDisallow: /a*b*c$\nDisallow:", [f"https://a.com{p}" for p in ["/aXbYc", "/aXbYcZ", "/abc/abc", "/b"]]) == [False, True, False, True]
    delay = discover.robots_rules(spark.createDataFrame([("a.com", ROBOTS)], "host string, body string"), "rolebot").collect()[0]
    assert delay["crawl_delay"] == 2.5


def test_a_host_with_many_rules_and_urls(spark):
    """The join gives what one rule after the other gives, and one row per URL row."""
    rng = random.Random(5)
    parts = ["/a", "/b", "/ab", "/a/b", "/x.pdf", "*", "/*.pdf", "$", "/a*b", "/jobs/"]
    rules = [(rng.random() < 0.4, "".join(rng.sample(parts, rng.randrange(1, 4))).replace("$", "") + rng.choice(["", "", "$"])) for _ in range(300)]
    rules = [(ok, p) for ok, p in rules if p]
    body = "User-agent: *\n" + "\n".join(f"{'Allow' if ok else 'Disallow'}: {p}" for ok, p in rules)
    paths = ["".join(rng.choice(["/a", "/b", "b", "/x.pdf", "/jobs/", "1"]) for _ in range(rng.randrange(0, 6))) for _ in range(200)]
    paths = [p if p.startswith("/") else "/" + p for p in paths] + ["/a", "/a"]

    def matches(pattern, path):
        bare, end = pattern.removesuffix("$"), pattern.endswith("$")
        if "*" not in bare:
            return path == bare if end else path.startswith(bare)
        segments, at = bare.split("*"), 0
        for k, s in enumerate(segments):
            found = path.find(s, at)
            if s and (found < 0 or (k == 0 and found > 0)):
                return False
            at = found + len(s) if s else at
        return path.endswith(segments[-1]) if end else True

    def verdict(path):
        hits = [(len(p), ok) for ok, p in rules if matches(p, path)]
        return max(hits)[1] if hits else True

    urls = [f"https://a.com{p}" for p in paths]
    assert allowed(spark, body, urls) == [verdict(p) for p in paths]
    u = spark.createDataFrame([("https://b.com/x", "b.com"), ("https://c.com/x", None)], "url string, host string")
    unknown = discover.robots_allowed(u, discover.robots_rules(spark.createDataFrame([("a.com", body)], "host string, body string"), "bot"))
    assert [r["allowed"] for r in unknown.collect()] == [False, False]


def test_climbing_stops_at_the_answer(spark, monkeypatch):
    rng = random.Random(6)
    good = "<title>Careers at Acme</title>open positions"
    answers = {1: 1, 2: 2, 3: 5, 4: None, 5: 13, 6: 3}
    ranks = {1: 9, 2: 4, 3: 5, 4: 7, 5: 20, 6: 3}
    fine = {(c, k): bool(answers[c]) and (k == answers[c] or k > answers[c] and rng.random() < 0.5) for c, n in ranks.items() for k in range(1, n + 1)}
    urls = lambda c, k: f"https://acme.com/{'careers' if fine[c, k] else 'p'}/{c}/{k}"
    cands = spark.createDataFrame(
        [(c, "Acme", urls(c, k), "https://acme.com/", "career_site", "sitemap", 2, k) for c, n in ranks.items() for k in range(1, n + 1)],
        "company_id int, company_name string, url string, base string, kind string, source string, tier int, rank int")
    responses = spark.createDataFrame(
        [(urls(c, k), "", 200, "text/html", good if fine[c, k] else "<title>Nothing</title>", False, None, False) for c, n in ranks.items() for k in range(1, n + 1)],
        "url string, final_url string, status int, content_type string, body string, truncated boolean, transport_error string, timed_out boolean")
    judged, whole = [], discover.gate(discover.fetch(cands, responses), strict=False)
    monkeypatch.setattr(discover, "gate", lambda rows, **kw: (judged.append(rows.count()), gate(rows, **kw))[1])
    got = discover.climb(cands, responses)
    assert {r["company_id"]: r["rank"] for r in got.filter("is_answer").collect()} == {c: k for c, k in answers.items() if k}
    want = discover.first_accepted(whole, "company_id", "rank", F.col("gate.status") == "accepted")
    same = ["company_id", "rank", "gate"]
    assert sorted(map(repr, got.select(*same).collect())) == sorted(map(repr, want.select(*same).collect()))
    assert sum(judged) < 2 * want.count() and len(judged) == 4 and judged[0] == 6


def test_robots_hints(spark):
    body = ROBOTS + "\nDisallow: /JOBS/internal # x\nsitemap:\nAllow: /vacancies"
    got = discover.robots_hints(spark.createDataFrame([("a", body)], "host string, body string")).orderBy("line_no").collect()
    assert [(r["hint"], r["value"]) for r in got] == [("sitemap", "https://a.com/s.xml"), ("path", "/careers"), ("path", "/JOBS/internal"), ("path", "/vacancies")]


def test_sitemaps(spark):
    url = lambda *xs: "<urlset>" + "".join(f"<url><loc> {x} </loc></url>" for x in xs) + "</urlset>"
    responses = spark.createDataFrame([
        ("https://a.com/i.xml", 200, "<sitemapindex><sitemap><loc>https://a.com/1.xml</loc></sitemap><sitemap><loc>https://a.com/2.xml</loc></sitemap></sitemapindex>"),
        ("https://a.com/1.xml", 200, url("https://a.com/x/careers", "https://a.com/careers?a=1&amp;b=2", "https://a.com/careers/privacy")),
        ("https://a.com/2.xml", 200, "<sitemapindex><loc>https://a.com/3.xml</loc></sitemapindex>"),
        ("https://b.com/sitemap.xml", 200, url("https://b.com/jobs", "https://b.com/about")),
        ("https://c.com/sitemap.xml", 404, url("https://c.com/jobs")),
    ], "url string, status int, body string")
    origins = spark.createDataFrame([(1, "https://a.com"), (2, "https://b.com"), (3, "https://c.com")], "company_id bigint, origin string")
    declared = spark.createDataFrame([(1, 7, "https://a.com/i.xml")], "company_id bigint, ref_no bigint, ref string")
    got = {(r["company_id"], r["url"]) for r in discover.sitemap_candidates(origins, declared, responses).collect()}
    assert got == {(1, "https://a.com/x/careers"), (1, "https://a.com/careers?a=1&b=2"), (2, "https://b.com/jobs")}


def test_sitemap_limits(spark):
    many = "".join(f"<loc>https://a.com/s{i}.xml</loc>" for i in range(8))
    rows = [("https://a.com/sitemap.xml", 200, f"<sitemapindex>{many}</sitemapindex>")] + [(f"https://a.com/s{i}.xml", 200, f"<urlset><loc>https://a.com/jobs/{i}</loc></urlset>") for i in range(8)]
    responses = spark.createDataFrame(rows, "url string, status int, body string")
    origins = spark.createDataFrame([(1, "https://a.com")], "company_id bigint, origin string")
    none = spark.createDataFrame([], "company_id bigint, ref_no bigint, ref string")
    got = sorted(r["url"] for r in discover.sitemap_candidates(origins, none, responses, max_sitemaps=5).collect())
    assert got == [f"https://a.com/jobs/{i}" for i in range(5)]


def test_first_accepted(spark):
    df = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False), (2, 7, True)], "k int, r int, ok boolean")
    got = sorted((x["k"], x["r"]) for x in discover.first_accepted(df, "k", "r", F.col("ok"), cap=6).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


CLAIMS = [
    ("Apple Inc", "https://www.apple.com/de/", "normal"), ("Apple Inc", "https://www.apple.com/", "normal"), ("Apple Inc", "http://apple.com", "deprecated"),
    ("Apple Inc", "https://www.apple.com/newsroom", "normal"), ("Two", "https://b.example.com/shop", "normal"), ("Pref", "https://x.com/", "normal"), ("Pref", "https://x.com/company/home/page", "preferred"),
]


def test_select_homepage(spark):
    got = {r["title"]: r for r in homepage.select_homepage(spark.createDataFrame(CLAIMS, "title string, url string, rank string")).collect()}
    assert got["Apple Inc"]["url"] == "https://www.apple.com/" and got["Apple Inc"]["rejected"] == 3 and got["Apple Inc"]["bare"]
    assert got["Two"]["reason"] == "no_usable_candidate" and got["Pref"]["rank"] == "preferred"


def test_entity_claims(spark):
    body = """{"entities":{"Q1":{"sitelinks":{"enwiki":{"title":"Apple"}},"claims":{"P856":[{"mainsnak":{"datavalue":{"value":"https://apple.com"}},"rank":"preferred"},
      {"mainsnak":{"datavalue":{"value":"https://a2.com"}}},{"mainsnak":{"datavalue":{"value":7}}},{"mainsnak":{}}]}},"Q2":{"sitelinks":{},"claims":{"P856":[{"mainsnak":{"datavalue":{"value":"x"}}}]}}}}"""
    got = homepage.entity_claims(spark.createDataFrame([(body,)], "body string")).collect()
    assert sorted((r["title"], r["url"], r["rank"]) for r in got) == [("Apple", "https://a2.com", "normal"), ("Apple", "https://apple.com", "preferred")]


def test_rekey_titles(spark):
    canonical = spark.createDataFrame([("AT&T",), ("Meta",), ("Solo",), ("Gone",)], "title string")
    aliases = spark.createDataFrame([("aT&T", "At&t", 1), ("At&t", "AT&T", 2), ("Facebook", "Meta", 3), ("FB", "Meta", 4), ("Lost", "Gone", 5)], "from string, to string, ord int")
    requested = spark.createDataFrame([("aT&T",), ("FB",), ("Solo",)], "title string")
    got = {r["title"]: r["key"] for r in homepage.rekey_titles(canonical, aliases, requested).collect()}
    assert got == {"AT&T": "aT&T", "Meta": "FB", "Solo": "Solo", "Gone": "Gone"}


def test_repeated_captures_do_not_multiply_requests(spark):
    schema = "url string, final_url string, status int, content_type string, body string, truncated boolean, transport_error string, timed_out boolean, captured_at string"
    rows = [("u", "", 500, "t", "late failure", False, None, False, "2"), ("u", "", 200, "t", "early", False, None, False, "1"), ("v", "", 200, "t", "one", False, None, False, "1")]
    responses = spark.createDataFrame(rows, schema)
    asked = spark.createDataFrame([(1, "u"), (2, "v"), (3, "w")], "k int, url string")

    def got(table):
        return sorted((r["k"], r["body"]) for r in discover.fetch(asked, discover.single_responses(table)).collect())

    assert got(responses) == [(1, "late failure"), (2, "one"), (3, None)]
    assert got(responses.drop("captured_at")) == [(1, "early"), (2, "one"), (3, None)]


def test_rekey_long_chains_and_cycles(spark):
    names = spark.createDataFrame([("n200",), ("n0",), ("c1",), ("lone",)], "title string")
    chain = [(f"n{k}", f"n{k + 1}", k) for k in range(200)] + [("c1", "c2", 1), ("c2", "c1", 2)]
    aliases = spark.createDataFrame(chain, "from string, to string, ord int")
    requested = spark.createDataFrame([("n0",)], "title string")
    got = {r["title"]: r["key"] for r in homepage.rekey_titles(names, aliases, requested).collect()}
    assert got == {"n200": "n0", "n0": "n0", "c1": "c1", "lone": "lone"}
    assert homepage.rekey_titles(names, aliases.limit(0), requested).count() == 4


WIKI_A = """intro {{NyseSymbol|ZZZ}}
{| class="wikitable"
! Symbol !! Security !! GICS Sector !! GICS Sub-Industry !! Headquarters Location !! CIK
|-
| {{NyseSymbol|MMM}} || [[3M]] || Industrials || Conglomerates<ref>x</ref> || [[Saint Paul, Minnesota|Saint Paul]] || 0000066740
|-
|{{NasdaqSymbol|COKE}}
|[[Coca-Cola|Coke Company (The)]]
|Staples
|
|'''Atlanta'''
|0000021344
|-
| no ticker || x
|}
{| later
| {{NyseSymbol|NOPE}} || Nope
|}"""
WIKI_B = """{| class="wikitable"
|-
! Symbol
! Security
! GICS Sector
|-
| style="x" | {{NYSE Arca|ABC}} || Plain Name<!-- c --> || Energy || [https://sec.gov/x?action=1&CIK=abc.d f]
|}"""


def test_constituents(spark):
    pages = spark.createDataFrame([("sp500", WIKI_A), ("sp400", WIKI_B), ("none", "text"), ("open", "{|\n| x"), ("over", "{|\n|}|}")], "index string, wikitext string")
    rows, problems = wikitext.constituents(pages)
    got = {(r["index"], r["name"]): r for r in rows.collect()}
    assert set(got) == {("sp500", "3M"), ("sp500", "The Coke Company"), ("sp400", "Plain Name")}
    m = got["sp500", "3M"]
    assert (m["article"], m["industry"], m["sub_industry"], m["headquarters"], m["cik"], m["raw_cik"]) == ("3M", "Industrials", "Conglomerates", "Saint Paul", 66740, "0000066740")
    k = got["sp500", "The Coke Company"]
    assert (k["article"], k["sub_industry"], k["headquarters"], k["cik"]) == ("Coca-Cola", "", "Atlanta", 21344)
    p = got["sp400", "Plain Name"]
    assert (p["industry"], p["cik"], p["raw_cik"]) == ("Energy", 0, "abc.d")
    assert {r["index"]: r["problem"] for r in problems.collect()} == {"none": "no table found", "open": "table is never closed", "over": "table closes more often than it opens"}


def test_constituents_join_nothing(spark):
    """Pages far larger than their estimate were joined by broadcast, and so passed the driver whole."""
    grown = F.concat(F.lit("{|\n! Symbol !! Security !! CIK\n|-\n| {{NyseSymbol|T}} || Firm "), F.col("id").cast("string"), F.lit(" || 0001234567\n\n|- x\n|-\n| {{NASDAQ|U}} || Later\n|}"))
    rows, problems = wikitext.constituents(spark.range(3).select(F.col("id").alias("k"), grown.alias("wikitext")), "k")
    assert sorted((r["k"], r["ordinal"], r["name"], r["cik"]) for r in rows.collect()) == sorted(
        x for k in range(3) for x in [(k, 1, f"Firm {k}", 1234567), (k, 3, "Later", 0)])
    assert problems.count() == 0
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_clean_text(value):
    assert value(wikitext.clean_text(F.lit("{{x|y}} [[A|B]] <ref name=q/>''c'' [https://x.y d e]"))) == "B c d e"


def test_let_binds_once(value):
    assert value(let(F.lit(2), lambda x: x * x + x)) == 6


def test_search_field_errors():
    from rolegrid.operators import runs

    with pytest.raises(ValueError):
        runs.search_steps(None, "x", ["nope"])
