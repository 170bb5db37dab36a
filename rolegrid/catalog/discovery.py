"""Registered queries: gate, robots, sitemaps, ladder steps, alias chains, raw scans, wikitext."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolegrid import vocab
from rolegrid.catalog.registry import Tables, query
from rolegrid.functions import times
from rolegrid.functions import urls as U
from rolegrid.operators import discover, homepage, logs, runs, wikitext
from rolegrid.operators.gate import gate
from rolegrid.session import cut
from rolegrid.sources import captures, feed, postings, registry, traces

# Ten kinds of response over the whole page table; the judged bodies are the pages themselves.
_GATE_URL = "(CASE page_id % 10 WHEN 6 THEN 'https://www.example.com/careers/' || CAST(page_id AS STRING) WHEN 7 THEN 'https://www.example.com/en-us' ELSE url END)"


@query("f24_f25_gate_over_pages", rf"""
WITH p AS (SELECT page_id, page_id % 10 AS m, lower(html) AS b, lower(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g')) AS t,
                  lower(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) AS h FROM pages),
s AS (SELECT *, regexp_matches(t, '{"|".join(vocab.CAREERS_TEXT_TOKENS)}') OR regexp_matches(h, '{"|".join(vocab.CAREERS_TEXT_TOKENS)}') OR regexp_matches(b, '{"|".join(vocab.OPENINGS_PHRASES)}') AS signal FROM p)
SELECT page_id, CASE m WHEN 0 THEN 'forbidden' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'http_500' WHEN 3 THEN 'timeout' WHEN 4 THEN 'empty_body' WHEN 5 THEN 'bot_challenge' WHEN 6 THEN 'html_careers'
   WHEN 7 THEN 'locale_only_path' WHEN 8 THEN 'html_homepage' ELSE CASE WHEN signal THEN 'html_careers' ELSE 'no_careers_signal' END END AS reason,
   CASE WHEN m IN (6, 8) OR (m = 9 AND signal) THEN 'accepted' WHEN m = 3 THEN 'error' ELSE 'rejected' END AS status FROM s""")
def _f24(t: Tables):
    m = F.col("page_id") % 10
    rows = t.pages.select(
        "page_id", F.expr(_GATE_URL).alias("url"), F.lit(None).cast("string").alias("base"), F.when(m == 8, "website").otherwise("career_site").alias("kind"),
        F.lit("sitemap").alias("source"), F.lit("Example Inc").alias("company_name"),
        F.when(m == 0, 403).when(m == 1, 429).when(m == 2, 500).when(m == 3, 0).otherwise(200).alias("status"), F.lit("").alias("response_url"), F.lit("text/html").alias("content_type"),
        F.when(m == 4, F.lit(" \n")).when(m == 5, F.concat(F.lit("<p>Checking your browser</p>"), "html")).otherwise(F.col("html")).alias("body"),
        F.when(m == 3, "late").alias("transport_error"), (m == 3).alias("timed_out"))
    return gate(rows, strict=False).select("page_id", "gate.reason", "gate.status")


@query("w14_first_accepted_ends_the_ladder", """
WITH r AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, event_type = 'purchase' AND value > 20 AS ok FROM events),
s AS (SELECT k, min(rank) FILTER (ok AND rank <= 12) AS stop FROM r GROUP BY k)
SELECT k, CAST(rank AS BIGINT) AS rank FROM r JOIN s USING (k) WHERE rank <= 12 AND (stop IS NULL OR rank <= stop)""")
def _w14(t: Tables):
    from rolegrid.operators.ranking import top_k

    ranked = top_k(t.events.withColumn("k", F.col("user_id")), ["k"], ["event_id"], 12, "rank")
    return discover.first_accepted(ranked, "k", "rank", (F.col("event_type") == "purchase") & (F.col("value") > 20), 12).select("k", "rank")


@query("j17_w16_f42_robots_evaluation", """
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS h, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS p FROM pages)
SELECT page_id, CASE WHEN ends_with(h, '.org') THEN true WHEN ends_with(h, '.net') THEN false WHEN ends_with(p, '.html') THEN false WHEN starts_with(p, '/en/8') THEN true WHEN starts_with(p, '/en/') THEN false ELSE true END AS allowed FROM p""")
def _j17(t: Tables):
    pages = t.pages.select("page_id", "url", U.host("url").alias("host"))
    com = "User-agent: *  # everyone\nDisallow: /en/\nAllow: /en/8\nDisallow: /*.html$\nCrawl-delay: 2"
    net = "User-agent: Other\nUser-agent: RoleBot\nDisallow: /\n\nUser-agent: *\nDisallow: /fr"
    robots = pages.select("host").distinct().select(
        "host", F.when(F.col("host").endswith(".org"), 404).otherwise(200).alias("status"), F.when(F.col("host").endswith(".net"), F.lit(net)).otherwise(F.lit(com)).alias("body"))
    return discover.robots_allowed(pages, discover.robots_rules(robots, "RoleBot/1.0")).select("page_id", "allowed")


@query("f41_robots_hints", """
SELECT page_id, 'sitemap' AS hint, 'https://h.example.com/' || page_id || '.xml' AS value FROM pages UNION ALL SELECT page_id, 'path', '/Jobs/' || page_id FROM pages""")
def _f41(t: Tables):
    body = F.concat(F.lit("# head\nSiteMap: https://h.example.com/"), F.col("page_id").cast("string"), F.lit(".xml # note\nDisallow: /Jobs/"), F.col("page_id").cast("string"), F.lit("\nAllow: /x\nsitemap:\nnothing"))
    return discover.robots_hints(t.pages.select("page_id", body.alias("body")), "page_id").select("page_id", "hint", "value")


@query("f40_sitemap_careers_urls", """
SELECT page_id, 'https://x.example.com/careers/' || page_id || '?a=1&b=2' AS loc FROM pages WHERE page_id % 3 <> 2""")
def _f40(t: Tables):
    n = F.col("page_id").cast("string")
    root = F.when(F.col("page_id") % 3 == 0, "urlset").when(F.col("page_id") % 3 == 1, "sitemapindex").otherwise("other")
    body = F.concat(F.lit("<?xml?><"), root, F.lit(' xmlns="s"><url><loc>\n https://x.example.com/careers/'), n, F.lit("?a=1&amp;b=2 </loc></url><url><loc>https://x.example.com/careers/privacy</loc></url><loc>https://x.example.com/about</loc></x>"))
    locs = discover.sitemap_locs(t.pages.select("page_id", body.alias("body")))
    return locs.filter(discover.is_careers_loc("loc")).select("page_id", "loc")


@query("j12_candidates_join_responses", """
WITH q AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000, url || '/gone' FROM pages)
SELECT q.page_id AS request_id, CASE WHEN p.page_id IS NULL THEN NULL ELSE 200 END AS status, CASE WHEN p.page_id IS NULL THEN 'not fetched' END AS transport_error FROM q LEFT JOIN (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url) p ON p.url = q.url""")
def _j12(t: Tables):
    responses = t.pages.groupBy("url").agg(F.min("page_id").alias("page_id")).select(
        "url", F.lit("").alias("final_url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.lit("x").alias("body"), F.lit(False).alias("truncated"),
        F.lit(None).cast("string").alias("transport_error"), F.lit(False).alias("timed_out"))
    asked = t.pages.select(F.col("page_id").alias("request_id"), "url")
    gone = t.pages.select((F.col("page_id") + 1000000).alias("request_id"), F.concat("url", F.lit("/gone")).alias("url"))
    return discover.fetch(asked.unionByName(gone), responses).select("request_id", "status", "transport_error")


@query("j14_alias_rekeying", """
WITH RECURSIVE e AS (SELECT p_partkey + 1 AS node, p_partkey AS prev FROM part WHERE p_size > 25),
w AS (SELECT p_partkey AS title, p_partkey AS node, 0 AS depth FROM part UNION ALL SELECT w.title, e.prev, depth + 1 FROM w JOIN e ON e.node = w.node),
o AS (SELECT title, arg_max(node, depth) AS origin FROM w GROUP BY title)
SELECT 'T' || o.title AS title, CASE WHEN p.p_size <= 25 THEN 'T' || o.origin ELSE 'T' || o.title END AS key FROM o JOIN part p ON p.p_partkey = o.origin""")
def _j14(t: Tables):
    name = lambda c: F.concat(F.lit("T"), c.cast("string"))
    aliases = t.part.filter("p_size > 25").select(name(F.col("p_partkey")).alias("from"), name(F.col("p_partkey") + 1).alias("to"), F.col("p_partkey").alias("ord"))
    canonical = t.part.select(name(F.col("p_partkey")).alias("title"))
    requested = t.part.filter("p_size <= 25").select(name(F.col("p_partkey")).alias("title"))
    return homepage.rekey_titles(canonical, aliases, requested)


@query("s1_feed_scan", """
WITH b AS (SELECT event_id, event_type, props FROM events)
SELECT event_id, CAST(i AS BIGINT) AS idx, element FROM (SELECT event_id, unnest([props, '1e3', '"a,]b"', '[ 1, {"x":2.50} ]']) AS element, unnest([0, 1, 2, 3]) AS i FROM b WHERE event_type IN ('click', 'view'))""")
def _s1(t: Tables):
    body = F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit(" [ "), "props", F.lit(' ,1e3, "a,]b",[ 1, {"x":2.50} ] ]\n'))).when(F.col("event_type") == "error", "null").when(F.col("event_type") == "signup", F.col("props")).otherwise("[oops")
    return feed.scan_feed(t.events.select("event_id", body.alias("body")))[0]


@query("s1_feed_rejects", "SELECT event_id FROM events WHERE event_type IN ('signup', 'purchase')")
def _s1r(t: Tables):
    body = F.when(F.col("event_type").isin("click", "view"), F.lit("[]")).when(F.col("event_type") == "error", "null").when(F.col("event_type") == "signup", F.col("props")).otherwise("[oops")
    return feed.scan_feed(t.events.select("event_id", body.alias("body")))[1].select("event_id")


@query("s7_log_stream_flatten", """
SELECT CAST(1700000000000000000 + event_id AS BIGINT) AS ts_ns, event_type AS app, 'line ' || props AS line FROM events ORDER BY event_id DESC LIMIT 0""".replace("ORDER BY event_id DESC LIMIT 0", "ORDER BY ts_ns LIMIT 500"))
def _s7(t: Tables):
    line = F.to_json(F.struct(F.concat(F.lit("line "), "props").alias("l")))
    body = F.concat(F.lit('{"data":{"result":[{"stream":{"app":"'), "event_type", F.lit('"},"values":[["'), (F.lit(1700000000000000000) + F.col("event_id")).cast("string"), F.lit('",'), F.substring(line, F.lit(6), F.length(line) - 6), F.lit('],["bad","x"],["5"],7]}]}}'))
    out = logs.flatten_streams(t.events.select(body.alias("body")), limit=500)
    return out.select("ts_ns", F.try_element_at("labels", F.lit("app")).alias("app"), "line")


@query("s5_s6_run_log_attribution", """
WITH own AS (SELECT user_id AS run_id, event_id AS line_no, 'own ' || props AS line FROM events WHERE event_type = 'view' AND value > 120),
sw AS (SELECT CAST(floor(event_id / 2000) AS BIGINT) + 100000000 AS parent, event_id AS line_no, 'x run_id=' || user_id || ' y' AS line, user_id AS run_id FROM events WHERE event_type = 'click'),
asked AS (SELECT DISTINCT user_id AS run_id FROM events UNION SELECT user_id + 500000000 FROM events WHERE event_type = 'error'),
orphan AS (SELECT run_id FROM asked WHERE run_id NOT IN (SELECT run_id FROM own)), newest AS (SELECT run_id, max(parent) AS parent FROM sw WHERE run_id IN (SELECT run_id FROM orphan) GROUP BY 1)
SELECT run_id, line_no, 'own' AS origin FROM own UNION ALL SELECT s.run_id, line_no, 'parent_batch:' || s.parent FROM sw s JOIN newest n ON n.run_id = s.run_id AND n.parent = s.parent
UNION ALL SELECT run_id, NULL, 'not_found' FROM orphan WHERE run_id NOT IN (SELECT run_id FROM newest)""")
def _s6(t: Tables):
    own = t.events.filter("event_type = 'view' AND value > 120").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), F.concat(F.lit("own "), "props").alias("line"))
    clicks = t.events.filter("event_type = 'click'").select(
        (F.floor(F.col("event_id") / 2000).cast("bigint") + 100000000).alias("run_id"), F.col("event_id").alias("line_no"), F.concat(F.lit("x run_id="), F.col("user_id").cast("string"), F.lit(" y")).alias("line"))
    asked = t.events.select(F.col("user_id").alias("run_id")).union(t.events.filter("event_type = 'error'").select(F.col("user_id") + 500000000)).distinct()
    return traces.attribute_logs(own.unionByName(clicks), asked, clicks.select("run_id").distinct()).select("run_id", "line_no", "origin")


@query("s4_trace_line_scan", """
SELECT event_id, event_type AS event, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS step, epoch_us(date_trunc('second', ts)) AS ts FROM events WHERE event_type NOT IN ('error', 'view')""")
def _s4(t: Tables):
    good = F.concat(F.lit('{"event":"'), "event_type", F.lit('","step":'), F.regexp_extract("props", "[0-9]+", 0), F.lit(',"ts":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}'))
    value = F.when(F.col("event_type") == "error", F.lit("{broken")).when(F.col("event_type") == "view", F.lit("  ")).otherwise(good)
    return traces.parse_trace_lines(t.events.select("event_id", value.alias("value"))).select("event_id", "event", "step", F.unix_micros("ts").alias("ts"))


@query("s12_evidence_paths", r"""
SELECT id, 'raw/careers/company-' || company_id || '/' || run_id || '/' || attempt_index || '-site.example.com.' || CASE WHEN validation_status = 'accepted' THEN 'json' ELSE 'html' END AS path FROM attempts""")
def _s12(t: Tables):
    kind = F.when(F.col("validation_status") == "accepted", "application/JSON").otherwise("text/html")
    return t.attempts.select("id", captures.evidence_path(F.concat(F.lit("Company "), F.col("company_id").cast("string")), "run_id", "attempt_index", "candidate_url", kind).alias("path"))


@query("w15_f35_f36_constituents", """
SELECT c_custkey AS k, 'The Firm ' || c_custkey AS name, 'Firm ' || c_custkey AS article, c_mktsegment AS industry, CAST(1000000 + c_custkey AS BIGINT) AS cik FROM customer WHERE c_acctbal >= 0""")
def _f36(t: Tables):
    n = F.col("c_custkey").cast("string")
    text = F.concat(
        F.lit('intro\n{| class="wikitable"\n! Symbol !! Security !! GICS Sector !! CIK\n|-\n| {{NyseSymbol|T'), n, F.lit("}} || [[Firm "), n, F.lit("|Firm "), n, F.lit(" (The)]]<ref>r</ref>\n| ''"), "c_mktsegment",
        F.lit("'' || 000"), (F.col("c_custkey") + 1000000).cast("string"), F.lit("\n|-\n| none || x\n"), F.when(F.col("c_acctbal") >= 0, "|}").otherwise(""), F.lit("\n{|\n| {{NyseSymbol|ZZ}} || Later\n|}"))
    pages = t.customer.select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") >= 0, text).otherwise(F.concat(F.lit("{|\n"), text)).alias("wikitext"))
    rows = wikitext.constituents(pages, "k")[0]
    return rows.filter("name LIKE 'The Firm%'").select("k", "name", "article", "industry", "cik")


@query("f38_entity_claims", """
SELECT 'Firm ' || c_custkey AS title, 'https://f' || c_custkey || '.example.com' AS url, CASE WHEN c_acctbal > 5000 THEN 'preferred' ELSE 'normal' END AS rank FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def _f38(t: Tables):
    n = F.col("c_custkey").cast("string")
    rank = F.when(F.col("c_acctbal") > 5000, F.lit(',"rank":"preferred"')).otherwise("")
    title = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.concat(F.lit("Firm "), n))
    body = F.concat(F.lit('{"entities":{"Q'), n, F.lit('":{"sitelinks":{"enwiki":{"title":"'), title, F.lit('"}},"claims":{"P856":[{"mainsnak":{"datavalue":{"value":"https://f'), n, F.lit('.example.com"}}'), rank, F.lit('},{"mainsnak":{"datavalue":{"value":5}}}]}}}}'))
    return homepage.entity_claims(t.customer.select(body.alias("body"))).select("title", "url", "rank")


@query("f51_step_lines", """
SELECT event_id, CASE WHEN value < 5 THEN NULL ELSE event_type || ',wait' END AS actions, CASE WHEN value < 5 THEN NULL ELSE CAST(2 AS BIGINT) END AS action_count FROM events""")
def _f51(t: Tables):
    acts = F.when(F.col("value") < 5, F.array().cast("array<map<string,int>>")).otherwise(F.array(F.create_map("event_type", F.lit(1)), F.create_map(F.lit("wait"), F.lit(2))))
    line = runs.step_line({"step": F.col("event_id"), "url": F.lit(""), "actions": acts})
    return t.events.select("event_id", line.alias("l")).select("event_id", F.array_join("l.actions", ",").alias("actions"), "l.action_count")


# --- ladder, homepage choice, extractor files, sessions -----------------------------------------

_ORIGIN = "'https://s' || page_id || '.example.com'"


def _origin(tail: str = ""):
    return F.concat(F.lit("https://s"), F.col("page_id").cast("string"), F.lit(".example.com" + tail))


def _sitemaps(t: Tables):
    """Declared (even pages) or conventional sitemaps; every third is an index of seven children."""
    n = t.pages.select("page_id", F.char_length("html").cast("string").alias("size"))
    ref = F.when(F.col("page_id") % 2 == 0, _origin("/map.xml")).otherwise(_origin("/sitemap.xml"))
    child = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.concat(F.lit("<sitemap><loc>"), _origin("/c"), k.cast("string"), F.lit(".xml</loc></sitemap>"))), "")
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<sitemapindex>"), child, F.lit("</sitemapindex>"))).otherwise(
        F.concat(F.lit("<urlset><loc>"), _origin("/jobs/"), "size", F.lit("</loc><loc>"), _origin("/about"), F.lit("</loc></urlset>")))
    tops = n.select(ref.alias("url"), body.alias("body"))
    leaves = n.filter("page_id % 3 = 0").select("page_id", "size", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k")).select(
        F.concat(_origin("/c"), F.col("k").cast("string"), F.lit(".xml")).alias("url"),
        F.concat(F.lit("<urlset><loc>"), _origin("/careers/"), F.col("k").cast("string"), F.lit("-"), "size", F.lit("</loc></urlset>")).alias("body"))
    origins = t.pages.select(F.col("page_id").alias("company_id"), _origin().alias("origin"))
    declared = t.pages.filter("page_id % 2 = 0").select(F.col("page_id").alias("company_id"), F.lit(3).cast("bigint").alias("ref_no"), _origin("/map.xml").alias("ref"))
    return origins, declared, tops.unionByName(leaves).withColumn("status", F.lit(200))


_SITEMAP_SQL = f"""
WITH p AS (SELECT page_id, {_ORIGIN} AS o, length(html) AS size, CASE WHEN page_id % 2 = 0 THEN {_ORIGIN} || '/map.xml' ELSE {_ORIGIN} || '/sitemap.xml' END AS ref FROM pages)
SELECT page_id AS company_id, ref AS base, o || '/jobs/' || size AS url, CAST(0 AS BIGINT) AS sub_no FROM p WHERE page_id % 3 <> 0
UNION ALL SELECT page_id, ref, o || '/careers/' || k || '-' || size, k FROM p, range({{n}}) AS r(k) WHERE page_id % 3 = 0"""


@query("j21_sitemap_candidates", _SITEMAP_SQL.format(n=7))
def _j21(t: Tables):
    return discover.sitemap_candidates(*_sitemaps(t)).select("company_id", "base", "url", "sub_no")


@query("j21_sitemap_candidates_capped", _SITEMAP_SQL.format(n=5))
def _j21c(t: Tables):
    return discover.sitemap_candidates(*_sitemaps(t), max_sitemaps=5).select("company_id", "base", "url", "sub_no")


_LADDER_SQL = f"""
WITH p AS (SELECT page_id, {_ORIGIN} AS o, length(html) AS size FROM pages)
SELECT page_id AS company_id, CAST(1 AS BIGINT) AS rank, o || '/careers' AS url, 'nav_anchor' AS source FROM p
UNION ALL SELECT page_id, 2, o || '/careers/' || size, 'sitemap' FROM p UNION ALL SELECT page_id, 3, o || '/jobs/x', 'robots_path' FROM p"""


def _ladder(t: Tables, **caps):
    size = F.char_length("html").cast("string")
    rows = t.pages.select("page_id", F.explode(F.array(
        F.struct(_origin("/").alias("url"), F.concat(F.lit('<title>Example</title><nav><a href="/careers">Careers</a></nav>'), "html").alias("body")),
        F.struct(_origin("/robots.txt").alias("url"), F.concat(F.lit("Sitemap: "), _origin("/map.xml"), F.lit("\nUser-agent: *\nDisallow: /jobs/x\n")).alias("body")),
        F.struct(_origin("/map.xml").alias("url"), F.concat(F.lit("<urlset><loc>"), _origin("/careers"), F.lit("</loc><loc>"), _origin("/careers/"), size, F.lit("</loc></urlset>")).alias("body")),
    )).alias("r")).select("r.*")
    responses = rows.select(
        "url", F.lit("").alias("final_url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), "body",
        F.lit(False).alias("truncated"), F.lit(None).cast("string").alias("transport_error"), F.lit(False).alias("timed_out"))
    companies = t.pages.select(F.col("page_id").alias("company_id"), F.lit("Example Group").alias("name"), _origin("/").alias("website"))
    responses = cut(responses)
    homes = cut(discover.homepage_attempts(companies, responses))
    return discover.ladder_candidates(homes, responses, **caps).select("company_id", "rank", "url", "source")


@query("j22_u1_ladder_candidates", _LADDER_SQL)
def _j22(t: Tables):
    return _ladder(t)


@query("j22_ladder_candidates_capped", f"SELECT * FROM ({_LADDER_SQL}) WHERE rank <= 2")
def _j22c(t: Tables):
    return _ladder(t, max_candidates=2)


@query("o10_best_homepage", """
WITH p AS (SELECT page_id % 40 AS grp, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS h, list_filter(string_split(lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '/'), lambda s: s <> '') AS l,
  CASE page_id % 3 WHEN 0 THEN 'preferred' WHEN 1 THEN 'normal' ELSE 'deprecated' END AS rank FROM pages),
s AS (SELECT *, CASE WHEN rank <> 'deprecated' THEN CAST(CASE rank WHEN 'preferred' THEN 1000 ELSE 0 END + CASE WHEN len(l) = 0 THEN 100 ELSE -10 END
   + CASE WHEN starts_with(url, 'https') THEN 20 ELSE 1 END - 5 * len(l) - 5 * greatest(0, length(h) - length(replace(h, '.', '')) - 1) + CASE WHEN contains(h, 'example') THEN 100 ELSE 0 END AS BIGINT) END AS score FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC NULLS LAST, contains(h, 'example') DESC, length(url), url, rank) AS rn, count(*) FILTER (score IS NULL) OVER (PARTITION BY grp) AS rejected FROM s)
SELECT grp, CASE WHEN score IS NOT NULL THEN url END AS url, score, rejected, CASE WHEN score IS NULL THEN 'no_usable_candidate' ELSE '' END AS reason FROM b WHERE rn = 1""")
def _o10(t: Tables):
    claims = t.pages.select((F.col("page_id") % 40).alias("grp"), "url", F.expr("CASE page_id % 3 WHEN 0 THEN 'preferred' WHEN 1 THEN 'normal' ELSE 'deprecated' END").alias("rank"), F.lit("The Example Group").alias("title"))
    return homepage.select_homepage(claims, key="grp").select("grp", "url", "score", "rejected", "reason")


@query("s10_extractor_postings", """
SELECT url AS listings_url, length(html) AS total_links, CAST(k AS BIGINT) AS ordinal, url || '/' || k AS url, 'Role ' || k || ' "q"' AS title FROM pages, range(3) AS r(k)""")
def _s10(t: Tables):
    jobs = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(F.concat("url", F.lit("/"), k.cast("string")).alias("url"), F.concat(F.lit("Role "), k.cast("string"), F.lit(' "q"')).alias("title")))
    body = F.to_json(F.struct(F.col("url").alias("listings_url"), F.char_length("html").alias("total_links"), jobs.alias("jobs")))
    files = t.pages.select(F.from_json(body, postings.POSTINGS_SCHEMA).alias("f")).select("f.*")
    return postings.explode_postings(files).select("listings_url", "total_links", "ordinal", "url", "title")


@query("s14_playbook_patterns", """
SELECT c_custkey, n_name AS vendor, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey < 20 THEN n_name || '/([0-9]+)' ELSE '' END AS pattern FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _s14(t: Tables):
    books = t.nation.filter("n_nationkey < 20").select(F.col("n_name").alias("vendor"), F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit("/([0-9]+)"))).alias("external_id_pattern"))
    vendors = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("vendor"))
    return registry.with_pattern(vendors, books).select("c_custkey", "vendor", "pattern")


@query("f48_window_start", """
SELECT event_id, epoch_us(ts) - 5400000000 AS m90, epoch_us(ts) - 7200000000 AS h2, epoch_us(ts) - 604800000000 AS d7, epoch_us(ts) - 604800000000 AS w1, epoch_us(ts) - 86400000000 AS missing FROM events""")
def _f48(t: Tables):
    start = lambda w: F.unix_micros(times.window_start(w, "ts"))
    return t.events.select("event_id", start("90m").alias("m90"), start("2h").alias("h2"), start("7d").alias("d7"), start("1w").alias("w1"), start(None).alias("missing"))


@query("t8_run_sessions_batch_twin", """
WITH l AS (SELECT run_id, ts, msg, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 20 MINUTE THEN 1 ELSE 0 END AS opens FROM log_lines WINDOW w AS (PARTITION BY run_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM l)
SELECT run_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) + 1200000000 AS session_end, count(*) AS lines, count(*) FILTER (msg = 'agent step') AS agent_steps,
       count(*) FILTER (msg = 'listing stored') AS listings_stored, coalesce(bool_or(msg = 'agent failed'), false) AS agent_failed, coalesce(bool_or(msg = 'summary'), false) AS finished FROM s GROUP BY run_id, session""")
def _t8(t: Tables):
    from rolegrid.streaming.logs import run_sessions

    out = run_sessions(t.log_lines)
    return out.withColumns({n: F.unix_micros(n) for n in ("session_start", "session_end")})
