"""Registered queries: URLs, page text, links, vendors, block pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolegrid import vocab
from rolegrid.catalog.registry import Tables, query
from rolegrid.functions import html as H
from rolegrid.functions import present as P
from rolegrid.functions import text as T
from rolegrid.functions import urls as U
from rolegrid.functions.base import squeeze
from rolegrid.operators import discover, homepage, ranking
from rolegrid.operators.gate import attempt_state, category, should_escalate


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --- URLs ---------------------------------------------------------------------------------------

_RAW_URL = """(CASE page_id % 7 WHEN 0 THEN ' ' || url || ' ' WHEN 1 THEN replace(url, 'http', 'ftp') WHEN 2 THEN replace(url, '://', ':///') WHEN 3 THEN url || '/%zz' WHEN 4 THEN upper(url) ELSE url END)"""


@query("f1_parse_http_url", f"""
WITH u AS (SELECT page_id, trim({_RAW_URL}) AS x FROM pages)
SELECT page_id, CASE WHEN regexp_matches(x, '^(?i:https?)://[^/?# ]') AND NOT regexp_matches(x, '^[^?]*%([^0-9A-Fa-f]|[0-9A-Fa-f]([^0-9A-Fa-f]|$)|$)') THEN x END AS url FROM u""")
def _f1(t: Tables):
    return t.pages.select("page_id", U.parse_http_url(F.expr(_RAW_URL)).alias("url"))


_HREFS = """(CASE page_id % 8 WHEN 0 THEN '/a/../b/./c' || CAST(page_id AS STRING) WHEN 1 THEN 'x/../y?z=1#q' WHEN 2 THEN '?q=' || CAST(page_id AS STRING) WHEN 3 THEN '//cdn.example.com/z' WHEN 4 THEN 'HTTPS://Other.example.org/k?x=1#f' WHEN 5 THEN '#top' WHEN 6 THEN ' JavaScript:void(0)' ELSE 'deep/' || CAST(page_id AS STRING) END)"""


@query("f2_resolve_url", f"""
WITH u AS (SELECT page_id, url, page_id % 8 AS m, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
v AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS dir FROM u)
SELECT page_id, CASE m WHEN 0 THEN root || '/b/c' || page_id WHEN 1 THEN root || dir || 'y?z=1' WHEN 2 THEN root || path || '?q=' || page_id
   WHEN 3 THEN regexp_extract(url, '^https?:', 0) || '//cdn.example.com/z' WHEN 4 THEN 'https://Other.example.org/k?x=1' WHEN 7 THEN root || dir || 'deep/' || page_id END AS link FROM v""")
def _f2(t: Tables):
    return t.pages.select("page_id", U.resolve_url("url", F.expr(_HREFS)).alias("link"))


@query("f3_f4_host_and_base_domain", r"""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, host, regexp_extract(host, '[^.]+\.[^.]+$', 0) AS base, host = 'ththth.example.net' AS is_wanted FROM h""")
def _f3(t: Tables):
    h = t.pages.withColumn("host", U.host(F.upper("url")))
    return h.select("page_id", F.when(F.col("host") != "", F.col("host")).otherwise("").alias("host"), U.base_domain("host").alias("base"),
                    U.same_host("url", F.lit("THTHTH.example.net")).alias("is_wanted"))


_MESSY = "(regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'z=9~*&a=' || CAST(page_id AS STRING) || '&mc_eid=4&b=%20x&UTM_q=1#frag')"


@query("f5_normalise_url", f"""
WITH u AS (SELECT page_id, {_MESSY} AS x FROM pages),
p AS (SELECT page_id, regexp_replace(x, '[?].*$', '') AS head, regexp_extract(x, '[?]([^#]*)', 1) AS q FROM u),
kv AS (SELECT page_id, head, list_sort(list_filter(string_split(q, '&'), lambda s: NOT regexp_matches(lower(string_split(s, '=')[1]), '^(utm_|mc_|ref$|source$|bc$)'))) AS l FROM p)
SELECT page_id, head || '?' || replace(replace(array_to_string(l, '&'), '%20', '+'), '*', '%2A') AS url FROM kv""")
def _f5(t: Tables):
    return t.pages.select("page_id", U.normalise_url(F.expr(_MESSY)).alias("url"))


@query("f5_normalise_is_idempotent", "SELECT count(*) AS pages, count(*) AS stable FROM pages")
def _f5i(t: Tables):
    once = t.pages.select(U.normalise_url(F.expr(_MESSY)).alias("a")).withColumn("b", U.normalise_url("a"))
    return once.agg(F.count("*").alias("pages"), F.count_if(F.col("a") == F.col("b")).alias("stable"))


@query("f6_same_url", """
SELECT page_id, NOT contains(url, 'page=') AS same FROM pages""")
def _f6(t: Tables):
    bare = F.regexp_replace("url", "[?#].*$", "")
    return t.pages.select("page_id", U.same_url("url", F.concat(bare, F.lit("?utm_source=x#y"))).alias("same"))


@query("f7_path_segments_and_depth", """
WITH p AS (SELECT page_id, list_filter(string_split(lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '/'), lambda s: s <> '') AS l FROM pages)
SELECT page_id, array_to_string(l, '|') AS segments, CAST(len(l) AS BIGINT) AS depth FROM p""")
def _f7(t: Tables):
    return t.pages.select("page_id", F.array_join(U.path_segments("url"), "|").alias("segments"), U.path_depth("url").alias("depth"))


_WORD_URL = "('https://x.example.com/' || regexp_replace(lower(p_name), '[^a-z]', '-') || CASE p_type WHEN 'ECONOMY' THEN '/careers-hub/Jobs_1' WHEN 'SMALL' THEN '/our-careers' WHEN 'STANDARD' THEN '/vacancy' WHEN 'LARGE' THEN '/join-us' ELSE '/ir' END)"


@query("f8_careers_word_rules", f"""
WITH s AS (SELECT p_partkey, lower(regexp_extract({_WORD_URL}, 'com(/.*)$', 1)) AS path FROM part)
SELECT p_partkey, regexp_matches(path, '/(career|job|join|employment|opportunit|hiring|vacanc)') AS prefix_rule,
       regexp_matches(path, 'career|job|join|employment|opportunit|hiring') AS contained_rule,
       regexp_matches(path, 'career|job|employment|vacanc|hiring|opportunit') AS anywhere_rule,
       regexp_matches(path, '/((careers|career|jobs|job|vacancies|vacancy)([-_][^/]*)?|join|join-us|joinus|hiring|employment)(/|$)') AS word_rule FROM s""")
def _f8(t: Tables):
    s = t.part.select("p_partkey", F.expr(_WORD_URL).alias("u")).withColumn("s", U.path_segments("u"))
    return s.select("p_partkey", U.has_prefix_token(F.col("s")).alias("prefix_rule"), U.has_contained_token(F.col("s")).alias("contained_rule"),
                    U.robots_path_hint(U.path_of("u")).alias("anywhere_rule"), U.has_careers_segment(F.col("s")).alias("word_rule"))


_LOCALE_URL = "(CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '/[0-9]+.*$', '') WHEN 1 THEN 'https://x.example.com/en-us/de' WHEN 2 THEN 'https://x.example.com/news' ELSE url END)"


@query("f9_locale_only_paths", f"""
WITH p AS (SELECT page_id, list_filter(string_split(lower(regexp_extract({_LOCALE_URL}, '^https?://[^/?#]*([^?#]*)', 1)), '/'), lambda s: s <> '') AS l FROM pages)
SELECT page_id, len(l) > 0 AND len(list_filter(l, lambda s: NOT regexp_full_match(s, '[a-z]{{2}}([-_][a-z]{{2,4}})?'))) = 0 AS gate_rule,
       len(l) > 0 AND len(list_filter(l, lambda s: NOT regexp_full_match(s, '[a-z_-]{{2,5}}'))) = 0 AS homepage_rule FROM p""")
def _f9(t: Tables):
    s = t.pages.withColumn("s", U.path_segments(F.expr(_LOCALE_URL)))
    return s.select("page_id", U.is_locale_only_gate(F.col("s")).alias("gate_rule"), U.is_locale_only_homepage(F.col("s")).alias("homepage_rule"))


_PATHY = "('https://x.example.com/' || CASE p_size % 5 WHEN 0 THEN 'privacy-policy/x' WHEN 1 THEN 'Careers/faq' WHEN 2 THEN 'news/a' WHEN 3 THEN 'about' ELSE replace(p_name, ' ', '/') END)"


@query("f12_boilerplate_and_non_homepage", f"""
WITH p AS (SELECT p_partkey, list_filter(string_split(lower(regexp_extract({_PATHY}, 'com/(.*)$', 1)), '/'), lambda s: s <> '') AS l FROM part)
SELECT p_partkey, list_has_any(l, ['privacy-policy', 'faq', 'contact', 'search']) AS boilerplate, list_has_any(l, ['news', 'about', 'careers', 'store', 'contact']) AS non_homepage FROM p""")
def _f12(t: Tables):
    s = t.part.withColumn("s", U.path_segments(F.expr(_PATHY)))
    return s.select("p_partkey", U.is_boilerplate_path(F.col("s")).alias("boilerplate"), U.is_non_homepage_path(F.col("s")).alias("non_homepage"))


@query("f10_f11_path_kinds", """
WITH p AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'press-kit' WHEN 'SMALL' THEN 'career-events' WHEN 'STANDARD' THEN 'events' WHEN 'LARGE' THEN 'help' ELSE 'x' END AS seg FROM part)
SELECT p_partkey, seg IN ('press-kit', 'help') AS product_path, CASE seg WHEN 'press-kit' THEN 'press' WHEN 'events' THEN 'event' END AS wrong_kind FROM p""")
def _f10(t: Tables):
    u = F.concat(F.lit("https://x.example.com/"), F.expr("CASE p_type WHEN 'ECONOMY' THEN 'press-kit' WHEN 'SMALL' THEN 'career-events' WHEN 'STANDARD' THEN 'events' WHEN 'LARGE' THEN 'help' ELSE 'x' END"))
    return t.part.select("p_partkey", U.is_product_or_investor(u, F.lit("sitemap")).alias("product_path"), U.wrong_kind_token(u).alias("wrong_kind"))


# --- text ---------------------------------------------------------------------------------------


@query("f13_slugify", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def _f13(t: Tables):
    return t.documents.select("doc_id", T.slugify("text").alias("slug"))


@query("f14_f15_distinctive_token", f"""
WITH w AS (SELECT p_partkey, p_name || ' ' || p_type || ' Holdings, Inc' AS n FROM part),
l AS (SELECT p_partkey, n, list_filter(regexp_split_to_array(n, '[^A-Za-z0-9]+'), lambda x: length(x) >= 3 AND lower(x) NOT IN ({_quoted(vocab.CORPORATE_STOP_WORDS)})) AS l FROM w),
k AS (SELECT p_partkey, lower(coalesce(list_reduce(list_prepend('', l), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END), '')) AS token FROM l)
SELECT p_partkey, token, token = '' OR contains('the economy widget', token) AS named FROM k""")
def _f14(t: Tables):
    n = F.concat("p_name", F.lit(" "), "p_type", F.lit(" Holdings, Inc"))
    return t.part.select("p_partkey", T.distinctive_token(n).alias("token"), T.contains_company_token(F.lit("The Economy WIDGET"), n).alias("named"))


@query("f16_title_and_heading", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS title,
       trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS heading FROM pages""")
def _f16(t: Tables):
    return t.pages.select("page_id", T.document_title("html").alias("title"), T.document_heading("html").alias("heading"))


@query("f17_page_counters", r"""
SELECT page_id, CAST(len(regexp_extract_all(html, 'href\s*=\s*["''][^"'']*(?:/the|/and|of)', 0)) AS BIGINT) AS links,
       CAST(CASE WHEN page_id % 2 = 0 THEN (page_id % 5) ELSE 0 END AS BIGINT) AS ids, CAST(page_id % 3 AS BIGINT) AS postings FROM pages""")
def _f17(t: Tables):
    ids = F.expr("""CASE WHEN page_id % 2 = 0 THEN '{"jobs" : [' ELSE '[' END || repeat('{"id": 1},', CAST(page_id % 5 AS INT)) || ']'""")
    marks = F.expr("""html || repeat('<script>{"@type" : "JobPosting"}</script>', CAST(page_id % 3 AS INT))""")
    return t.pages.select("page_id", T.count_listing_links("html", r"""(?i)href\s*=\s*["'][^"']*(?:/the|/and|of)""".replace("(?i)", "")).alias("links"),
                          T.count_board_ids(ids).alias("ids"), T.count_job_postings(marks).alias("postings"))


_MARKED = "(CASE source WHEN 'src1' THEN 'Just a moment. ' || text WHEN 'src2' THEN text || ' search jobs' WHEN 'src3' THEN 'This Domain is for sale ' || text WHEN 'src4' THEN text || ' access denied' WHEN 'src5' THEN 'Our CAREERS: ' || text ELSE text END)"


@query("f18_marker_tests_whole_body", f"""
WITH d AS (SELECT doc_id, lower({_MARKED}) AS b FROM documents)
SELECT doc_id, starts_with(b, 'just a moment') OR contains(b, 'access denied') AS challenge, starts_with(b, 'this domain is for sale') AS parked FROM d""")
def _f18w(t: Tables):
    d = t.documents.select("doc_id", F.expr(_MARKED).alias("raw"))
    return d.select("doc_id", T.looks_like_challenge("raw", F.lit("")).alias("challenge"), T.is_parked("raw", F.lit("")).alias("parked"))


@query("f18_marker_tests", f"""
WITH d AS (SELECT doc_id, {_MARKED} AS raw, lower({_MARKED}) AS b FROM documents)
SELECT doc_id, regexp_matches(b, '{"|".join(vocab.CAREERS_TEXT_TOKENS)}') AS careers, regexp_matches(b, '{"|".join(vocab.OPENINGS_PHRASES)}') AS openings,
       starts_with(b, 'just a moment') OR (instr(b, 'access denied') > 0 AND strlen(left(raw, instr(b, 'access denied') - 1)) + 13 <= 4096) AS challenge,
       starts_with(b, 'this domain is for sale') AS parked FROM d""")
def _f18(t: Tables):
    d = t.documents.select("doc_id", F.expr(_MARKED).alias("raw"))
    return d.select("doc_id", T.has_careers_signal("raw").alias("careers"), T.has_openings_phrase("raw").alias("openings"),
                    T.looks_like_challenge("raw", F.lit(""), vocab.MARKER_SCAN_BYTES).alias("challenge"), T.is_parked("raw", F.lit(""), vocab.MARKER_SCAN_BYTES).alias("parked"))


_TITLES = "(CASE p_type WHEN 'ECONOMY' THEN ' Careers ' WHEN 'SMALL' THEN 'Engineer Job Search at ' || p_name WHEN 'STANDARD' THEN 'Open Positions' ELSE p_name END)"


@query("f19_generic_titles", f"SELECT p_partkey, lower(trim({_TITLES})) IN ('jobs', 'careers', 'open positions', 'job search') OR contains(lower({_TITLES}), 'job search') AS generic FROM part")
def _f19(t: Tables):
    return t.part.select("p_partkey", T.is_generic_title(F.expr(_TITLES)).alias("generic"))


_BLOCK_TEXT = "(CASE source WHEN 'src1' THEN 'Please complete the security check. ' || text WHEN 'src2' THEN 'x' || text || ' Access Denied' WHEN 'src3' THEN 'Powered by Cloudflare ' || text WHEN 'src4' THEN 'Please   sign in ' || text ELSE text END)"
_BLOCK_STATUS = "(CASE WHEN source = 'src5' THEN 403 WHEN source = 'src6' THEN 429 WHEN source = 'src7' THEN 404 ELSE 200 END)"


@query("f20_p25_block_classifier", f"""
WITH d AS (SELECT doc_id, source, lang || chr(10) || substring({_BLOCK_TEXT}, 1, 60000) AS raw FROM documents),
h AS (SELECT doc_id, source, lower(raw) AS h FROM d)
SELECT doc_id,
  source IN ('src1', 'src3', 'src5', 'src6') OR (source = 'src2' AND contains(h, 'access denied')) OR (source = 'src4' AND contains(h, 'please sign in')) AS blocked,
  CASE source WHEN 'src1' THEN 'captcha' WHEN 'src3' THEN 'challenge' WHEN 'src5' THEN 'forbidden' WHEN 'src6' THEN 'rate_limited' ELSE CASE WHEN source = 'src2' AND contains(h, 'access denied') THEN 'blocked' ELSE '' END END AS block_reason,
  CASE source WHEN 'src5' THEN 'HTTP 403' WHEN 'src6' THEN 'HTTP 429'
    WHEN 'src1' THEN trim(regexp_replace(substring(h, greatest(instr(h, 'complete the security check') - 20, 1), instr(h, 'complete the security check') - 1 + 60 - greatest(instr(h, 'complete the security check') - 21, 0)), '\\s+', ' ', 'g'))
    WHEN 'src3' THEN trim(regexp_replace(substring(h, greatest(instr(h, 'cloudflare') - 20, 1), instr(h, 'cloudflare') - 1 + 60 - greatest(instr(h, 'cloudflare') - 21, 0)), '\\s+', ' ', 'g'))
    WHEN 'src2' THEN CASE WHEN contains(h, 'access denied') THEN trim(regexp_replace(substring(h, greatest(instr(h, 'access denied') - 20, 1), instr(h, 'access denied') - 1 + 60 - greatest(instr(h, 'access denied') - 21, 0)), '\\s+', ' ', 'g')) ELSE '' END
    ELSE '' END AS block_evidence FROM h""")
def _f20(t: Tables):
    d = t.documents.select("doc_id", F.expr(_BLOCK_STATUS).alias("status"), F.col("lang").alias("title"), F.expr(_BLOCK_TEXT).alias("text"))
    return discover.annotate_blocks(d, scan_chars=vocab.BLOCK_SCAN_CHARS).select("doc_id", "blocked", "block_reason", "block_evidence")


@query("f21_answer_cross_check", """
WITH c AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN text || ' recaptcha' ELSE text END AS evidence FROM conversations)
SELECT conv_id, turn, role = 'system' OR contains(lower(evidence), 'recaptcha') AS blocked, CASE WHEN role = 'system' THEN 'said so' WHEN contains(lower(evidence), 'recaptcha') THEN 'captcha' ELSE '' END AS block_reason FROM c""")
def _f21(t: Tables):
    evidence = F.when(F.col("role") == "user", F.concat("text", F.lit(" recaptcha"))).otherwise(F.col("text"))
    out = t.conversations.withColumn("b", T.answer_block(F.col("role") == "system", F.lit("said so"), evidence))
    return out.select("conv_id", "turn", "b.blocked", "b.block_reason")


@query("f56_careers_shaped", f"""
WITH u AS (SELECT p_partkey, lower({_WORD_URL}) AS u, CASE WHEN p_size > 20 THEN 'application/LD+json; charset=utf-8' ELSE 'text/html' END AS ct FROM part)
SELECT p_partkey, regexp_matches(regexp_extract(u, 'com(/.*)$', 1), 'career|job|join|employment|opportunit|hiring') AS shaped, contains(lower(ct), '+json') AS is_json FROM u""")
def _f56(t: Tables):
    ct = F.when(F.col("p_size") > 20, "application/LD+json; charset=utf-8").otherwise("text/html")
    return t.part.select("p_partkey", T.careers_shaped_location(F.expr(_WORD_URL)).alias("shaped"), T.is_json_content_type(ct).alias("is_json"))


@query("f49_log_tokens", r"""
WITH l AS (SELECT o_orderkey, 'ts=1 run_id=' || o_orderkey || ' company=acme-' || o_custkey || '. found=' || CAST(o_orderkey % 100 AS STRING) AS line FROM orders)
SELECT o_orderkey, regexp_extract(line, '\bcompany=([A-Za-z0-9._-]+)', 1) AS company, CAST(regexp_extract(line, '\brun_id=([0-9]+)', 1) AS BIGINT) AS run_id FROM l""")
def _f49(t: Tables):
    line = F.expr("'ts=1 run_id=' || CAST(o_orderkey AS STRING) || ' company=acme-' || CAST(o_custkey AS STRING) || '. found=' || CAST(o_orderkey % 100 AS STRING)")
    return t.orders.select("o_orderkey", T.log_company(line).alias("company"), T.log_int(line, "run_id").alias("run_id"))


@query("f52_trace_parent", """
WITH h AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'bad' WHEN 'view' THEN '00-' || lpad(CAST(event_id AS STRING), 31, 'A') || '-01' ELSE '00-' || lpad(CAST(event_id AS STRING), 32, 'AB') || '-b7-01' END AS x FROM events)
SELECT event_id, lower(nullif(regexp_extract(x, '^[^-]*-([0-9a-fA-F]{32})(-|$)', 1), '')) AS trace_id FROM h""")
def _f52(t: Tables):
    x = F.expr("CASE event_type WHEN 'error' THEN 'bad' WHEN 'view' THEN '00-' || lpad(CAST(event_id AS STRING), 31, 'A') || '-01' ELSE '00-' || lpad(CAST(event_id AS STRING), 32, 'AB') || '-b7-01' END")
    return t.events.select("event_id", T.trace_id(x).alias("trace_id"))


@query("f54_fetch_failure_label", """
SELECT event_id, CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN CASE WHEN k = 3 THEN 'http_403' WHEN k = 4 THEN 'http_404' WHEN k = 29 THEN 'http_429_twice' WHEN k >= 50 THEN 'http_5xx' ELSE 'http_status' END
   WHEN 'signup' THEN 'retry_after_too_long' WHEN 'error' THEN 'timeout' ELSE CASE WHEN k < 30 THEN 'tls_failure' ELSE 'connection_failed' END END AS label
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events)""")
def _f54(t: Tables):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
    kind = F.expr("CASE event_type WHEN 'view' THEN 'unexpected_status' WHEN 'signup' THEN 'retry_after' WHEN 'error' THEN 'deadline' WHEN 'purchase' THEN 'other' END")
    status = F.when(k >= 50, 500 + k).otherwise(400 + k)
    message = F.when(k < 30, "remote error: tls: bad certificate").otherwise("connection reset")
    return t.events.select("event_id", T.fetch_condition(kind, message, status).alias("label"))


@query("f55_error_text", r"""
SELECT doc_id, 'parse: ' || left(replace(replace(replace(text, chr(10), '\n'), chr(13), '\r'), chr(9), '\t'), 1000) AS feed_text,
       left(regexp_replace(text, '[\n\r\t]', ' ', 'g'), 1000) AS index_text FROM documents""")
def _f55(t: Tables):
    return t.documents.select("doc_id", T.error_text(F.lit("parse"), "text", limit=1000).alias("feed_text"), T.single_line("text", "index", 1000).alias("index_text"))


@query("f55_error_text_whole", r"""
SELECT doc_id, 'parse: ' || replace(replace(replace(text, chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS feed_text,
       regexp_replace(text, '[\n\r\t]', ' ', 'g') AS index_text FROM documents""")
def _f55w(t: Tables):
    return t.documents.select("doc_id", T.error_text(F.lit("parse"), "text").alias("feed_text"), T.single_line("text", "index").alias("index_text"))


@query("a27_first_words_tally", r"""
SELECT array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:6], ' ') AS words, count(*) AS n FROM documents GROUP BY 1""")
def _a27(t: Tables):
    return t.documents.groupBy(T.first_words("text", 6).alias("words")).agg(F.count("*").alias("n"))


@query("f50_bounded_note", r"""
WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents)
SELECT doc_id, CASE WHEN length(x) <= 200 THEN x ELSE left(x, 200) || '...' END AS note FROM s""")
def _f50(t: Tables):
    return t.documents.select("doc_id", T.first_chars("text", 200).alias("note"))


# --- links --------------------------------------------------------------------------------------

_ANCHORS = r"""
tok AS (SELECT page_id, url, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (
  SELECT page_id, url, regexp_extract_all(html, '(?is)<(?:nav|header|footer)\b[^>]*>.*?</(?:nav|header|footer)>|<a\b[^>]*>.*?</a>', 0) AS l FROM pages)),
inner_ AS (SELECT page_id, url, i, regexp_matches(t, '(?i)^<(nav|header|footer)\b') AS in_nav,
  CASE WHEN regexp_matches(t, '(?i)^<(nav|header|footer)\b') THEN regexp_extract_all(t, '(?is)<a\b[^>]*>.*?</a>', 0) ELSE [t] END AS l FROM tok),
anc AS (SELECT page_id, url, in_nav, i, unnest(l) AS a, generate_subscripts(l, 1) AS j FROM inner_),
links AS (SELECT page_id, url, in_nav, row_number() OVER (PARTITION BY page_id ORDER BY i, j) - 1 AS pos,
  regexp_extract(a, '(?is)^<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1) AS href,
  trim(regexp_replace(regexp_replace(regexp_extract(a, '(?is)^<a\b[^>]*>(.*)</a>$', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM anc),
res AS (SELECT *, regexp_extract(url, '^(https?://[^/?#]*)', 1) ||
  array_to_string(list_transform(string_split(href, ''), lambda c: CASE WHEN regexp_full_match(c, '[A-Za-z0-9_.~!$&''()*+,;=:@/%-]') THEN c ELSE url_encode(c) END), '') AS link FROM links)
"""


@query("f23_anchor_extraction", f"WITH {_ANCHORS} SELECT page_id, CAST(pos AS BIGINT) AS pos, in_nav, href, label AS anchor_text, link FROM res")
def _f23(t: Tables):
    return H.explode_anchors(t.pages).select("page_id", "pos", "in_nav", "href", "anchor_text", "link")


# Page links are invented words, so the vocabulary is given: the scoring rules stay the same.
_TOK = {"text_tokens": ["th", "eau"], "path_tokens": ["en", "the", "an"], "exact_pattern": "^(the|and|of|en|la)$", "nav_phrases": ["ou", "er"]}
_SCORED = _ANCHORS + r""",
sig AS (SELECT *, regexp_matches(lower(label), '^(the|and|of|en|la)$') AS ex, regexp_matches(lower(label), 'th|eau') AS sg, regexp_matches(lower(href), '^/(en|the|an)') AS pt FROM res),
core AS (SELECT *, CASE WHEN ex THEN 100 WHEN sg THEN 60 ELSE 0 END + CASE WHEN pt THEN 25 ELSE 0 END AS base FROM sig),
sc AS (SELECT *, base + CASE WHEN in_nav AND base = 0 AND regexp_matches(lower(label), 'ou|er') THEN 60 ELSE 0 END AS core FROM core),
scored AS (SELECT page_id, link, pos, label, core + CASE WHEN in_nav THEN 15 ELSE 0 END AS score FROM sc WHERE core > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY score DESC, pos) AS rn, min(pos) OVER (PARTITION BY page_id, link) AS first_pos FROM scored)
"""


@query("f23_w13_best_anchor_scores", f"WITH {_SCORED} SELECT page_id, link, CAST(score AS BIGINT) AS score, label AS anchor_text, CAST(first_pos AS BIGINT) AS pos FROM best WHERE rn = 1")
def _w13(t: Tables):
    return discover.scored_anchors(t.pages, **_TOK).select("page_id", "link", "score", "anchor_text", "pos")


@query("o8_candidate_ranking", f"""WITH {_SCORED}, ranked AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, length(link), link) AS rank FROM best WHERE rn = 1)
SELECT page_id, link, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 4""")
def _o8(t: Tables):
    return ranking.rank_candidates(discover.scored_anchors(t.pages, **_TOK), k=4).select("page_id", "link", "rank")


@query("f28_next_hop", f"""WITH {_SCORED}, ranked AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, length(link), link) AS rank FROM best WHERE rn = 1)
SELECT page_id, link AS hop_url FROM ranked WHERE rank = 1""")
def _f28h(t: Tables):
    return discover.next_hop(t.pages, **_TOK)


@query("o9_sitemap_ranking", """
WITH d AS (SELECT page_id, url, len(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')) AS depth, regexp_extract(url, '[^.]+[.][^./]+', 0) AS host FROM pages)
SELECT page_id, rank FROM (SELECT page_id, CAST(row_number() OVER (PARTITION BY regexp_extract(url, 'example[.]([a-z]+)', 1) ORDER BY depth, url, page_id) AS BIGINT) AS rank FROM d) WHERE rank <= 20""")
def _o9(t: Tables):
    p = t.pages.withColumns({"tld": F.regexp_extract("url", "example[.]([a-z]+)", 1), "depth": U.path_depth("url")})
    return ranking.top_k(p, ["tld"], ["depth", "url", "page_id"], 20, "rank").select("page_id", "rank")


@query("p21_o11_posting_links_capped", f"""WITH {_ANCHORS},
picked AS (SELECT page_id, link, label, pos, row_number() OVER (PARTITION BY page_id, link ORDER BY pos) AS rn FROM res
            WHERE href <> '' AND NOT starts_with(href, '#') AND trim(label) <> '' AND regexp_matches(lower(href), '/th|/e|/la')),
capped AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM picked WHERE rn = 1),
n AS (SELECT page_id, count(*) AS total_links FROM res GROUP BY 1)
SELECT page_id, CAST(rank AS BIGINT) AS rank, link, label AS title, total_links, (count(*) OVER (PARTITION BY page_id)) >= 3 AS capped FROM capped JOIN n USING (page_id) WHERE rank <= 3""")
def _p21(t: Tables):
    return discover.posting_links(t.pages, "page_id", "url", "html", max_jobs=3, tokens=["/th", "/e", "/la"])


@query("p22_allowed_domains", r"""
WITH h AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://acme.wd1.myworkdayjobs.com/x' WHEN 1 THEN 'https://x.boards.greenhouse.io/y' ELSE url END AS u, url FROM pages)
SELECT page_id, page_id % 3 = 0 OR (page_id % 3 = 2 AND regexp_matches(url, '^https?://([^/]*\.)?example\.net([/?#]|$)')) AS allowed FROM h""")
def _p22(t: Tables):
    u = F.expr("CASE page_id % 3 WHEN 0 THEN 'https://acme.wd1.myworkdayjobs.com/x' WHEN 1 THEN 'https://x.boards.greenhouse.io/y' ELSE url END")
    return t.pages.select("page_id", U.allowed_domain(u, F.lit("https://www.example.net/start")).alias("allowed"))


# --- vendors ------------------------------------------------------------------------------------

_HOSTS = [("the of", "words-a"), ("cheap-pills", "pills"), ("example.org", "org"), ("la de", "words-b"), ("example.net", "net")]


@query("j15_vendor_reference_scan", f"""
WITH v(host, vendor) AS (VALUES {", ".join(f"('{h}', '{v}')" for h, v in _HOSTS)})
SELECT vendor, count(DISTINCT page_id) AS pages FROM pages JOIN v ON contains(lower(html), host) GROUP BY vendor""")
def _j15(t: Tables):
    return discover.vendor_references(t.pages, "page_id", "html", _HOSTS)


_SUFFIX = [("www.example.org", "never"), ("spam-farm.example.org", "farm"), ("example.org", "org"), ("example.net", "net")]


@query("j16_vendor_by_host_suffix", f"""
WITH v(ord, host, vendor) AS (VALUES {", ".join(f"({i}, '{h}', '{v}')" for i, (h, v) in enumerate(_SUFFIX))}),
p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS h FROM pages)
SELECT page_id, (SELECT arg_min(vendor, ord) FROM v WHERE p.h = v.host OR ends_with(p.h, '.' || v.host)) AS vendor FROM p""")
def _j16(t: Tables):
    return discover.vendor_by_host(t.pages.withColumn("h", U.host("url")), "h", _SUFFIX).select("page_id", "vendor")


_BOARD_URL = "(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'https://boards.greenhouse.io/acme' || CAST(c_custkey AS STRING) || '/jobs' WHEN 'BUILDING' THEN 'https://co' || CAST(c_custkey AS STRING) || '.jobs.lever.co/' WHEN 'FURNITURE' THEN 'https://jobs.ashbyhq.com/Big%20Co' WHEN 'MACHINERY' THEN 'https://x.wd5.myworkdayjobs.com/en-US/y' ELSE 'https://boards.greenhouse.io' END)"


@query("f27_board_tenants", f"""
SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'acme' || c_custkey WHEN 'BUILDING' THEN 'co' || c_custkey WHEN 'FURNITURE' THEN 'Big%20Co' END AS tenant,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'greenhouse' WHEN 'BUILDING' THEN 'lever' WHEN 'FURNITURE' THEN 'ashby' WHEN 'MACHINERY' THEN 'workday' ELSE 'greenhouse' END AS vendor,
       CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 'ats_board' ELSE 'career_site' END AS kind,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'https://boards-api.greenhouse.io/v1/boards/acme' || c_custkey || '/jobs' WHEN 'BUILDING' THEN 'https://api.lever.co/v0/postings/co' || c_custkey || '?mode=json'
            WHEN 'FURNITURE' THEN 'https://api.ashbyhq.com/posting-api/job-board/Big%2520Co' END AS api_url,
       CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 11 WHEN 'FURNITURE' THEN 14 WHEN 'MACHINERY' THEN 12 ELSE 10 END AS BIGINT) AS platform_id FROM customer""")
def _f27(t: Tables):
    u = t.customer.select("c_custkey", F.expr(_BOARD_URL).alias("u"))
    return u.select("c_custkey", U.tenant("u")["tenant"].alias("tenant"), U.vendor_from_url("u").alias("vendor"), U.kind_for_url("u").alias("kind"),
                    U.board_api_url("u").alias("api_url"), U.platform_id_for_host(U.host("u")).alias("platform_id"))


@query("f28_vendor_fingerprint", """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'phenom' WHEN 1 THEN 'eightfold' WHEN 2 THEN 'icims' WHEN 3 THEN 'successfactors' WHEN 4 THEN 'lever' END AS vendor FROM pages""")
def _f28(t: Tables):
    body = F.expr("""html || CASE page_id % 6 WHEN 0 THEN '<i data-ph-at-id="x">' WHEN 1 THEN '<i data-testid="position-query-search-search">' WHEN 2 THEN '<a href="https://x.ICIMS.com/">' WHEN 3 THEN 'careerSiteCompanyId' ELSE '' END""")
    u = F.expr("CASE WHEN page_id % 6 = 4 THEN 'https://jobs.lever.co/acme' ELSE url END")
    return t.pages.select("page_id", T.fingerprint(u, body).alias("vendor"))


_API = """(CASE event_type WHEN 'click' THEN '[' || props || ',' || props || ']' WHEN 'view' THEN '{"jobs":[' || props || ']}' WHEN 'signup' THEN '{"content":[]}' WHEN 'error' THEN '{"jobs":' ELSE props END)"""


@query("f26_board_checks", """
WITH k AS (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN k < 5 THEN 'ats_truncated_body' WHEN k < 10 THEN 'transport_error' WHEN k < 15 THEN 'ats_http_5xx' WHEN k < 20 THEN 'ats_http_4xx' WHEN k < 25 THEN 'empty_body'
   WHEN event_type = 'error' THEN 'ats_invalid_json' WHEN event_type IN ('signup', 'purchase') THEN 'ats_empty_board' ELSE '' END AS reason,
   CAST(CASE WHEN k < 25 THEN 0 WHEN event_type = 'click' THEN 2 WHEN event_type = 'view' THEN 1 ELSE 0 END AS BIGINT) AS job_count FROM k""")
def _f26(t: Tables):
    from rolegrid.operators.gate import board_check

    k = F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
    rows = t.events.select(
        "event_id", F.lit("https://boards.greenhouse.io/acme").alias("tenant_url"),
        F.when((k >= 10) & (k < 15), 503).when((k >= 15) & (k < 20), 404).otherwise(200).alias("status"),
        F.when((k >= 20) & (k < 25), " ").otherwise(F.expr(_API)).alias("body"), (k < 5).alias("truncated"),
        F.when((k >= 5) & (k < 10), "reset").alias("transport_error"), F.lit(False).alias("timed_out"))
    return board_check(rows).select("event_id", "board.reason", "board.job_count")


@query("f43_f44_verdict_categories", f"""
SELECT id, CASE WHEN validation_status = 'accepted' THEN 'confirmed' WHEN rejection_reason IN ({_quoted(vocab.WRONG_REASONS)}) THEN 'wrong' ELSE 'unverifiable' END AS category,
       coalesce(rejection_reason IN ({_quoted(vocab.ESCALATE_REASONS)}), false) AS escalate,
       CASE WHEN rejection_reason IN ('transport_error', 'timeout', 'no_status') THEN 'error' ELSE 'rejected' END AS state FROM attempts""")
def _f43(t: Tables):
    return t.attempts.select("id", category("validation_status", "rejection_reason").alias("category"), should_escalate("rejection_reason").alias("escalate"),
                             attempt_state("rejection_reason").alias("state"))


@query("f33_external_id", r"""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN CAST(o_orderkey AS STRING) ELSE 'https://x.example.com/careers/job/' || o_orderkey || '?a=1' END AS external_id FROM orders""")
def _f33(t: Tables):
    url = F.expr("'https://x.example.com/careers/job/' || CAST(o_orderkey AS STRING) || '?a=1'")
    pattern = F.expr(r"CASE o_orderpriority WHEN '1-URGENT' THEN 'careers/job/(\\d+)' WHEN '2-HIGH' THEN 'none/(x)' WHEN '3-MEDIUM' THEN 'careers/job/\\d+' WHEN '5-LOW' THEN '' END")
    return t.orders.select("o_orderkey", U.external_id(url, pattern).alias("external_id"))


# --- homepages ----------------------------------------------------------------------------------


@query("f39_homepage_score", """
WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS h, list_filter(string_split(lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '/'), lambda s: s <> '') AS l,
  CASE page_id % 3 WHEN 0 THEN 'preferred' WHEN 1 THEN 'normal' ELSE 'deprecated' END AS rank FROM pages)
SELECT page_id, CASE WHEN rank <> 'deprecated' THEN CAST(CASE rank WHEN 'preferred' THEN 1000 ELSE 0 END + CASE WHEN len(l) = 0 THEN 100 ELSE -10 END
   + CASE WHEN starts_with(url, 'https') THEN 20 ELSE 1 END - 5 * len(l) - 5 * greatest(0, length(h) - length(replace(h, '.', '')) - 1) + CASE WHEN contains(h, 'example') THEN 100 ELSE 0 END AS BIGINT) END AS score FROM p""")
def _f39(t: Tables):
    claims = t.pages.select("page_id", "url", F.expr("CASE page_id % 3 WHEN 0 THEN 'preferred' WHEN 1 THEN 'normal' ELSE 'deprecated' END").alias("rank"), F.lit("The Example Group").alias("title"))
    return homepage.score_homepage(claims).select("page_id", "score")


@query("j13_two_source_homepages", r"""
WITH a AS (SELECT c_custkey AS k, 'https://www.' || lower(replace(c_name, '#', '')) || '.example.com' AS u FROM customer WHERE c_acctbal > 0),
b AS (SELECT o_custkey AS k, CASE max(o_orderstatus) WHEN 'P' THEN 'https://example.com/x' ELSE 'https://elsewhere.example.org/' END AS u FROM orders WHERE o_totalprice > 300000 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS title, coalesce(a.u, b.u) AS url, CASE WHEN a.u IS NOT NULL THEN 'infobox' ELSE 'p856' END AS source,
       coalesce(a.u IS NOT NULL AND b.u IS NOT NULL AND contains(b.u, '.org'), false) AS disagreement, CASE WHEN a.u IS NOT NULL AND contains(b.u, '.org') THEN b.u END AS other_url
  FROM a FULL OUTER JOIN b ON a.k = b.k""")
def _j13(t: Tables):
    box = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("title"), F.expr("'https://www.' || lower(replace(c_name, '#', '')) || '.example.com'").alias("url"))
    claims = t.orders.filter("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("title")).agg(
        F.when(F.max("o_orderstatus") == "P", "https://example.com/x").otherwise("https://elsewhere.example.org/").alias("url"))
    return homepage.two_source_homepage(box, claims)


@query("f37_infobox_website", """
SELECT c_custkey, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'https://www.x' || c_custkey || '.example.com/a' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'https://other.example.com' END AS website FROM customer""")
def _f37(t: Tables):
    value = F.expr("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '{{URL|https://www.x' || CAST(c_custkey AS STRING) || '.example.com/a|site}}' WHEN 'BUILDING' THEN 'see https://www.x' || CAST(c_custkey AS STRING) || '.example.com/a.' WHEN 'FURNITURE' THEN '<!-- https://no.example.com -->' WHEN 'MACHINERY' THEN 'None' ELSE '' END")
    wikitext = F.concat(F.lit("{{Infobox company\n| name = X\n | Website = "), value, F.lit("\n| homepage = https://other.example.com\n}}"))
    return t.customer.select("c_custkey", homepage.infobox_website(wikitext).alias("website"))


# --- presentation -------------------------------------------------------------------------------


@query("f53_presentation_labels", """
SELECT job_id, CASE status WHEN 'open' THEN 'Open' WHEN 'filled' THEN 'Filled' WHEN 'closed' THEN 'Closed' END AS status_label,
       CASE WHEN location_text <> '' THEN location_text WHEN country <> '' THEN country WHEN is_remote = 1 THEN 'Remote' ELSE '' END AS place,
       coalesce(CASE employment_type WHEN 'full_time' THEN 'Full Time' WHEN 'contract' THEN 'Contract' WHEN 'apprentice' THEN 'Apprentice' END, '') AS type_label FROM jobs""")
def _f53(t: Tables):
    return t.jobs.select("job_id", P.job_status("status").alias("status_label"), P.location_text("location_text", "country", F.col("is_remote") == 1).alias("place"),
                         P.humanize("employment_type").alias("type_label"))


@query("f53_salary_text", r"""
WITH c AS (SELECT job_id, salary_min_cents AS a, salary_max_cents AS b, CASE salary_currency WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' WHEN 'XAU' THEN 'XAU ' ELSE '' END AS s, salary_period AS p FROM jobs),
f AS (SELECT *, s || format('{:,}', a // 100) || CASE WHEN a % 100 = 0 THEN '' ELSE '.' || lpad(CAST(a % 100 AS STRING), 2, '0') END AS x,
             s || format('{:,}', b // 100) || CASE WHEN b % 100 = 0 THEN '' ELSE '.' || lpad(CAST(b % 100 AS STRING), 2, '0') END AS y FROM c)
SELECT job_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN x || '–' || y WHEN a IS NOT NULL THEN 'from ' || x WHEN b IS NOT NULL THEN 'up to ' || y ELSE '' END
   || CASE WHEN a IS NULL AND b IS NULL THEN '' ELSE coalesce(' / ' || CASE p WHEN 'year' THEN 'yr' WHEN 'hour' THEN 'hr' END, '') END AS salary FROM f""")
def _f53s(t: Tables):
    return t.jobs.select("job_id", P.salary_text("salary_min_cents", "salary_max_cents", "salary_currency", "salary_period").alias("salary"))


@query("f53_duration_text", """
WITH d AS (SELECT id, CAST(floor((epoch_us(finished_at) - epoch_us(started_at)) / 1e6 + 0.5) AS BIGINT) AS s FROM runs)
SELECT id, CASE WHEN s IS NULL THEN '' WHEN s >= 3600 THEN (s // 3600) || 'h ' || ((s // 60) % 60) || 'm ' || (s % 60) || 's' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS duration FROM d""")
def _f53d(t: Tables):
    return t.runs.select("id", P.duration_text("started_at", "finished_at").alias("duration"))


@query("f57_report_lines", "SELECT id, 'run_id=' || id || ' found=' || items_found || ' error=' || coalesce(left(error_text, 5), '-') AS line FROM runs")
def _f57(t: Tables):
    return t.runs.select("id", P.report_line([("run_id", "id"), ("found", "items_found"), ("error", F.left("error_text", F.lit(5)))]).alias("line"))


@query("f46_evidence_text", """
SELECT id, 'verdict=' || validation_status || CASE WHEN evidence_path IS NOT NULL THEN ';note=' || left(evidence_path, 6) || '...' ELSE '' END AS evidence FROM attempts""")
def _f46(t: Tables):
    note = F.concat(F.lit("note="), T.truncate_bytes("evidence_path", 6))
    return t.attempts.select("id", T.append_evidence(F.concat(F.lit("verdict="), "validation_status"), note).alias("evidence"))


@query("f45_source_vocabulary", "SELECT id, CASE source WHEN 'nav_anchor' THEN 'anchor_scan' WHEN 'sitemap' THEN 'sitemap' WHEN 'robots_path' THEN 'robots_signal' ELSE '' END AS stored FROM attempts")
def _f45(t: Tables):
    from rolegrid.functions.base import map_lookup

    return t.attempts.select("id", F.coalesce(map_lookup(F.col("source"), vocab.TIER_TO_SOURCE), F.lit("")).alias("stored"))


@query("f2_squeeze_text", r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM conversations")
def _squeeze(t: Tables):
    return t.conversations.select("conv_id", "turn", squeeze("text").alias("flat"))
