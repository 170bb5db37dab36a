"""Registered queries: the composed jobs over data derived from the driver tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from rolegrid.catalog.registry import Tables, query
from rolegrid.catalog.telemetry import _EL, _ELEMENT
from rolegrid.functions import urls as U
from rolegrid.operators import slots
from rolegrid.plans import careers, ingest
from rolegrid.session import checkpoint_dir, cut
from rolegrid.sources import registry


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def responses_of(rows):
    """(url, body) rows in the shape of a responses table."""
    return rows.select(
        "url", F.lit("").alias("final_url"), F.coalesce("status", F.lit(200)).alias("status"), F.lit("text/html").alias("content_type"), "body",
        F.lit(False).alias("truncated"), F.lit(None).cast("string").alias("transport_error"), F.lit(False).alias("timed_out"))


def site_pages(t: Tables):
    """One page per URL."""
    return t.pages.groupBy("url").agg(F.min_by("page_id", "page_id").alias("page_id"), F.min_by("html", "page_id").alias("html"))


# What is planted on a page depends on the length of its text, so every job reads whole pages.
_SITES = "site AS (SELECT url, min(page_id) AS page_id, length(arg_min(html, page_id)) AS size FROM pages GROUP BY url)"


@query("d20_vendor_classification_job", f"""WITH {_SITES}
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'phenom' WHEN 1 THEN 'eightfold' WHEN 2 THEN 'icims' WHEN 3 THEN 'phenom' END AS vendor, page_id % 6 = 3 AS hop,
       CASE WHEN page_id % 6 < 4 THEN 'classified' ELSE 'unknown' END AS outcome FROM site""")
def _d20(t: Tables):
    m = F.col("page_id") % 6
    mark = (F.when(m == 0, '<i data-ph-at-id="x">').when(m == 1, '<i data-testid="position-query-search-search">').when(m == 2, '<a href="https://x.ICIMS.com/">x</a>')
            .when(m == 3, F.concat(F.lit('<nav><a href="https://hop.example.com/'), F.col("page_id").cast("string"), F.lit('">Careers</a></nav>'))).otherwise(""))
    site = site_pages(t)
    first = site.select("url", F.lit(200).alias("status"), F.concat("html", mark).alias("body"))
    second = site.filter(m == 3).select(F.concat(F.lit("https://hop.example.com/"), F.col("page_id").cast("string")).alias("url"), F.lit(200).alias("status"), F.lit("<i data-ph-at-id=1>").alias("body"))
    companies = site.select(F.col("page_id").alias("company_id"), F.col("page_id").cast("string").alias("slug"), F.col("url").alias("career_site_url"))
    out = careers.classify_vendors(companies, responses_of(first.unionByName(second)), registry.platforms(t.spark))
    return out["rows"].select(F.col("company_id").alias("page_id"), "vendor", "hop", "outcome")


@query("d23_careers_resolution_job", f"""WITH {_SITES}
SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/]*[.]org(/|$|[?#])') THEN NULL ELSE regexp_extract(url, '^https?://[^/?#]*', 0) || '/careers' END AS new_url,
       CASE WHEN regexp_matches(url, '^https?://[^/]*[.]org(/|$|[?#])') THEN NULL ELSE 'anchor_scan' END AS new_url_source, CAST(2 AS BIGINT) AS attempts FROM site""")
def _d23(t: Tables):
    site = site_pages(t)
    home = site.select("url", F.lit(200).alias("status"), F.concat(F.lit('<title>Example</title><nav><a href="/careers">Careers</a></nav>'), "html").alias("body"))
    root = F.regexp_extract("url", "^https?://[^/?#]*", 0)
    boards = site.filter(~U.host("url").endswith(".org")).select(F.concat(root, F.lit("/careers")).alias("url")).distinct().select(
        "url", F.lit(200).alias("status"), F.lit("<title>Careers at Example</title>open positions").alias("body"))
    companies = site.select(F.col("page_id").alias("company_id"), F.col("page_id").cast("string").alias("slug"), F.lit("Example Group").alias("name"), F.col("url").alias("website"))
    out = careers.resolve_careers(companies, responses_of(home.unionByName(boards)))
    tried = out["attempts"].groupBy("company_id").agg(F.count("*").alias("attempts"))
    return out["resolutions"].join(tried, "company_id").select(F.col("company_id").alias("page_id"), "new_url", "new_url_source", "attempts")


@query("d24_f25_stored_url_validation_job", f"""WITH {_SITES}
SELECT page_id, CASE size % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'wrong' WHEN 2 THEN 'unverifiable' WHEN 3 THEN 'confirmed' ELSE 'unverifiable' END AS new_verdict, size % 5 IN (2, 3, 4) AS escalated FROM site""")
def _d24(t: Tables):
    m = F.char_length("html") % 5
    n = F.col("page_id").cast("string")
    site = site_pages(t)
    stored = site.select(F.col("page_id").alias("company_id"), n.alias("slug"), F.lit("Example").alias("name"), F.concat(F.lit("https://www.example.com/careers/"), n).alias("career_site_url"))
    first = site.select(
        F.concat(F.lit("https://www.example.com/careers/"), n).alias("url"), F.when(m == 2, 403).otherwise(200).alias("status"),
        F.when(m == 0, F.concat(F.lit("<title>Example careers</title>"), "html")).when(m == 1, F.concat(F.lit("<title>Example fraud alert</title>open roles"), "html")).when(m == 4, "")
        .when(m == 3, F.concat("html", F.lit("<p>verify you are human</p>"))).otherwise(F.col("html")).alias("body"))
    second = site.select(F.concat(F.lit("https://jobs.example.com/open-jobs/"), n).alias("url"), F.lit(200).alias("status"), F.when(m == 3, "<title>Example jobs</title>open roles").otherwise("<title>Hello</title>").alias("body"))
    asked = site.filter(m >= 2).select(F.col("page_id").alias("company_id"), F.concat(F.lit("https://jobs.example.com/open-jobs/"), n).alias("final_url"), F.lit(True).alias("ok"))
    out = careers.validate_stored(stored, responses_of(first.unionByName(second)), asked)
    return out["verdicts"].select(F.col("company_id").alias("page_id"), "new_verdict", "escalated")


def feed_captures(t: Tables):
    """A feed body per event, stored as captures are: the ingest reads them in several steps. Events are dealt out before
    their bodies are made, as few small files hold very many."""
    tasks = max(2 * t.spark.sparkContext.defaultParallelism, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    k = t.events.repartition(tasks).withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("bigint"))
    return cut(k.select(F.concat(F.lit("["), F.expr(_ELEMENT), F.lit("]")).alias("body")))


@query("d21_feed_ingest_job", f"""WITH {_EL}
SELECT 'ok' AS outcome, (SELECT count(*) FROM el) AS found, (SELECT count(*) FROM el WHERE k >= 15 AND NOT (k >= 30 AND k < 38)) AS accepted, (SELECT count(*) FROM el WHERE k >= 15 AND NOT (k >= 30 AND k < 38)) AS inserted,
       (SELECT count(*) FROM jobs WHERE status = 'open' AND discovery_platform_id = 1 AND external_id IS NOT NULL) AS closed, (SELECT count(*) FROM el WHERE k BETWEEN 3 AND 14 OR (k >= 30 AND k < 38)) AS skipped""")
def _d21(t: Tables):
    captures = feed_captures(t)
    companies = t.companies.select("company_id", "slug", "name")
    jobs = t.jobs.withColumns({"created_at": F.col("first_seen_at"), "updated_at": F.col("last_seen_at"), "tags": F.array().cast("array<string>"), "is_remote": F.col("is_remote") == 1})
    report = ingest.feed_ingest(captures, companies, jobs, 1, now())["report"]
    return report.select("outcome", "found", "accepted", "inserted", "closed", "skipped")


def slot_table(t: Tables, rows, layout: slots.Layout) -> slots.SlotTable:
    """rows as version 0 of a slot table in the shared folder."""
    out = slots.SlotTable(t.spark, f"{checkpoint_dir(t.spark)}/slots/{uuid.uuid4().hex}", layout)
    out.create(rows)
    return out


def few_slots(layout: slots.Layout) -> slots.Layout:
    """The layout with slots for tables of these sizes."""
    return replace(layout, groups=4, parts=4)


def ingested(t: Tables) -> tuple[slots.SlotTable, slots.SlotTable]:
    """(companies, postings) after a feed run on slot tables."""
    captures = feed_captures(t)
    companies = slot_table(t, t.companies.select("company_id", "slug", "name"), few_slots(slots.COMPANIES))
    jobs = t.jobs.withColumns({"created_at": F.col("first_seen_at"), "updated_at": F.col("last_seen_at"), "tags": F.array().cast("array<string>"), "is_remote": F.col("is_remote") == 1})
    postings = slot_table(t, jobs, few_slots(slots.POSTINGS))
    ingest.feed_ingest_into(captures, companies, postings, 1, now())
    return companies, postings


@query("d21_feed_ingest_postings", f"""WITH {_EL}
SELECT external_id, discovery_platform_id AS platform_id, title, CASE WHEN status = 'open' AND discovery_platform_id = 1 AND external_id IS NOT NULL THEN 'closed' ELSE status END AS status,
       salary_min_cents, CAST(NULL AS VARCHAR) AS slug FROM jobs
UNION ALL
SELECT CAST(event_id AS VARCHAR), 1, 'Dev ' || k, 'open', CASE WHEN k >= 38 THEN k * 100 END, 'co-' || user_id FROM el WHERE k >= 15 AND NOT (k >= 30 AND k < 38)""")
def _d21p(t: Tables):
    companies, postings = ingested(t)
    named = companies.rows().filter("slug LIKE 'co-%'").select("company_id", "slug")
    return postings.rows().join(named, "company_id", "left").select("external_id", F.col("discovery_platform_id").alias("platform_id"), "title", "status", "salary_min_cents", "slug")


@query("d21_feed_ingest_companies", f"""WITH {_EL}
SELECT slug, name FROM companies UNION ALL SELECT DISTINCT 'co-' || user_id, 'Co ' || user_id FROM el WHERE k >= 15 AND NOT (k >= 30 AND k < 38)""")
def _d21c(t: Tables):
    return ingested(t)[0].rows().select("slug", "name")


def _step(before: str, after: str, batch: str, tag: str) -> str:
    """One merge as SQL: upsert by key, reopen, and close what the batch's platforms no longer show."""
    return f"""{after} AS (
  SELECT coalesce(s.p, b.p) AS p, coalesce(s.x, b.x) AS x, CASE WHEN b.x IS NOT NULL THEN b.title ELSE s.title END AS title,
         CASE WHEN b.x IS NOT NULL THEN 'open' WHEN s.status = 'open' AND s.x IS NOT NULL AND s.p IN (SELECT p FROM {batch}) THEN 'closed' ELSE s.status END AS status,
         CASE WHEN b.x IS NOT NULL THEN '{tag}' ELSE s.seen END AS seen, s.kept
    FROM {before} s FULL OUTER JOIN {batch} b ON s.p = b.p AND s.x = b.x)"""


_BATCHES = (("a", "discovery_platform_id IN (1, 10) AND o > 3"), ("b", "discovery_platform_id IN (10, 11) AND job_id % 3 = 0"))


@query("t4_posting_merge_batch_twin", f"""
WITH j AS (SELECT *, CAST(right(CAST(job_id AS VARCHAR), 1) AS BIGINT) AS o FROM jobs),
s0 AS (SELECT discovery_platform_id AS p, external_id AS x, title, status, 'never' AS seen, job_id AS kept FROM j WHERE o < 7),
{", ".join(f"{n} AS (SELECT discovery_platform_id AS p, external_id AS x, title || ' {n}' AS title FROM j WHERE {where} AND external_id IS NOT NULL)" for n, where in _BATCHES)},
{_step("s0", "s1", "a", "a")}, {_step("s1", "s2", "b", "b")}
SELECT p AS platform_id, x AS external_id, title, status, seen, kept, (SELECT count(*) FROM s2) AS n_ids FROM s2""")
def _t4(t: Tables):
    jobs = t.jobs.withColumns({"created_at": F.col("first_seen_at"), "updated_at": F.col("last_seen_at"), "o": F.right(F.col("job_id").cast("string"), F.lit(1)).cast("bigint")})
    state = jobs.filter("o < 7").drop("o")
    table = slot_table(t, state, few_slots(slots.POSTINGS))
    for day, (name, where) in enumerate(_BATCHES, 2):
        batch = jobs.filter(where).filter("external_id IS NOT NULL").select(*[c for c in state.columns if c not in ("job_id", "status", "title")], F.concat("title", F.lit(f" {name}")).alias("title"), F.col("job_id").alias("ordinal"))
        slots.merge_postings(table, batch, F.lit(f"2024-06-0{day} 00:00:00").cast("timestamp"))
    out, top = table.rows(), state.agg(F.max("job_id")).scalar()
    seen = F.when(F.col("last_seen_at") == F.lit("2024-06-02 00:00:00").cast("timestamp"), "a").when(F.col("last_seen_at") == F.lit("2024-06-03 00:00:00").cast("timestamp"), "b").otherwise("never")
    return out.select(F.col("discovery_platform_id").alias("platform_id"), "external_id", "title", "status", seen.alias("seen"), F.when(F.col("job_id") <= top, F.col("job_id")).alias("kept"),
                      out.agg(F.countDistinct("job_id")).scalar().alias("n_ids"))


@query("d22_index_ingest_job", """
SELECT 'idx' || c_custkey AS index, CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS found, CAST(CASE WHEN c_acctbal >= 0 THEN 0 ELSE 1 END AS INTEGER) AS exit_code FROM customer""")
def _d22(t: Tables):
    n = F.col("c_custkey").cast("string")
    table = F.concat(F.lit("{|\n! Symbol !! Security !! GICS Sector\n|-\n| {{NyseSymbol|T"), n, F.lit("}} || [[Firm "), n, F.lit("]] || "), "c_mktsegment", F.when(F.col("c_acctbal") >= 0, "\n|}").otherwise(""))
    pages = t.customer.select(F.concat(F.lit("idx"), n).alias("index"), F.col("c_custkey").alias("position"), table.alias("wikitext"))
    blank = F.lit(None).cast("string")
    state = t.companies.select("company_id", "slug", "name", "industry", blank.alias("cik"), blank.alias("gics_sub_industry"), blank.alias("headquarters_location"), "index_membership", "article_title", "created_at", "updated_at")
    return ingest.index_ingest(pages, state, now())["report"].select("index", F.col("found").cast("int").alias("found"), "exit_code")


@query("d22_index_ingest_companies", """
WITH firm AS (SELECT c_custkey AS n, c_mktsegment AS sector, unnest([c_nationkey, (c_nationkey + 7) % 25]) AS page FROM customer),
last AS (SELECT n, max(page) AS page, any_value(sector) AS sector FROM firm GROUP BY n)
SELECT slug, name, industry, index_membership FROM companies UNION ALL SELECT 'firm-' || n, 'Firm ' || n, sector, 'idx' || page FROM last""")
def _d22c(t: Tables):
    n = F.col("c_custkey").cast("string")
    row = F.concat(F.lit("|-\n| {{NyseSymbol|T"), n, F.lit("}} || [[Firm "), n, F.lit("]] || "), "c_mktsegment")
    firms = t.customer.select(row.alias("row"), F.explode(F.array("c_nationkey", (F.col("c_nationkey") + 7) % 25)).alias("page"))
    # A whole table per page: hundreds of constituents, most of them on another page too.
    pages = firms.groupBy("page").agg(F.array_join(F.collect_list("row"), "\n").alias("rows")).select(
        F.concat(F.lit("idx"), F.col("page").cast("string")).alias("index"), F.col("page").cast("bigint").alias("position"),
        F.concat(F.lit("{|\n! Symbol !! Security !! GICS Sector\n"), "rows", F.lit("\n|}")).alias("wikitext"))
    blank = F.lit(None).cast("string")
    state = t.companies.select("company_id", "slug", "name", "industry", blank.alias("cik"), blank.alias("gics_sub_industry"), blank.alias("headquarters_location"), "index_membership", "article_title", "created_at", "updated_at")
    table = slot_table(t, state, few_slots(slots.COMPANIES))
    ingest.index_ingest(pages, table, now())
    return table.rows().select("slug", "name", "industry", "index_membership")


@query("d25_listings_job", f"""WITH {_SITES}
SELECT page_id, CASE size % 5 WHEN 0 THEN 'no_remote_roles' WHEN 1 THEN 'agent_failed' WHEN 2 THEN 'blocked' ELSE 'fetched' END AS outcome,
       CAST(CASE WHEN size % 5 >= 3 THEN 3 ELSE 0 END AS BIGINT) AS found, CAST(CASE WHEN size % 5 >= 3 THEN 1 ELSE 0 END AS BIGINT) AS inserted,
       CAST(CASE WHEN size % 5 >= 3 THEN 1 ELSE 0 END AS BIGINT) AS skipped_non_us, CAST(CASE WHEN size % 5 >= 3 THEN 1 ELSE 0 END AS BIGINT) AS closed FROM site""")
def _d25(t: Tables):
    m = F.char_length("html") % 5
    n = F.col("page_id").cast("string")
    site = site_pages(t)
    start = F.concat(F.lit("https://list.example.com/p"), n)
    links = F.concat(F.lit('<a href="/jobs/'), n, F.lit('a">One</a><a href="/jobs/'), n, F.lit('b">Two</a><a href="/jobs/'), n, F.lit('c">Three</a><a href="/about">x</a>'), "html")

    def posting(tail: str, country: str):
        body = F.lit('<script type="application/ld+json">{"@type":"JobPosting","title":"T","description":"d","jobLocation":{"address":{"addressCountry":"' + country + '"}}}</script>')
        return site.filter(m >= 3).select(F.concat(F.lit("https://list.example.com/jobs/"), n, F.lit(tail)).alias("url"), F.lit(200).alias("status"), body.alias("body"))

    lists = site.select(start.alias("url"), F.when(m == 2, 403).otherwise(200).alias("status"), links.alias("body"))
    responses = responses_of(lists.unionByName(posting("a", "US")).unionByName(posting("b", "DE")))  # the third posting is never answered
    none = F.lit(None).cast("string")
    companies = site.select(
        F.col("page_id").alias("company_id"), n.alias("slug"), n.alias("name"), F.lit(11).cast("bigint").alias("discovery_platform_id"), F.lit("").alias("pattern"),
        none.alias("listings_url"), none.alias("listings_url_resolved_at"), F.lit(None).cast("boolean").alias("listings_url_remote_confirmed"), now().alias("updated_at"))
    answers = site.select(F.col("page_id").alias("company_id"), start.alias("listings_url"), (m != 0).alias("has_remote"), F.lit(False).alias("blocked"), (m != 1).alias("ok"), none.alias("error"))
    state = t.jobs.withColumns({"created_at": now(), "updated_at": now(), "is_remote": F.lit(True)})
    old = site.select(
        *[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("job_id", "company_id", "discovery_platform_id", "external_id", "status") else
          {"job_id": F.col("page_id"), "company_id": F.col("page_id"), "discovery_platform_id": F.lit(11).cast("bigint"), "external_id": F.concat(F.lit("gone-"), n), "status": F.lit("open")}[f.name].alias(f.name)
          for f in state.schema.fields])
    report = ingest.listings_job(companies, answers, responses, old, now(), 5)["report"]
    return report.select(F.col("company_id").alias("page_id"), "outcome", "found", "inserted", "skipped_non_us", "closed")
