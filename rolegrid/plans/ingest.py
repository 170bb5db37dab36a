"""Ingest jobs: a feed of postings, an index of companies, a page of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.functions.text import slugify
from rolegrid.operators import merge, quality, runs, slots
from rolegrid.operators.discover import annotate_blocks, fetch, posting_links, robots_allowed, single_responses
from rolegrid.operators.reads import cached_listings
from rolegrid.operators.wikitext import constituents
from rolegrid.functions import jsonld
from rolegrid.functions import urls as U
from rolegrid.functions.base import ColumnOrName, attach_row
from rolegrid.session import cut
from rolegrid.sources import feed
from rolegrid.sources.postings import posting_batch


def feed_ingest(captures: DataFrame, companies: DataFrame, jobs: DataFrame, platform_id: int, now: ColumnOrName) -> dict[str, DataFrame]:
    """One feed run over whole snapshots: scan, normalise, create companies, upsert postings, close what is gone.

    Returns the new ``companies`` and ``jobs``, and a one-row ``report`` whose outcome is ok, no_jobs
    or normalize_failed. Without an accepted posting nothing is written. ``feed_ingest_into`` does the same on slot tables.
    """
    elements, rejects = feed.scan_feed(captures)
    # The elements feed companies, postings, the seen set and the report: parsed once, kept once.
    parsed = cut(feed.normalise_feed(elements))
    fresh, bad_names = _new_companies(parsed, companies)
    new_companies = cut(companies.unionByName(fresh))
    merged = merge.upsert_jobs(jobs, _feed_batch(parsed, new_companies, platform_id), now)
    new_jobs = cut(merge.mark_stale(merged, _feed_seen(parsed, platform_id), ["discovery_platform_id"], now))
    return {
        "companies": new_companies, "jobs": new_jobs.drop("merge_action", "newly_closed"), "changes": new_jobs,
        "report": _feed_report(parsed, new_jobs, rejects), "bad_names": bad_names, "rejects": rejects,
    }


def feed_ingest_into(captures: DataFrame, companies: slots.SlotTable, jobs: slots.SlotTable, platform_id: int, now: ColumnOrName) -> dict[str, DataFrame]:
    """One feed run on slot tables: a new version of ``companies`` where a company is new, one of ``jobs`` always.

    Read and written are the slots of the feed's companies and postings, and of the platform's slots those in which a
    posting closes. Returns the ``report``, the ``changes`` (rewritten postings with their action), ``bad_names``, ``rejects``.
    """
    elements, rejects = feed.scan_feed(captures)
    parsed = cut(feed.normalise_feed(elements))
    names = feed.feed_jobs(parsed).select(slugify("company_name").alias("slug")).distinct()
    at, base = companies.slots_of(names), companies.latest()
    known = companies.read(at, base).drop(slots.SLOT)
    fresh, bad_names = _new_companies(parsed, known, companies.top(base))
    fresh = cut(fresh)
    added = companies.slots_of(fresh)
    now_known = cut(known.unionByName(fresh))
    if added:
        companies.replace(now_known.withColumn(slots.SLOT, companies.layout.slot()).filter(F.col(slots.SLOT).isin(sorted(added))), added, base, base + 1)
    batch = cut(_feed_batch(parsed, now_known, platform_id))
    changes = slots.merge_postings(jobs, batch, now, observed=_feed_seen(parsed, platform_id))
    return {"report": _feed_report(parsed, changes, rejects), "changes": changes, "bad_names": bad_names, "rejects": rejects}


def _new_companies(parsed: DataFrame, companies: DataFrame, top: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(companies that the feed names first, in the columns of the table; names without a slug)."""
    accepted = feed.feed_jobs(parsed).select(F.col("company_name").alias("name"), F.col("idx").alias("ordinal"))
    fresh, bad_names = merge.resolve_companies(companies, accepted)
    numbered = merge.assign_ids(fresh, companies, ["slug"], "company_id", top=top)
    return _as(numbered, companies), bad_names


def _as(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows in the columns of a table, NULL where they have none."""
    return rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields])


def _feed_batch(parsed: DataFrame, companies: DataFrame, platform_id: int) -> DataFrame:
    accepted = feed.feed_jobs(parsed).withColumn("slug", slugify("company_name")).join(companies.select("slug", "company_id"), "slug")
    return accepted.withColumns({"discovery_platform_id": F.lit(platform_id).cast("bigint"), "ordinal": F.col("idx")})


def _feed_seen(parsed: DataFrame, platform_id: int) -> DataFrame:
    """The feed's keys, taken before any filter; none where no posting was accepted, so that nothing closes."""
    some = parsed.agg(F.coalesce(F.bool_or(F.col("reason").isNull()), F.lit(False)).alias("some"))
    return feed.feed_seen(parsed).withColumn("discovery_platform_id", F.lit(platform_id).cast("bigint")).filter(some.scalar())


def _feed_report(parsed: DataFrame, changes: DataFrame, rejects: DataFrame) -> DataFrame:
    counted = changes.agg(F.count_if("newly_closed").alias("closed"), F.count_if(F.col("merge_action") == "inserted").alias("inserted"))
    read = parsed.agg(
        F.count("*").alias("found"), F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.count_if(F.col("external_id").isNotNull()).alias("identified"),
        F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "notice")).alias("skipped"),
    )
    report = attach_row(attach_row(read, counted), rejects.agg(F.count("*").alias("rejected_bodies")))
    outcome = F.when(F.col("accepted") > 0, "ok").when(F.col("identified") == 0, "no_jobs").otherwise("normalize_failed")
    return report.withColumns({"outcome": outcome, "updated": F.col("accepted") - F.col("inserted")})


def index_ingest(pages: DataFrame, companies: DataFrame | slots.SlotTable, now: ColumnOrName) -> dict[str, DataFrame]:
    """Index pages (index, position, wikitext) into companies. A company on several pages ends on the
    last one, as if the pages were read in order. The report flags empty pages (exit 4).

    On a slot table only the slots of the pages' companies are read and, as its next version, written; ``changes`` are then
    the rows of those slots."""
    rows, problems = constituents(pages.select("index", "wikitext"))
    rows = cut(rows.join(pages.select("index", F.col("position").alias("page_no")), "index"))
    named = rows.withColumns({"name": F.trim("name"), "slug": slugify(F.trim("name"))})
    errors = named.filter((F.coalesce("name", F.lit("")) == "") | (F.col("slug") == "")).select("index", "ordinal", "name")
    good = named.filter(F.col("slug") != "")
    first_class = good.groupBy("index", "slug").agg(F.min_by(F.struct(*good.columns), "ordinal").alias("r")).select("r.*")
    last_page = first_class.groupBy("slug").agg(F.max_by(F.struct(*first_class.columns), "page_no").alias("r")).select("r.*")
    blank = lambda n: F.nullif(F.trim(n), F.lit(""))
    batch = last_page.select(
        "slug", "name", blank("industry").alias("industry"),
        F.when(F.col("cik") != 0, F.col("cik").cast("string")).otherwise(blank("raw_cik")).alias("cik"),
        blank("sub_industry").alias("gics_sub_industry"), blank("headquarters").alias("headquarters_location"),
        F.col("index").alias("index_membership"), blank("article").alias("article_title"),
    )
    held, top, touched = companies, None, set()
    if isinstance(companies, slots.SlotTable):
        batch, base = cut(batch), companies.latest()
        touched, top = companies.slots_of(batch), companies.top(base)
        held = companies.read(touched, base).drop(slots.SLOT)
    merged = cut(merge.index_upsert(held, batch, now))
    fresh = merge.assign_ids(merged.filter("merge_action = 'created'").drop("company_id"), held, ["slug"], "company_id", top=top)
    out = merged.filter("merge_action <> 'created'").unionByName(fresh.select(*merged.columns))
    if touched:
        out = cut(out)
        companies.replace(out.drop("merge_action"), touched, base, base + 1)
    found = rows.groupBy("index").agg(F.count("*").alias("found"))
    exit_code = F.when(F.col("problem").isNotNull(), 1).when(F.col("found") == 0, 4).otherwise(0)
    report = (
        pages.select("index", "position").join(found, "index", "left").join(problems, "index", "left").fillna(0, ["found"])
        .withColumn("exit_code", exit_code)
    )
    return {"companies": out.drop("merge_action"), "changes": out, "report": report, "errors": errors}


def report_exit(report: DataFrame) -> DataFrame:
    """One exit code over all pages of a run."""
    return quality.worst_exit(report.withColumn("all", F.lit("all")), ["all"], "exit_code", "position")


def listings_job(
    companies: DataFrame, answers: DataFrame, responses: DataFrame, jobs: DataFrame, now: ColumnOrName, run_id: int,
    robots: DataFrame | None = None, ttl_seconds: int = 7 * 86400, max_jobs: int | None = None,
) -> dict[str, DataFrame]:
    """Listings of all companies at once: cache or agent answer, fetch gate, links, postings, upsert,
    guarded staleness, counters.

    companies(company_id, slug, name, vendor, discovery_platform_id, pattern, listings_url, ...),
    answers(company_id, listings_url, has_remote, evidence, blocked, block_reason, ok, error, steps).
    """
    responses = cut(single_responses(responses))
    cached = cached_listings(companies, now, ttl_seconds)
    a = answers.select("company_id", *[F.col(x).alias(f"a_{x}") for x in ("listings_url", "has_remote", "blocked", "ok", "error")])
    j = cached.join(a, "company_id", "left")
    use_cache = F.col("cache_usable")
    decided = cut(j.select(
        "company_id", "slug", "discovery_platform_id", "pattern",
        F.when(use_cache, "cache").otherwise("agent").alias("resolution"),
        F.when(use_cache, F.col("listings_url")).otherwise(F.coalesce("a_listings_url", F.lit(""))).alias("start_url"),
        F.when(use_cache, F.coalesce("listings_url_remote_confirmed", F.lit(False))).otherwise(F.coalesce("a_has_remote", F.lit(False))).alias("remote_confirmed"),
        (~use_cache & ~F.coalesce(F.col("a_ok"), F.lit(False))).alias("agent_failed"), F.coalesce("a_blocked", F.lit(False)).alias("answer_blocked"),
    ))
    to_cache = decided.filter((F.col("resolution") == "agent") & ~F.col("agent_failed")).select(
        "company_id", F.col("start_url").alias("listings_url"), F.col("remote_confirmed").alias("has_remote"), F.col("answer_blocked").alias("blocked")
    )
    new_companies = merge.set_listings(companies, merge.cacheable_answers(to_cache), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    go = merge.fetchable(decided.filter((F.col("start_url") != "") & ~F.col("agent_failed")))
    go = go.withColumn("host", U.host("start_url"))
    if robots is not None:
        go = robots_allowed(go, robots, "start_url", "host")
        disallowed = go.filter(~F.col("allowed"))
        go = go.filter("allowed")
    else:
        disallowed = go.limit(0)
    pages = fetch(go.withColumn("url", F.col("start_url")), responses)
    text = jsonld.strip_tags("body")
    from rolegrid.functions.text import document_title

    judged = cut(annotate_blocks(pages.withColumns({"title": document_title("body"), "text": text}), "status", "title", "text"))
    unread = F.col("transport_error").isNotNull()
    open_pages = judged.filter(~F.col("blocked") & ~unread)
    links = posting_links(open_pages.select("company_id", F.coalesce(F.nullif("response_url", F.lit("")), "url").alias("page_url"), "body"), "company_id", "page_url", "body", max_jobs)
    fetched = fetch(links.withColumnRenamed("link", "url").withColumnRenamed("title", "link_title"), responses)
    read = fetched.withColumns({"__r": jsonld.posting_record(F.coalesce("body", F.lit("")), "link_title"), "title": document_title("body"), "text": text})
    noted = annotate_blocks(read, "status", "title", "text")
    postings = cut(noted.select(
        "company_id", F.col("rank").alias("ordinal"), "url", F.col("__r.title").alias("title"), F.col("__r.description").alias("description"),
        F.col("__r.raw_data").alias("raw_data"), F.col("__r.country").alias("country"), F.col("__r.is_us").alias("is_us"),
        F.col("__r.location_text").alias("location_text"), F.col("transport_error").alias("error"), F.nullif("block_reason", F.lit("")).alias("block_reason"),
        jsonld.parse_posting("__r.raw_data")["remote"].alias("remote"),
    ).join(decided.select("company_id", "discovery_platform_id", "pattern"), "company_id"))
    # The seen set comes before any filter: foreign and unreadable postings are still there.
    seen = merge.observed_keys(postings.withColumn("external_id", U.external_id("url", "pattern")), ["discovery_platform_id", "company_id"])
    notes = merge.closure_notes(postings, ["company_id"], max_jobs)
    batch = posting_batch(postings.withColumn("scrape_run_id", F.lit(run_id).cast("bigint")))
    merged = merge.upsert_jobs(jobs, batch, now)
    new_jobs = cut(merge.mark_stale(merged, merge.safe_seen(seen, notes, ["company_id"]), ["discovery_platform_id", "company_id"], now))
    counters = runs.scrape_counters(postings, ["company_id"])
    written = new_jobs.groupBy("company_id").agg(
        F.count_if(F.col("merge_action") == "inserted").alias("inserted"), F.count_if(F.col("merge_action") == "updated").alias("refreshed"),
        F.count_if("newly_closed").alias("closed"),
    )
    page_state = judged.select("company_id", "blocked", "block_reason", unread.alias("unread"))
    denied = disallowed.select("company_id", F.lit(True).alias("__denied"))
    report = (
        decided.join(page_state, "company_id", "left").join(counters, "company_id", "left").join(written, "company_id", "left")
        .join(notes.select("company_id", "stale_note"), "company_id", "left").join(denied, "company_id", "left")
        .fillna(0, ["found", "accepted", "skipped_non_us", "remote_evidence", "inserted", "refreshed", "closed"])
    )
    outcome: Column = (
        F.when(F.col("agent_failed"), "agent_failed").when(F.col("start_url") == "", "listings_none")
        .when(~F.col("remote_confirmed"), "no_remote_roles").when(F.col("__denied"), "robots_disallowed")
        .when(F.col("unread"), "fetch_failed").when(F.col("blocked"), "blocked").otherwise("fetched")
    )
    report = report.withColumns({
        "outcome": outcome, "status": F.when(outcome.isin("agent_failed", "fetch_failed", "blocked"), "error").otherwise("ok"),
        "stale_note": F.when(outcome == "fetched", F.coalesce("stale_note", F.lit("none_observed"))).otherwise(F.coalesce("stale_note", F.lit(""))),
    })
    report = report.withColumn("quality", F.when(F.col("outcome") == "fetched", runs.quality_note("resolution", "remote_confirmed", "found", "inserted", "skipped_non_us")).otherwise("")).drop("__denied")
    return {
        "companies": new_companies, "jobs": new_jobs.drop("merge_action", "newly_closed"), "postings": postings, "report": report,
        "unreadable": runs.unreadable_tally(postings),
    }
