"""Keyed writes as snapshot merges: ``new_state = f(old_state, batch)``.

State tables are immutable snapshots, so every write is a join of the old state and a batch on the
natural key. Rows with a NULL key part match nothing; they are set aside before the join and added
back after it. The rest is unique on the key on both sides, so no key is ever hot in the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid import vocab
from rolegrid.functions import text as T
from rolegrid.functions.base import ColumnOrName, blank_to_null, c
from rolegrid.functions.jsonld import parse_posting
from rolegrid.operators.ranking import first_per_group, last_wins
from rolegrid.operators.scans import bucket, number_rows

JOB_KEY = ["discovery_platform_id", "external_id"]
# The columns a re-observation replaces.
JOB_CONTENT = [
    "company_id", "application_url", "listing_url", "discovery_url", "title", "employment_type",
    "is_remote", "location_text", "country", "is_us", "description", "salary_min_cents",
    "salary_max_cents", "salary_currency", "salary_period", "tags", "posted_at", "scrape_run_id",
]
NUMBER_BUCKETS = 4096
SEEN = "__seen"


def assign_ids(
    fresh: DataFrame, state: DataFrame, key: list[str], id_col: str, buckets: int = NUMBER_BUCKETS, top: Column | None = None
) -> DataFrame:
    """Dense new ids after the highest existing one (or ``top``). Rows are numbered inside hash buckets and offset
    by bucket totals, so no single task numbers the whole table."""
    spread = F.pmod(F.xxhash64(*key), F.lit(buckets))
    numbered = number_rows(fresh, [], [F.col(k) for k in key], spread, "__n")
    after = state.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top")).scalar() if top is None else top
    return numbered.withColumn(id_col, after + F.col("__n")).drop("__n")


def keyed(key: list[str]) -> Column:
    """No part of the key is NULL."""
    return reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in key])


def number_fresh(
    batch: DataFrame, state: DataFrame, key: list[str], id_col: str, buckets: int = NUMBER_BUCKETS, top: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """batch (unique on key) with ids for the keys that state does not hold, NULL for the others, as (rows with a whole
    key, rows with a NULL in it): dense ids after the highest one (``top`` where state is only a part of the table), found
    before the merge so that the merge itself is planned once. Only keys are numbered; the rows meet their ids in a join
    by key, which the merge then needs anyway."""
    whole = keyed(key)
    order, spread = [F.col(k) for k in key], F.pmod(F.xxhash64(*key), F.lit(buckets))
    after = state.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top")).scalar() if top is None else top
    alone = batch.filter(~whole)
    loose = number_rows(alone, [], order, spread, "__n").withColumn(id_col, after + F.col("__n")).drop("__n")
    fresh = batch.filter(whole).select(*key).distinct().join(state.filter(whole).select(*key), key, "left_anti")
    after = after + alone.agg(F.count(F.lit(1)).alias("__alone")).scalar()
    ids = number_rows(fresh, [], order, spread, "__n").select(*key, (after + F.col("__n")).alias(id_col))
    return batch.filter(whole).join(ids, key, "left"), loose


def upsert(
    state: DataFrame,
    batch: DataFrame,
    key: list[str],
    content: list[str],
    now: ColumnOrName,
    insert_only: list[str] | None = None,
    touched: list[str] | None = None,
    born: list[str] | None = None,
    status: str | None = None,
    ordinal: str | None = None,
    loose: DataFrame | None = None,
) -> DataFrame:
    """Full-outer merge. Content comes from the batch where it has the key; ``insert_only`` columns
    only for new keys; ``born`` columns are stamped once, ``touched`` at every sighting. Adds
    ``merge_action``: inserted, updated or kept. Rows with a NULL key part never match; ``loose`` are those of the
    batch where they were set aside before."""
    b = last_wins(batch, key, ordinal) if ordinal else batch
    stamp = c(now) if not isinstance(now, Column) else now
    insert_only, touched, born = insert_only or [], touched or [], born or []
    whole = keyed(key)
    cond = F.lit(True)
    for k in key:
        cond = cond & (F.col(f"s.{k}") == F.col(f"b.{k}"))
    left = state.filter(whole).withColumn("__old", F.lit(True)).alias("s")
    right = b.filter(whole).withColumn("__new", F.lit(True)).alias("b")
    joined = left.join(right, cond, "full_outer")
    seen, known = F.col("b.__new").isNotNull(), F.col("s.__old").isNotNull()
    batch_cols = set(b.columns)
    out = []
    for col in state.columns:
        old = F.col(f"s.{col}")
        if col in key:
            value = F.coalesce(old, F.col(f"b.{col}"))
        elif col in content:
            value = F.when(seen, F.col(f"b.{col}")).otherwise(old) if col in batch_cols else F.when(seen, F.lit(None)).otherwise(old)
        elif col in insert_only:
            value = F.when(seen & ~known, F.col(f"b.{col}")).otherwise(old) if col in batch_cols else old
        elif col in touched:
            value = F.when(seen, stamp).otherwise(old)
        elif col in born:
            value = F.when(known, old).otherwise(stamp)
        elif col == status:
            value = F.when(seen, F.lit("open")).otherwise(old)
        else:
            value = old
        out.append(value.alias(col))
    action = F.when(seen & known, "updated").when(seen, "inserted").otherwise("kept").alias("merge_action")
    alone = []
    for col in state.columns:
        if col in touched or col in born:
            value = stamp
        elif col == status:
            value = F.lit("open")
        else:
            given = col in batch_cols and (col in key or col in content or col in insert_only)
            value = F.col(col) if given else F.lit(None).cast(state.schema[col].dataType)
        alone.append(value.alias(col))
    return (
        joined.select(*out, action)
        .unionByName(state.filter(~whole).select(*state.columns, F.lit("kept").alias("merge_action")))
        .unionByName((b.filter(~whole) if loose is None else loose).select(*alone, F.lit("inserted").alias("merge_action")))
    )


def upsert_jobs(
    state: DataFrame, batch: DataFrame, now: ColumnOrName, replace_raw: bool = False, ordinal: str | None = "ordinal", top: Column | None = None
) -> DataFrame:
    """Posting upsert: content replaced, reopened, last_seen moved; first_seen, created and (unless
    told otherwise) raw_data kept. New rows get ids after the highest one (``top``, if given). A ``__seen`` flag
    (``flag_seen``) on both sides goes with the content."""
    content = [*JOB_CONTENT, SEEN] + (["raw_data"] if replace_raw else [])
    last, loose = last_wins(batch, JOB_KEY, ordinal) if ordinal else batch, None
    ids = "job_id" in state.columns
    if ids:
        last, loose = number_fresh(last.drop("job_id"), state, JOB_KEY, "job_id", top=top)
    return upsert(
        state, last, JOB_KEY, content, now,
        insert_only=([] if replace_raw else ["raw_data"]) + (["job_id"] if ids else []),
        touched=["last_seen_at", "updated_at"], born=["first_seen_at", "created_at"], status="status", loose=loose,
    )


def browser_batch(postings: DataFrame) -> DataFrame:
    """Listings-flow batch: blank optionals as NULL; what the flow never learns is NULL."""
    optional = ["employment_type", "location_text", "country", "description", "raw_data"]
    return postings.withColumns({col: blank_to_null(col) for col in optional if col in postings.columns})


def flag_seen(rows: DataFrame, seen: DataFrame, scope: list[str], key: str = "external_id") -> DataFrame:
    """Adds ``__seen``: true where the row's scope and key were seen, else NULL."""
    observed = seen.filter(F.col(key).isNotNull()).select(*scope, key).distinct()
    return rows.join(observed.withColumn(SEEN, F.lit(True)), [*scope, key], "left").select(*rows.columns, SEEN)


def mark_stale(state: DataFrame, seen: DataFrame, scope: list[str], now: ColumnOrName, key: str = "external_id") -> DataFrame:
    """Close open rows of a scope whose non-NULL key was not seen. A scope with an empty seen set
    closes nothing, nor does a NULL key. Adds ``newly_closed``. Rows that carry ``__seen`` are not looked up again."""
    scopes = seen.filter(F.col(key).isNotNull()).select(*scope).distinct().withColumn("__scope", F.lit(True))
    flagged = (state if SEEN in state.columns else flag_seen(state, seen, scope, key)).join(scopes, scope, "left")
    stale = (
        (F.col("status") == "open") & F.col(key).isNotNull() & F.col("__scope").isNotNull() & F.col(SEEN).isNull()
    )
    return flagged.select(
        *[
            F.when(stale, F.lit("closed")).otherwise(F.col(col)).alias(col) if col == "status"
            else F.when(stale, c(now)).otherwise(F.col(col)).alias(col) if col == "updated_at"
            else F.col(col)
            for col in state.columns
            if col != SEEN
        ],
        F.coalesce(stale, F.lit(False)).alias("newly_closed"),
    )


def stale_difference(state: DataFrame, seen: DataFrame, scope: list[str], key: str = "external_id") -> DataFrame:
    """Known open keys minus seen keys, NULL keys left out first (an anti join would keep them)."""
    known = state.filter((F.col("status") == "open") & F.col(key).isNotNull())
    return known.join(seen.select(*scope, key).distinct(), [*scope, key], "left_anti")


def observed_keys(raw: DataFrame, scope: list[str], key: str = "external_id") -> DataFrame:
    """The seen set, taken from the raw batch before any filter."""
    return raw.filter(F.col(key).isNotNull() & (F.col(key) != "")).select(*scope, key).distinct()


def closure_notes(fetched: DataFrame, scope: list[str], max_jobs: int | None = None, url: str = "url", accepted: str | None = None) -> DataFrame:
    """Per scope the reason not to close anything ('' = closing is safe)."""
    counts = fetched.groupBy(*scope).agg(
        F.count("*").alias("fetched"),
        F.count_if(F.coalesce(F.col(url), F.lit("")) != "").alias("observed"),
        (F.count_if(F.col(accepted)) if accepted else F.count("*")).alias("accepted"),
    )
    note = (
        F.when(F.col("accepted") == 0, F.lit("none_accepted"))
        .when(F.col("observed") == 0, F.lit("none_observed"))
        .when(F.lit(False) if max_jobs is None else F.col("fetched") >= max_jobs, F.lit(f"truncated_at_max_jobs={max_jobs}"))
        .otherwise("")
    )
    return counts.withColumn("stale_note", note)


def safe_seen(seen: DataFrame, notes: DataFrame, scope: list[str]) -> DataFrame:
    """The seen set without the scopes that carry a note."""
    return seen.join(notes.filter(F.col("stale_note") != "").select(*scope), scope, "left_anti")


# --- companies ----------------------------------------------------------------------------------


def resolve_companies(companies: DataFrame, names: DataFrame, name: str = "name", ordinal: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(new companies, rejected names). A new slug takes its first spelling."""
    slugged = names.select(F.col(name).alias("name"), F.col(ordinal).alias("ordinal"), T.slugify(name).alias("slug"))
    rejected = slugged.filter(F.coalesce(F.col("slug"), F.lit("")) == "").select("name", "ordinal")
    fresh = (
        slugged.filter(F.col("slug") != "").groupBy("slug").agg(F.min_by("name", "ordinal").alias("name"))
        .join(companies.select("slug"), "slug", "left_anti")
    )
    return fresh, rejected


INDEX_COLUMNS = ["name", "industry", "cik", "gics_sub_industry", "headquarters_location", "index_membership", "article_title"]


def index_batch(rows: DataFrame, index: str) -> tuple[DataFrame, DataFrame]:
    """(batch, errors) of constituent rows: the first row of a slug wins; unusable names are errors."""
    named = rows.withColumns({"name": F.trim("name"), "slug": T.slugify(F.trim("name"))})
    problem = F.when(F.coalesce(F.col("name"), F.lit("")) == "", "empty company name").when(
        F.col("slug") == "", "name has no characters usable in a slug"
    )
    judged = named.withColumn("problem", problem)
    cik = F.when(F.coalesce(F.col("cik"), F.lit(0)) != 0, F.col("cik").cast("string")).otherwise(blank_to_null("raw_cik"))
    good = first_per_group(judged.filter(F.col("problem").isNull()), ["slug"], ["ordinal"]).select(
        "slug", "name", blank_to_null("industry").alias("industry"), cik.alias("cik"),
        blank_to_null("sub_industry").alias("gics_sub_industry"), blank_to_null("headquarters").alias("headquarters_location"),
        F.lit(index).alias("index_membership"), blank_to_null("article").alias("article_title"),
    )
    return good, judged.filter(F.col("problem").isNotNull()).select("ordinal", "name", "problem")


def index_upsert(state: DataFrame, batch: DataFrame, now: ColumnOrName, columns: list[str] = INDEX_COLUMNS) -> DataFrame:
    """Index upsert by slug: nothing moves when nothing differs (null-safe); created_at is kept.
    Adds ``merge_action``: created, changed, same or kept."""
    old = state.withColumn("__old", F.lit(True))
    new = batch.select("slug", *[F.col(x).alias(f"__{x}") for x in columns], F.lit(True).alias("__new"))
    j = old.join(new, "slug", "full_outer")
    differs = F.lit(False)
    for col in columns:
        differs = differs | ~F.col(col).eqNullSafe(F.col(f"__{col}"))
    seen, known = F.col("__new").isNotNull(), F.col("__old").isNotNull()
    action = F.when(seen & ~known, "created").when(seen & differs, "changed").when(seen, "same").otherwise("kept")
    moved = action.isin("created", "changed")
    out = []
    for col in state.columns:
        if col in columns:
            out.append(F.when(seen, F.col(f"__{col}")).otherwise(F.col(col)).alias(col))
        elif col == "created_at":
            out.append(F.when(known, F.col(col)).otherwise(c(now)).alias(col))
        elif col == "updated_at":
            out.append(F.when(moved, c(now)).otherwise(F.col(col)).alias(col))
        else:
            out.append(F.col(col))
    return j.select(*out, action.alias("merge_action"))


def set_listings(companies: DataFrame, answers: DataFrame, now: ColumnOrName) -> DataFrame:
    """Cache or clear listings URLs. ``answers(company_id, new_url, new_confirmed)``: a NULL URL clears."""
    hit = F.col("__hit").isNotNull()
    j = companies.join(answers.select("company_id", "new_url", "new_confirmed", F.lit(True).alias("__hit")), "company_id", "left")
    setting = F.col("new_url").isNotNull()
    return j.withColumns({
        "listings_url": F.when(hit, F.col("new_url")).otherwise(F.col("listings_url")),
        "listings_url_resolved_at": F.when(hit & setting, c(now)).when(hit, F.lit(None)).otherwise(F.col("listings_url_resolved_at")),
        "listings_url_remote_confirmed": F.when(hit & setting, F.coalesce("new_confirmed", F.lit(False))).when(hit, F.lit(None)).otherwise(F.col("listings_url_remote_confirmed")),
        "updated_at": F.when(hit, c(now)).otherwise(F.col("updated_at")),
    }).select(*companies.columns)


def cacheable_answers(answers: DataFrame) -> DataFrame:
    """Answers worth caching: a URL was named and the page was not blocked."""
    return answers.filter(~F.coalesce(F.col("blocked"), F.lit(False)) & (F.coalesce(F.col("listings_url"), F.lit("")) != "")).select(
        "company_id", F.col("listings_url").alias("new_url"), F.col("has_remote").alias("new_confirmed")
    )


def fetchable(companies: DataFrame, confirmed: str = "remote_confirmed") -> DataFrame:
    """Only companies whose listings page was confirmed to hold remote roles are fetched."""
    return companies.filter(F.coalesce(F.col(confirmed), F.lit(False)))


def vendor_upsert(state: DataFrame, batch: DataFrame, platforms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new state, rejects) of company vendors; only application systems are accepted."""
    kinds = platforms.select("platform_id", "platform_type")
    judged = batch.join(kinds, "platform_id", "left")
    good = judged.filter(F.col("platform_type") == "application_system").select("company_id", "platform_id", blank_to_null("base_url").alias("base_url"))
    rejects = judged.filter(~F.col("platform_type").eqNullSafe("application_system"))
    merged = upsert(state, good, ["company_id", "platform_id"], ["base_url"], F.current_timestamp())
    return merged, rejects.select("company_id", "platform_id", "platform_type")


RESOLUTION_COLUMNS = {
    "website": "new_website", "website_source": "new_website_source", "career_site_url": "new_url",
    "career_site_url_source": "new_url_source", "career_site_url_http_status": "new_status",
    "career_site_url_title": "new_title",
}


def write_resolutions(companies: DataFrame, resolutions: DataFrame, now: ColumnOrName) -> DataFrame:
    """Coalesce new facts over old ones; the check time always moves; dry runs write nothing. Adds
    ``resolution_action``: inserted, updated, none (NULL = not part of the batch)."""
    cols = {k: v for k, v in RESOLUTION_COLUMNS.items() if k in companies.columns and v in resolutions.columns}
    live = F.col("__res").isNotNull() & ~F.coalesce(F.col("__dry"), F.lit(False))
    r = resolutions.select(
        "company_id", *[(F.nullif(F.col(v), F.lit(0)) if v == "new_status" else blank_to_null(v)).alias(v) for v in cols.values()],
        F.col("dry_run").alias("__dry"), F.lit(True).alias("__res"),
    )
    j = companies.join(r, "company_id", "left")
    new, old = F.col("new_url"), F.col("career_site_url")
    action = (
        F.when(F.col("__res").isNull(), F.lit(None))
        .when(live & new.isNotNull() & old.isNull(), "inserted")
        .when(live & new.isNotNull() & (old != new), "updated")
        .otherwise("none")
    )
    changes = {k: F.when(live, F.coalesce(F.col(v), F.col(k))).otherwise(F.col(k)) for k, v in cols.items()}
    for stamp in ("career_site_url_checked_at", "updated_at"):
        if stamp in companies.columns:
            changes[stamp] = F.when(live, c(now)).otherwise(F.col(stamp))
    return j.withColumns({**changes, "resolution_action": action}).select(*companies.columns, "resolution_action")


def write_verdicts(companies: DataFrame, verdicts: DataFrame, now: ColumnOrName) -> DataFrame:
    """Set verdict, judged URL, time and run; a blank verdict leaves the stored one alone."""
    v = verdicts.filter(F.coalesce(F.col("new_verdict"), F.lit("")) != "").select("company_id", "new_verdict", "new_verdict_url", "new_run_id")
    j = companies.join(v, "company_id", "left")
    hit = F.col("new_verdict").isNotNull()
    return j.withColumns({
        "verdict": F.coalesce("new_verdict", "verdict"),
        "verdict_url": F.when(hit, F.col("new_verdict_url")).otherwise(F.col("verdict_url")),
        "verdict_at": F.when(hit, c(now)).otherwise(F.col("verdict_at")),
        "verdict_run_id": F.when(hit, F.col("new_run_id")).otherwise(F.col("verdict_run_id")),
    }).select(*companies.columns)


def declared_reason(reason: ColumnOrName) -> Column:
    return F.coalesce(c(reason).isin(vocab.REASON_NAMES) | c(reason).startswith("http_"), F.lit(False))


def check_resolutions(resolutions: DataFrame) -> DataFrame:
    """Adds ``problem``: the first broken write rule, NULL when the row may be written."""
    blank = lambda n: F.coalesce(F.col(n), F.lit("")) == ""
    problem = (
        F.when(F.coalesce(F.col("company_id"), F.lit(0)) == 0, "company id is zero")
        .when(~blank("new_url") & ~F.coalesce(F.col("new_url_source").isin(vocab.CAREER_SITE_SOURCES), F.lit(False)), "career site source is not declared")
        .when(blank("new_url") & ~blank("new_url_source"), "source set with no career site URL")
        .when(~blank("new_website") & ~F.coalesce(F.col("new_website_source").isin(vocab.WEBSITE_SOURCES), F.lit(False)), "website source is not declared")
        .when(blank("new_website") & ~blank("new_website_source"), "website source set with no website")
        .when(~blank("new_verdict") & ~F.col("new_verdict").isin(vocab.VERDICTS), "verdict is not declared")
        .when(~blank("new_verdict") & (F.trim(F.coalesce(F.col("new_verdict_url"), F.lit(""))) == ""), "verdict with no URL")
        .when(blank("new_verdict") & ~blank("new_verdict_url"), "verdict URL with no verdict")
    )
    return resolutions.withColumn("problem", problem)


def check_attempts(attempts: DataFrame) -> DataFrame:
    """Adds ``problem``: accepted has no reason, anything else has a declared one."""
    blank = F.coalesce(F.col("rejection_reason"), F.lit("")) == ""
    problem = (
        F.when(F.coalesce(F.col("validation_status"), F.lit("")) == "", "validation state is empty")
        .when((F.col("validation_status") == "accepted") & ~blank, "accepted attempt carries a reason")
        .when((F.col("validation_status") != "accepted") & blank, "attempt has no reason")
        .when((F.col("validation_status") != "accepted") & ~declared_reason("rejection_reason"), "reason is not declared")
    )
    return attempts.withColumn("problem", problem)


def attempt_rows(candidates: DataFrame, existing: DataFrame, run: str = "run_id", by: Column | None = None) -> DataFrame:
    """Attempt rows to append: slots continue from the company's first free one in the run; accepted
    carries no reason; status 0 and blanks are NULL. Positions are numbered inside buckets of ``position``
    (``by``, which never falls while it rises; a number's own bucket by default), so that the attempts of one
    company in one run, or of rows without either, spread over tasks."""
    taken = existing.groupBy(run, "company_id").agg((F.max("attempt_index") + 1).alias("__first"))
    numbered = number_rows(candidates, [run, "company_id"], ["position"], bucket("position") if by is None else by, "__slot")
    j = numbered.join(taken, [run, "company_id"], "left")
    return j.select(
        "company_id", run, (F.coalesce("__first", F.lit(0)) + F.col("__slot") - 1).cast("bigint").alias("attempt_index"),
        "source", "candidate_url", "candidate_kind", F.nullif(F.col("http_status"), F.lit(0)).cast("bigint").alias("http_status"),
        blank_to_null("final_url").alias("final_url"), blank_to_null("title").alias("title"), "validation_status",
        F.when(F.col("validation_status") != "accepted", F.col("rejection_reason")).alias("rejection_reason"),
        blank_to_null("evidence").alias("evidence"),
    )


# --- run ledger ---------------------------------------------------------------------------------


def fold_runs(events: DataFrame) -> DataFrame:
    """Run rows from start and finish events: the first start, the last finish."""
    start, finish = F.col("kind") == "start", F.col("kind") == "finish"
    order = F.struct("at", "seq")

    def first(name: str) -> Column:
        return F.min_by(F.when(start, F.col(name)), F.when(start, order)).alias(name)

    def last(name: str) -> Column:
        return F.max_by(F.when(finish, F.col(name)), F.when(finish, order))

    counts = ["items_found", "items_inserted", "items_updated", "items_wrong", "items_unverifiable"]
    return events.groupBy("run_id").agg(
        first("platform_id"), first("company_id"), F.min(F.when(start, F.col("at"))).alias("started_at"),
        F.max(F.when(finish, F.col("at"))).alias("finished_at"),
        F.coalesce(last("status"), F.lit("running")).alias("status"),
        *[F.coalesce(last(n), F.lit(0)).cast("bigint").alias(n) for n in counts],
        last("error_text").alias("error_text"),
        F.coalesce(F.bool_or(F.when(start, F.col("dry_run"))), F.lit(False)).alias("dry_run"),
    )


def _stop_running(runs: DataFrame, which: Column, now: ColumnOrName, text: str) -> DataFrame:
    stop = F.coalesce(which & (F.col("status") == "running"), F.lit(False))
    return runs.withColumns({
        "stopped": stop,
        "finished_at": F.when(stop, c(now)).otherwise(F.col("finished_at")),
        "error_text": F.when(stop, F.lit(text)).otherwise(F.col("error_text")),
        "status": F.when(stop, F.lit("error")).otherwise(F.col("status")),
    })


def cancel_runs(runs: DataFrame, run_ids: list[int], now: ColumnOrName) -> DataFrame:
    """Cancel the named runs that are still running."""
    return _stop_running(runs, F.col("id").isin(run_ids), now, "cancelled by user")


def reconcile_runs(runs: DataFrame, now: ColumnOrName) -> DataFrame:
    """Every run still marked running after a restart ends as an error."""
    return _stop_running(runs, F.lit(True), now, "interrupted by restart")


# --- backfills ----------------------------------------------------------------------------------


def posting_backfill(jobs: DataFrame, now: ColumnOrName) -> DataFrame:
    """Re-read the stored posting JSON and fill type and date only where they differ. Adds
    ``backfilled``; running it on its own result changes nothing."""
    p = jobs.withColumn("__p", parse_posting("raw_data", ("employment_type", "posted_at")))
    new_type, new_time = F.nullif(F.col("__p.employment_type"), F.lit("")), F.col("__p.posted_at")
    type_moves = new_type.isNotNull() & ~new_type.eqNullSafe(F.col("employment_type"))
    time_moves = new_time.isNotNull() & ~new_time.eqNullSafe(F.col("posted_at"))
    moves = F.col("raw_data").isNotNull() & (type_moves | time_moves)
    changed = {
        "backfilled": F.coalesce(moves, F.lit(False)),
        "employment_type": F.when(type_moves, new_type).otherwise(F.col("employment_type")),
        "posted_at": F.when(time_moves, new_time).otherwise(F.col("posted_at")),
    }
    if "updated_at" in jobs.columns:
        changed["updated_at"] = F.when(moves, c(now)).otherwise(F.col("updated_at"))
    return p.withColumns(changed).drop("__p")


def backfill_counts(jobs: DataFrame, now: ColumnOrName) -> DataFrame:
    """scanned, parsed, remote_declared, to_write in one row: the dry run."""
    p = jobs.filter(F.col("raw_data").isNotNull()).withColumn("__q", parse_posting("raw_data"))
    return posting_backfill(p, now).agg(
        F.count("*").alias("scanned"), F.count_if(F.col("__q.is_posting")).alias("parsed"),
        F.count_if(F.col("__q.remote").isNotNull()).alias("remote_declared"), F.count_if("backfilled").alias("to_write"),
    )


def membership_platform(membership: ColumnOrName) -> Column:
    from rolegrid.functions.base import map_lookup

    return map_lookup(c(membership), vocab.MEMBERSHIP_PLATFORM).cast("bigint")


def confirm_cached(companies: DataFrame) -> DataFrame:
    """A cached listings URL counts as confirmed."""
    return companies.withColumn(
        "listings_url_remote_confirmed", F.when(F.col("listings_url").isNotNull(), F.lit(True)).otherwise(F.col("listings_url_remote_confirmed"))
    )
