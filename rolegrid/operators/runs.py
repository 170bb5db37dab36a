"""Run, trace and sweep analytics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid import vocab
from rolegrid.functions import times
from rolegrid.functions.base import ColumnOrName, attach_row, c
from rolegrid.operators.ranking import percentiles, tally, top_k
from rolegrid.operators.scans import bucket, number_rows, previous, running_sum

# --- runs ---------------------------------------------------------------------------------------


def normalise_runs(local: DataFrame | None, remote: DataFrame | None) -> DataFrame:
    """Runs from either shape: missing columns are added, missing counts are 0 and texts ''."""
    parts = [df for df in (local, remote) if df is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    defaults = {"platform": "", "status": "", "error_text": "", "company": "", "items_found": 0, "items_inserted": 0, "items_updated": 0}
    for name, value in defaults.items():
        lit = F.lit(value).cast("bigint") if isinstance(value, int) else F.lit(value)
        out = out.withColumn(name, F.coalesce(F.col(name), lit) if name in out.columns else lit)
    return out


def with_duration(runs: DataFrame) -> DataFrame:
    return runs.withColumn("duration_s", times.duration_seconds("started_at", "finished_at"))


FILTERS = {
    "platform", "status", "company", "error_contains", "min_duration_s", "max_duration_s",
    "since", "until", "min_id", "max_id", "has_trace", "sort", "limit", "offset",
}


def query_runs(runs: DataFrame, traced: DataFrame | None = None, **filters) -> DataFrame:
    """Filter, sort and cut runs. An unknown filter or sort raises, so a typo cannot return everything.

    ``traced`` (run_id) is needed for ``has_trace``.
    """
    unknown = set(filters) - FILTERS
    if unknown:
        raise ValueError(f"unknown filter(s): {', '.join(sorted(unknown))}")
    out = with_duration(runs)
    get = filters.get

    def contains(col: str, needle: str) -> Column:
        return F.contains(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit(needle.lower()))

    if get("platform"):
        out = out.filter(F.col("platform") == get("platform"))
    if get("status"):
        out = out.filter(F.col("status") == get("status"))
    if get("company"):
        out = out.filter(contains("company", get("company")))
    if get("error_contains"):
        out = out.filter(contains("error_text", get("error_contains")))
    if get("min_duration_s") is not None:
        out = out.filter(F.col("duration_s") >= get("min_duration_s"))
    if get("max_duration_s") is not None:
        out = out.filter(F.col("duration_s") <= get("max_duration_s"))
    if get("since"):
        out = out.filter(F.col("started_at") >= F.lit(get("since")).cast("timestamp"))
    if get("until"):
        out = out.filter(F.coalesce(F.col("started_at") <= F.lit(get("until")).cast("timestamp"), F.lit(True)))
    if get("min_id") is not None:
        out = out.filter(F.col("id") >= get("min_id"))
    if get("max_id") is not None:
        out = out.filter(F.col("id") <= get("max_id"))
    if get("has_trace") is not None:
        if traced is None:
            raise ValueError("has_trace needs the traced runs")
        known = traced.select(F.col("run_id").alias("id")).distinct()
        out = out.join(known, "id", "left_semi" if get("has_trace") else "left_anti")
    sort = get("sort") or "id_desc"
    if sort not in vocab.RUN_SORTS:
        raise ValueError(f"unknown sort {sort!r}")
    if get("limit") or get("offset") or get("sort"):
        out = out.orderBy(*run_order(sort))
    if get("offset"):
        out = out.offset(int(get("offset")))
    return out.limit(int(get("limit"))) if get("limit") else out


def run_order(sort: str) -> list[Column]:
    """Sort keys; runs without a duration come last both ways. The id makes every order total."""
    return {
        "duration_desc": [F.desc_nulls_last("duration_s"), F.asc("id")],
        "duration_asc": [F.asc_nulls_last("duration_s"), F.asc("id")],
        "id_asc": [F.asc("id")],
        "id_desc": [F.desc("id")],
        "started_desc": [F.desc_nulls_last("started_at"), F.asc("id")],
    }[sort]


def run_stats(runs: DataFrame, traced: DataFrame | None = None, digits: int | None = 1) -> DataFrame:
    """One row: runs, wall hours, runs without duration, traced runs, and duration percentiles."""
    timed = with_duration(runs)
    head = timed.agg(
        F.count("*").alias("runs"),
        F.round(F.coalesce(F.sum(F.round(F.col("duration_s") * 1e6).cast("bigint")), F.lit(0)) / F.lit(3.6e9), 1).alias("total_wall_hours"),
        F.count_if(F.col("duration_s").isNull()).alias("runs_without_duration"),
    )
    pct = percentiles(timed, "duration_s", digits=digits).withColumnRenamed("n", "timed_runs")
    out = attach_row(head, pct)
    if traced is not None:
        seen = runs.join(traced.select(F.col("run_id").alias("id")).distinct(), "id", "left_semi").agg(F.count("*").alias("traced"))
        out = attach_row(out, seen)
    return out


def run_tallies(runs: DataFrame, errors: int | None = None, prefix: int | None = None) -> DataFrame:
    """Long form (kind, label, n): status and platform counts, and the error texts of failed runs: whole
    or by their first ``prefix`` characters, all or the ``errors`` most frequent."""
    text = F.coalesce(F.nullif(F.col("error_text"), F.lit("")), F.lit("(no error text)"))
    text = text if prefix is None else F.left(text, F.lit(prefix))
    parts = [
        tally(runs, "status", "label").withColumn("kind", F.lit("status")),
        tally(runs, "platform", "label").withColumn("kind", F.lit("platform")),
        tally(runs.filter("status = 'error'"), text, "label", errors).withColumn("kind", F.lit("error")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("kind", "label", "n")


# --- traces -------------------------------------------------------------------------------------


def trace_state(runs: DataFrame, files: DataFrame, events: DataFrame) -> DataFrame:
    """runs with ``trace_state``: present, empty (a trace without events) or missing (no trace)."""
    found = files.select(F.col("run_id").alias("id"), F.lit(True).alias("__file")).distinct()
    filled = events.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("trace_events"))
    j = runs.join(found, "id", "left").join(filled, "id", "left")
    state = F.when(F.col("__file").isNull() & F.col("trace_events").isNull(), "missing").when(F.col("trace_events") > 0, "present").otherwise("empty")
    return j.withColumn("trace_state", state).drop("__file").fillna(0, ["trace_events"])


def action_name(action: ColumnOrName) -> Column:
    """Name of an action: the first key of its object. Takes a map or a JSON object text."""
    return F.map_keys(c(action))[0]


def steps_per_run(events: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(run_id, steps) of every run that has a trace, 0 for a trace without steps."""
    counts = events.groupBy("run_id").agg(F.count_if(F.col("event") == "step").alias("steps"))
    if files is None:
        return counts
    return files.select("run_id").distinct().join(counts, "run_id", "left").fillna(0, ["steps"])


def action_counts(steps: DataFrame, action: str = "action") -> DataFrame:
    """Actions by name, most used first."""
    return tally(steps.filter(F.col("event") == "step"), action, "action")


def done_counts(events: DataFrame) -> DataFrame:
    done = events.filter(F.col("event") == "done")
    return done.agg(F.count("*").alias("with_done_event"), F.count_if(F.coalesce(F.col("success"), F.lit(False))).alias("done_successful"))


def step_bucket(steps: ColumnOrName) -> Column:
    n = c(steps)
    out = F.lit(None).cast("string")
    for label, low, high in reversed(vocab.STEP_BUCKETS):
        inside = n >= low if high is None else n.between(low, high)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def step_histogram(per_run: DataFrame) -> DataFrame:
    """Runs per step bucket; empty buckets are kept with 0."""
    spark = per_run.sparkSession
    dim = spark.createDataFrame([(label,) for label, _, _ in vocab.STEP_BUCKETS], "bucket string")
    counts = per_run.groupBy(step_bucket("steps").alias("bucket")).agg(F.count("*").alias("runs"))
    return dim.join(counts, "bucket", "left").fillna(0, ["runs"])


def step_latency(events: DataFrame, order: str = "seq", by: Column | None = None) -> DataFrame:
    """Seconds since the previous stamped step of the run in ``order``, which stamps need not follow:
    (run_id, step, latency_s). ``by`` must rise with ``order``.

    A step is stamped if it has any text for a stamp (``ts_text``, where the table has it); a stamp that is no
    instant gives neither its own step nor the next one a latency, and is not bridged."""
    stamp = F.nullif(F.col("ts_text"), F.lit("")) if "ts_text" in events.columns else F.col("ts")
    stamped = events.filter((F.col("event") == "step") & stamp.isNotNull()).select("run_id", order, "step", "ts")
    gaps = previous(stamped, ["run_id"], [order], by if by is not None else bucket(order), ["ts"])
    return gaps.filter(F.col("prev_ts").isNotNull() & F.col("ts").isNotNull()).select(
        "run_id", "step", times.duration_seconds("prev_ts", "ts").alias("latency_s")
    )


def slowest_steps(latency: DataFrame, k: int = 10) -> DataFrame:
    return latency.orderBy(F.desc("latency_s"), F.desc("run_id"), F.desc("step")).limit(k)


def trace_digest(events: DataFrame, order: str = "seq") -> DataFrame:
    """One row per run: steps, events, distinct URLs, first and last URL, and how it ended."""
    step = F.col("event") == "step"
    url = F.when(step, F.nullif(F.col("url"), F.lit("")))
    done = F.col("event") == "done"
    at = F.col(order)
    digest = events.groupBy("run_id").agg(
        F.count("*").alias("events"), F.count_if(step).alias("steps"),
        F.coalesce(F.min_by(url, F.when(url.isNotNull(), at)), F.lit("")).alias("first_url"),
        F.coalesce(F.max_by(url, F.when(url.isNotNull(), at)), F.lit("")).alias("last_url"),
        F.coalesce(F.bool_or(done), F.lit(False)).alias("has_done_event"),
        F.min_by(F.when(done, F.coalesce("success", F.lit(False))), F.when(done, at)).alias("done_success"),
        F.coalesce(F.min_by(F.when(done, F.col("final_result")), F.when(done, at)), F.lit("")).alias("final_result"),
    )
    urls = events.filter(step & (F.coalesce(F.col("url"), F.lit("")) != "")).groupBy("run_id").agg(F.countDistinct("url").alias("distinct_urls"))
    return digest.join(urls, "run_id", "left").fillna(0, ["distinct_urls"])


def digest_steps(events: DataFrame, max_steps: int | None = None, order: str = "seq", goal_chars: int | None = None) -> DataFrame:
    """The steps of each run (or the first ``max_steps``) with their goal (or its first ``goal_chars``)."""
    steps = events.filter(F.col("event") == "step")
    if max_steps is None:
        steps = number_rows(steps, ["run_id"], [order], bucket(order), "place")
    else:
        steps = top_k(steps, ["run_id"], [order], max_steps, "place")
    goal = F.coalesce(F.nullif(F.col("next_goal"), F.lit("")), F.nullif(F.col("evaluation_previous_goal"), F.lit("")))
    return steps.select("run_id", "place", "step", "url", (goal if goal_chars is None else F.left(goal, F.lit(goal_chars))).alias("goal"), "ts")


def step_line(event: dict[str, ColumnOrName]) -> Column:
    """Compact step struct: step, url, action names and their number; no model text."""
    names = F.transform(F.filter(c(event["actions"]), lambda a: F.size(a) > 0), lambda a: F.map_keys(a)[0])
    return F.struct(
        c(event["step"]).alias("step"), F.nullif(c(event["url"]), F.lit("")).alias("url"),
        F.when(F.size(names) > 0, names).alias("actions"), F.when(F.size(names) > 0, F.size(names)).cast("bigint").alias("action_count"),
    )


def search_steps(events: DataFrame, pattern: str, fields: list[str] | None = None, limit: int | None = None, order: str = "seq") -> DataFrame:
    """First field of each step that matches, with a snippet from 60 characters before the match to
    100 after it."""
    fields = fields or vocab.STEP_FIELDS
    unknown = [f for f in fields if f not in vocab.STEP_FIELDS]
    if unknown:
        raise ValueError(f"unknown field(s): {', '.join(unknown)}; known: {', '.join(vocab.STEP_FIELDS)}")
    try:
        re.compile(pattern)
    except re.error as exc:
        raise ValueError(f"bad regex {pattern!r}: {exc}") from exc
    rx = F.lit(f"(?i){pattern}")
    present = [f for f in fields if f in events.columns]
    texts = {f: F.col(f) if dict(events.dtypes)[f] == "string" else F.to_json(f) for f in present}
    hit = F.coalesce(*[F.when(F.regexp_like(texts[f], rx), F.struct(F.lit(f).alias("field"), texts[f].alias("text"))) for f in present])
    rows = events.filter(F.col("event") == "step").withColumn("__h", hit).filter(F.col("__h").isNotNull())
    found = F.regexp_substr("__h.text", rx)
    start = F.regexp_instr("__h.text", rx) - 1
    low = F.greatest(start - 60, F.lit(0))
    snippet = F.replace(F.substring(F.col("__h.text"), low + 1, start + F.length(found) + 100 - low), F.lit("\n"), F.lit(" "))
    out = rows.select("run_id", "step", F.col("__h.field").alias("field"), F.coalesce("url", F.lit("")).alias("url"), snippet.alias("snippet"), order)
    return out.orderBy("run_id", order).limit(limit) if limit else out


def search_scanned(events: DataFrame) -> DataFrame:
    """How much a step search looked at."""
    return events.agg(F.countDistinct("run_id").alias("scanned_runs"), F.count_if(F.col("event") == "step").alias("scanned_steps"))


def job_story(jobs: DataFrame, runs: DataFrame, digests: DataFrame) -> DataFrame:
    """Why a posting was found: posting, the run that stored it, the digest of that run's trace."""
    r = runs.select(F.col("id").alias("scrape_run_id"), F.col("status").alias("run_status"), "started_at")
    d = digests.select(F.col("run_id").alias("scrape_run_id"), "steps", "last_url", "final_result")
    return jobs.select("job_id", "title", "scrape_run_id").join(r, "scrape_run_id", "left").join(d, "scrape_run_id", "left")


# --- sweep planning -----------------------------------------------------------------------------


def skip_rule(skip_ok: bool, skip_traced: bool) -> Column:
    """Why a target is passed over; a trace counts only when that run ended well."""
    ok = F.col("last_run_status") == "ok"
    return F.when(F.lit(skip_ok) & ok, "last run ok").when(
        F.lit(skip_traced) & ok & F.coalesce(F.col("has_trace"), F.lit(False)), "browser-use trace present"
    )


def plan_sweep(
    targets: DataFrame, skip: Column, slugs: list[str] | None = None, from_slug: str | None = None, limit: int = 0,
    position: str = "pos", by: Column | None = None,
) -> DataFrame:
    """Targets with ``decision`` (planned or skipped) and ``reason``, in plan order.

    Slugs, then from-slug, then the skip rule, and the limit last: targets met after the quota was
    filled are in neither set.
    """
    out = targets
    if slugs:
        out = out.filter(F.col("slug").isin([s.strip() for s in slugs if s.strip()]))
    if from_slug:
        out = out.filter(F.lower("slug") >= from_slug.strip().lower())
    judged = out.withColumn("reason", skip)
    kept = F.col("reason").isNull()
    judged = judged.withColumn("decision", F.when(kept, "planned").otherwise("skipped"))
    if limit <= 0:
        return judged
    counted = running_sum(judged, [], [position], by if by is not None else bucket(position), {"__kept": kept.cast("int")})
    quota = F.when(F.col("decision") == "planned", F.col("__kept") <= limit).otherwise(F.col("__kept") < limit)
    return counted.filter(quota).drop("__kept")


def stop_point(outcomes: DataFrame, sweep: str, position: str, stop_after: int, by: Column | None = None) -> DataFrame:
    """Per sweep the position where it stops: the first streak of ``stop_after`` failures, or the
    first outcome that says the model host is down. NULL = the sweep runs through.

    outcomes(sweep, position, ok boolean, host_down boolean).
    """
    buckets = by if by is not None else bucket(position)
    scanned = running_sum(
        outcomes, [sweep], [position], buckets,
        {"__oks": F.col("ok").cast("int"), "__fails": (~F.col("ok")).cast("int")},
    )
    # Failures counted up to the last success: constant within a streak, so the streak's length is a
    # difference of two running counts.
    base = scanned.groupBy(sweep, "__oks").agg(F.min(F.when(~F.col("ok"), F.col("__fails"))).alias("__first"))
    j = scanned.join(base, [sweep, "__oks"])
    streak = F.when(~F.col("ok"), F.col("__fails") - F.col("__first") + 1)
    hits = (F.lit(stop_after > 0) & (streak >= stop_after)) | F.coalesce(F.col("host_down"), F.lit(False))
    return j.groupBy(sweep).agg(F.min(F.when(hits, F.col(position))).alias("stop_at"))


def not_run(outcomes: DataFrame, stops: DataFrame, sweep: str, position: str) -> DataFrame:
    """Companies after the stop point."""
    return outcomes.join(stops.filter(F.col("stop_at").isNotNull()), sweep).filter(F.col(position) > F.col("stop_at")).drop("stop_at")


def resume_point(events: DataFrame, sweep: str = "sweep_id", position: str = "seq") -> DataFrame:
    """Per sweep the last company started, NULL after a full run ('sweep finished' not stopped early)."""
    started = F.col("msg") == "company started"
    full = (F.col("msg") == "sweep finished") & ~F.coalesce(F.col("stopped_early"), F.lit(False))
    last = F.max_by(F.when(started, F.col("company")), F.when(started, F.col(position)))
    return events.groupBy(sweep).agg(last.alias("__last"), F.coalesce(F.bool_or(full), F.lit(False)).alias("__full")).select(
        sweep, F.when(~F.col("__full"), F.col("__last")).alias("resume_from")
    )


# --- plain-text sweep logs ----------------------------------------------------------------------

BANNER = r"^\[(\d+)/(\d+)\] company=(\S+) vendor=(\S+)\s*$"


def sweep_blocks(lines: DataFrame, run: str = "run_id", line_no: str = "line_no", by: Column | None = None) -> DataFrame:
    """One row per company banner of a sweep log: outcome by marker priority, and the first found=,
    inserted= and closed= numbers of its block."""
    line = F.col("line")
    marked = lines.withColumn("__banner", line.rlike(BANNER))
    blocks = running_sum(marked, [run], [line_no], by if by is not None else bucket(line_no), {"block": F.col("__banner").cast("int")})
    body = blocks.filter(F.col("block") > 0)

    def has(mark: str) -> Column:
        return F.bool_or(~F.col("__banner") & line.contains(mark))

    def number(key: str) -> Column:
        value = F.regexp_extract(line, rf"\b{key}=(\d+)", 1)
        there = ~F.col("__banner") & (value != "")
        return F.coalesce(F.min_by(F.when(there, value.try_cast("bigint")), F.when(there, F.col(line_no))), F.lit(0)).alias(key)

    banner = F.when(F.col("__banner"), line)
    agg = body.groupBy(run, "block").agg(
        F.max(F.regexp_extract(banner, BANNER, 3)).alias("company"), F.max(F.regexp_extract(banner, BANNER, 4)).alias("vendor"),
        F.max(F.regexp_extract(banner, BANNER, 2).try_cast("bigint")).alias("sweep_size"),
        has("agent_failed=1").alias("m1"), has("robots=disallowed").alias("m2"), has("listings=none").alias("m3"),
        has("no_remote_roles=true").alias("m4"), has("found=").alias("m5"), number("found"), number("inserted"), number("closed"),
    )
    outcome = (
        F.when(F.col("m1"), "agent_failed").when(F.col("m2"), "robots_disallowed").when(F.col("m3"), "listings_none")
        .when(F.col("m4"), "no_remote_roles").when(F.col("m5"), "fetched").otherwise("incomplete")
    )
    return agg.withColumn("outcome", outcome).drop("m1", "m2", "m3", "m4", "m5")


def sweep_outcomes(blocks: DataFrame, run: str = "run_id", companies: int | None = None) -> DataFrame:
    """Per sweep and outcome: how many companies, and their names in the log's order (the first ones
    with ``companies``)."""
    counts = blocks.groupBy(run, "outcome").agg(F.count("*").alias("n"))
    first = top_k(blocks, [run, "outcome"], ["block"], companies)
    named = first.groupBy(run, "outcome").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "company"))), lambda x: x["company"]), ",").alias("companies")
    )
    return counts.join(named, [run, "outcome"])


def sweep_totals(blocks: DataFrame, run: str = "run_id") -> DataFrame:
    return blocks.groupBy(run).agg(
        F.count("*").alias("companies_in_log"), F.max("sweep_size").alias("sweep_size"),
        *[F.sum(x).alias(x) for x in ("found", "inserted", "closed")],
    )


# --- counters of the working jobs ---------------------------------------------------------------


def validation_summary(outcomes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """found, confirmed, wrong, unverifiable, escalated, failed, first_error.

    outcomes(ordinal, slug, category, escalated, error).
    """
    failed = F.col("error").isNotNull()
    said = F.concat(F.col("slug"), F.lit(": "), F.col("error"))

    def good(cat: str) -> Column:
        return F.count_if(~failed & (F.col("category") == cat)).alias(cat)

    return outcomes.groupBy(*(keys or [])).agg(
        F.count("*").alias("found"), good("confirmed"), good("wrong"),
        F.count_if(~failed & ~F.coalesce(F.col("category").isin("confirmed", "wrong"), F.lit(False))).alias("unverifiable"),
        F.count_if(F.coalesce(F.col("escalated"), F.lit(False))).alias("escalated"), F.count_if(failed).alias("failed"),
        F.coalesce(F.min_by(F.when(failed, said), F.when(failed, F.col("ordinal"))), F.lit("")).alias("first_error"),
    )


def validation_error_text(summary: DataFrame) -> DataFrame:
    text = F.when(F.col("failed") > 0, F.concat(F.col("failed").cast("string"), F.lit(" companies could not be validated; first failure: "), "first_error"))
    return summary.withColumns({"status": F.when(F.col("failed") > 0, "error").otherwise("ok"), "error_text": text})


def resolution_summary(outcomes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """found, inserted, updated, resolved, unresolved, skipped, failed, first_error, error_text.

    outcomes(ordinal, slug, resolution_action, resolved, skipped, error).
    """
    skipped = F.coalesce(F.col("skipped"), F.lit(False))
    failed = ~skipped & F.col("error").isNotNull()
    fine = ~skipped & ~failed
    said = F.concat(F.col("slug"), F.lit(": "), F.col("error"))
    resolved = F.count_if(fine & F.col("resolved"))
    out = outcomes.groupBy(*(keys or [])).agg(
        F.count_if(~skipped).alias("found"), F.count_if(fine & (F.col("resolution_action") == "inserted")).alias("inserted"),
        F.count_if(fine & (F.col("resolution_action") == "updated")).alias("updated"), resolved.alias("resolved"),
        F.count_if(~skipped & (F.col("error").isNotNull() | ~F.coalesce(F.col("resolved"), F.lit(False)))).alias("unresolved"),
        F.count_if(skipped).alias("skipped"), F.count_if(failed).alias("failed"),
        F.coalesce(F.min_by(F.when(failed, said), F.when(failed, F.col("ordinal"))), F.lit("")).alias("first_error"),
    )
    none = F.when(F.col("first_error") != "", F.concat(F.lit("no companies resolved; first failure: "), "first_error")).otherwise("no companies resolved")
    return out.withColumn("error_text", F.when((F.col("resolved") == 0) & (F.col("found") > 0), none))


def unresolved_reason(attempts: DataFrame, companies: DataFrame, key: str = "company_id") -> DataFrame:
    """(company, attempts, reason, sources) of companies that were not resolved: the last attempt's
    reason, ``no_candidates`` when nothing was tried. Sources form a closed vocabulary, so the list
    of distinct ones stays short."""
    last = attempts.groupBy(key).agg(F.count("*").alias("attempts"), F.max_by("rejection_reason", F.struct("attempt_index", "id")).alias("__last"))
    sources = (
        attempts.filter(F.coalesce(F.col("source"), F.lit("")) != "").groupBy(key, "source").agg(F.min(F.struct("attempt_index", "id")).alias("at"))
        .groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "source"))), lambda x: x["source"]), ",").alias("sources"))
    )
    j = companies.select(key).join(last, key, "left").join(sources, key, "left")
    reason = F.when(F.col("attempts").isNull(), "no_candidates").otherwise(F.coalesce(F.nullif(F.col("__last"), F.lit("")), F.lit("no_acceptable_candidate")))
    return j.select(key, F.coalesce("attempts", F.lit(0)).cast("bigint").alias("attempts"), reason.alias("reason"), F.coalesce("sources", F.lit("")).alias("sources"))


def scrape_counters(fetched: DataFrame, keys: list[str]) -> DataFrame:
    """found, accepted, skipped_non_us, remote_evidence per scope of a fetched batch."""
    usable = (F.coalesce(F.col("url"), F.lit("")) != "") & (F.coalesce(F.col("error"), F.lit("")) == "")
    us = F.col("is_us").eqNullSafe(True)
    return fetched.groupBy(*keys).agg(
        F.count("*").alias("found"), F.count_if(usable & us).alias("accepted"), F.count_if(usable & ~us).alias("skipped_non_us"),
        F.count_if(F.coalesce(F.col("remote"), F.lit(False))).alias("remote_evidence"),
    )


def unreadable_tally(fetched: DataFrame, words: int | None = None) -> DataFrame:
    """(kind, label, n) of postings that could not be read: block reasons, and errors (whole, or by their
    first ``words`` words)."""
    from rolegrid.functions.text import first_words

    blocked = tally(fetched.filter(F.coalesce(F.col("block_reason"), F.lit("")) != ""), "block_reason", "label")
    errored = tally(fetched.filter(F.coalesce(F.col("error"), F.lit("")) != ""), F.col("error") if words is None else first_words("error", words), "label")
    return blocked.withColumn("kind", F.lit("blocked")).unionByName(errored.withColumn("kind", F.lit("errored"))).select("kind", "label", "n")


def quality_note(resolution: ColumnOrName, confirmed: ColumnOrName, found: ColumnOrName, inserted: ColumnOrName, skipped: ColumnOrName) -> Column:
    """Runs that ended well without working: four named shapes, '' otherwise."""
    nothing = F.coalesce(c(confirmed), F.lit(False)) & (c(found) > 0) & (c(inserted) == 0)
    return (
        F.when((c(resolution) == "cache") & (c(found) == 0), "cached_url_yielded_nothing")
        .when(F.coalesce(c(confirmed), F.lit(False)) & (c(found) == 0), "agent_confirmed_remote_but_fetch_found_nothing")
        .when(nothing & (c(skipped) > 0), "agent_confirmed_remote_but_all_postings_non_us")
        .when(nothing, "agent_confirmed_remote_but_nothing_stored")
        .otherwise("")
    )


