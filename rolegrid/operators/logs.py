"""Structured-log analytics: parse, search, look up, count, and tell the story of a run or sweep.

Parsed log lines are rows (seq, ts, container, level, app, svc, span, msg, trace_id, run_id,
sweep_id, company, error, status, path, method, duration_ms, fields map<string,string>, raw).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid import vocab
from rolegrid.functions import times
from rolegrid.functions.base import ColumnOrName, attach_row, c

NUMERIC = {"status": "bigint", "duration_ms": "bigint", "sweep_id": "bigint"}


# --- parsing ------------------------------------------------------------------------------------


def flatten_streams(results: DataFrame, body: str = "body", limit: int | None = None) -> DataFrame:
    """(ts_ns, labels, line) of a stream query result: malformed values are dropped; with ``limit`` the
    first lines after the sort are kept."""
    schema = "struct<data:struct<result:array<struct<stream:map<string,string>,values:array<variant>>>>>"
    streams = results.select(F.explode(F.from_json(body, schema)["data"]["result"]).alias("s"))
    values = streams.select(F.coalesce("s.stream", F.create_map().cast("map<string,string>")).alias("labels"), F.explode("s.values").alias("v"))
    pairs = values.filter(F.coalesce(F.schema_of_variant("v").startswith("ARRAY"), F.lit(False))).select(
        "labels", F.try_variant_get("v", "$[0]", "string").try_cast("bigint").alias("ts_ns"), F.try_variant_get("v", "$[1]", "string").alias("line"),
    )
    out = pairs.filter(F.col("ts_ns").isNotNull() & F.col("line").isNotNull())
    return out if limit is None else out.orderBy("ts_ns", "line").limit(limit)


def parse_lines(lines: DataFrame, line: str = "line", keep: list[str] | None = None, raw_limit: int | None = None) -> DataFrame:
    """Log lines as flat records. JSON objects give the promoted fields and a ``fields`` map of the
    rest (blanks dropped; an id of 0 means "never set", a duration of 0 is a duration); anything else
    is kept as ``raw`` (whole, or its first ``raw_limit`` characters)."""
    keep = keep if keep is not None else [x for x in lines.columns if x != line]
    body = F.from_json(c(line), "map<string,string>")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(line)).startswith("OBJECT"), F.lit(False))
    parsed = lines.select(*keep, F.col(line).alias("__line"), F.when(is_object, body).alias("__m"))
    m = F.col("__m")

    def promoted(name: str) -> Column:
        value = F.nullif(F.try_element_at(m, F.lit(name)), F.lit(""))
        if name in vocab.ID_FIELDS:
            value = F.nullif(value, F.lit("0"))
        return value.try_cast(NUMERIC[name]).alias(name) if name in NUMERIC else value.alias(name)

    names = [n for n in vocab.PROMOTED_FIELDS if n not in keep]
    taken = vocab.PROMOTED_FIELDS + ["ts"]
    rest = F.map_filter(m, lambda k, v: ~k.isin(taken) & ~F.coalesce(v, F.lit("")).isin("", "[]", "{}"))
    return parsed.select(
        *keep, *[promoted(n) for n in names],
        F.when(F.size(rest) > 0, rest).alias("fields"), F.when(m.isNull(), F.col("__line") if raw_limit is None else F.left("__line", F.lit(raw_limit))).alias("raw"),
    )


def collect(lines: DataFrame, projects: list[str], project: str = "project", line: str = "line") -> DataFrame:
    """Collector step: lines of the wanted projects, label and metadata columns promoted, the line
    kept as it was. Works on a batch and on a stream."""
    names = ["level", "app", "svc", "msg", "trace_id", "span", "company", "run_id", "sweep_id"]
    m = F.from_json(c(line), "map<string,string>")
    kept = lines.filter(F.col(project).isin(projects))
    return kept.select(*lines.columns, *[F.nullif(F.try_element_at(m, F.lit(n)), F.lit("")).alias(n) for n in names])


def notable_request(method: ColumnOrName, status: ColumnOrName, elapsed_ms: ColumnOrName, log_all: bool = False) -> Column:
    """Why a request is worth keeping; NULL when it is not."""
    if log_all:
        return F.lit("all-requests-enabled")
    return (
        F.when(~c(method).isin("GET", "HEAD"), "state-changing").when(c(status) >= 400, "failed")
        .when(c(elapsed_ms) >= vocab.SLOW_REQUEST_MS, "slow")
    )


def notable(requests: DataFrame, log_all: bool = False) -> DataFrame:
    return requests.withColumn("why", notable_request("method", "status", "duration_ms", log_all)).filter(F.col("why").isNotNull())


# --- search and lookup --------------------------------------------------------------------------


def search(lines: DataFrame, labels: dict[str, str], pattern: str | None = None, since: Column | None = None, limit: int | None = None, newest: bool = True) -> DataFrame:
    """Lines by label equality and content pattern; with ``limit`` the newest (or oldest) ones."""
    out = lines
    for key, value in labels.items():
        out = out.filter(F.col(key) == value)
    if pattern:
        out = out.filter(F.col("line").rlike(pattern))
    if since is not None:
        out = out.filter(F.col("ts") >= since)
    if limit is None:
        return out
    order = [F.desc("ts"), F.desc("seq")] if newest else [F.col("ts"), F.col("seq")]
    return out.orderBy(*order).limit(limit)


def check_id(value, name: str) -> str:
    """An id as text: a positive integer or a short token."""
    if isinstance(value, bool) or (isinstance(value, int) and value <= 0):
        raise ValueError(f"{name} must be a positive integer, got {value!r}")
    text = str(value).strip()
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", text):
        raise ValueError(f"{name} must be a positive integer or a short id token, got {value!r}")
    return text


def lookup(lines: DataFrame, key: str, value, since: Column | None = None, limit: int | None = None) -> DataFrame:
    """Lines of one unit of work, oldest first. Promoted keys are columns, so the scan prunes; other
    keys are read from the ``fields`` map."""
    if key not in vocab.LOOKUP_KEYS:
        raise ValueError(f"unknown lookup key {key!r}")
    wanted = check_id(value, key) if key != "company" else str(value).strip()
    if not wanted:
        raise ValueError("company must be a non-empty company slug")
    col = F.col(key).cast("string") if key in lines.columns else F.try_element_at("fields", F.lit(key))
    out = lines.filter(col == wanted)
    if since is not None:
        out = out.filter(F.col("ts") >= since)
    return out.orderBy("ts", "seq").limit(limit) if limit else out


# --- counts -------------------------------------------------------------------------------------


def in_window(lines: DataFrame, window: str | None, now: ColumnOrName, default: str = "24h") -> DataFrame:
    return lines.filter((F.col("ts") >= times.window_start(window, now, default)) & (F.col("ts") <= c(now)))


def label_counts(lines: DataFrame, label: str) -> DataFrame:
    """What is actually arriving per value of a label."""
    if label not in vocab.COUNTED_LABELS:
        raise ValueError(f"refusing to count unknown label {label!r}")
    return lines.filter(F.coalesce(F.col(label), F.lit("")) != "").groupBy(F.col(label).alias("value")).agg(F.count("*").alias("n"))


def error_groups(lines: DataFrame, level: str = "error", app: str = "") -> DataFrame:
    """All (app, svc, msg) groups of a level pattern with their count."""
    hit = lines.filter(F.col("level").rlike(f"^(?:{level})$"))
    if app:
        hit = hit.filter(F.col("app") == app)
    blank = F.lit("")
    return hit.groupBy(
        F.coalesce("app", blank).alias("app"), F.coalesce("svc", blank).alias("svc"), F.coalesce(F.nullif("msg", blank), F.lit("(unparsed)")).alias("msg")
    ).agg(F.count("*").alias("n"))


def error_summary(lines: DataFrame, level: str = "error", limit: int | None = None, app: str = "") -> DataFrame:
    """The groups (with ``limit`` the largest ones) with the number of groups and the total over all of them, not only the shown."""
    groups = error_groups(lines, level, app)
    totals = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    shown = groups if limit is None else groups.orderBy(F.desc("n"), "app", "svc", "msg").limit(limit)
    return attach_row(shown, totals)


def container_health(lines: DataFrame, limit: int | None = None, pattern: str = vocab.CONTAINER_PROBLEM_PATTERN) -> DataFrame:
    """Containers (with ``limit`` the loudest ones), ranked by how many of their lines report a problem."""
    counts = lines.filter(F.coalesce(F.col("container"), F.lit("")) != "").groupBy("container").agg(
        F.count("*").alias("lines"), F.count_if(F.col("line").rlike(pattern)).alias("problem_lines")
    )
    loud = counts if limit is None else counts.orderBy(F.desc("lines"), "container").limit(limit)
    return loud.withColumn("problem_per_1k", F.round(F.col("problem_lines") / F.col("lines") * 1000, 1)).orderBy(
        F.desc("problem_per_1k"), F.desc("problem_lines"), "container"
    )


def check_trace_id(trace_id: str) -> str:
    text = trace_id.strip().lower()
    if not re.fullmatch(r"[0-9a-f]{32}", text):
        raise ValueError(f"trace_id must be 32 lowercase hex characters, got {trace_id!r}")
    return text


def trace_spans(lines: DataFrame, trace_id: str) -> DataFrame:
    """Lines per span of one trace ('-' = no span)."""
    one = lines.filter(F.col("trace_id") == check_trace_id(trace_id))
    return one.groupBy(F.coalesce(F.nullif("span", F.lit("")), F.lit("-")).alias("span")).agg(F.count("*").alias("n"))


def trace_summary(lines: DataFrame) -> DataFrame:
    """Per trace: lines, errors (warn and above), first and last instant."""
    return lines.filter(F.col("trace_id").isNotNull()).groupBy("trace_id").agg(
        F.count("*").alias("lines"), F.count_if(F.col("level").isin("error", "warn", "fatal")).alias("errors"),
        F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
    )


def listing_story(lines: DataFrame, listing: ColumnOrName = "listing_id") -> DataFrame:
    """Per listing: how often it was stored and by whom, and what was done with it elsewhere."""
    stored = F.col("msg") == "listing stored"
    at = F.struct("ts", "seq")
    return lines.withColumn("__l", c(listing)).filter(F.col("__l").isNotNull()).groupBy(F.col("__l").alias("listing_id")).agg(
        F.count("*").alias("lines"), F.count_if(stored).alias("stored"), F.count_if(~stored).alias("applications"),
        F.coalesce(F.min_by(F.when(stored, F.col("company")), F.when(stored, at)), F.min_by("company", at)).alias("company"),
        F.min(F.when(stored, F.col("ts"))).alias("first_stored_at"), F.max(F.when(~stored, F.col("ts"))).alias("last_application_at"),
    )


# --- stories ------------------------------------------------------------------------------------


def field(name: str) -> Column:
    """A field wherever it landed: a column, else the ``fields`` map."""
    return F.try_element_at(F.col("fields"), F.lit(name))


def _first(msg: str, value: Column) -> Column:
    """Value of the first line with this message."""
    hit = F.col("msg") == msg
    return F.min_by(F.when(hit, F.struct(value.alias("v"))), F.when(hit, F.struct("ts", "seq")))["v"]


def _any(cond: Column) -> Column:
    return F.coalesce(F.bool_or(cond), F.lit(False))


def run_facts(lines: DataFrame, keys: list[str], getter=field) -> DataFrame:
    """How each unit of work ended and what it cost, from its lines in one aggregation.

    The outcome follows the strongest evidence: failed to run, agent failed, blocked, skip reason,
    stored, completed, in progress.
    """
    msg = F.col("msg")
    summary, skip = "summary", "skip"
    seen = lines.groupBy(*keys).agg(
        F.count("*").alias("lines"),
        _any(msg == "company failed").alias("x_failed"), _any(msg == "agent failed").alias("x_agent_failed"),
        _any(msg == "listings page blocked").alias("x_blocked"), _any(msg == skip).alias("x_skip"),
        _any(msg == "listing stored").alias("x_stored"), _any(msg == summary).alias("x_summary"),
        _first(summary, getter("blocked")).alias("s_blocked"), _first(skip, getter("reason")).alias("s_reason"),
        F.count_if(msg == "agent step").alias("x_steps"),
        _first("agent decided", getter("agent_steps")).try_cast("bigint").alias("d_steps"),
        _first("agent failed", getter("agent_steps")).try_cast("bigint").alias("f_steps"),
        _first(summary, getter("agent_s")).alias("s_agent_s"), _first("agent decided", getter("agent_s")).alias("d_agent_s"),
        _first(summary, getter("total_s")).alias("total_s"),
        _first("company finished", F.col("duration_ms")).alias("duration_ms"),
        _first(summary, getter("quality")).alias("quality"),
        _first("listings page blocked", getter("block_reason")).alias("b_reason"), _first(summary, getter("block_reason")).alias("s_breason"),
        F.count_if(msg == "listing stored").alias("listings_stored"),
        F.count_if(F.col("level").isin("error", "fatal")).alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings"),
        F.min("ts").alias("first_at"), _first("start", F.col("company")).alias("start_company"),
        F.min_by("company", F.when(F.col("company").isNotNull(), F.struct("ts", "seq"))).alias("any_company"),
        _first("start", F.col("sweep_id")).alias("start_sweep"), _first("start", getter("vendor")).alias("vendor"),
    )
    blank = F.lit("")
    outcome = (
        F.when(F.col("x_failed"), "failed_to_run").when(F.col("x_agent_failed"), "agent_failed")
        .when(F.col("x_blocked") | F.coalesce(F.col("s_blocked") == "true", F.lit(False)), "blocked")
        .when(F.col("x_skip"), F.coalesce(F.nullif("s_reason", blank), F.lit("skipped")))
        .when(F.col("x_stored"), "stored").when(F.col("x_summary"), "completed").otherwise("in_progress")
    )
    clean = lambda *names: F.coalesce(*[F.nullif(F.col(n), blank) for n in names])
    return seen.select(
        *keys, "lines", outcome.alias("outcome"),
        F.coalesce(F.nullif("x_steps", F.lit(0)), "d_steps", "f_steps").alias("agent_steps"),
        clean("s_agent_s", "d_agent_s").alias("agent_s"), clean("total_s").alias("total_s"), "duration_ms", clean("quality").alias("quality"),
        clean("b_reason", "s_breason").alias("block_reason"), "listings_stored", "errors", "warnings", "first_at",
        clean("start_company", "any_company").alias("company"), F.col("start_sweep").alias("sweep_id"), clean("vendor").alias("vendor"),
    )


def stored_listings(lines: DataFrame, keys: list[str], getter=field) -> DataFrame:
    """(keys, listing_id) rows of what a unit of work stored."""
    ids = lines.filter(F.col("msg") == "listing stored").select(*keys, getter("listing_id").alias("listing_id"), "ts", "seq")
    return ids.filter(~F.coalesce(F.col("listing_id"), F.lit("")).isin("", "0"))


def step_urls(lines: DataFrame, keys: list[str], getter=field) -> DataFrame:
    return lines.filter(F.col("msg") == "agent step").select(*keys, "ts", "seq", getter("url").alias("url"))


def run_summary(lines: DataFrame, keys: list[str], getter=field) -> DataFrame:
    """run_facts plus what the agent decided and what happened to the postings."""
    decided, fetched, summary = "agent decided", "fetch", "summary"
    more = lines.groupBy(*keys).agg(
        F.coalesce(_first(decided, getter("listings_url")), _first("start", getter("listings_url"))).alias("listings_url"),
        (_first(decided, getter("remote_confirmed")) == "true").alias("remote_confirmed"),
        (_first(decided, getter("agent_judged")) == "true").alias("judged"), _first(decided, getter("agent_judgement")).alias("judgement"),
        _first(decided, getter("role_count")).try_cast("bigint").alias("role_count"), _first("agent failed", F.col("error")).alias("agent_error"),
        _first(fetched, getter("extracted")).try_cast("bigint").alias("extracted"),
        *[_first(summary, getter(n)).try_cast("bigint").alias(n) for n in ("inserted", "refreshed", "skipped_non_us")],
        _first("stale", getter("closed")).try_cast("bigint").alias("closed"),
    )
    return run_facts(lines, keys, getter).join(more, keys)


def sweep_rows(lines: DataFrame, getter=field) -> DataFrame:
    """One row per run of a sweep, plus one per company that never produced a run. Company-level
    batch lines (started, finished, failed) carry no run id; they are attached to the company's run."""
    batch_msg = F.col("msg").isin("company started", "company finished", "company failed")
    with_run = lines.filter(F.col("run_id").isNotNull())
    owner = with_run.groupBy("sweep_id", "run_id").agg(
        F.min_by("company", F.when(F.coalesce(F.col("company"), F.lit("")) != "", F.struct("ts", "seq"))).alias("owner")
    )
    company_lines = lines.filter(F.col("run_id").isNull() & batch_msg & (F.coalesce(F.col("company"), F.lit("")) != ""))
    cols = company_lines.columns
    o = owner.select(F.col("sweep_id").alias("__s"), F.col("run_id").alias("__run"), "owner")
    attached = company_lines.join(o, (F.col("sweep_id") == F.col("__s")) & (F.col("company") == F.col("owner")), "left")
    extra = attached.withColumn("run_id", F.col("__run")).select(*cols)
    runless = F.when(F.col("run_id").isNull(), F.col("company"))
    both = with_run.unionByName(extra).withColumn("__alone", runless)
    return _sweep_facts(both, getter)


def _sweep_facts(both: DataFrame, getter) -> DataFrame:
    renamed = both.withColumn("sweep", F.col("sweep_id"))
    facts = run_facts(renamed, ["sweep", "run_id", "__alone"], getter)
    return facts.select(
        F.col("sweep").alias("sweep_id"), "run_id", "company", "vendor", "outcome", "agent_steps", "agent_s", "duration_ms",
        "quality", "block_reason", "listings_stored",
    )


def sweep_plan(lines: DataFrame, getter=field) -> DataFrame:
    """Per sweep: what was planned and how it finished (NULL while running)."""
    started, finished = "sweep started", "sweep finished"
    num = lambda m, n: _first(m, getter(n)).try_cast("bigint").alias(n)
    return lines.groupBy("sweep_id").agg(
        F.count("*").alias("lines"), num(started, "companies"), num(started, "candidates"), num(started, "limit"),
        (_first(started, getter("skip_ok")) == "true").alias("skip_ok"), (_first(started, getter("skip_traced")) == "true").alias("skip_traced"),
        F.nullif(_first(started, getter("from_slug")), F.lit("")).alias("from_slug"),
        num(finished, "ok"), num(finished, "failed"), num(finished, "skipped"),
        (_first(finished, getter("stopped_early")) == "true").alias("stopped_early"),
        F.count_if(F.col("level").isin("error", "fatal")).alias("errors"),
    )


def sweep_skips(lines: DataFrame, getter=field) -> DataFrame:
    """Companies passed over before starting, with the reason."""
    return lines.filter(F.col("msg") == "company skipped").select("sweep_id", "company", getter("reason").alias("reason"), "ts", "seq")


def outcome_tally(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "outcome").agg(F.count("*").alias("n"))


def company_history(lines: DataFrame, getter=field) -> DataFrame:
    """Per company: one row per run plus one per skip that had no run. Order by at desc, run_id desc."""
    runs = run_facts(lines.filter(F.col("run_id").isNotNull()).withColumn("__c", F.col("company")), ["__c", "run_id"], getter)
    rows = runs.select(
        F.col("__c").alias("company"), "run_id", "sweep_id", F.col("first_at").alias("at"), "vendor", F.lit(None).cast("string").alias("reason"),
        "outcome", "agent_steps", "agent_s", "total_s", "quality", "block_reason",
    )
    skips = sweep_skips(lines, getter).select(
        "company", F.lit(None).cast("string").alias("run_id"), "sweep_id", F.col("ts").alias("at"), "reason", F.lit("skipped_before_running").alias("outcome"),
    )
    return rows.unionByName(skips, allowMissingColumns=True)


def company_totals(history: DataFrame) -> DataFrame:
    return history.groupBy("company").agg(F.count("run_id").alias("runs"), F.count_if(F.col("run_id").isNull()).alias("skipped"))

