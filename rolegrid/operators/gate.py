"""The validation gate: is this response the careers page it claims to be?

``gate`` works on candidates already joined to responses and adds one ``gate`` struct. Page features
are computed once as columns; the decision is a single CASE over them, first matching rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid import vocab
from rolegrid.functions import text as T
from rolegrid.functions import urls as U
from rolegrid.functions.base import ColumnOrName, c, first_marker

# Reasons that are acceptances.
ACCEPTING = ["html_homepage", "html_careers", "ats_board"]


def category(status: ColumnOrName, reason: ColumnOrName) -> Column:
    """confirmed, wrong (the content says so) or unverifiable (everything else)."""
    return (
        F.when(c(status) == "accepted", "confirmed")
        .when(c(reason).isin(vocab.WRONG_REASONS), "wrong")
        .otherwise("unverifiable")
    )


def should_escalate(reason: ColumnOrName) -> Column:
    return F.coalesce(c(reason).isin(vocab.ESCALATE_REASONS), F.lit(False))


def attempt_state(reason: ColumnOrName) -> Column:
    """error for reasons that never saw a page, rejected for the rest."""
    return F.when(c(reason).isin(vocab.ERROR_REASONS), "error").otherwise("rejected")


def reason_dimension(spark) -> DataFrame:
    """The closed reason vocabulary with its categories."""
    return spark.createDataFrame(vocab.REASONS, "reason string, category string, escalate boolean, attempt_status string")


def page_features(df: DataFrame, final: str = "__final", body: str = "body", company: str = "company_name", scan_bytes: int | None = None) -> DataFrame:
    """Columns the gate decides on, each computed once. Prefix ``g_``."""
    step = df.withColumns({"g_title": T.document_title(body), "g_heading": T.document_heading(body), "g_host": U.host(final), "g_segments": U.path_segments(final), "g_token": T.distinctive_token(company)})
    step = step.withColumns({
        "g_challenge": T.looks_like_challenge(body, "g_title", scan_bytes),
        "g_parked": T.is_parked(body, "g_title", scan_bytes),
        "g_generic": T.is_generic_title("g_title"),
        "g_named": F.lower(F.concat_ws(" ", "g_title", "g_heading")),
        "g_careers_path": U.has_contained_token(F.col("g_segments")),
        "g_postings": T.count_job_postings(body),
        "g_openings": T.has_openings_phrase(body),
        "g_links": T.count_listing_links(body),
    })
    return step.withColumn("g_shaped", F.col("g_careers_path") | T.has_careers_signal("g_host"))


def _names(col: str) -> Column:
    """The text names the company (an empty token names anyone)."""
    return (F.col("g_token") == "") | F.lower(F.col(col)).contains(F.col("g_token"))


def _decision(kind: str = "kind", source: str = "source", strict: str = "strict") -> Column:
    """struct(status, reason, evidence) over the feature columns."""

    def verdict(status: str, reason: Column | str, evidence: Column | None = None, title: bool = True) -> Column:
        r = F.lit(reason) if isinstance(reason, str) else reason
        e = evidence if evidence is not None else F.lit("")
        return F.struct(F.lit(status).alias("status"), r.alias("reason"), e.alias("evidence"), F.lit(title).alias("has_title"))

    st = F.col("status")
    accept = lambda r, e=None, t=True: verdict("accepted", r, e, t)
    reject = lambda r, e=None, t=True: verdict("rejected", r, e, t)
    is_board, is_site = F.col(kind) == "ats_board", F.col(kind) == "website"
    no_token = F.col("g_token") == ""
    corroborated = _names("g_title") | (_names("g_host") & F.col("g_shaped"))
    generous = F.concat_ws(
        ",",
        F.when(F.col("g_postings") > 0, F.concat(F.lit("jobposting="), F.col("g_postings").cast("string"))),
        F.when(F.col("g_careers_path"), F.lit("careers_path")),
        F.when(T.has_careers_signal("g_title"), F.lit("careers_title")),
        F.when(T.has_careers_signal("g_heading"), F.lit("careers_heading")),
        F.when(F.col("g_openings"), F.lit("openings_phrase")),
    )
    listing = F.concat_ws(
        ",",
        F.when(F.col("g_postings") > 0, F.concat(F.lit("jobposting="), F.col("g_postings").cast("string"))),
        F.when(F.col("g_openings"), F.lit("openings_phrase")),
        F.when(F.col("g_links") >= vocab.LISTING_LINK_THRESHOLD, F.concat(F.lit("job_links="), F.col("g_links").cast("string"))),
    )
    landing = (
        F.col("g_shaped") & (T.has_careers_signal("g_named") | U.has_careers_segment(F.col("g_segments")))
        & ~no_token & _names("g_named")
    )
    other_kind = first_marker(F.col("g_named"), vocab.OTHER_PAGE_MARKERS)
    other_path = U.wrong_kind_token("__final")
    strict_path = F.col(strict) & (F.col(kind) == "career_site")
    strict_evidence = F.when(listing != "", listing).when(landing, F.lit("careers_landing")).otherwise("")
    json_board = T.is_json_content_type("content_type") & F.col(kind).isin("career_site", "ats_board")
    entries = T.count_board_ids("body")
    entries_text = F.concat(F.lit("ats_entries="), entries.cast("string"))
    return (
        F.when(F.col("transport_error").isNotNull() & F.coalesce(F.col("timed_out"), F.lit(False)), verdict("error", "timeout", title=False))
        .when(F.col("transport_error").isNotNull(), verdict("error", "transport_error", title=False))
        .when(F.coalesce(st, F.lit(0)) == 0, verdict("error", "no_status", title=False))
        .when(~U.is_http_url("__final"), reject("unparseable_final_url", t=False))
        .when(st == 403, reject("forbidden", t=False))
        .when(st == 429, reject("rate_limited", t=False))
        .when((st < 200) | (st > 299), reject(F.concat(F.lit("http_"), st.cast("string")), t=False))
        .when((st == 204) | (F.trim(F.regexp_replace(F.coalesce(F.col("body"), F.lit("")), r"\s+", "")) == ""), reject("empty_body", t=False))
        .when(~F.coalesce(F.col(kind).isin(vocab.CANDIDATE_KINDS), F.lit(False)), verdict("error", "unknown_kind", title=False))
        .when(json_board & (entries == 0), reject("ats_empty_board", entries_text, False))
        .when(json_board, accept("ats_board", entries_text, False))
        .when(F.col("g_challenge"), reject("bot_challenge"))
        .when(F.col("g_parked"), reject("parked_domain"))
        .when(F.col("g_generic") & is_board & no_token, reject("unverifiable_ats_title"))
        .when(F.col("g_generic") & ~corroborated, reject("generic_title_without_company"))
        .when(is_site, accept("html_homepage"))
        .when(is_board & no_token, reject("unverifiable_ats_title"))
        .when(U.is_product_or_investor("__final", source), reject("product_or_investor_path"))
        .when(U.is_locale_only_gate(F.col("g_segments")), reject("locale_only_path"))
        .when(strict_path & other_kind.isNotNull(), reject("product_or_investor_path", F.concat(F.lit("page_kind="), other_kind)))
        .when(strict_path & other_path.isNotNull(), reject("product_or_investor_path", F.concat(F.lit("path_kind="), other_path)))
        .when(strict_path & (strict_evidence == ""), reject("no_careers_signal"))
        .when(strict_path, accept("html_careers", strict_evidence))
        .when(generous == "", reject("no_careers_signal"))
        .otherwise(accept("html_careers", generous))
    )


def gate(candidates: DataFrame, strict: bool | None = None, scan_bytes: int | None = None) -> DataFrame:
    """Candidates joined to responses in; the same rows plus ``gate`` struct(status, reason,
    final_url, title, evidence) out.

    Needed columns: url, base, kind, source, company_name, status, response_url, content_type, body,
    transport_error, timed_out and, unless ``strict`` is given, a boolean ``strict``.
    """
    keep = candidates.columns
    rows = candidates if strict is None else candidates.withColumn("strict", F.lit(strict))
    joined = F.when(F.coalesce(F.col("base"), F.lit("")) != "", F.coalesce(U.resolve_url("base", "url"), F.col("url"))).otherwise(F.col("url"))
    final = F.coalesce(F.nullif(F.col("response_url"), F.lit("")), joined)
    featured = page_features(rows.withColumn("__final_raw", final).withColumn("__final", U.normalise_url("__final_raw")), scan_bytes=scan_bytes)
    judged = featured.withColumn("__v", _decision())
    unseen = F.col("__v.reason").isin("timeout", "transport_error", "no_status") & (F.col("__v.status") == "error")
    return judged.select(
        *keep,
        F.struct(
            F.col("__v.status").alias("status"), F.col("__v.reason").alias("reason"),
            F.when(unseen, F.coalesce(F.col("response_url"), F.lit(""))).otherwise(F.col("__final")).alias("final_url"),
            F.when(F.col("__v.has_title"), F.col("g_title")).otherwise("").alias("title"),
            F.col("__v.evidence").alias("evidence"),
        ).alias("gate"),
    )


def board_check(boards: DataFrame) -> DataFrame:
    """Board URLs joined to their API responses in; plus struct ``board``(accepted, reason, job_count,
    evidence) out. Empty is not broken: truncated, transport, status, blank, JSON and zero are told apart.

    Needed columns: tenant_url, status, body, truncated, transport_error, timed_out.
    """
    parsed = F.try_parse_json("body")
    is_array = F.coalesce(F.schema_of_variant(parsed).startswith("ARRAY"), F.lit(False))
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    inner = F.coalesce(F.try_variant_get(parsed, "$.jobs", "variant"), F.try_variant_get(parsed, "$.content", "variant"))
    inner_kind = F.schema_of_variant(inner)
    empty_inner = inner.isNull() | F.coalesce(F.is_variant_null(inner), F.lit(True))
    count = (
        F.when(is_array, F.json_array_length("body"))
        .when(is_object & empty_inner, F.lit(0))
        .when(is_object & inner_kind.startswith("ARRAY"), F.json_array_length(F.to_json(inner)))
        .when(parsed.isNotNull() & F.is_variant_null(parsed), F.lit(0))
    ).cast("bigint")
    rows = boards.withColumns({"__tenant": U.tenant("tenant_url"), "__count": count})
    st, n = F.col("status"), F.col("__count")
    reason = (
        F.when(F.col("__tenant").isNull(), "unknown_kind")
        .when(F.coalesce(F.col("truncated"), F.lit(False)), "ats_truncated_body")
        .when(F.col("transport_error").isNotNull() & F.coalesce(F.col("timed_out"), F.lit(False)), "timeout")
        .when(F.col("transport_error").isNotNull(), "transport_error")
        .when(st == 403, "forbidden").when(st == 429, "rate_limited")
        .when(st >= 500, "ats_http_5xx").when(F.coalesce((st < 200) | (st > 299), F.lit(True)), "ats_http_4xx")
        .when(F.trim(F.coalesce(F.col("body"), F.lit(""))) == "", "empty_body")
        .when(n.isNull(), "ats_invalid_json").when(n == 0, "ats_empty_board")
    )
    reached_json = F.col("__tenant").isNotNull() & (reason.isNull() | (reason == "ats_empty_board"))
    return rows.select(
        *boards.columns,
        F.struct(
            reason.isNull().alias("accepted"), F.coalesce(reason, F.lit("")).alias("reason"),
            F.when(reached_json, n).otherwise(0).cast("bigint").alias("job_count"),
            F.when(reached_json, F.concat(F.lit("ats_entries="), n.cast("string"), F.lit(" vendor="), F.col("__tenant.vendor"))).otherwise("").alias("evidence"),
        ).alias("board"),
    )
