"""Text expressions: slugs, company tokens, page titles, marker tests, bounded notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolegrid import vocab
from rolegrid.functions.base import ColumnOrName, blank_to_null, c, contains_any, first_marker, let, map_lookup, squeeze
from rolegrid.functions import urls


def slugify(name: ColumnOrName) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one hyphen; ends trimmed."""
    dashed = F.regexp_replace(F.lower(c(name)), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-|-$", "")


def distinctive_token(company: ColumnOrName) -> Column:
    """The first longest word of three or more characters that is not a corporate stop word."""
    words = F.filter(
        F.split(F.regexp_replace(c(company), "[^A-Za-z0-9]+", " "), " "),
        lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(vocab.CORPORATE_STOP_WORDS),
    )
    best = F.aggregate(words, F.lit(""), lambda acc, w: F.when(F.length(w) > F.length(acc), w).otherwise(acc))
    return F.coalesce(F.lower(best), F.lit(""))


def contains_company_token(haystack: ColumnOrName, company: ColumnOrName) -> Column:
    """True when the company has no distinctive token, or the text names it."""
    token = distinctive_token(company)
    return (token == "") | F.lower(F.coalesce(c(haystack), F.lit(""))).contains(token)


def _tag_text(body: ColumnOrName, tag: str) -> Column:
    inner = F.regexp_extract(c(body), rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return squeeze(F.regexp_replace(inner, "<[^>]*>", ""))


def document_title(body: ColumnOrName) -> Column:
    return _tag_text(body, "title")


def document_heading(body: ColumnOrName) -> Column:
    return _tag_text(body, "h1")


def count_job_postings(body: ColumnOrName) -> Column:
    return F.regexp_count(c(body), F.lit(r'"@type"\s*:\s*"JobPosting"')).cast("bigint")


def count_listing_links(body: ColumnOrName, pattern: str = vocab.LISTING_LINK_PATTERN) -> Column:
    return F.regexp_count(c(body), F.lit(pattern)).cast("bigint")


def count_board_ids(body: ColumnOrName) -> Column:
    """Number of "id": markers of a body that holds a jobs, postings or content array, else 0."""
    has_array = c(body).rlike(r'"(jobs|postings|content)"\s*:\s*\[')
    return F.when(has_array, F.regexp_count(c(body), F.lit(r'"id"\s*:'))).otherwise(0).cast("bigint")


def has_careers_signal(text: ColumnOrName) -> Column:
    return F.coalesce(contains_any(F.lower(c(text)), vocab.CAREERS_TEXT_TOKENS), F.lit(False))


def has_openings_phrase(body: ColumnOrName) -> Column:
    return F.coalesce(contains_any(F.lower(c(body)), vocab.OPENINGS_PHRASES), F.lit(False))


def _head(body: ColumnOrName, title: ColumnOrName, scan_bytes: int | None) -> Column:
    """Lowered title plus the body, or its first ``scan_bytes`` bytes (cut in bytes, read leniently)."""
    lead = F.concat(F.coalesce(c(title), F.lit("")), F.lit("\n"))
    if scan_bytes is None:
        return F.lower(F.concat(lead, c(body)))
    prefix = F.substring(c(body), 1, scan_bytes)
    # Cut by bytes only where the prefix is not pure ASCII: elsewhere both cuts are the same.
    by_bytes = F.make_valid_utf8(F.substring(c(body).cast("binary"), 1, scan_bytes).cast("string"))
    head = F.when(F.octet_length(prefix) <= scan_bytes, prefix).otherwise(by_bytes)
    return F.lower(F.concat(lead, head))


def looks_like_challenge(body: ColumnOrName, title: ColumnOrName, scan_bytes: int | None = None) -> Column:
    """A bot check, by wording in the title and the whole body (or its first ``scan_bytes`` bytes)."""
    return contains_any(_head(body, title, scan_bytes), vocab.CHALLENGE_PAGE_MARKERS)


def is_parked(body: ColumnOrName, title: ColumnOrName, scan_bytes: int | None = None) -> Column:
    return contains_any(_head(body, title, scan_bytes), vocab.PARKED_MARKERS)


def is_generic_title(title: ColumnOrName) -> Column:
    low = F.lower(F.trim(c(title)))
    return low.isin(vocab.GENERIC_TITLES) | contains_any(low, vocab.GENERIC_TITLE_MARKERS)


def careers_shaped_location(url: ColumnOrName) -> Column:
    """The path holds a careers word, or the host reads like one."""
    return urls.has_contained_token(urls.path_segments(url)) | has_careers_signal(urls.host(url))


def is_json_content_type(content_type: ColumnOrName) -> Column:
    low = F.lower(F.coalesce(c(content_type), F.lit("")))
    return low.contains("application/json") | low.contains("+json")


def vendor_from_html(html: ColumnOrName) -> Column:
    """Vendor from the page itself: DOM signature, then a board host, then a weak marker."""
    body = c(html)
    low = F.lower(body)
    signature = [F.when(body.contains(mark), F.lit(vendor)) for mark, vendor in vocab.DOM_SIGNATURES]
    by_host = [F.when(low.contains(h), F.lit(vendor)) for h, vendor in vocab.VENDOR_HOSTS]
    weak = F.when(low.contains("careersitecompanyid") | low.contains("successfactors"), F.lit("successfactors"))
    return F.coalesce(*signature, *by_host, weak)


def fingerprint(final_url: ColumnOrName, html: ColumnOrName) -> Column:
    """Vendor by URL first, by page second; NULL when unknown."""
    return F.coalesce(urls.vendor_from_url(final_url), vendor_from_html(html))


def literal_search(columns: list[ColumnOrName], term: str) -> Column:
    """Case-insensitive literal substring on any of the columns; '_' and '%' are ordinary text."""
    hit = F.lit(False)
    for col in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c(col)), F.lower(F.lit(term.strip()))), F.lit(False))
    return hit


# --- block classifier ---------------------------------------------------------------------------


def block_verdict(status: ColumnOrName, title: ColumnOrName, text: ColumnOrName, scan_chars: int | None = None) -> Column:
    """struct(blocked, reason, evidence): status code first, then captcha, challenge, blocked and
    login wording in the title plus the text (or its first ``scan_chars`` characters)."""
    body = F.coalesce(c(text), F.lit(""))
    st = c(status)
    haystack = F.lower(
        F.concat(
            F.coalesce(c(title), F.lit("")),
            F.lit("\n"),
            body if scan_chars is None else F.substring(body, 1, scan_chars),
        )
    )
    return let(
        F.struct(haystack.alias("text"), st.cast("int").alias("status")),
        lambda page: _classify_block(page["status"], page["text"]),
    )


def _classify_block(st: Column, haystack: Column) -> Column:
    by_status = map_lookup(st, vocab.BLOCK_STATUS_REASONS)
    found = F.coalesce(
        F.when(by_status.isNotNull(), F.struct(by_status.alias("reason"), F.lit(None).cast("string").alias("marker"))),
        *[
            F.when(haystack.contains(m), F.struct(F.lit(reason).alias("reason"), F.lit(m).alias("marker")))
            for reason, markers in vocab.BLOCK_MARKERS
            for m in markers
        ],
    )

    def describe(hit: Column) -> Column:
        at = F.position(hit["marker"], haystack)
        start = F.greatest(at - 21, F.lit(0))
        snippet = squeeze(F.substring(haystack, start + 1, at - 1 + 60 - start))
        return F.struct(
            hit["reason"].isNotNull().alias("blocked"),
            F.coalesce(hit["reason"], F.lit("")).alias("reason"),
            F.when(hit["marker"].isNotNull(), snippet)
            .when(hit["reason"].isNotNull(), F.concat(F.lit("HTTP "), st.cast("string")))
            .otherwise("")
            .alias("evidence"),
        )

    return let(found, describe)


def block_columns(status: ColumnOrName, title: ColumnOrName, text: ColumnOrName) -> dict[str, Column]:
    verdict = block_verdict(status, title, text)
    return {"blocked": verdict["blocked"], "block_reason": verdict["reason"], "block_evidence": verdict["evidence"]}


def answer_block(flag: ColumnOrName, reason: ColumnOrName, evidence: ColumnOrName) -> Column:
    """struct(blocked, block_reason): an answer's own flag, else what its evidence text says."""
    detected = block_verdict(F.lit(None).cast("int"), F.lit(""), evidence)
    said = F.coalesce(c(flag), F.lit(False))
    return F.struct(
        (said | detected["blocked"]).alias("blocked"),
        F.when(said, F.coalesce(c(reason), F.lit(""))).when(detected["blocked"], detected["reason"]).otherwise("").alias("block_reason"),
    )


# --- bounded text, evidence, log tokens ---------------------------------------------------------


def first_chars(text: ColumnOrName, limit: int) -> Column:
    """Whitespace-collapsed, cut to ``limit`` with an ellipsis."""
    t = squeeze(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.left(t, F.lit(limit)), F.lit("...")))


def first_words(text: ColumnOrName, n: int) -> Column:
    words = F.filter(F.split(c(text), r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, n), " ")


def append_evidence(existing: ColumnOrName, item: ColumnOrName) -> Column:
    return F.concat_ws(";", blank_keep(existing), blank_keep(item))


def blank_keep(value: ColumnOrName) -> Column:
    """The value unchanged, NULL when blank."""
    return F.when(F.trim(c(value)) != "", c(value))


def truncate_bytes(text: ColumnOrName, limit: int, ellipsis: str = "...") -> Column:
    """Cut to ``limit`` UTF-8 bytes on a character boundary."""
    t = c(text)
    raw = F.substring(t.cast("binary"), 1, limit).cast("string")
    clean = F.regexp_replace(F.make_valid_utf8(raw), "\uFFFD+$", "")
    return F.when(F.octet_length(t) <= limit, t).otherwise(F.concat(clean, F.lit(ellipsis)))


def log_token(line: ColumnOrName, key: str, value: str = r"\S+") -> Column:
    """Value of a ``key=value`` token; NULL when absent."""
    return F.nullif(F.regexp_extract(c(line), rf"\b{key}=({value})", 1), F.lit(""))


def log_company(line: ColumnOrName) -> Column:
    return log_token(line, "company", r"[A-Za-z0-9._-]+")


def log_int(line: ColumnOrName, key: str) -> Column:
    return log_token(line, key, r"\d+").cast("bigint")


def single_line(text: ColumnOrName, style: str, limit: int | None = None) -> Column:
    """One line, whole or cut at ``limit`` characters. ``feed`` escapes newlines, returns and tabs; ``index``
    turns them into spaces and drops other control characters."""
    t = c(text)
    if style == "feed":
        for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            t = F.replace(t, F.lit(raw), F.lit(shown))
        t = F.regexp_replace(t, r"[\x00-\x1f\x7f]", " ")
    elif style == "index":
        t = F.regexp_replace(F.regexp_replace(t, r"[\n\r\t]", " "), r"[\x00-\x1f]", "")
    else:
        raise ValueError(f"style must be feed or index, got {style!r}")
    return t if limit is None else F.left(t, F.lit(limit))


def error_text(condition: ColumnOrName, message: ColumnOrName, style: str = "feed", limit: int | None = None) -> Column:
    """``condition: message`` on one line; the condition alone without a message; NULL for neither."""
    cond, msg = blank_to_null(condition), c(message)
    return F.when(msg.isNotNull(), F.concat(F.coalesce(cond, F.lit("")), F.lit(": "), single_line(msg, style, limit))).otherwise(cond)


def fetch_condition(error_kind: ColumnOrName, message: ColumnOrName, status: ColumnOrName) -> Column:
    """Closed label for a failed fetch. ``error_kind`` is one of unexpected_status, retry_after,
    deadline, dns, other; NULL means no failure."""
    kind, st = c(error_kind), c(status)
    by_status = (
        F.when(st == 403, "http_403").when(st == 404, "http_404").when(st == 429, "http_429_twice")
        .when(st >= 500, "http_5xx").otherwise("http_status")
    )
    return (
        F.when(kind.isNull(), F.lit(""))
        .when(kind == "retry_after", F.lit("retry_after_too_long"))
        .when(kind == "unexpected_status", by_status)
        .when(kind == "deadline", F.lit("timeout"))
        .when(kind == "dns", F.lit("dns_failure"))
        .when(c(message).rlike("tls:|certificate"), F.lit("tls_failure"))
        .otherwise(F.lit("connection_failed"))
    )


def trace_id(traceparent: ColumnOrName) -> Column:
    """32-hex trace id of a W3C trace-parent header, lower-cased; NULL when malformed."""
    return F.nullif(
        F.lower(F.regexp_extract(F.trim(c(traceparent)), "^[^-]*-([0-9a-fA-F]{32})(-|$)", 1)), F.lit("")
    )


def judgement_note(raw_json: ColumnOrName) -> Column:
    """First non-empty of five known keys of a judgement object, else the raw text; 200 characters."""
    raw = c(raw_json)
    # The keys, in order of preference.
    keys = ["verdict", "reasoning", "failure_reason", "reason", "error"]

    def pick(parsed: Column) -> Column:
        is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
        texts = []
        for k in keys:
            value = F.try_variant_get(parsed, f"$.{k}", "variant")
            said = is_object & (F.schema_of_variant(value) == "STRING")
            texts.append(F.when(said, F.nullif(F.try_variant_get(value, "$", "string"), F.lit(""))))
        return first_chars(F.coalesce(*texts, raw), 200)

    return F.when(raw.isNull() | (raw == "") | (raw == "null"), F.lit("")).otherwise(
        let(F.try_parse_json(raw), pick)
    )
