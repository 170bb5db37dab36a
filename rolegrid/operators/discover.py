"""Careers-page discovery over a table of fetched responses: candidates, robots, sitemaps, ladder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid import vocab
from rolegrid.functions import html as H
from rolegrid.functions import text as T
from rolegrid.functions import urls as U
from rolegrid.functions.base import ColumnOrName, c, let
from rolegrid.operators.gate import gate
from rolegrid.operators.ranking import best_anchor, first_per_group, top_k
from rolegrid.operators.scans import bucket, running_sum
from rolegrid.session import cut

RESPONSE_COLUMNS = ["status", "response_url", "content_type", "body", "truncated", "transport_error", "timed_out"]


# --- responses ----------------------------------------------------------------------------------


def single_responses(responses: DataFrame) -> DataFrame:
    """One response per URL, so that a repeated capture never multiplies requests: the latest by
    ``captured_at`` where the table has it, else an answered one before others, ties by content."""
    first = [F.col("captured_at")] if "captured_at" in responses.columns else []
    content = F.xxhash64(*[c for c in responses.columns if c != "captured_at"])
    best = F.struct(*first, (F.coalesce("status", F.lit(0)) == 200).alias("ok"), content.alias("content"))
    row = F.struct(*[F.col(c) for c in responses.columns])
    return responses.groupBy(F.col("url").alias("__url")).agg(F.max_by(row, best).alias("r")).select("r.*")


def fetch(requests: DataFrame, responses: DataFrame, url: str = "url") -> DataFrame:
    """Requests joined to the response of their URL (left); an unanswered URL is a transport error.

    The redirect target arrives as ``response_url`` and is what later steps judge. responses hold one
    row per URL (``single_responses``); the jobs reduce theirs once, before any step.
    """
    r = responses.select(
        F.col("url").alias("__u"), F.col("final_url").alias("response_url"),
        *[F.col(x) for x in RESPONSE_COLUMNS if x != "response_url"], F.lit(True).alias("__hit"),
    )
    joined = requests.join(r, requests[url] == F.col("__u"), "left")
    missing = F.col("__hit").isNull()
    return joined.withColumns({
        "transport_error": F.when(missing, F.lit("not fetched")).otherwise(F.col("transport_error")),
        "timed_out": F.when(missing, F.lit(False)).otherwise(F.col("timed_out")),
    }).drop("__u", "__hit")


# --- anchors ------------------------------------------------------------------------------------


def scored_anchors(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", **tokens) -> DataFrame:
    """Careers links of pages: score, external, evidence; one row per (page, link), best score kept."""
    found = pages.select(key, url, F.explode(H.scored_links(url, html, **tokens)).alias("x"))
    flat = found.select(
        key, url, "x.a.pos", "x.a.link", "x.a.anchor_text", "x.s.score", "x.s.external", "x.s.evidence",
    )
    return best_anchor(flat, key, "link")


def next_hop(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", **tokens) -> DataFrame:
    """The best link of each page that is not the page itself."""
    links = scored_anchors(pages, key, url, html, **tokens).filter(U.normalise_url("link") != U.normalise_url(url))
    return first_per_group(links, [key], [F.desc("score"), F.length("link"), "link"]).select(key, F.col("link").alias("hop_url"))


def posting_links(pages: DataFrame, key: str, url: str, html: str, max_jobs: int | None = None, pattern: str | None = None, tokens=vocab.POSTING_PATH_TOKENS) -> DataFrame:
    """Posting links of listings pages: first sighting per link (with ``max_jobs`` the first
    ones of a page), the page's total link count and a flag that the cap was reached."""
    from pyspark.sql import Window

    def chosen(a: Column) -> Column:
        return H.is_posting_link(F.coalesce(a["link"], a["href"]), a["anchor_text"], pattern, tokens)

    # One row per page holds its links; only the picked ones are exploded.
    listed = pages.select(key, let(
        H.anchor_links(url, html),
        lambda links: F.struct(F.size(links).cast("bigint").alias("total"), F.filter(links, chosen).alias("picked")),
    ).alias("l"))
    picked = listed.select(key, F.col("l.total").alias("total_links"), F.explode("l.picked").alias("a")).select(
        key, "total_links", "a.pos", F.col("a.anchor_text").alias("title"), F.coalesce("a.link", "a.href").alias("link"))
    unique = first_per_group(picked, [key, "link"], ["pos"])
    capped = top_k(unique, [key], ["pos"], max_jobs, "rank")
    return capped.select(
        key, "rank", "link", "title", "total_links", (F.lit(False) if max_jobs is None else F.count("*").over(Window.partitionBy(key)) >= max_jobs).alias("capped"))


# --- vendors ------------------------------------------------------------------------------------


def vendor_references(pages: DataFrame, key: str, html: str, hosts: list[tuple[str, str]] = vocab.VENDOR_HOSTS) -> DataFrame:
    """Pages per vendor whose host occurs anywhere in the page. The host list is a constant, so each
    page emits its vendors in one pass instead of joining pages to hosts."""
    low = F.lower(html)
    named = F.array_compact(F.array(*[F.when(low.contains(h), F.lit(v)) for h, v in hosts]))
    hits = pages.select(key, F.explode(F.array_distinct(named)).alias("vendor"))
    return hits.groupBy("vendor").agg(F.countDistinct(key).alias("pages"))


def vendor_by_host(df: DataFrame, host: ColumnOrName, hosts: list[tuple[str, str]] = vocab.VENDOR_HOSTS, name: str = "vendor") -> DataFrame:
    """Vendor by host suffix; list order wins."""
    h = c(host)
    return df.withColumn(name, F.coalesce(*[F.when(U.host_matches(h, s), F.lit(v)) for s, v in hosts]))


# --- robots -------------------------------------------------------------------------------------


def robots_lines(robots: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    """(host, line_no, field, value) of usable robots lines; comments are cut."""
    lines = robots.select(host, F.posexplode(F.split(body, "\n")).alias("line_no", "raw"))
    line = F.trim(F.regexp_replace(F.regexp_replace("raw", "#[\\s\\S]*$", ""), "[\\r\\t]", " "))
    usable = lines.withColumn("line", line).filter(F.col("line").contains(":"))
    return usable.select(
        host, F.col("line_no").cast("bigint").alias("line_no"),
        F.lower(F.trim(F.regexp_extract("line", "^([^:]*):", 1))).alias("field"),
        F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"),
    )


def robots_hints(robots: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    """Declared sitemaps and careers-looking paths: (host, line_no, hint, value)."""
    lines = robots_lines(robots, host, body).filter(F.col("value") != "")
    hint = F.when(F.col("field") == "sitemap", "sitemap").when(
        F.col("field").isin("allow", "disallow") & U.robots_path_hint("value"), "path"
    )
    return lines.withColumn("hint", hint).filter(F.col("hint").isNotNull()).select(host, "line_no", "hint", "value")


def robots_groups(robots: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    """Robots lines with the group they belong to: each user-agent line opens a new one, so stacked
    agents keep only the last one's rules. Group 0 holds rules before any agent."""
    lines = robots_lines(robots, host, body).filter(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    return running_sum(lines, [host], ["line_no"], bucket("line_no"), {"grp": (F.col("field") == "user-agent").cast("int")})


def pattern_regex(pattern: ColumnOrName) -> Column:
    """A robots pattern as an anchored regular expression: prefix match, ``*`` wildcard, final ``$``
    anchor. With a wildcard the anchor only asks that the path ends like the pattern."""
    p = c(pattern)
    anchored = p.endswith("$")
    bare = F.regexp_replace(p, r"\$$", "")
    quoted = F.array_join(
        F.transform(F.split(bare, r"\*", -1), lambda s: F.regexp_replace(s, r"([\\.\[\]{}()+?^$|])", r"\\$1")), ".*?"
    )
    tail = F.regexp_extract(bare, r"([^*]*)$", 1)
    quoted_tail = F.regexp_replace(tail, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    ends = F.concat(F.lit("(?=.*"), quoted_tail, F.lit("$)"))
    return (
        F.when(anchored & ~bare.contains("*"), F.concat(F.lit("(?s)^"), quoted, F.lit("$")))
        .when(anchored, F.concat(F.lit("(?s)^"), ends, quoted))
        .otherwise(F.concat(F.lit("(?s)^"), quoted))
    )


def robots_rules(robots: DataFrame, agent: str, host: str = "host", body: str = "body") -> DataFrame:
    """The rules of the group an agent falls under, a row per rule: host, crawl_delay, len, allow, head, regex.

    The first group named by the agent wins, else the first ``*`` group. ``head`` is what a matching path has to begin
    with: all of a plain pattern, the text before the wildcard or anchor of another, which ``regex`` then decides. A host
    without rules has one row without ``head``. ``status`` (when there) decides unreadable hosts: 404 and 410
    allow everything, anything but 200 denies everything.
    """
    lines = robots_groups(robots, host, body)
    want = agent.lower()
    value = F.lower("value")
    named = (value != "*") & (value != "") & F.lit(want).contains(value)
    heads = lines.filter(F.col("field") == "user-agent").groupBy(host).agg(
        F.coalesce(F.min(F.when(named, F.col("grp"))), F.min(F.when(value == "*", F.col("grp")))).alias("__grp")
    )
    chosen = lines.join(heads, host).filter((F.col("grp") == F.col("__grp")) & (F.col("field") != "user-agent"))
    said = F.when(F.col("field") == "crawl-delay", F.col("value").try_cast("double"))
    delay = F.when(said >= 0, said)
    delays = chosen.groupBy(host).agg(F.max_by(delay, F.when(delay.isNotNull(), F.col("line_no"))).alias("__delay"))
    plain = ~F.col("value").contains("*") & ~F.col("value").endswith("$")
    rules = chosen.filter(F.col("field").isin("allow", "disallow") & (F.col("value") != "")).select(
        host, F.length("value").alias("len"), (F.col("field") == "allow").alias("allow"),
        F.regexp_extract(F.regexp_replace("value", r"\$$", ""), r"^([^*]*)", 1).alias("head"), F.when(~plain, pattern_regex("value")).alias("regex"),
    )
    status = F.coalesce(F.col("status"), F.lit(0)) if "status" in robots.columns else F.lit(200)
    hosts = robots.select(host, status.alias("__status")).join(delays, host, "left")
    wait = F.coalesce(F.when(F.col("__status") == 200, F.col("__delay")), F.lit(0.0)).alias("crawl_delay")
    read = hosts.filter("__status = 200").join(rules, host, "left")
    denied = ~F.col("__status").isin(404, 410)
    unread = hosts.filter("__status <> 200").select(
        host, wait, F.when(denied, 1).alias("len"), F.when(denied, F.lit(False)).alias("allow"), F.when(denied, "/").alias("head"), F.lit(None).cast("string").alias("regex"))
    return read.select(host, wait, "len", "allow", "head", "regex").unionByName(unread)


def robots_allowed(urls: DataFrame, rules: DataFrame, url: str = "url", host: str = "host") -> DataFrame:
    """Adds ``allowed`` and ``crawl_delay``: the longest matching pattern wins, allow wins ties, no match allows. A host
    without a rules row was never readable and is denied.

    A longest-prefix join: each distinct path of a host is looked up under its beginnings, of the lengths only that
    the host's rules have, by equality on host and beginning. So a host with very many rules or URLs spreads over tasks,
    and a path meets only rules that begin like it. The lengths per host stay few: n different ones take n^2 / 2 bytes of rules.
    """
    path = F.coalesce(F.nullif(U.decoded_path(url), F.lit("")), F.lit("/"))
    placed = urls.withColumn("__path", path)
    asked = placed.select(F.col(host).alias("__host"), F.col("__path").alias("__at")).distinct()
    r = rules.filter(F.col("head").isNotNull()).select(F.col(host).alias("__host"), F.col("head").alias("__head"), "regex", F.struct("len", "allow").alias("__rule"))
    lengths = r.select("__host", F.length("__head").alias("n")).distinct().groupBy("__host").agg(F.collect_list("n").alias("__lengths"))
    beginnings = asked.join(lengths, "__host").select(
        "__host", "__at", F.explode(F.filter("__lengths", lambda n: n <= F.length("__at"))).alias("__n"))
    probes = beginnings.select("__host", "__at", F.left("__at", F.col("__n")).alias("__head"))
    hits = probes.join(r, ["__host", "__head"]).filter(F.col("regex").isNull() | F.regexp_like("__at", F.col("regex")))
    best = hits.groupBy("__host", "__at").agg(F.max("__rule")["allow"].alias("__best"))
    known = rules.groupBy(F.col(host).alias("__known")).agg(F.max("crawl_delay").alias("crawl_delay"))
    decided = placed.join(best, (F.col(host) == F.col("__host")) & (F.col("__path") == F.col("__at")), "left").drop("__host", "__at")
    j = decided.join(known, F.col(host) == F.col("__known"), "left")
    allowed = F.when(F.col("__known").isNull(), F.lit(False)).otherwise(F.coalesce("__best", F.lit(True)))
    return j.withColumn("allowed", allowed).drop("__path", "__best", "__known")


# --- sitemaps -----------------------------------------------------------------------------------

_LOC = r"(?is)<loc\s*>\s*(.*?)\s*</loc>"


def sitemap_locs(sitemaps: DataFrame, body: str = "body") -> DataFrame:
    """One row per <loc> of documents that are a sitemap or a sitemap index: pos, loc, is_index."""
    b = F.col(body)
    is_index = b.rlike(r"(?i)<sitemapindex\b")
    rows = sitemaps.filter(is_index | b.rlike(r"(?i)<urlset\b")).withColumn("is_index", is_index)
    others = [x for x in sitemaps.columns if x != body]
    out = rows.select(*others, "is_index", F.posexplode(F.regexp_extract_all(b, F.lit(_LOC), F.lit(1))).alias("pos", "loc"))
    decoded = F.trim("loc")
    # The entities a sitemap uses; &amp; last, so that nothing is decoded twice.
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    return out.withColumns({"loc": decoded, "pos": F.col("pos").cast("bigint")}).filter(F.col("loc") != "")


def is_careers_loc(loc: ColumnOrName) -> Column:
    """Careers-looking path that is not boilerplate."""
    segments = U.path_segments(loc)
    return ~U.is_boilerplate_path(segments) & (U.has_prefix_token(segments) | U.robots_path_hint(U.path_of(loc)))


def sitemap_candidates(origins: DataFrame, declared: DataFrame, responses: DataFrame, max_sitemaps: int | None = None) -> DataFrame:
    """(company_id, base, url, ref_no, sub_no, place) of careers URLs found in sitemaps.

    Declared sitemaps, else the conventional one; one level of index nesting; with ``max_sitemaps`` at most
    so many sitemaps per company and children per index.
    """
    refs = declared.join(origins.select("company_id"), "company_id", "left_semi").select("company_id", "ref_no", "ref")
    undeclared = origins.join(declared.select("company_id").distinct(), "company_id", "left_anti")
    conventional = undeclared.select("company_id", F.lit(0).cast("bigint").alias("ref_no"), F.concat("origin", F.lit("/sitemap.xml")).alias("ref"))
    wanted = top_k(refs, ["company_id"], ["ref_no"], max_sitemaps).unionByName(conventional)
    good = responses.filter((F.col("status") == 200) & (F.coalesce(F.col("body"), F.lit("")) != "")).select(F.col("url").alias("__u"), "body")
    first = sitemap_locs(wanted.join(good, F.col("ref") == F.col("__u")).drop("__u"))
    children = top_k(first.filter("is_index"), ["company_id", "ref_no"], ["pos"], max_sitemaps)
    second = sitemap_locs(
        children.select("company_id", "ref_no", "ref", F.col("pos").alias("sub_no"), F.col("loc").alias("child"))
        .join(good, F.col("child") == F.col("__u")).drop("__u")
    ).filter(~F.col("is_index"))
    direct = first.filter(~F.col("is_index")).select("company_id", "ref_no", F.lit(0).cast("bigint").alias("sub_no"), "ref", "loc")
    nested = second.select("company_id", "ref_no", "sub_no", "ref", "loc")
    return direct.unionByName(nested).filter(is_careers_loc("loc")).select(
        "company_id", F.col("ref").alias("base"), F.col("loc").alias("url"), "ref_no", "sub_no", U.path_depth("loc").alias("depth")
    )


# --- the ladder ---------------------------------------------------------------------------------

CANDIDATE = ["company_id", "company_name", "homepage", "url", "base", "kind", "source", "tier", "a", "b", "d"]


def homepage_attempts(companies: DataFrame, responses: DataFrame) -> DataFrame:
    """Homepages fetched and judged. In: company_id, name, website."""
    usable = companies.filter(U.is_http_url("website")).select(
        "company_id", F.col("name").alias("company_name"), F.trim("website").alias("homepage"),
        F.concat(U.scheme("website"), F.lit("://"), F.regexp_extract(F.trim("website"), "^[^:]*://([^/?#]*)", 1)).alias("origin"),
    ).withColumns({"url": F.col("homepage"), "base": F.lit(None).cast("string"), "kind": F.lit("website"), "source": F.lit("homepage")})
    return gate(fetch(usable, responses), strict=False)


def ladder_candidates(homes: DataFrame, responses: DataFrame, max_candidates: int | None = None, max_sitemaps: int | None = None) -> DataFrame:
    """Candidates per company in tier order (links, sitemaps, robots paths), first of each URL, as ``rank``
    1..n; all of them, or the first ``max_candidates``."""
    ident = homes.select("company_id", "company_name", "homepage", "origin")
    ok = homes.filter("gate.status = 'accepted'")
    page = ok.select("company_id", F.col("gate.final_url").alias("url"), F.col("body").alias("html"))
    links = scored_anchors(page, "company_id").select(
        "company_id", "url", "link", "score").withColumnRenamed("url", "base")
    anchor_rows = links.select(
        "company_id", F.col("link").alias("url"), "base",
        F.when(U.is_board_host(U.host("link")), "ats_board").otherwise("career_site").alias("kind"),
        F.lit("nav_anchor").alias("source"), F.lit(1).alias("tier"),
        F.struct((-F.col("score")).alias("x"), F.length("link").cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("z")).alias("o"),
    )
    robots = fetch(ident.select("company_id", "origin", F.concat("origin", F.lit("/robots.txt")).alias("url")), responses)
    robots = robots.filter((F.col("status") == 200) & (F.coalesce(F.col("body"), F.lit("")) != ""))
    hints = robots_hints(robots.select(F.col("company_id"), "body"), "company_id")
    declared = hints.filter("hint = 'sitemap'").select("company_id", F.col("line_no").alias("ref_no"), F.col("value").alias("ref"))
    sites = sitemap_candidates(ident.select("company_id", "origin"), declared, responses, max_sitemaps)
    site_rows = sites.select(
        "company_id", "url", "base", F.lit("career_site").alias("kind"), F.lit("sitemap").alias("source"), F.lit(2).alias("tier"),
        F.struct(F.col("ref_no").alias("x"), F.col("sub_no").alias("y"), F.col("depth").alias("z")).alias("o"),
    )
    path_rows = (
        hints.filter("hint = 'path'").join(ident.select("company_id", "origin"), "company_id")
        .select(
            "company_id", U.resolve_url(F.concat("origin", F.lit("/")), "value").alias("url"), F.concat("origin", F.lit("/")).alias("base"),
            F.lit("career_site").alias("kind"), F.lit("robots_path").alias("source"), F.lit(3).alias("tier"),
            F.struct(F.col("line_no").alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("z")).alias("o"),
        ).filter(F.col("url").isNotNull())
    )
    union = anchor_rows.unionByName(site_rows).unionByName(path_rows)
    unique = first_per_group(union, ["company_id", "url"], ["tier", "o"])
    ranked = top_k(unique, ["company_id"], ["tier", "o", "url"], max_candidates, "rank")
    return ranked.join(ident, "company_id").drop("o")


def climb(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """Judge candidates; the first accepted one ends a company's ladder and later ones are not
    attempts. Adds ``gate`` and ``is_answer``.

    Candidates are taken in rounds by rank: the first, the next two, the next four and so on, each time of companies
    without an answer yet. So a company's candidates after its answer are neither joined nor judged, but for those of the
    round that found it, and the number of rounds is the logarithm of the longest ladder.
    """
    open_ = cut(candidates)
    # The responses that any candidate asks for; the rounds do not shuffle the others.
    asked = cut(responses.join(open_.select("url").distinct(), "url", "left_semi"))
    out, low = [], 1
    while True:
        high = 2 * low - 1
        judged = cut(gate(fetch(open_.filter(F.col("rank").between(low, high)), asked), strict=False))
        stop = judged.filter(F.col("gate.status") == "accepted").groupBy("company_id").agg(F.min("rank").alias("__stop"))
        j = judged.join(stop, "company_id", "left").filter(F.col("__stop").isNull() | (F.col("rank") <= F.col("__stop")))
        out.append(j.withColumn("is_answer", F.coalesce(F.col("rank") == F.col("__stop"), F.lit(False))).drop("__stop"))
        open_ = cut(open_.filter(F.col("rank") > high).join(stop, "company_id", "left_anti"))
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, out)
        low = high + 1


def first_accepted(ranked: DataFrame, key: str, rank: str, accepted: ColumnOrName, cap: int | None = None) -> DataFrame:
    """Rows up to and including the first accepted one per key."""
    rows = ranked.filter(F.col(rank) <= cap) if cap else ranked
    stop = rows.groupBy(key).agg(F.min(F.when(c(accepted), F.col(rank))).alias("__stop"))
    return rows.join(stop, key).filter(F.col("__stop").isNull() | (F.col(rank) <= F.col("__stop"))).drop("__stop")


def annotate_blocks(pages: DataFrame, status: str = "status", title: str = "title", text: str = "text", scan_chars: int | None = None) -> DataFrame:
    """Pages with blocked, block_reason, block_evidence. Callers drop blocked listings pages and keep
    blocked posting pages, annotated."""
    return pages.withColumn("__b", T.block_verdict(status, title, text, scan_chars)).select(
        *pages.columns, F.col("__b.blocked").alias("blocked"), F.col("__b.reason").alias("block_reason"), F.col("__b.evidence").alias("block_evidence")
    )


