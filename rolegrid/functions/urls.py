"""URL expressions: split, validate, normalise, resolve and classify without leaving the JVM.

A URL is taken apart with one RFC 3986 pattern per component instead of ``parse_url``, because real
crawl data holds spaces, pipes and non-ASCII paths that the strict parser refuses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolegrid import vocab
from rolegrid.functions.base import ColumnOrName, c, let

_SHAPE = r"^([^:/?#]+):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"
_HTTP = r"^(?i:https?)://([^/?#@]*@)?(\[[^\]/?#]*\](:[0-9]*)?|[^\[\]/?#@: ]+(:[0-9]*)?)([/?#]|$)"
_BAD_ESCAPE = r"^[^?]*%([^0-9A-Fa-f]|[0-9A-Fa-f]([^0-9A-Fa-f]|$)|$)"
_CONTROL = r"[\x00-\x1f\x7f]"
_PATH_SAFE = r"[A-Za-z0-9\-_.~!$&'()*+,;=:@\[\]/%]"


def is_http_url(url: ColumnOrName) -> Column:
    """True for an absolute http(s) URL with a host and well-formed escapes."""
    t = F.trim(c(url))
    return F.coalesce(t.rlike(_HTTP) & ~t.rlike(_BAD_ESCAPE) & ~t.rlike(_CONTROL), F.lit(False))


def parse_http_url(url: ColumnOrName) -> Column:
    """The trimmed URL when it is a usable http(s) URL, else NULL."""
    return F.when(is_http_url(url), F.trim(c(url)))


def _part(url: Column, index: int) -> Column:
    return F.regexp_extract(F.trim(url), _SHAPE, index)


def scheme(url: ColumnOrName) -> Column:
    return F.when(is_http_url(url), F.lower(_part(c(url), 1)))


def authority(url: ColumnOrName) -> Column:
    """host[:port] as written, without user info."""
    return F.when(is_http_url(url), F.regexp_replace(_part(c(url), 2), "^.*@", ""))


def host(url: ColumnOrName) -> Column:
    """Lower-cased host without port or user info; '' when the URL is not usable."""
    bare = F.regexp_replace(F.lower(authority(url)), r":[0-9]*$", "")
    return F.coalesce(F.regexp_replace(bare, r"^\[|\]$", ""), F.lit(""))


def same_host(url: ColumnOrName, wanted: ColumnOrName) -> Column:
    """Case-insensitive host equality; a blank on either side never matches."""
    return (host(url) != "") & (F.lower(c(wanted)) != "") & (host(url) == F.lower(c(wanted)))


def base_domain(host_col: ColumnOrName) -> Column:
    """The last two labels of a host."""
    return F.substring_index(F.lower(c(host_col)), ".", -2)


def same_site(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Both URLs usable and their hosts share the last two labels."""
    return is_http_url(a) & is_http_url(b) & (base_domain(host(a)) == base_domain(host(b)))


def raw_path(url: ColumnOrName) -> Column:
    """Path as written; '' when the URL is not usable."""
    return F.when(is_http_url(url), _part(c(url), 3)).otherwise("")


def decoded_path(url: ColumnOrName) -> Column:
    """Percent-decoded path; '' when the URL is not usable."""
    raw = raw_path(url)
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    return F.when(raw.contains("%"), decoded).otherwise(raw)


def path_of(url: ColumnOrName) -> Column:
    """Lower-cased, percent-decoded path."""
    return F.lower(decoded_path(url))


def path_segments(url: ColumnOrName) -> Column:
    """Non-empty lower-cased path segments."""
    return F.filter(F.split(path_of(url), "/"), lambda s: s != "")


def path_depth(url: ColumnOrName) -> Column:
    return F.size(path_segments(url)).cast("bigint")


def encode_path(path: Column) -> Column:
    """Percent-encode the characters a path may not hold; escapes already there stay."""
    encoded = F.array_join(
        F.transform(
            F.split(path, ""),
            lambda ch: F.when(ch.rlike(_PATH_SAFE) | (ch == ""), ch)
            .when(ch == " ", F.lit("%20"))
            .otherwise(F.url_encode(ch)),
        ),
        "",
    )
    return F.when(path.rlike(f"^{_PATH_SAFE}*$"), path).otherwise(encoded)


def _encode_query_text(text: Column) -> Column:
    """Form encoding where '~' stays and '*' is escaped."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def is_tracking_param(name: Column) -> Column:
    low = F.lower(name)
    hit = low.isin(vocab.TRACKING_PARAMS)
    for prefix in vocab.TRACKING_PREFIXES:
        hit = hit | low.startswith(prefix)
    return hit


def _clean_query(query: Column) -> Column:
    """Query text (no '?') without tracking parameters, sorted by key, re-encoded."""
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.contains(";"))
    decoded = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"),
            i.alias("i"),
            F.try_url_decode(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v"),
        ),
    )
    kept = F.filter(decoded, lambda s: s["k"].isNotNull() & s["v"].isNotNull() & ~is_tracking_param(s["k"]))
    return F.array_join(
        F.transform(
            F.array_sort(kept),
            lambda s: F.concat(_encode_query_text(s["k"]), F.lit("="), _encode_query_text(s["v"])),
        ),
        "&",
    )


def normalise_url(url: ColumnOrName) -> Column:
    """Drop the fragment and tracking parameters, sort the rest; unusable input is returned as is."""
    u = c(url)
    query = F.substring(_part(u, 4), 2, 1 << 30)
    cleaned = _clean_query(query)
    tail = (
        F.when(query == "", _part(u, 4))
        .when(cleaned == "", F.lit(""))
        .otherwise(F.concat(F.lit("?"), cleaned))
    )
    return F.when(
        is_http_url(u),
        F.concat(F.lower(_part(u, 1)), F.lit("://"), _part(u, 2), encode_path(_part(u, 3)), tail),
    ).otherwise(u)


def same_url(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Equal after normalisation; blanks are never equal."""
    filled = (F.trim(c(a)) != "") & (F.trim(c(b)) != "")
    return F.coalesce(filled & (normalise_url(a) == normalise_url(b)), F.lit(False))


def remove_dot_segments(path: Column) -> Column:
    """RFC 3986 dot-segment removal on an absolute path."""
    folded = F.aggregate(
        F.split(F.regexp_replace(path, "^/", ""), "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    slash = F.when(path.rlike(r"/\.{1,2}$") & (F.size(folded) > 0), F.lit("/")).otherwise("")
    clean = F.concat(F.lit("/"), F.array_join(folded, "/"), slash)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), clean).otherwise(path)


def is_navigation(href: ColumnOrName) -> Column:
    """False for blank, fragment-only and non-navigational hrefs."""
    t = F.trim(c(href))
    bad = (t == "") | t.startswith("#")
    for s in vocab.NON_NAVIGATION_SCHEMES:
        bad = bad | F.lower(t).startswith(s)
    return F.coalesce(~bad, F.lit(False))


def resolve_url(base: ColumnOrName, href: ColumnOrName) -> Column:
    """Join an href to the page it was found on; NULL when it is not a navigable link."""
    b, h = F.trim(c(base)), F.trim(c(href))
    no_frag = F.regexp_replace(h, r"#[\s\S]*$", "")
    parts = F.struct(
        b.alias("base"),
        no_frag.alias("ref"),
        F.regexp_extract(no_frag, r"^([^?]*)", 1).alias("ref_path"),
        F.regexp_replace(no_frag, r"^[^?]*", "").alias("ref_query"),
    )
    usable = is_navigation(h) & b.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+")
    return F.when(usable, let(parts, _join_reference))


def _join_reference(p: Column) -> Column:
    """Each kind of reference reduces to head, path and query, so that the path is tidied once."""
    base_scheme, base_path = F.lower(_part(p["base"], 1)), _part(p["base"], 3)
    root = F.concat(base_scheme, F.lit("://"), _part(p["base"], 2))
    absolute = p["ref"].rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    network, rooted = p["ref"].startswith("//"), p["ref_path"].startswith("/")
    same_page = p["ref_path"] == ""
    ref_head = F.regexp_extract(p["ref"], r"^([^:/?]*:)?(//[^/?]*)?", 0)
    head = (
        F.when(absolute, F.concat(F.lower(F.regexp_extract(ref_head, "^[^:]*", 0)), F.regexp_replace(ref_head, "^[^:]*", "")))
        .when(network, F.concat(base_scheme, F.lit(":"), ref_head))
        .otherwise(root)
    )
    merged = F.concat(F.regexp_replace(base_path, "[^/]*$", ""), p["ref_path"])
    path = (
        F.when(absolute | network, F.substring(p["ref_path"], F.length(ref_head) + 1, F.length(p["ref_path"])))
        .when(rooted, p["ref_path"])
        .when(same_page, base_path)
        .otherwise(F.when(merged.startswith("/"), merged).otherwise(F.concat(F.lit("/"), merged)))
    )
    query = F.when(same_page & (p["ref_query"] == "") & ~absolute & ~network, _part(p["base"], 4)).otherwise(p["ref_query"])
    tidy = let(let(path, remove_dot_segments), encode_path)
    return F.concat(head, tidy, query)


# --- careers words in paths: four rules that differ on purpose ----------------------------------


def has_prefix_token(segments: Column, tokens=vocab.SEGMENT_PREFIX_TOKENS) -> Column:
    """A segment starts with one of the tokens (links, sitemaps)."""
    pattern = "^(" + "|".join(tokens) + ")"
    return F.exists(segments, lambda s: s.rlike(pattern))


def has_contained_token(segments: Column, tokens=vocab.SEGMENT_CONTAINS_TOKENS) -> Column:
    """A segment contains one of the tokens (gate)."""
    pattern = "|".join(tokens)
    return F.exists(segments, lambda s: s.rlike(pattern))


def robots_path_hint(path: ColumnOrName, tokens=vocab.ROBOTS_PATH_TOKENS) -> Column:
    """The lowered text contains one of the tokens anywhere (robots lines)."""
    return F.lower(c(path)).rlike("|".join(tokens))


def has_careers_segment(segments: Column) -> Column:
    """A whole segment is a careers word, or starts with one followed by '-' or '_' (strict gate)."""
    pattern = "^((" + "|".join(vocab.SEGMENT_WORD_PREFIXES) + ")([-_].*)?|" + "|".join(vocab.SEGMENT_WORDS_EXACT) + ")$"
    return F.exists(segments, lambda s: s.rlike(pattern))


def is_locale_only_gate(segments: Column) -> Column:
    """Every segment is xx or xx-yy; an empty path is not a locale."""
    return (F.size(segments) > 0) & F.forall(segments, lambda s: s.rlike("^[a-z]{2}([-_][a-z]{2,4})?$"))


def is_locale_only_homepage(segments: Column) -> Column:
    """Looser form used for homepages: 2 to 5 characters of a-z, '-' and '_'."""
    return (F.size(segments) > 0) & F.forall(segments, lambda s: s.rlike("^[a-z_-]{2,5}$"))


def is_boilerplate_path(segments: Column) -> Column:
    return F.arrays_overlap(segments, F.array(*[F.lit(s) for s in vocab.BOILERPLATE_SEGMENTS]))


def is_non_homepage_path(segments: Column) -> Column:
    return F.arrays_overlap(segments, F.array(*[F.lit(s) for s in vocab.NON_HOMEPAGE_SEGMENTS]))


def is_product_or_investor(url: ColumnOrName, source: ColumnOrName) -> Column:
    """A product host always; a product path prefix unless the page's own navigation named the link."""
    pattern = "^(" + "|".join(vocab.PRODUCT_PATH_PREFIXES) + ")"
    by_path = F.exists(path_segments(url), lambda s: s.rlike(pattern))
    return is_http_url(url) & (host(url).isin(vocab.PRODUCT_HOSTS) | ((c(source) != "nav_anchor") & by_path))


def wrong_kind_token(url: ColumnOrName) -> Column:
    """First token saying the path is another kind of page: hard tokens, then soft ones unless the
    segment also names careers. NULL when there is none."""
    careers = "|".join(vocab.SEGMENT_PREFIX_TOKENS)

    def hit(s: Column, tokens: list[str]) -> Column:
        return F.coalesce(*[F.when(s.contains(t), F.lit(t)) for t in tokens])

    found = F.transform(
        path_segments(url),
        lambda s: F.coalesce(
            hit(s, vocab.HARD_PATH_TOKENS), F.when(~s.rlike(careers), hit(s, vocab.SOFT_PATH_TOKENS))
        ),
    )
    return F.try_element_at(F.filter(found, lambda t: t.isNotNull()), F.lit(1))


def host_matches(host_col: Column, suffix: Column | str) -> Column:
    """Host equals the suffix or is a subdomain of it."""
    s = F.lit(suffix) if isinstance(suffix, str) else suffix
    return (host_col == s) | host_col.endswith(F.concat(F.lit("."), s))


def is_board_host(host_col: Column) -> Column:
    pattern = r"(^|\.)(" + "|".join(h.replace(".", r"\.") for h in vocab.BOARD_HOSTS) + ")$"
    return host_col.rlike(pattern)


def allowed_domain(url: ColumnOrName, start_url: ColumnOrName) -> Column:
    """URL stays on the start URL's base domain (or a subdomain) or on a known board."""
    wild = [p.removeprefix("*.").replace(".", r"\.") for p in vocab.ALLOWED_BOARD_DOMAINS if p.startswith("*.")]
    exact = [p for p in vocab.ALLOWED_BOARD_DOMAINS if not p.startswith("*.")]
    board_pattern = r"(^|\.)(" + "|".join(wild) + ")$"

    def decide(hosts: Column) -> Column:
        h, base = hosts["h"], hosts["base"]
        own = (base != "") & host_matches(h, base)
        return (h != "") & (own | h.rlike(board_pattern) | h.isin(exact))

    return let(F.struct(host(url).alias("h"), base_domain(host(start_url)).alias("base")), decide)


# --- applicant-tracking boards ------------------------------------------------------------------


def _by_host(h: Column, table, value_of) -> Column:
    return F.coalesce(*[F.when(host_matches(h, suffix), value_of(suffix, value)) for suffix, value in table])


def _tenant_of(parts: Column) -> Column:
    h = parts["h"]
    first = F.nullif(F.regexp_extract(parts["p"], "^/*([^/]+)", 1), F.lit(""))

    def value(suffix: str, vendor: str) -> Column:
        sub = F.nullif(F.regexp_extract(h, r"([^.]+)\." + suffix.replace(".", r"\.") + "$", 1), F.lit(""))
        return F.struct(F.coalesce(first, sub).alias("tenant"), F.lit(vendor).alias("vendor"))

    found = _by_host(h, vocab.TENANT_HOSTS, value)
    return F.when(found["tenant"].isNotNull(), found)


def tenant(url: ColumnOrName) -> Column:
    """struct(tenant, vendor) of a board URL: first path segment, else the label before the board
    host. NULL when the host is not a board or names no tenant."""
    return let(F.struct(host(url).alias("h"), raw_path(url).alias("p")), _tenant_of)


def vendor_from_url(url: ColumnOrName) -> Column:
    """Vendor by host suffix, list order wins; NULL when unknown."""
    return let(
        F.struct(host(url).alias("h"), raw_path(url).alias("p")),
        lambda parts: F.coalesce(
            _tenant_of(parts)["vendor"], _by_host(parts["h"], vocab.VENDOR_HOSTS, lambda _s, v: F.lit(v))
        ),
    )


def kind_for_url(url: ColumnOrName) -> Column:
    return F.when(tenant(url).isNotNull(), F.lit("ats_board")).otherwise("career_site")


def board_api_url(url: ColumnOrName) -> Column:
    """Endpoint that lists a tenant's postings; NULL when the URL names no tenant."""
    def endpoint(t: Column) -> Column:
        slug = F.replace(_encode_query_text(t["tenant"]), F.lit("+"), F.lit("%20"))
        return F.coalesce(
            *[
                F.when(t["vendor"] == vendor, F.concat(F.lit(head), slug, F.lit(tail)))
                for vendor, (head, tail) in vocab.BOARD_API.items()
            ]
        )

    return let(tenant(url), endpoint)


def platform_id_for_host(host_col: Column) -> Column:
    return F.coalesce(_by_host(host_col, vocab.PLATFORM_FOR_HOST, lambda _s, v: F.lit(v)), F.lit(0)).cast("bigint")


def external_id(url: ColumnOrName, pattern: ColumnOrName) -> Column:
    """Capture group 1 of the vendor's pattern, else the URL itself."""
    p, u = c(pattern), c(url)
    has_group = p.rlike(r"(?<!\\)\((?!\?)")
    return F.when(p.isNull() | (p == "") | ~has_group, u).otherwise(
        F.when(F.regexp_like(u, p), F.regexp_extract_all(u, p, F.lit(1))[0]).otherwise(u)
    )
