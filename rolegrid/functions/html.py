"""Link extraction and scoring from raw HTML, as generators over string columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid import vocab
from rolegrid.functions import urls
from rolegrid.functions.base import ColumnOrName, c, first_marker, let, squeeze

ANCHOR = r"(?is)<a\b[^>]*>.*?</a>"
REGION_OR_ANCHOR = (
    r"(?is)<(?:nav|header|footer)\b[^>]*>.*?</(?:nav|header|footer)>|<a\b[^>]*>.*?</a>"
)
_HREF = r"""(?is)^<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""


def anchor_tokens(html: ColumnOrName) -> Column:
    """array<struct<in_nav, token>> of the anchors of a page, in document order.

    A navigation region is one token; its anchors are pulled out in a second pass, so membership
    follows from where the anchor starts.
    """
    tokens = F.regexp_extract_all(c(html), F.lit(REGION_OR_ANCHOR), F.lit(0))
    return F.flatten(
        F.transform(
            tokens,
            lambda t: F.when(
                t.rlike(r"(?i)^<(nav|header|footer)\b"),
                F.transform(
                    F.regexp_extract_all(t, F.lit(ANCHOR), F.lit(0)),
                    lambda a: F.struct(F.lit(True).alias("in_nav"), a.alias("token")),
                ),
            ).otherwise(F.array(F.struct(F.lit(False).alias("in_nav"), t.alias("token")))),
        )
    )


def href_of(token: ColumnOrName) -> Column:
    t = c(token)
    return F.coalesce(*[F.nullif(F.regexp_extract(t, _HREF, i), F.lit("")) for i in (1, 2, 3)], F.lit(""))


def anchor_text(token: ColumnOrName) -> Column:
    inner = F.regexp_extract(c(token), r"(?is)^<a\b[^>]*>(.*)</a>$", 1)
    return squeeze(F.regexp_replace(inner, "<[^>]*>", " "))


def anchor_links(url: ColumnOrName, html: ColumnOrName) -> Column:
    """array<struct<pos, in_nav, href, anchor_text, link>> of a page, in document order. ``link`` is
    the resolved URL, NULL when not navigable."""

    def resolved(parts: Column) -> Column:
        return F.struct(
            parts["pos"].alias("pos"), parts["in_nav"].alias("in_nav"), parts["href"].alias("href"),
            parts["text"].alias("anchor_text"), urls.resolve_url(url, parts["href"]).alias("link"),
        )

    return F.transform(
        anchor_tokens(html),
        lambda a, i: let(
            F.struct(
                i.cast("bigint").alias("pos"), a["in_nav"].alias("in_nav"), href_of(a["token"]).alias("href"),
                anchor_text(a["token"]).alias("text"),
            ),
            resolved,
        ),
    )


def explode_anchors(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row per anchor: kept page columns, pos, in_nav, href, anchor_text, link."""
    keep = keep if keep is not None else [x for x in pages.columns if x != html]
    return pages.select(*keep, F.explode(anchor_links(url, html)).alias("a")).select(*keep, "a.*")


def scored_links(url: ColumnOrName, html: ColumnOrName, **tokens) -> Column:
    """The page's careers links with their score. Extraction, joining and scoring happen inside one
    array expression, so a page is read once and only links with a signal leave it."""
    scored = F.transform(
        F.filter(anchor_links(url, html), lambda a: a["link"].isNotNull()),
        lambda a: F.struct(a.alias("a"), score_anchor(url, a["link"], a["anchor_text"], a["in_nav"], **tokens).alias("s")),
    )
    return F.filter(scored, lambda x: x["s"]["has_signal"])


def score_anchor(
    page_url: ColumnOrName,
    link: ColumnOrName,
    label: ColumnOrName,
    in_nav: ColumnOrName,
    text_tokens: list[str] = vocab.CAREERS_TEXT_TOKENS,
    path_tokens: list[str] = vocab.SEGMENT_PREFIX_TOKENS,
    exact_pattern: str = vocab.EXACT_LINK_TEXT,
    nav_phrases: list[str] = vocab.NAV_PHRASES,
) -> Column:
    """struct(score, external, evidence) of one link; score 0 means the link carries no signal."""
    facts = F.struct(
        F.lower(c(label)).alias("low"),
        c(in_nav).alias("in_nav"),
        urls.has_prefix_token(urls.path_segments(link), path_tokens).alias("path"),
        (~urls.same_site(page_url, link)).alias("external"),
    )
    wording = "|".join(re.escape(t) for t in text_tokens)

    def weigh(f: Column) -> Column:
        exact = F.trim(f["low"]).rlike(exact_pattern)
        text_score = F.when(exact, vocab.SCORE_TEXT_EXACT).when(f["low"].rlike(wording), vocab.SCORE_TEXT_SIGNAL).otherwise(0)
        path_score = F.when(f["path"], vocab.SCORE_URL_SIGNAL).otherwise(0)
        phrase = F.when(f["in_nav"] & ((text_score + path_score) == 0), first_marker(f["low"], nav_phrases))
        return F.struct(f.alias("f"), text_score.alias("text"), path_score.alias("path"), phrase.alias("phrase"))

    def total(w: Column) -> Column:
        f = w["f"]
        core = w["text"] + w["path"] + F.when(w["phrase"].isNotNull(), vocab.SCORE_TEXT_SIGNAL).otherwise(0)
        nav = F.when(f["in_nav"], vocab.SCORE_NAV_REGION).otherwise(0)
        away = F.when(f["external"], vocab.SCORE_EXTERNAL).otherwise(0)
        evidence = F.array_compact(
            F.array(
                F.when(w["text"] == vocab.SCORE_TEXT_EXACT, F.concat(F.lit("text_exact:"), f["low"])).when(w["text"] > 0, F.lit("text_signal")),
                F.when(f["path"], F.lit("url_signal")),
                F.concat(F.lit("nav_text:"), w["phrase"]),
                F.when(f["in_nav"], F.lit("in_nav")),
                F.when(f["external"], F.lit("external")),
            )
        )
        return F.struct(
            F.when(core > 0, core + nav + away).otherwise(0).cast("bigint").alias("score"),
            f["external"].alias("external"), evidence.alias("evidence"), (core > 0).alias("has_signal"),
        )

    return let(let(facts, weigh), total)


def looks_like_posting(href: ColumnOrName, label: ColumnOrName, tokens: list[str] = vocab.POSTING_PATH_TOKENS) -> Column:
    """A link whose lowered path holds a posting token and whose text is not blank."""
    h = c(href)
    bad = h.isNull() | (h == "")
    for prefix in vocab.POSTING_LINK_REJECTS:
        bad = bad | h.startswith(prefix)
    path = F.lower(F.regexp_extract(h, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#;]*)", 1))
    hit = path.rlike("|".join(re.escape(t) for t in tokens))
    return F.coalesce(~bad & (F.trim(c(label)) != "") & hit, F.lit(False))


def is_posting_link(href: ColumnOrName, label: ColumnOrName, link_pattern: str | None = None, tokens=vocab.POSTING_PATH_TOKENS) -> Column:
    """An override pattern replaces the heuristic entirely."""
    return c(href).rlike(link_pattern) if link_pattern else looks_like_posting(href, label, tokens)
