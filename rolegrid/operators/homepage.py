"""Which URL is a company's homepage: scored claims, infobox text, two-source join, alias chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid import vocab
from rolegrid.functions import urls as U
from rolegrid.functions.base import ColumnOrName, c
from rolegrid.functions.text import distinctive_token
from rolegrid.operators.ranking import first_per_group
from rolegrid.session import cut


def score_homepage(claims: DataFrame, url: str = "url", rank: str = "rank", company: str = "title") -> DataFrame:
    """claims with usable, bare, host_match and score. Locale-only, non-homepage, deprecated and
    unusable claims are not usable."""
    step = claims.withColumns({"__h": U.host(url), "__s": U.path_segments(url), "__t": distinctive_token(company)})
    usable = (
        U.is_http_url(url) & (F.coalesce(F.col(rank), F.lit("normal")) != "deprecated")
        & ~U.is_locale_only_homepage(F.col("__s")) & ~U.is_non_homepage_path(F.col("__s"))
    )
    bare = F.size("__s") == 0
    named = (F.col("__t") != "") & F.col("__h").contains(F.col("__t"))
    dots = F.length("__h") - F.length(F.replace("__h", F.lit("."), F.lit("")))
    score = (
        F.when(F.col(rank) == "preferred", vocab.HOME_PREFERRED).otherwise(0)
        + F.when(bare, vocab.HOME_BARE).otherwise(vocab.HOME_NON_BARE)
        + F.when(U.scheme(url) == "https", vocab.HOME_HTTPS).otherwise(vocab.HOME_HTTP)
        - vocab.HOME_STEP * F.size("__s")
        - vocab.HOME_STEP * F.greatest(F.lit(0), dots - 1)
        + F.when(named, vocab.HOME_BARE).otherwise(0)
    )
    return step.withColumns({"usable": usable, "bare": bare, "host_match": named, "score": F.when(usable, score).cast("bigint")}).drop("__h", "__s", "__t")


def select_homepage(claims: DataFrame, key: str = "title", url: str = "url", rank: str = "rank", company: str = "title") -> DataFrame:
    """The best claim per key: score, host names the company, shorter, URL; with the rejected count."""
    scored = score_homepage(claims, url, rank, company).withColumn(url, F.trim(url))
    rejected = scored.groupBy(key).agg(F.count_if(~F.col("usable")).alias("rejected"))
    best = first_per_group(scored.filter("usable"), [key], [F.desc("score"), F.desc("host_match"), F.length(url), url])
    return rejected.join(best.select(key, F.col(url).alias("url"), F.col(rank).alias("rank"), "bare", "score"), key, "left").withColumn(
        "reason", F.when(F.col("url").isNull(), "no_usable_candidate").otherwise("")
    )


def infobox_website(wikitext: ColumnOrName) -> Column:
    """First URL of the infobox ``website`` line; NULL for none, comments and empty values."""
    value = F.trim(F.regexp_extract(c(wikitext), r"(?im)^\s*\|\s*website\s*=\s*(.*)$", 1))
    found = F.regexp_extract(value, r"""https?://[^\s\]\}<>"|]+""", 0)
    bad = value.startswith("<!--") | (F.lower(value) == "none")
    return F.when(~bad, F.nullif(F.regexp_replace(found, "[.,;:)]+$", ""), F.lit("")))


def entity_claims(entities: DataFrame, body: str = "body") -> DataFrame:
    """(title, url, rank) of the website claims in entity documents; a missing rank is ``normal``."""
    claim = "struct<mainsnak:struct<datavalue:struct<value:variant>>,rank:string>"
    entity = f"struct<claims:map<string,array<{claim}>>,sitelinks:struct<enwiki:struct<title:string>>>"
    rows = entities.select(F.explode(F.from_json(body, f"struct<entities:map<string,{entity}>>")["entities"]).alias("qid", "e"))
    titled = rows.filter(F.coalesce(F.col("e.sitelinks.enwiki.title"), F.lit("")) != "")
    claims = titled.select("qid", F.col("e.sitelinks.enwiki.title").alias("title"), F.explode(F.try_element_at("e.claims", F.lit("P856"))).alias("claim"))
    value = F.col("claim.mainsnak.datavalue.value")
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return claims.select("qid", "title", text.alias("url"), F.coalesce(F.nullif("claim.rank", F.lit("")), F.lit("normal")).alias("rank")).filter(
        F.coalesce(F.col("url"), F.lit("")) != ""
    )


def two_source_homepage(infobox: DataFrame, selected: DataFrame) -> DataFrame:
    """(title, url, source, disagreement, other_url): the infobox is preferred, the claim is the
    fallback, and differing hosts are recorded. In: infobox(title, url), selected(title, url)."""
    a = infobox.filter(F.coalesce(F.col("url"), F.lit("")) != "").select("title", F.col("url").alias("__a"))
    b = selected.filter(F.coalesce(F.col("url"), F.lit("")) != "").select("title", F.col("url").alias("__b"))
    j = a.join(b, "title", "full_outer")
    differ = F.coalesce(F.col("__a").isNotNull() & F.col("__b").isNotNull() & ~U.same_site("__a", "__b"), F.lit(False))
    return j.select(
        "title", F.coalesce("__a", "__b").alias("url"),
        F.when(F.col("__a").isNotNull(), "infobox").otherwise("p856").alias("source"),
        differ.alias("disagreement"), F.when(differ, F.col("__b")).alias("other_url"),
    )


def rekey_titles(canonical: DataFrame, aliases: DataFrame, requested: DataFrame) -> DataFrame:
    """(title, key): the requested title behind a canonical one, back through normalisation and
    redirects; the canonical title when the chain does not end at a requested one.

    aliases(from, to, ord): the last ``from`` of a ``to`` wins. As many steps are taken as there are
    aliases, by pointer jumping: a table of jumps is joined with itself, which doubles its reach, until
    nothing moves. Chains of any length and cycles end after the logarithm of the aliases' number.
    """
    back = aliases.filter(F.col("from") != "").groupBy(F.col("to").alias("node")).agg(F.max_by("from", "ord").alias("prev"))
    jump = cut(back.filter("node is not null").select("node", F.col("prev").alias("goal")))
    steps = jump.count()
    walk = canonical.select("title").distinct().withColumn("at", F.col("title"))

    def apply(walk: DataFrame, jump: DataFrame) -> DataFrame:
        moves = jump.select(F.col("node").alias("at"), "goal")
        return walk.join(moves, "at", "left").select("title", F.coalesce("goal", "at").alias("at"))

    while steps:
        if steps & 1:
            walk = cut(apply(walk, jump))
        steps >>= 1
        if not steps:
            break
        further = jump.select(F.col("node").alias("goal"), F.col("goal").alias("beyond"))
        longer = cut(jump.join(further, "goal", "left").select("node", F.coalesce("beyond", "goal").alias("goal"), F.col("beyond").isNotNull().alias("moved")))
        still = longer.filter("moved").limit(1).count()
        jump = longer.drop("moved")
        if not still:  # every jump ends where its chain ends
            walk = apply(walk, jump)
            break
    wanted = requested.select(F.col("title").alias("at"), F.lit(True).alias("__asked")).distinct()
    return walk.join(wanted, "at", "left").select("title", F.when(F.col("__asked"), F.col("at")).otherwise(F.col("title")).alias("key"))
