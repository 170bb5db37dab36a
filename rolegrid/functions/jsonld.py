"""Structured posting JSON: picking it out of a page, reading it, placing it on the map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolegrid import vocab
from rolegrid.functions import text as T
from rolegrid.functions.base import ColumnOrName, c, let, map_lookup, squeeze
from rolegrid.functions.times import parse_instant

_LD_SCRIPT = r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def as_list(v: Column) -> Column:
    """Variant scalar-or-array as array<variant>; missing and JSON null are empty."""
    return (
        F.when(v.isNull() | F.is_variant_null(v), F.array().cast("array<variant>"))
        .when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
        .otherwise(F.array(v))
    )


def first_string(v: Column) -> Column:
    """Trimmed text of a string, or the first non-blank element of an array made of strings only;
    '' otherwise."""
    return let(v, _first_string)


def _first_string(v: Column) -> Column:
    items = as_list(v)
    only_text = F.forall(items, lambda x: F.is_variant_null(x) | _is(x, "STRING"))
    texts = F.filter(F.transform(items, lambda x: F.trim(F.try_variant_get(x, "$", "string"))), lambda s: s != "")
    picked = F.when(_is(v, "STRING"), F.trim(F.try_variant_get(v, "$", "string"))).when(
        only_text, F.try_element_at(texts, F.lit(1))
    )
    return F.coalesce(picked, F.lit(""))


def employment_type(raw: ColumnOrName) -> Column:
    key = F.translate(F.upper(F.trim(c(raw))), "- ", "__")
    return map_lookup(key, vocab.EMPLOYMENT_TYPE_MAP)


POSTING_PARTS = ("is_posting", "remote", "employment_type", "posted_at", "valid_through")


def parse_posting(raw: ColumnOrName, parts: Sequence[str] = POSTING_PARTS) -> Column:
    """struct(is_posting, remote, employment_type, posted_at, valid_through), or the named parts of it, of a posting JSON text.

    ``remote`` is true or NULL, never false: absence of the marker says nothing. Text that opens no object is not handed
    to a JSON parser: each failure there is an exception, dearer than a parse.
    """
    text = F.when(c(raw).rlike(r"^\s*\{"), c(raw))
    read = F.struct(text.alias("text"), F.from_json(text, _POSTING_FIELDS).alias("f"), F.try_parse_json(text).isNotNull().alias("valid"))
    return let(read, lambda p: let(F.struct(_is_posting(p).alias("ok"), p["f"].alias("f")), lambda q: _read_posting(q, parts)))


# The fields that are read.
_POSTING_FIELDS = "`@type` string, jobLocationType string, employmentType string, datePosted string, validThrough string"


def _scalar_or_first(text: Column) -> Column:
    """Text of a field read as string. An array arrives as its JSON text and gives its first non-blank
    element, provided it holds strings only."""
    return F.when(text.startswith("["), first_string(F.try_parse_json(text))).otherwise(F.trim(F.coalesce(text, F.lit(""))))


def _is_posting(p: Column) -> Column:
    typed = F.lower(_scalar_or_first(p["f"]["@type"])) == "jobposting"
    marked = F.arrays_overlap(F.json_object_keys(p["text"]), F.array(*[F.lit(k) for k in vocab.POSTING_MARKER_KEYS]))
    return F.coalesce(p["valid"] & (typed | marked), F.lit(False))


def _read_posting(q: Column, parts: Sequence[str]) -> Column:
    def kept(name: str) -> Column:
        return F.when(q["ok"], _scalar_or_first(q["f"][name]))

    made = {
        "is_posting": lambda: q["ok"],
        "remote": lambda: F.when(kept("jobLocationType") == "TELECOMMUTE", F.lit(True)),
        "employment_type": lambda: employment_type(kept("employmentType")),
        "posted_at": lambda: let(kept("datePosted"), parse_instant),
        "valid_through": lambda: let(kept("validThrough"), parse_instant),
    }
    return F.struct(*[made[name]().alias(name) for name in parts])


def country_code(name: ColumnOrName) -> Column:
    """Two-letter code of a country name or code; '' when not recognised."""
    t = F.trim(c(name))
    return F.when(F.upper(t).rlike("^[A-Z]{2}$"), F.upper(t)).otherwise(
        F.coalesce(map_lookup(F.lower(t), vocab.COUNTRY_CODES), F.lit(""))
    )


def _place_text(v: Column) -> Column:
    """Text of a field that is a string or an object with a name; '' otherwise."""
    inner = F.when(_is(v, "OBJECT"), field(v, "$.name")).otherwise(v)
    return F.coalesce(F.trim(F.try_variant_get(inner, "$", "string")), F.lit(""))


def classify_location(raw: ColumnOrName) -> Column:
    """struct(country, is_us, location_text) from location requirements and job addresses.

    US wins; a single other country is named; several stay NULL. ``is_us`` is NULL when no country
    was recognised.
    """
    return let(F.try_parse_json(c(raw)), _place_posting)


def _place_posting(v: Column) -> Column:
    objects = lambda path: F.filter(as_list(field(v, path)), lambda x: _is(x, "OBJECT"))
    required = F.filter(
        F.transform(objects("$.applicantLocationRequirements"), lambda r: _place_text(field(r, "$.name"))),
        lambda s: s != "",
    )
    addresses = F.transform(
        objects("$.jobLocation"),
        lambda loc: F.struct(
            _place_text(field(loc, "$.address.addressCountry")).alias("country"),
            _place_text(field(loc, "$.address.addressRegion")).alias("region"),
            _place_text(field(loc, "$.address.addressLocality")).alias("locality"),
        ),
    )
    named = F.concat(required, F.transform(addresses, lambda a: a["country"]))
    countries = F.filter(F.transform(named, country_code), lambda s: s != "")
    address_parts = F.flatten(F.transform(addresses, lambda a: F.array(a["country"], a["region"], a["locality"])))
    parts = F.array_distinct(F.filter(F.concat(required, address_parts), lambda s: s != ""))


    def decide(seen: Column) -> Column:
        us = F.array_contains(seen["countries"], "US")
        return F.struct(
            F.when(us, F.lit("US")).when(F.size(seen["countries"]) == 1, F.try_element_at(seen["countries"], F.lit(1))).alias("country"),
            F.when(F.size(seen["countries"]) > 0, us).alias("is_us"),
            F.nullif(F.array_join(seen["parts"], ", "), F.lit("")).alias("location_text"),
        )

    return let(F.struct(countries.alias("countries"), parts.alias("parts")), decide)


def pick_posting(html: ColumnOrName) -> Column:
    """The first ld+json item of a page that is a posting or carries a description, as JSON text."""
    scripts = F.regexp_extract_all(c(html), F.lit(_LD_SCRIPT), F.lit(1))
    items = F.flatten(F.transform(scripts, lambda s: as_list(F.try_parse_json(s))))
    wanted = F.filter(
        items,
        lambda x: _is(x, "OBJECT")
        & (
            F.coalesce(F.try_variant_get(field(x, "$['@type']"), "$", "string") == "JobPosting", F.lit(False))
            | field(x, "$.description").isNotNull()
        ),
    )
    return F.to_json(F.try_element_at(wanted, F.lit(1)))


def strip_tags(html: ColumnOrName) -> Column:
    """Readable text: scripts and styles out, tags to spaces, whitespace collapsed."""
    t = F.regexp_replace(c(html), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]+>", " "), "&nbsp;", " ")
    return squeeze(t)


def posting_record(html: ColumnOrName, link_title: ColumnOrName, max_bytes: int | None = None) -> Column:
    """struct(raw_data, title, description, country, is_us, location_text) of a posting page; the
    description is whole, or cut at ``max_bytes``."""
    return let(
        F.struct(pick_posting(html).alias("raw"), c(html).alias("html"), c(link_title).alias("title")),
        lambda page: _posting_fields(page["raw"], page["html"], page["title"], max_bytes),
    )


def _posting_fields(raw: Column, html: Column, link_title: Column, max_bytes: int | None) -> Column:
    v = F.try_parse_json(raw)
    own_title = F.nullif(F.try_variant_get(field(v, "$.title"), "$", "string"), F.lit(""))
    described = strip_tags(F.coalesce(F.try_variant_get(field(v, "$.description"), "$", "string"), F.lit("")))
    place = classify_location(raw)
    text = F.when(raw.isNotNull(), described).otherwise(strip_tags(html))
    return F.struct(
        raw.alias("raw_data"),
        F.coalesce(own_title, link_title).alias("title"),
        (text if max_bytes is None else T.truncate_bytes(text, max_bytes, "")).alias("description"),
        place["country"].alias("country"),
        place["is_us"].alias("is_us"),
        place["location_text"].alias("location_text"),
    )
