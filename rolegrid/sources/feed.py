"""Feed captures: array scan, element normalisation, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.functions.base import attach_row, let
from rolegrid.sources.arrays import BLOCK, split_arrays

# Element fields that must be text when present.
TEXT_FIELDS = ["slug", "company", "position", "description", "location", "url", "apply_url", "company_logo", "date"]


def scan_feed(captures: DataFrame, body: str = "body", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(elements, rejects). Each array element comes out as its own text with its index, uninspected;
    a JSON null is an empty feed; anything but a valid array is a reject. A body larger than ``block``
    bytes is scanned by many tasks."""
    elements, rest = split_arrays(captures, body, block)
    blank = F.regexp_replace(F.coalesce(F.col(body), F.lit("")), r"^\s+|\s+$", "")
    return elements, rest.filter(blank != "null").select(*captures.columns)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _element_id(v: Column, raw: Column) -> Column:
    """The id as written: a non-empty string, or the literal text of a number; NULL otherwise."""
    f = _field(v, "id")
    number_text = F.regexp_extract(raw, r'"id"\s*:\s*(-?[0-9][0-9.eE+\-]*)', 1)
    return (
        F.when(_kind(f) == "STRING", F.nullif(F.try_variant_get(f, "$", "string"), F.lit("")))
        .when(_kind(f) == "BIGINT", F.try_variant_get(f, "$", "string"))
        .when(_kind(f).startswith("DECIMAL") | (_kind(f) == "DOUBLE"), F.nullif(number_text, F.lit("")))
    )


def _present(v: Column, name: str) -> Column:
    return _field(v, name).isNotNull()


def _decodes(v: Column) -> Column:
    """Every typed field is absent, null or of its type."""
    ok = F.lit(True)
    for name in TEXT_FIELDS:
        ok = ok & _kind(_field(v, name)).isin("VOID", "STRING")
    ok = ok & _kind(_field(v, "epoch")).isin("VOID", "BIGINT")
    tags = _field(v, "tags")
    return ok & (_kind(tags).isin("VOID", "ARRAY<VOID>", "ARRAY<STRING>"))


def _cents(v: Column, name: str) -> Column:
    f = _field(v, name)
    return F.when(_kind(f) == "BIGINT", F.nullif(F.try_variant_get(f, "$", "bigint"), F.lit(0)) * 100)


def _bad_salary(v: Column, name: str) -> Column:
    return ~_kind(_field(v, name)).isin("VOID", "BIGINT")


def _read_element(el: Column) -> Column:
    v, raw = el["v"], el["raw"]
    eid = _element_id(v, raw)
    is_object = _kind(v).startswith("OBJECT")
    is_notice = ~_present(v, "position") & ~_present(v, "company")
    text = lambda n: F.try_variant_get(_field(v, n), "$", "string")
    reason = (
        F.when(~is_object & (_kind(v) != "VOID") | v.isNull(), "unmarshal_failed")
        .when(eid.isNull() & is_notice, "notice")
        .when(eid.isNull(), "missing_id")
        .when(~_decodes(v), "unmarshal_failed")
        .when(_bad_salary(v, "salary_min"), "salary_min_not_integer")
        .when(_bad_salary(v, "salary_max"), "salary_max_not_integer")
    )
    epoch = F.coalesce(F.try_variant_get(_field(v, "epoch"), "$", "bigint"), F.lit(0))
    tags = F.coalesce(F.try_variant_get(_field(v, "tags"), "$", "array<string>"), F.array().cast("array<string>"))
    return F.struct(
        F.when(is_object, eid).alias("external_id"), reason.alias("reason"),
        F.coalesce(text("company"), F.lit("")).alias("company_name"), F.coalesce(text("position"), F.lit("")).alias("title"),
        F.coalesce(text("url"), F.lit("")).alias("listing_url"), F.coalesce(text("apply_url"), F.lit("")).alias("application_url"),
        F.coalesce(text("description"), F.lit("")).alias("description"),
        F.nullif(text("location"), F.lit("")).alias("location_text"),
        _cents(v, "salary_min").alias("salary_min_cents"), _cents(v, "salary_max").alias("salary_max_cents"),
        tags.alias("tags"), F.timestamp_seconds(epoch).alias("posted_at"), raw.alias("raw_data"),
    )


def normalise_feed(elements: DataFrame, element: str = "element") -> DataFrame:
    """Every element with its fields and ``reason``: NULL = accepted, ``notice`` = dropped silently,
    anything else = skipped for that reason. ``external_id`` is there whenever the element could be
    identified, also when it is skipped."""
    raw = F.col(element)
    read = let(F.struct(F.try_parse_json(raw).alias("v"), raw.alias("raw")), _read_element)
    others = [x for x in elements.columns if x != element]
    return elements.withColumn("__e", read).select(*others, "__e.*")


def feed_jobs(normalised: DataFrame) -> DataFrame:
    """Accepted postings; a feed of a remote-only board marks every one as remote."""
    return normalised.filter(F.col("reason").isNull()).drop("reason").withColumn("is_remote", F.lit(True))


def feed_seen(normalised: DataFrame) -> DataFrame:
    """Identifiers observed, decoded or not: a bad row is "not updated", never "gone"."""
    return normalised.filter(F.col("external_id").isNotNull()).select("external_id").distinct()


def feed_skips(normalised: DataFrame) -> DataFrame:
    return normalised.filter(F.col("reason").isNotNull() & (F.col("reason") != "notice"))


def feed_profile(elements: DataFrame, element: str = "element") -> DataFrame:
    """Per key: presence, JSON type, empty or zero values, shortest and longest text."""
    pairs = elements.select(F.explode(F.from_json(F.col(element), "map<string,string>")).alias("key", "value"), F.try_parse_json(element).alias("v"))
    typed = pairs.withColumn("type", _kind(F.try_element_at(F.try_variant_get("v", "$", "map<string,variant>"), F.col("key"))))
    return typed.groupBy("key", F.regexp_extract("type", "^[A-Z]+", 0).alias("type")).agg(
        F.count("*").alias("present"), F.count_if(F.coalesce(F.col("value"), F.lit("")).isin("", "0", "[]")).alias("empty"),
        F.min(F.length("value")).cast("bigint").alias("min_len"), F.max(F.length("value")).cast("bigint").alias("max_len"),
    )


def tag_profile(jobs: DataFrame, tags: str = "tags") -> DataFrame:
    """tags per job (one row): jobs, min, max, total tags, distinct tags, and jobs without tags."""
    per_job = jobs.agg(
        F.count("*").alias("jobs"), F.min(F.size(tags)).cast("bigint").alias("min_tags"), F.max(F.size(tags)).cast("bigint").alias("max_tags"),
        F.sum(F.size(tags)).cast("bigint").alias("total_tags"), F.count_if(F.size(tags) == 0).alias("untagged"),
    )
    distinct = jobs.select(F.explode(tags).alias("t")).agg(F.countDistinct("t").alias("distinct_tags"))
    return attach_row(per_job, distinct)


def tag_histogram(jobs: DataFrame, tags: str = "tags") -> DataFrame:
    return jobs.groupBy(F.size(tags).cast("bigint").alias("tags")).agg(F.count("*").alias("jobs"))


def top_tags(jobs: DataFrame, k: int = 20, tags: str = "tags") -> DataFrame:
    counts = jobs.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "tag").limit(k)
