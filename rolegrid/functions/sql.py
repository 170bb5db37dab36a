"""SQL surface: session functions for ad-hoc queries.

``register`` defines temporary SQL functions with the semantics of the Column expressions, and one
table function for page links. Jobs use the expressions; this is for people at a prompt.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from rolegrid.functions import text, urls

def _normalise_sql() -> str:
    """URL normalisation as one SQL expression over x."""
    part = lambda i: f"regexp_extract(trim(x), r'{urls._SHAPE}', {i})"
    safe = urls._PATH_SAFE.replace("'", "\\x27")
    form = lambda e: f"replace(replace(url_encode({e}), '*', '%2A'), '%7E', '~')"
    names = ", ".join(repr(n) for n in urls.vocab.TRACKING_PARAMS)
    decoded = (
        f"filter(transform(filter(split(substring({part(4)}, 2), '&'), p -> p <> '' AND NOT contains(p, ';')), (p, i) -> struct("
        "try_url_decode(substring_index(p, '=', 1)) AS k, i AS i, try_url_decode(IF(contains(p, '='), regexp_replace(p, '^[^=]*=', ''), '')) AS v)), "
        f"s -> s.k IS NOT NULL AND s.v IS NOT NULL AND NOT (lower(s.k) IN ({names}) OR startswith(lower(s.k), 'utm_') OR startswith(lower(s.k), 'mc_')))"
    )
    query = f"array_join(transform(array_sort({decoded}), s -> concat({form('s.k')}, '=', {form('s.v')})), '&')"
    path = (
        f"array_join(transform(split({part(3)}, ''), ch -> CASE WHEN ch = '' OR ch RLIKE r'{safe}' THEN ch WHEN ch = ' ' THEN '%20' ELSE url_encode(ch) END), '')"
    )
    valid = f"trim(x) RLIKE r'{urls._HTTP}' AND NOT trim(x) RLIKE r'{urls._BAD_ESCAPE}'"
    return (
        f"CASE WHEN {valid} THEN concat(lower({part(1)}), '://', {part(2)}, {path}, "
        f"CASE WHEN length({part(4)}) <= 1 THEN {part(4)} WHEN {query} = '' THEN '' ELSE concat('?', {query}) END) ELSE x END"
    )


def register(spark: SparkSession) -> list[str]:
    """Define the session functions; returns their names."""
    from rolegrid.functions.udtf import PageLinks

    spark.udtf.register("rg_page_links", PageLinks)
    statements = {
        "rg_slugify": "regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-'), '^-|-$', '')",
        "rg_distinctive_token": (
            "coalesce(lower(aggregate(filter(split(regexp_replace(x, '[^A-Za-z0-9]+', ' '), ' '), w -> length(w) >= 3 AND NOT array_contains("
            f"array({', '.join(repr(w) for w in text.vocab.CORPORATE_STOP_WORDS)}), lower(w))), '', (a, w) -> IF(length(w) > length(a), w, a))), '')"
        ),
        "rg_parse_instant": (
            "CASE WHEN trim(x) RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$' THEN try_cast(trim(x) AS TIMESTAMP) "
            "WHEN trim(x) RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?$' THEN try_cast(concat(trim(x), 'Z') AS TIMESTAMP) "
            "WHEN trim(x) RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}$' THEN try_cast(concat(trim(x), ':00Z') AS TIMESTAMP) "
            "WHEN trim(x) RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' THEN try_cast(concat(trim(x), 'T00:00:00Z') AS TIMESTAMP) END"
        ),
    }
    statements["rg_normalise_url"] = _normalise_sql()
    kinds = {"rg_parse_instant": "TIMESTAMP"}
    for name, body in statements.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kinds.get(name, 'STRING')} RETURN {body}")
    return [*statements, "rg_page_links"]
