"""Presentation columns: labels, durations, money and report lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolegrid import vocab
from rolegrid.functions.base import ColumnOrName, c, map_lookup

DASH = "—"
EN_DASH = "–"


def utc_text(iso: ColumnOrName) -> Column:
    """``yyyy-mm-dd hh:mm:ss`` of an RFC 3339 text; a dash when empty, the input when it is neither."""
    t = c(iso)
    hit = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})", 1)
    clock = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})", 2)
    return F.when(t.isNull() | (t == ""), F.lit(DASH)).when(hit != "", F.concat(hit, F.lit(" "), clock)).otherwise(t)


def humanize(token: ColumnOrName) -> Column:
    """snake_case to words; known acronyms in capitals."""
    words = F.transform(
        F.split(F.coalesce(c(token), F.lit("")), "_"),
        lambda w: F.when(F.lower(w).isin(vocab.ACRONYMS), F.upper(w)).otherwise(
            F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))
        ),
    )
    return F.array_join(words, " ")


def run_status(status: ColumnOrName) -> Column:
    s = F.nullif(c(status), F.lit(""))
    capital = F.concat(F.upper(F.left(s, F.lit(1))), F.substring(s, 2, 1 << 30))
    return F.coalesce(map_lookup(s, vocab.RUN_STATUS_LABELS), capital, F.lit("Unknown"))


def verdict(value: ColumnOrName) -> Column:
    return F.coalesce(map_lookup(c(value), vocab.VERDICT_LABELS), F.lit("Not validated"))


def job_status(status: ColumnOrName) -> Column:
    s = F.nullif(c(status), F.lit(""))
    return F.coalesce(map_lookup(s, vocab.JOB_STATUS_LABELS), F.when(s.isNotNull(), humanize(s)), F.lit("Unknown"))


def attempt_status(status: ColumnOrName) -> Column:
    s = F.nullif(c(status), F.lit(""))
    return F.coalesce(map_lookup(s, vocab.ATTEMPT_STATUS_LABELS), F.when(s.isNotNull(), humanize(s)), F.lit("Unknown"))


def membership(value: ColumnOrName) -> Column:
    return F.coalesce(map_lookup(c(value), vocab.MEMBERSHIP_LABELS), c(value), F.lit(""))


def attempt_count(n: ColumnOrName) -> Column:
    k = F.coalesce(c(n), F.lit(0))
    return F.when(k == 1, F.lit("1 attempt")).otherwise(F.concat(k.cast("string"), F.lit(" attempts")))


def duration_text(start: ColumnOrName, finish: ColumnOrName) -> Column:
    """``1h 2m 3s``; '' while unfinished or when the clock ran backwards."""
    micros = F.unix_micros(c(finish)) - F.unix_micros(c(start))
    total = F.floor(micros / 1_000_000 + 0.5).cast("bigint")
    s, m, h = total % 60, F.floor(total / 60) % 60, F.floor(total / 3600)
    return (
        F.when(micros.isNull() | (micros < 0), F.lit(""))
        .when(h > 0, F.format_string("%dh %dm %ds", h, m, s))
        .when(m > 0, F.format_string("%dm %ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )


def cents_text(cents: ColumnOrName) -> Column:
    """Grouped amount; the fraction only when there is one. NULL stays NULL."""
    n = F.abs(c(cents))
    whole = F.format_number(F.floor(n / 100).cast("bigint"), 0)
    fraction = F.when(n % 100 == 0, F.lit("")).otherwise(F.format_string(".%02d", n % 100))
    return F.concat(F.when(c(cents) < 0, F.lit("-")).otherwise(""), whole, fraction)


def salary_text(low: ColumnOrName, high: ColumnOrName, currency: ColumnOrName, period: ColumnOrName) -> Column:
    cur = F.nullif(c(currency), F.lit(""))
    symbol = F.coalesce(map_lookup(cur, vocab.CURRENCY_SYMBOLS), F.concat(cur, F.lit(" ")), F.lit(""))
    a, b = F.concat(symbol, cents_text(low)), F.concat(symbol, cents_text(high))
    body = (
        F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, a).otherwise(F.concat(a, F.lit(EN_DASH), b)))
        .when(a.isNotNull(), F.concat(F.lit("from "), a))
        .when(b.isNotNull(), F.concat(F.lit("up to "), b))
    )
    per = F.nullif(c(period), F.lit(""))
    tail = F.coalesce(F.concat(F.lit(" / "), F.coalesce(map_lookup(per, vocab.PERIOD_SHORT), per)), F.lit(""))
    return F.coalesce(F.concat(body, tail), F.lit(""))


def location_text(text: ColumnOrName, country: ColumnOrName, is_remote: ColumnOrName) -> Column:
    """Published text, else country, else Remote."""
    blank = F.lit("")
    return F.coalesce(F.nullif(c(text), blank), F.nullif(c(country), blank), F.when(c(is_remote), F.lit("Remote")), blank)


def action_text(action: ColumnOrName) -> Column:
    """One trace action (a one-key object, as variant) as ``name url``, ``name text`` or ``name value``."""
    a = c(action)
    keys = F.json_object_keys(F.to_json(a))
    name = keys[0]
    body = F.try_element_at(F.try_variant_get(a, "$", "map<string,variant>"), name)
    kind = F.schema_of_variant(body)
    pick = lambda k: F.nullif(F.try_variant_get(body, f"$.{k}", "string"), F.lit(""))
    detail = F.when(kind.startswith("OBJECT"), F.coalesce(pick("url"), pick("href"), pick("text")))
    scalar = ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY")
    one_key = F.coalesce(F.size(keys), F.lit(0)) == 1
    return (
        F.when(a.isNull() | F.is_variant_null(a), F.lit(""))
        .when(one_key & F.coalesce(F.is_variant_null(body), F.lit(True)), name)
        .when(one_key & detail.isNotNull(), F.concat_ws(" ", name, detail))
        .when(one_key & scalar, F.concat_ws(" ", name, F.try_variant_get(body, "$", "string")))
        .when(~F.schema_of_variant(a).startswith("OBJECT") & ~F.schema_of_variant(a).startswith("ARRAY"), F.try_variant_get(a, "$", "string"))
        .otherwise(F.to_json(a))
    )


def report_line(pairs: list[tuple[str, ColumnOrName]]) -> Column:
    """``k=v k=v`` line; booleans as 1 and 0, NULL as '-'."""
    return F.concat_ws(
        " ", *[F.concat(F.lit(f"{k}="), F.coalesce(c(v).cast("string"), F.lit("-"))) for k, v in pairs]
    )
