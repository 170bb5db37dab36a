"""Instants, durations and relative windows."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolegrid.functions.base import ColumnOrName, c

# The accepted spellings of an instant.
_DATE = r"\d{4}-\d{2}-\d{2}"
_FULL_ZONED = rf"^{_DATE}T\d{{2}}:\d{{2}}:\d{{2}}([.,]\d+)?(Z|[+-]\d{{2}}:\d{{2}})$"
_FULL_LOCAL = rf"^{_DATE}T\d{{2}}:\d{{2}}:\d{{2}}([.,]\d+)?$"
_MINUTE_LOCAL = rf"^{_DATE}T\d{{2}}:\d{{2}}$"
_DAY = rf"^{_DATE}$"


def parse_instant(raw: ColumnOrName) -> Column:
    """Timestamp from one of the accepted layouts, zone-less text read as UTC; NULL otherwise."""
    t = F.translate(F.trim(c(raw)), ",", ".")
    zoned = (
        F.when(t.rlike(_FULL_ZONED), t)
        .when(t.rlike(_FULL_LOCAL), F.concat(t, F.lit("Z")))
        .when(t.rlike(_MINUTE_LOCAL), F.concat(t, F.lit(":00Z")))
        .when(t.rlike(_DAY), F.concat(t, F.lit("T00:00:00Z")))
    )
    return zoned.try_cast("timestamp")


def duration_seconds(start: ColumnOrName, finish: ColumnOrName) -> Column:
    """Seconds between two instants; NULL while either is missing."""
    return (F.unix_micros(c(finish)) - F.unix_micros(c(start))) / F.lit(1e6)


def rfc3339(ts: ColumnOrName) -> Column:
    """UTC text with seconds."""
    return F.date_format(F.to_utc_timestamp(c(ts), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def parse_window(value: str | None, default: str = "24h", now: datetime | None = None) -> timedelta:
    """``90m``, ``2h``, ``7d``, ``1w`` or an ISO instant meaning "since then"; argument parsing only."""
    given = (value or default).strip()
    simple = re.fullmatch(r"(\d+)\s*([smhdw])", given)
    if simple:
        return timedelta(seconds=int(simple[1]) * _UNITS[simple[2]])
    try:
        instant = datetime.fromisoformat(given.replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"bad window {value!r}: use 90m, 2h, 7d, 1w or an ISO 8601 instant") from None
    if instant.tzinfo is None:
        instant = instant.replace(tzinfo=timezone.utc)
    span = (now or datetime.now(timezone.utc)) - instant
    return max(span, timedelta(seconds=1)) if span > timedelta(0) else timedelta(seconds=1)


def window_start(window: str | None, now: ColumnOrName, default: str = "24h") -> Column:
    """The instant a relative window opens."""
    seconds = int(parse_window(window, default).total_seconds())
    return F.timestamp_micros(F.unix_micros(c(now)) - F.lit(seconds * 1_000_000))
