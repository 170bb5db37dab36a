"""Ordered scans (running sums, previous row, islands) that survive a hot key.

A plain window puts every row of its partition key into one task. These scans cut each key's order
into buckets, scan inside (key, bucket), and carry one pre-aggregated row per bucket across to the
next. No task ever holds more than one bucket of one key plus the list of bucket totals.

``by`` must never fall while ``order`` rises: the scans take the buckets in their own order. Derive it
from the first order column (``bucket``, ``time_bucket``), never from another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WIDTH = 100_000
_B = "__bucket"


def bucket(order: str | Column, width: float = DEFAULT_WIDTH) -> Column:
    """Bucket of a numeric order column."""
    col = F.col(order) if isinstance(order, str) else order
    return F.floor(col / F.lit(width)).cast("bigint")


def time_bucket(ts: str | Column, unit: str = "hour") -> Column:
    """Bucket of a time order column."""
    return F.date_trunc(unit, F.col(ts) if isinstance(ts, str) else ts)


def join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on null-safe keys, keeping the left key columns."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, cond, "left").drop(*[f"__r_{k}" for k in keys])


def running_sum(
    df: DataFrame, keys: list[str], order: list[str | Column], by: Column, sums: dict[str, Column]
) -> DataFrame:
    """Adds inclusive running totals ``{name: expr}`` per key. ``by`` is the order's bucket."""
    base = df.withColumns({_B: by, **{f"__v_{n}": e.cast("bigint") for n, e in sums.items()}})
    inside = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns({f"__l_{n}": F.sum(f"__v_{n}").over(inside) for n in sums})
    totals = base.groupBy(*keys, _B).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, _B, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    joined = join_on(local, offsets, [*keys, _B])
    out = joined.withColumns({n: (F.col(f"__l_{n}") + F.col(f"__o_{n}")).cast("bigint") for n in sums})
    return out.drop(_B, *[f"__{p}_{n}" for n in sums for p in "vlo"])


def previous(df: DataFrame, keys: list[str], order: list[str], by: Column, values: list[str], prefix: str = "prev_") -> DataFrame:
    """Adds the previous row's values per key as ``prev_<name>`` (NULL on a key's first row)."""
    base = df.withColumn(_B, by)
    row = F.struct(*values)
    inside = Window.partitionBy(*keys, _B).orderBy(*order)
    local = base.withColumn("__p", F.lag(row).over(inside))
    lasts = base.groupBy(*keys, _B).agg(F.max_by(row, F.struct(*order)).alias("__last"))
    carried = lasts.select(*keys, _B, F.lag("__last").over(Window.partitionBy(*keys).orderBy(_B)).alias("__carry"))
    joined = join_on(local, carried, [*keys, _B])
    prev = F.coalesce(F.col("__p"), F.col("__carry"))
    return joined.withColumns({f"{prefix}{v}": prev[v] for v in values}).drop(_B, "__p", "__carry")


def number_rows(df: DataFrame, keys: list[str], order: list[str | Column], by: Column, name: str = "rn") -> DataFrame:
    """row_number per key as a running count."""
    return running_sum(df, keys, order, by, {name: F.lit(1)})
