"""Small helpers every expression module uses."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def c(value: ColumnOrName) -> Column:
    """A column from a name or a column."""
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row.

    A Column used twice is an expression evaluated twice; binding it to a lambda variable keeps a
    costly part (a JSON parse, a lowered page) single however often the body mentions it.
    """
    return F.transform(F.array(value), body)[0]


def blank_to_null(value: ColumnOrName) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.trim(c(value)), F.lit(""))


def first_marker(text: Column, markers: Iterable[str]) -> Column:
    """The first marker (in list order) that occurs in already-lowered text, else NULL."""
    return F.coalesce(*[F.when(text.contains(m), F.lit(m)) for m in markers])


def contains_any(text: Column, markers: Iterable[str]) -> Column:
    """True when already-lowered text holds any of the markers: plain substring searches over one
    bound value, which beat a regular-expression alternation on long pages."""
    return let(text, lambda t: reduce(lambda x, y: x | y, [t.contains(m) for m in markers]))


def map_lookup(key: Column, mapping: Mapping) -> Column:
    """Literal-map lookup, NULL when the key is not there."""
    entries = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*entries), key)


def squeeze(text: ColumnOrName) -> Column:
    """Whitespace runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(c(text), r"\s+", " "))


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """df with the columns of a one-row result on every row, as a scalar subquery (no join)."""
    packed = row.select(F.struct(*row.columns)).scalar()
    wide = df.withColumn("__row", packed)
    return wide.select(*df.columns, *[F.col("__row")[name].alias(name) for name in row.columns])
