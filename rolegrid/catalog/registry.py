"""Registered queries: a Spark callable and, where SQL can say it, the SQL that must agree."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolegrid.catalog.domain import DERIVED
from rolegrid.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SPARK = [
    (r"EP\[([^\[\]]*)\]", r"unix_micros(\1)"),
    (r"TSU\[([^\[\]]*)\]", r"timestamp_micros(CAST(\1 AS BIGINT))"),
]
_DUCK = [
    (r"EP\[([^\[\]]*)\]", r"epoch_us(\1)"),
    (r"TSU\[([^\[\]]*)\]", r"make_timestamp(CAST(\1 AS BIGINT))"),
]


def _expand(text: str, rules: list[tuple[str, str]]) -> str:
    before = None
    while before != text:
        before = text
        for pattern, repl in rules:
            text = re.sub(pattern, repl, text)
    return text


class Tables:
    """``t.orders`` is a driver table, ``t.companies`` one derived from it."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in DERIVED:
            source, columns = DERIVED[name]
            exprs = [_expand(f"{expr} AS {alias}", _SPARK) for alias, expr in columns.items()]
            return table(self.spark, self.sf_dir, source).selectExpr(*exprs)
        return table(self.spark, self.sf_dir, name)


def cte(name: str) -> str:
    """The derived table as a DuckDB common table expression."""
    source, columns = DERIVED[name]
    select = ", ".join(f"{_expand(expr, _DUCK)} AS {alias}" for alias, expr in columns.items())
    return f"{name} AS (SELECT {select} FROM {source})"


def duck(sql: str) -> str:
    """Oracle SQL with the derived tables it mentions put in front."""
    body = _expand(sql.strip(), _DUCK)
    used = [n for n in DERIVED if re.search(rf"\b{n}\b", body)]
    if not used:
        return body
    head = ", ".join(cte(n) for n in used)
    if re.match(r"(?i)with\s", body):
        return f"WITH {head}, {body[4:].lstrip()}"
    return f"WITH {head} {body}"


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register ``fn(tables) -> DataFrame`` under a name, with the SQL that must give the same rows."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = duck(sql)
        return fn

    return add
