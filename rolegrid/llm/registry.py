"""Registered queries of the operators, each with the SQL that must agree where SQL can say it."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from rolegrid.llm.shared import new_path
from rolegrid.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, for launches that do not put it on their path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    jvm = context._jvm
    target = jvm.org.apache.hadoop.fs.Path(new_path(spark, "package") + "/rolegrid.zip")
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(target.toString())
    _shipped.add(context.applicationId)


def register(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register fn(read) -> DataFrame, where read(table name) gives a driver table."""

    def add(fn: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship(spark)
            return fn(lambda t: table(spark, sf_dir, t))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
