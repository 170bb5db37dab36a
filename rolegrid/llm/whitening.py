"""Whitened embeddings: projections on the leading principal components, scaled to unit variance.

Vectors become integers (``vectors.integers``). Each distinct vector counts once in the fit: exact sums give the mean,
a second pass sums centred products per task, and ``feast`` finds the leading eigenpairs of that covariance. All
rows are then projected. What passes the driver is one sum and one covariance matrix, sized by the dimension alone.

Edge cases: rows whose vector is null or has null or non-finite components are dropped. The vectors' length is the one
most rows have (the longest of several); rows of another length keep their rows, with null deviation and whitened, and
are not in the fit. A component without variance (fewer distinct vectors than components, constant columns)
has null whitened and explained 0. A deviation that does not fit a long is null (``deviation_exact`` has it as text).
Repeated ids and vectors are rows like others. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolegrid.llm.feast import eigenpairs
from rolegrid.llm.shared import stash
from rolegrid.llm.vectors import dimension, integer_vectors, lists, matrix

COMPONENTS = 4
_ROWS = 4096
_LONG = 1 << 63


def _sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(dim, np.int64)
    for batch in batches:
        total += matrix(batch.column("x"), dim).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(total)], names=["at", "total"])


def moments(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(rows, exact sum per dimension)."""
    n = fit.count()
    rows = fit.mapInArrow(lambda b: _sums(b, dim), "at bigint, total bigint").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    return n, [int(r["total"]) for r in sorted(rows, key=lambda r: r["at"])]


def covariance(fit: DataFrame, mean: np.ndarray, n: int) -> np.ndarray:
    """Covariance with divisor n; vectors are centred before they are multiplied, products summed per task."""
    dim = len(mean)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                centred = matrix(batch.column("x").slice(at, _ROWS), dim) - mean
                total += centred.T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["cell", "v"])

    cells = fit.mapInArrow(products, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(dim * dim)
    out[cells["cell"].to_numpy()] = cells["v"].to_numpy()
    out = out.reshape(dim, dim) / n
    return (out + out.T) / 2


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sum over dimensions of (n x - S)^2 per vector."""
    reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if reach * reach * len(sums) < _LONG:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    return ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1).tolist()


def _projected(mean: np.ndarray, scaled: np.ndarray, n: int, sums: list[int]):
    """Rows (x, ...) with their whitened components and deviation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                x = matrix(part.column("x"), len(mean))
                exact = deviations(x, n, sums)
                columns = [*part.drop_columns(["x"]).columns, lists((x - mean) @ scaled), pa.array([d if d < _LONG else None for d in exact], pa.int64()), pa.array(map(str, exact), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*(c for c in part.schema.names if c != "x"), "whitened", "deviation", "deviation_exact"])

    return run


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact): one row per kept row
    of rows (vec_id, embedding) and component, components numbered from 1 by falling variance."""
    spark = rows.sparkSession
    held = integer_vectors(rows, "vec_id")
    dim = dimension(held)
    count = min(components, max(dim, 0))
    if dim <= 0:
        names = {"component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double", "deviation_exact": "string"}
        return held.where("false").select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in names.items()])
    held = stash(held, "vectors")
    usual = held.where(F.size("x") == dim)
    fit = stash(usual.select("x").distinct(), "distinct-vectors")
    n, sums = moments(fit, dim)
    mean = np.array([s / n for s in sums])
    cov = covariance(fit, mean, n)
    values, vectors = eigenpairs(spark, cov, count)
    trace = float(np.trace(cov))
    explained = [float(v) / trace for v in values] + [0.0] * (count - len(values))
    work = _projected(mean, vectors / np.sqrt(values), n, sums)
    out = T.StructType([T.StructField("vec_id", held.schema["vec_id"].dataType), T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType()), T.StructField("deviation_exact", T.StringType())])
    projected = usual.mapInArrow(work, out)
    other = held.where(F.size("x") != dim).select("vec_id", F.array().cast("array<double>").alias("whitened"), F.lit(None).cast("bigint").alias("deviation"), F.lit(None).cast("string").alias("deviation_exact"))
    error = identity_error(fit.mapInArrow(work, T.StructType(out.fields[1:])), len(values))
    places = F.explode(F.sequence(F.lit(1), F.lit(count))).alias("component")
    return projected.unionByName(other).select("vec_id", "deviation", "deviation_exact", "whitened", places).select(
        "vec_id", "component", F.lit(n).cast("bigint").alias("n"), "deviation", F.get("whitened", F.col("component") - 1).alias("whitened"),
        F.element_at(F.array(*[F.lit(e) for e in explained]), F.col("component")).alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact")


def identity_error(whitened: DataFrame, count: int) -> float:
    """Largest absolute entry of the covariance of the fit's whitened components minus the identity."""
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    if not pairs:
        return 0.0
    found = whitened.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))
