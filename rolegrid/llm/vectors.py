"""Embedding rows as integer vectors, for the operators on vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components become floor(SCALE * x).
SCALE = 256
#: Largest size of an integer component: squared distances over 32 of them fit a long.
LARGEST = 1 << 27


def integers(vector: str = "embedding") -> Column:
    """The vector with each component as floor(256 * x), counted in double precision. A component beyond
    LARGEST is an error, as no exact squared distance in a long is possible."""

    def one(x: Column) -> Column:
        scaled = x.cast("double") * SCALE
        return F.when(F.abs(scaled) <= LARGEST, F.floor(scaled)).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("bigint"))

    return F.transform(F.col(vector), one)


def usable(vector: str = "embedding") -> Column:
    """Whether a vector is there and has no null or non-finite component."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))


def integer_vectors(rows: DataFrame, *carry: str, vector: str = "embedding") -> DataFrame:
    """(carry..., x) of the usable rows."""
    return rows.where(usable(vector)).select(*[F.col(f"`{c}`") for c in carry], integers(vector).alias("x"))


def dimension(vectors: DataFrame) -> int:
    """The length that most vectors have, the longest of several; -1 without rows."""
    sizes = vectors.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return top[0]["size"] if top else -1


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """A list column whose lists all have ``width`` values as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def lists(values: np.ndarray) -> pa.ListArray:
    """A matrix as a list column."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.ravel()))
