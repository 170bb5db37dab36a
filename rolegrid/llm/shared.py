"""Shared folder for intermediate tables, and small helpers of the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrid.session import checkpoint_dir

# Bytes that count as space in the contracts: blank and \t \n \v \f \r.
SPACE = b" \t\n\x0b\x0c\r"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df once into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no live plan reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def narrow(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns never clash or travel."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of bounded length."""
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part), schema)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part), schema)], schema=schema)
