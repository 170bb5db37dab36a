"""Session defaults and table access."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "rolegrid") -> SparkSession:
    """A session for tests and the bench. On a cluster the submitter's settings rule."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Zone-less timestamps are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


# Folders made for single-machine sessions without the setting, by application.
_own_folders: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a single-machine session (tests, the bench)
    gets a fresh folder where nothing is set; anywhere else a missing setting is an error, as a folder
    of one machine is not seen by the others.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = current.get() if current.isDefined() else None
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor sees")
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="spark-ckpt-")
        configured = _own_folders[app]
    return configured.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written once as Parquet into the shared folder and read back: lineage ends there, a lost
    executor costs nothing, and later steps read only the columns they need."""
    path = f"{checkpoint_dir(df.sparkSession)}/cut/{uuid.uuid4().hex}"
    kept = df.withColumns({f.name: F.col(f"`{f.name}`").cast("string") for f in df.schema.fields if isinstance(f.dataType, T.NullType)})
    kept.write.parquet(path)
    return df.sparkSession.read.schema(kept.schema).parquet(path)
