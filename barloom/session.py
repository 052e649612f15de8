"""Session settings the library relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session settings used by every job.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Wide projections: split into methods the JIT will compile.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A join on (symbol, tile, chunk) may reuse a layout hashed by (symbol, tile).
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


_LOCAL: dict[str, str | None] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time SQL settings to a session somebody else created."""
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: str = "8", app: str = "barloom", **extra: str) -> SparkSession:
    """A session for tests and the local benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
    )
    for key, value in {**SQL_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode, where the driver is the only machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _LOCAL.setdefault("dir", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _LOCAL["dir"] = folder
    return folder


def materialize(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Cuts lineage, survives lost executors and keeps column pruning and
    predicate pushdown for everything downstream. ``by``: columns that name folders.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/barloom/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by or []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
