"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.indicators import features
from ..session import prepare
from ..sources import bars as B


# Many small shuffle partitions, put together up to so many bytes. Rows of bars and trades compress to a few bytes each, so
# the default of 64 MB puts millions of them into one task, whose sorts and hash tables then grow with the input.
TASK_SETTINGS = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "512", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for key, value in TASK_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bars_of(spark: SparkSession, sf_dir: str, source: str = "events", width: int | None = None, columns: list[str] | None = None) -> DataFrame:
    build = {"events": B.event_bars, "orders": B.order_bars, "lineitem": B.lineitem_bars}[source]
    rows = table(spark, sf_dir, source)
    if columns is not None:  # of lineitem bars only
        return build(rows, columns=columns)
    return build(rows) if width is None else build(rows, width_ms=width)


def rounded(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[
        (F.round(F.col(c), digits) + 0.0).alias(c) if c in cols else F.col(c) for c in df.columns
    ])


def feature_query(names: list[str], source: str = "events"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = features(bars_of(spark, sf_dir, source), names)
        return rounded(f.select("symbol", "bar_idx", *names), names)
    return run


class Registry:
    """Named queries with their SQL twins."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name, run, sql: str | None = None):
        if name in self.queries:
            raise ValueError(f"duplicate query {name}")
        self.queries[name] = run
        if sql is not None:
            self.sql[name] = sql
