"""Shared pieces: tables, skew-safe lookups, connected components."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, prepare

# A key of a spread join is heavy if it holds one of this many parts of all rows,
# so at most this many keys are broadcast, whatever the input's size.
HEAVY_PARTS = 20_000
HEAVY_LEAST = 64


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once; nothing to do for the user but to import it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, function, schema: str, caches: bool = False) -> DataFrame:
    """mapInArrow with a function of this package. Workers outlive operators: unless the function ``caches`` units, what others cached goes first."""
    ship(df.sparkSession)

    def run(batches):
        from .units import UnitCache

        UnitCache.release()
        return function(batches)

    return df.mapInArrow(function if caches else run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable is never inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores until the frame has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (_id, _hash, _text): what identifies a document, free of clashing names. Null texts are empty.

    Rows that agree in id and text are one document and share every result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))


def heavy_bar(total: int) -> int:
    return max(HEAVY_LEAST, total // HEAVY_PARTS)


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows to one keyed row per key without sending a hot key to one task.

    ``count`` is a column of ``keyed`` that holds how many of ``total`` rows have the key.
    Keys over the bar (at most HEAVY_PARTS of them) are broadcast, all others are shuffled.
    Both inputs should be written tables, for they are read twice.
    """
    bar = heavy_bar(total)
    heavy = F.broadcast(keyed.filter(F.col(count) > bar).drop(count))
    light = keyed.filter(F.col(count) <= bar).drop(count)
    hot = rows.join(heavy, key)
    rest = rows.join(heavy.select(key), key, "left_anti").join(light, key, how)
    return hot.unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node reachable. Nodes without edges don't appear.

    Large-star and small-star rounds; each round is a written table, so lost
    executors cost one round, and nothing is gathered on the driver but a checksum.
    """
    links = materialize(_down(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "links")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _down(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = _down(small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b"))))
        links = materialize(small, "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(state)


def least_of(rooted: DataFrame, low: str, out: str) -> DataFrame:
    """The frame with a column for the least ``low`` of its root, without ``root`` and ``low``; a root may hold many rows."""
    rooted = materialize(rooted, "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min(low).alias(out), F.count("*").alias("_members")), "roots")
    return spread_join(rooted, least, "root", "_members", rooted.count()).drop("root", low)


def _down(links: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller end."""
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
