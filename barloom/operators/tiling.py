"""Splitting ordered series into bounded tiles.

A window partitioned by symbol alone puts a whole series into one task.  Every
ordered operator here works on ``(symbol, tile)`` instead: a tile holds at most
``size`` consecutive rows plus ``halo`` copied rows of the tile before it, so a
frame of up to ``halo`` rows sees everything it needs and no task ever holds
more than ``size + halo`` rows of a series.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tiles:
    size: int = 8192
    halo: int = 512
    chunk: int = 256

    def __post_init__(self):
        if self.size % self.chunk or self.halo % self.chunk or self.halo > self.size:
            raise ValueError("size and halo must be multiples of chunk, halo at most size")


def with_halo(df: DataFrame, size: int, halo: int, idx: str = "bar_idx", tile: str = "tile") -> DataFrame:
    """Add ``tile``; rows in the last ``halo`` positions also join the next tile."""
    own = F.expr(f"{idx} div {size}")
    copies = F.when(F.col(idx) % size >= size - halo, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn(tile, F.explode(copies))


def drop_halo(df: DataFrame, size: int, idx: str = "bar_idx", tile: str = "tile", keep_tile: bool = False) -> DataFrame:
    df = df.filter(F.expr(f"{tile} = {idx} div {size}"))
    return df if keep_tile else df.drop(tile)


def tile_window(tile: str = "tile", idx: str = "bar_idx", key: str = "symbol"):
    return Window.partitionBy(key, tile).orderBy(idx)


def running_offset(
    totals: DataFrame, keys: list[str], part: str, value: str | list[str], out: str | list[str], fan: int = 4096
) -> DataFrame:
    """Exclusive running sum of one or more columns over the integer ``part``.

    Two levels: inside groups of ``fan`` parts, then over the group totals, so
    the widest window holds 1/fan of the parts.
    """
    values, outs = ([value], [out]) if isinstance(value, str) else (value, out)
    totals = totals.withColumn("_grp", F.expr(f"({part}) div {fan}"))
    w = Window.partitionBy(*keys, "_grp").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    inner = totals.select("*", *[
        F.coalesce(F.sum(v).over(w), F.lit(0) * F.col(v)).alias(o) for v, o in zip(values, outs)])
    top_w = Window.partitionBy(*keys).orderBy("_grp").rowsBetween(Window.unboundedPreceding, -1)
    top = totals.groupBy(*keys, "_grp").agg(*[F.sum(v).alias(f"_t_{o}") for v, o in zip(values, outs)])
    top = top.select(*keys, "_grp", *[
        F.coalesce(F.sum(f"_t_{o}").over(top_w), F.lit(0) * F.col(f"_t_{o}")).alias(f"_lift_{o}") for o in outs])
    joined = inner.join(top, [*keys, "_grp"])
    return joined.select(*[c for c in inner.columns if c not in outs and c != "_grp"],
                         *[(F.col(o) + F.col(f"_lift_{o}")).alias(o) for o in outs])


def number_rows(df: DataFrame, keys: list[str], order: list[Column], part: Column, out: str) -> DataFrame:
    """Dense 0-based position per key without a per-key sort.

    ``part`` is an integer expression that never decreases along the order; it
    bounds the rows one sort has to hold.
    """
    df = df.withColumn("_part", part)
    counts = df.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_offset(counts, keys, "_part", "_n", "_off").select(*keys, "_part", "_off")
    w = Window.partitionBy(*keys, "_part").orderBy(*order)
    return (
        df.join(offsets, [*keys, "_part"])
        .withColumn(out, F.col("_off") + F.row_number().over(w) - 1)
        .drop("_part", "_off")
    )
