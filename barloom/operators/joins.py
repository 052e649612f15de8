"""Time joins: lower bound, nearest, as-of, seen-set filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Buckets whose heads one window holds.
FAN = 4096


def lower_bound(points: DataFrame, bars: DataFrame, width_ms: int, out: str = "idx") -> DataFrame:
    """First bar at or after ``t`` per (symbol, t); the series length if none.

    Points meet only the bars of their own time bucket; where that bucket has
    no later bar, the first bar of the next bucket that has one is used, found
    on the bucket table in two levels: among ``FAN`` neighbouring buckets, then
    among such groups. No point enters a window.
    """
    b = bars.select("symbol", "bar_idx", "close_ms", F.expr(f"close_ms div {width_ms}").alias("_b"))
    heads = b.groupBy("symbol", "_b").agg(F.min("bar_idx").alias("_head"), F.max("bar_idx").alias("_tail"))
    p = points.select("symbol", "t", F.expr(f"t div {width_ms}").alias("_b")).distinct()
    same = p.join(b, ["symbol", "_b"]).filter("close_ms >= t").groupBy("symbol", "t").agg(F.min("bar_idx").alias("_same"))
    slots = heads.select("symbol", "_b", "_head").unionByName(p.select("symbol", "_b").distinct().withColumn("_head", F.lit(None).cast("bigint")))
    slots = slots.groupBy("symbol", "_b").agg(F.min("_head").alias("_head")).withColumn("_g", F.expr(f"_b div {FAN}"))
    after = "RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    groups = slots.groupBy("symbol", "_g").agg(F.min("_head").alias("_first")).selectExpr(
        "symbol", "_g", f"min(_first) OVER (PARTITION BY symbol ORDER BY _g {after} AS _far")
    near = slots.selectExpr("symbol", "_b", "_g", f"min(_head) OVER (PARTITION BY symbol, _g ORDER BY _b {after} AS _near")
    later = near.join(groups, ["symbol", "_g"]).select("symbol", "_b", F.coalesce("_near", "_far").alias("_next"))
    sizes = heads.groupBy("symbol").agg((F.max("_tail") + 1).alias("_n"))
    found = p.join(later, ["symbol", "_b"]).join(sizes, "symbol", "left").join(same, ["symbol", "t"], "left").select(
        "symbol", "t", F.coalesce("_same", "_next", "_n").alias(out))
    return points.join(found, ["symbol", "t"])


def nearest(points: DataFrame, bars: DataFrame, width_ms: int) -> DataFrame:
    """The bar whose close is nearest to ``t``; the earlier one on a tie."""
    bounds = lower_bound(points, bars, width_ms, "_at")
    sides = bounds.withColumn("bar_idx", F.explode(F.array(F.col("_at") - 1, F.col("_at"))))
    j = sides.join(bars.select("symbol", "bar_idx", "close_ms"), ["symbol", "bar_idx"])
    gap = F.abs(F.col("close_ms") - F.col("t"))
    return j.groupBy("symbol", "t").agg(
        F.min(F.struct(gap.alias("gap"), F.col("bar_idx"))).alias("m")).select("symbol", "t", "m.bar_idx", "m.gap")


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been seen."""
    return rows.join(seen.select(key), key, "left_anti")
