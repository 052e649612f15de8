"""Trend-following stop line that flips side (period 10, three ranges wide).

The side after a bar is set by the latest breakout: a close under the lower
band turns it short, one over the upper band turns it long.  The line is the
best band seen since the side last changed.  Both are running "latest" and
"best since" values, carried between tiles through small per-tile tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import PART, tiled_features
from .tiling import Tiles, drop_halo

WIDTH = 3.0
_SERIES = "OVER (PARTITION BY symbol ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_UPTO = f"OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def supertrend(bars: DataFrame, tiles: Tiles = Tiles()) -> DataFrame:
    """symbol, bar_idx, SuperTrend10, SuperTrendDir10 for every bar."""
    df = drop_halo(tiled_features(bars, ["_atr10"], tiles), tiles.size, keep_tile=True)
    df = df.selectExpr(
        "symbol", "tile", "bar_idx", "close",
        f"(high + low) / 2D + {WIDTH}D * _atr10 AS hi", f"(high + low) / 2D - {WIDTH}D * _atr10 AS lo",
    ).selectExpr("*", "CASE WHEN bar_idx = 0 THEN NULL WHEN close < lo THEN -1 WHEN close > hi THEN 1 END AS turn")

    # side at the end of each tile, carried into the next ones
    ends = df.groupBy("symbol", "tile").agg(F.expr("max_by(turn, bar_idx) FILTER (WHERE turn IS NOT NULL) AS turn"))
    sides = ends.selectExpr("symbol", "tile", f"coalesce(last(turn, true) {_SERIES}, 1) AS side_in")
    df = df.join(sides, ["symbol", "tile"]).selectExpr(
        "*", f"coalesce(last(turn, true) {_UPTO}, side_in) AS side"
    ).selectExpr("*", f"coalesce(lag(side) OVER ({PART}), side_in) AS side_before")
    df = df.selectExpr("*", f"sum(int(side != side_before)) {_UPTO} AS run")

    # best band of the run that is open at the end of each tile
    runs = df.filter("bar_idx > 0").groupBy("symbol", "tile", "run").agg(
        F.max("lo").alias("best_lo"), F.min("hi").alias("best_hi")
    )
    tails = runs.groupBy("symbol", "tile").agg(
        F.max_by("best_lo", "run").alias("best_lo"), F.max_by("best_hi", "run").alias("best_hi"),
        F.max("run").alias("flips"),
    ).selectExpr("*", "sum(flips) OVER (PARTITION BY symbol ORDER BY tile) AS era")
    in_era = "OVER (PARTITION BY symbol, era ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    open_run = tails.selectExpr("symbol", "tile + 1 AS tile", f"max(best_lo) {in_era} AS lo_in", f"min(best_hi) {in_era} AS hi_in")
    df = df.join(open_run, ["symbol", "tile"], "left")
    in_run = "OVER (PARTITION BY symbol, tile, run ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    live = lambda c: f"CASE WHEN bar_idx > 0 THEN {c} END"
    df = df.selectExpr(
        "*",
        f"greatest(max({live('lo')}) {in_run}, CASE WHEN run = 0 THEN lo_in END) AS best_lo",
        f"least(min({live('hi')}) {in_run}, CASE WHEN run = 0 THEN hi_in END) AS best_hi",
    )
    line = "CASE WHEN side = 1 THEN CASE WHEN best_lo > 0 THEN best_lo ELSE lo END ELSE best_hi END"
    return df.selectExpr(
        "symbol", "bar_idx",
        f"CASE WHEN bar_idx = 0 THEN 0D ELSE {line} END AS SuperTrend10",
        "CASE WHEN bar_idx = 0 THEN 0D ELSE double(side) END AS SuperTrendDir10",
    )
