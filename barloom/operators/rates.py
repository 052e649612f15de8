"""How often strategies' conditions hold, in any window, as differences of running counts.

Window edges cut each series into cells; one scan counts every condition per cell, and a two-level
running sum over cells gives the counts before each edge. A window's counts are those before its end less those before
its start, so bars never meet windows, however many windows overlap.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import features_of, volatility_ok
from ..plans.strategy import Strategy
from ..session import materialize
from .signals import rule_inputs, shifted_sql
from .tiling import Tiles, running_offset

COUNTS = ["bars", "entry", "regime", "overlap", "edges"]
YEAR_MINUTES = 365.25 * 24 * 60
PAIR = ["strategy", "symbol"]
# Features that every strategy's conditions look at, beside those of its rules.
_FILTERS = ("AND", ("GT", "Active", 0.0), ("AND", ("GT", "ATR14", 0.0), ("GT", "ATR14_SMA50", 0.0)))


def condition_inputs(bars: DataFrame, strategies: list[Strategy], tiles: Tiles = Tiles()) -> DataFrame:
    """One row per bar with all that ``window_counts`` of these strategies, or some of them, reads. Write it once."""
    rules = {f"e{i}": s.entry for i, s in enumerate(strategies)} | {f"r{i}": s.regime for i, s in enumerate(strategies)}
    return rule_inputs(bars, rules | {"filters": _FILTERS}, tiles)


def _conditions(s: Strategy, back: int = 0) -> tuple[str, str, str, str]:
    """Entry, regime, activity and volatility filter of a strategy, so many bars ago."""
    entry, regime = (shifted_sql(r, features_of(r), back) for r in (s.entry, s.regime))
    at = f"__{back}" if back else ""
    calm = re.sub(r"\bATR14(_SMA50)?\b", rf"\g<0>{at}", volatility_ok(s.vol_threshold))
    return entry, regime, f"coalesce(Active{at} > 0, false)", f"coalesce({calm}, false)"


def _tallies(s: Strategy) -> dict[str, str]:
    entry, regime, active, calm = _conditions(s)
    before = " AND ".join(_conditions(s, 1))
    now = f"{entry} AND {regime} AND {active}"
    return {"entry": f"{entry} AND {active}", "regime": regime, "overlap": now, "edges": f"{now} AND {calm} AND NOT (bar_idx > 0 AND {before})"}


def window_counts(inputs: DataFrame, strategies: list[Strategy], windows: DataFrame, tiles: Tiles = Tiles(), batch: int = 50) -> DataFrame:
    """(strategy, symbol, grp, bars, entry, regime, overlap, edges) of the windows (symbol, grp, lo_idx, end_idx).

    entry: bars on which the entry rule holds and the series is active; overlap: the regime holds there too; edges: bars on which all that
    and the volatility filter hold but did not on the bar before. The first bar of a window knows the bar before it.
    """
    size = tiles.size
    edges = windows.select("symbol", F.explode(F.array("lo_idx", "end_idx")).alias("cut")).distinct()
    edges = edges.withColumn("tile", F.expr(f"cut div {size}"))
    cuts = materialize(edges.groupBy("symbol", "tile").agg(F.sort_array(F.collect_list("cut")).alias("cuts")), "cuts")
    placed = inputs.withColumn("tile", F.expr(f"bar_idx div {size}")).join(cuts, ["symbol", "tile"], "left")
    placed = placed.withColumn("cell", F.expr("coalesce(size(filter(cuts, c -> c <= bar_idx)), 0)"))
    # A row of zeros for each edge, also where no bar follows it.
    names = F.explode(F.array(*[F.lit(s.name) for s in strategies]))
    total = cuts.select("symbol", "tile", F.posexplode("cuts").alias("cell", "cut")).select(
        names.alias("strategy"), "symbol", "tile", (F.col("cell") + 1).alias("cell"), "cut", *[F.lit(0).cast("bigint").alias(c) for c in COUNTS])
    for start in range(0, len(strategies), batch):
        part = strategies[start:start + batch]
        sums = [F.expr(f"count_if({text})").alias(f"{c}_{i}") for i, s in enumerate(part) for c, text in _tallies(s).items()]
        wide = placed.groupBy("symbol", "tile", "cell").agg(F.count(F.lit(1)).alias("bars"), *sums)
        rows = F.array(*[F.struct(F.lit(s.name).alias("strategy"), "bars", *[F.col(f"{c}_{i}").alias(c) for c in COUNTS[1:]]) for i, s in enumerate(part)])
        long = wide.select("symbol", "tile", "cell", F.inline(rows)).withColumn("cut", F.lit(None).cast("bigint"))
        total = total.unionByName(long)
    cells = total.groupBy(*PAIR, "tile", "cell").agg(F.max("cut").alias("cut"), *[F.sum(c).alias(c) for c in COUNTS])
    cells = materialize(cells, "cells")
    tile_sums = cells.groupBy(*PAIR, "tile").agg(*[F.sum(c).alias(c) for c in COUNTS])
    lifts = running_offset(tile_sums, PAIR, "tile", COUNTS, [f"_{c}" for c in COUNTS]).select(*PAIR, "tile", *[f"_{c}" for c in COUNTS])
    before = Window.partitionBy(*PAIR, "tile").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    inside = cells.select(*PAIR, "tile", "cut", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in COUNTS]).filter("cut IS NOT NULL")
    upto = materialize(inside.join(lifts, [*PAIR, "tile"]).select(*PAIR, "cut", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in COUNTS]), "running-counts")
    lo = upto.select(*PAIR, F.col("cut").alias("lo_idx"), F.struct(*COUNTS).alias("lo"))
    hi = upto.select(*PAIR, F.col("cut").alias("end_idx"), F.struct(*COUNTS).alias("hi"))
    both = windows.select("symbol", "grp", "lo_idx", "end_idx").join(lo, ["symbol", "lo_idx"]).join(hi, [*PAIR, "end_idx"])
    return both.select(*PAIR, "grp", *[(F.col(f"hi.{c}") - F.col(f"lo.{c}")).alias(c) for c in COUNTS])


def fold_rates(counts: DataFrame, minutes: int = 60, thin: int = 2, least_regime: float = 1.0) -> DataFrame:
    """Over the windows of each (strategy, symbol): totals, windows below a floor, and edges a year in all and in the worst window.

    ``minutes`` is the length of a bar.
    """
    year = YEAR_MINUTES / minutes
    rate = lambda n, bars: F.when(bars > 0, n / bars * year)
    out = counts.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("folds"), *[F.sum(c).alias(c) for c in ("bars", "edges", "overlap")],
        F.count_if(F.col("overlap") < thin).alias("thin_folds"), F.count_if(F.col("edges") == 0).alias("dead_folds"),
        F.count_if((F.col("bars") > 0) & (F.col("regime") * 100.0 / F.col("bars") < least_regime)).alias("dead_regimes"),
        F.min(rate(F.col("edges"), F.col("bars"))).alias("worst_rate"))
    return out.withColumn("edges_per_year", F.coalesce(rate(F.col("edges"), F.col("bars")), F.lit(0.0)))


def edge_floor(per_year: float, auto: float, minutes: int) -> float:
    """A floor of edges a year: negative means ``auto``, zero none; bars shorter than an hour raise it in proportion."""
    floor = auto if per_year < 0 else per_year
    return floor * 60.0 / minutes if minutes < 60 else floor
