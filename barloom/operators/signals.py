"""Signals: how often rules fire, and how alike two rules are."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import PART, tiled_features
from ..functions.rules import features_of, rule_sql
from .tiling import Tiles, drop_halo, running_offset

_LAG = re.compile(r"lag\((\w+), (\d+)\) OVER \([^()]*\)")


def shifted_sql(rule, names: list[str], back: int) -> str:
    """Rule text over plain columns: ``x__k`` is feature x, k bars ago."""
    sql = _LAG.sub(lambda m: f"{m.group(1)}__{int(m.group(2)) + back}", rule_sql(rule))
    if back:
        for name in names:
            sql = re.sub(rf"\b{name}\b", f"{name}__{back}", sql)
    return sql


def rule_inputs(bars: DataFrame, rules: dict[str, tuple], tiles: Tiles = Tiles()) -> DataFrame:
    """Every feature and shifted feature a set of rules needs, one row per bar.

    Written once, it turns any number of rules into plain scans without
    windows or shuffles: a rule on the previous bar is the same rule over
    columns shifted one further.
    """
    names = features_of(*rules.values())
    need = {(n, 1) for n in names}
    for rule in rules.values():
        for name, k in _LAG.findall(rule_sql(rule)):
            need |= {(name, int(k)), (name, int(k) + 1)}
    t = tiled_features(bars, names, tiles).select("symbol", "tile", "bar_idx", *names)
    t = t.select(*[F.expr(f"nanvl({c}, CAST(NULL AS DOUBLE)) AS {c}") if c in names else F.col(c) for c in t.columns])
    t = t.select("*", *[F.expr(f"lag({n}, {k}) OVER ({PART}) AS {n}__{k}") for n, k in sorted(need)])
    return drop_halo(t, tiles.size)


def rule_counts(inputs: DataFrame, rules: dict[str, tuple], batch: int = 100) -> DataFrame:
    """True bars and false-to-true edges per (symbol, rule).

    Each batch of rules is one scan with map-side combine; a row of counts per
    symbol is unpivoted afterwards, so bars are never multiplied by rules.
    """
    items, out = list(rules.items()), None
    for start in range(0, len(items), batch):
        part = items[start:start + batch]
        aggs = []
        for i, (_, rule) in enumerate(part):
            names = features_of(rule)
            now, before = shifted_sql(rule, names, 0), shifted_sql(rule, names, 1)
            aggs += [F.expr(f"count_if({now}) AS h{i}"), F.expr(f"count_if({now} AND NOT (bar_idx > 0 AND {before})) AS e{i}")]
        wide = inputs.groupBy("symbol").agg(*aggs)
        rows = ", ".join(f"struct('{name}' AS rule, h{i} AS hits, e{i} AS edges)" for i, (name, _) in enumerate(part))
        long = wide.selectExpr("symbol", f"inline(array({rows}))")
        out = long if out is None else out.unionByName(long)
    return out


def agreement(df: DataFrame, left: str, right: str, skip: int = 200, step: int = 1, least: int = 100, key: str = "symbol", tiles: Tiles = Tiles()) -> DataFrame:
    """Compare two boolean columns on every ``step``-th bar after ``skip``, in bounded tiles.

    A series with fewer than ``least`` bars after ``skip`` agrees by definition.
    """
    at = F.col("bar_idx") - skip
    marked = df.filter((at >= 0) & (at % step == 0)).select(key, "bar_idx", (F.col(left) == F.col(right)).alias("_same"), F.expr(f"bar_idx div {tiles.size}").alias("_tile"))
    agreed = marked.groupBy(key, "_tile").agg(F.count_if("_same").alias("_n"))
    before = running_offset(agreed, [key], "_tile", "_n", "_off").select(key, "_tile", "_off")
    w = Window.partitionBy(key, "_tile").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    islands = marked.withColumn("_own", F.sum(F.col("_same").cast("long")).over(w)).join(before, [key, "_tile"])
    runs = islands.groupBy(key, (F.col("_own") + F.col("_off")).alias("_isl")).agg(F.count_if(~F.col("_same")).alias("_gap"), F.count_if("_same").alias("_agree"), F.count(F.lit(1)).alias("_n"))
    totals = runs.groupBy(key).agg(F.sum("_agree").alias("_agree"), F.max("_gap").alias("_gap"), F.sum("_n").alias("_n"))
    sizes = df.groupBy(key).agg((F.count(F.lit(1)) - skip).alias("_size"))
    enough = F.col("_size") >= least
    return sizes.join(totals, key, "left").select(
        key, F.when(enough, F.col("_agree") / F.col("_n")).otherwise(1.0).alias("agreement"), F.when(enough, F.col("_gap")).otherwise(F.lit(0)).alias("longest_gap"))


def entry_penalty(n_edges: Column, true_pct: Column, bars: Column, per_window: int = 2, base: int = 51840) -> list[Column]:
    """Too-low / too-high verdicts and the penalty factor for an entry rate."""
    least = F.greatest(F.lit(2), F.least(F.lit(8), F.floor(per_window * bars / base)))
    most = F.greatest(F.lit(80), F.least(F.lit(200), F.floor(120 * bars / base)))
    low, high, often = n_edges < least, n_edges > most, true_pct > 30.0
    excess = n_edges / most
    by_count = (
        F.when(low, F.when(n_edges == 0, 0.0).otherwise(n_edges / least))
        .when(high & (excess >= 3), 0.0).when(high & (excess >= 2), 0.3)
        .when(high, F.greatest(F.lit(0.3), 1 - 0.5 * (excess - 1))).otherwise(1.0)
    )
    factor = F.when(often, F.least(30.0 / true_pct, by_count)).otherwise(by_count)
    return [low.alias("too_low"), high.alias("too_high"), often.alias("too_often"), factor.alias("penalty")]


def overlap_verdict(bars: Column, entry: Column, regime: Column, overlap: Column, has_regime: bool | Column) -> Column:
    """First failed band: entry rate, regime rate where there is a regime, entry/regime overlap."""
    pct = lambda n: n * 100.0 / bars
    verdict = F.when(bars <= 0, "empty_window").when((pct(entry) < 0.1) | (pct(entry) > 31.0), "entry_rate_out_of_band")
    has_regime = F.lit(has_regime) if isinstance(has_regime, bool) else has_regime
    verdict = verdict.when(has_regime & ((pct(regime) < 1.0) | (pct(regime) > 99.7)), "regime_rate_out_of_band")
    return verdict.when((overlap < 10) & (pct(overlap) < 0.03), "entry_regime_no_overlap")


def dead_rule(bars: Column, entry: Column, regime: Column, overlap: Column, has_regime: bool) -> Column:
    """Why a rule cannot produce trades, NULL if it can."""
    verdict = (
        F.when(entry == 0, "dead_entry").when((entry < 3) | (entry < bars * 0.001), "entry_too_sparse")
        .when(entry > bars * 0.35, "entry_too_high")
    )
    if has_regime:
        verdict = (
            verdict.when(regime == 0, "dead_regime").when(regime * 100.0 / bars < 2.0, "regime_too_restrictive")
            .when(overlap == 0, "zero_overlap").when(overlap < 2, "overlap_too_sparse")
        )
    return verdict
