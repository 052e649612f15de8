"""Feature metadata: types, families, look-back, threshold bounds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .indicators import ALL_FEATURES

# Feature type by name.
TYPES = {
    "price_level": [
        "EMA10", "EMA20", "EMA50", "EMA100", "EMA200", "HMA9", "HMA20", "HMA50", "HMA100", "HMA200", "Kijun26",
        "BB_Lower20", "BB_Lower50", "BB_Upper20", "BB_Upper50", "SwingHigh", "SwingLow",
        "HH_20_prev", "HH_50_prev", "HH_100_prev", "HH_200_prev",
        "LL_20_prev", "LL_50_prev", "LL_100_prev", "LL_200_prev",
        "KC_Middle20", "KC_Upper20", "KC_Lower20",
        "Donchian_Upper20", "Donchian_Lower20", "Donchian_Upper55", "Donchian_Lower55", "SuperTrend10",
    ],
    "oscillator": [
        "RSI7", "RSI14", "RSI21", "MFI14", "ADX", "PlusDI", "MinusDI",
        "StochK_14", "StochD_14", "StochK_5", "StochD_5", "WilliamsR_14", "WilliamsR_7",
    ],
    "momentum": [
        "ROC5", "ROC10", "ROC20", "MACD", "MACD_Signal", "MACD_Hist", "ForceIndex2", "ForceIndex13",
        "Momentum60", "Momentum240", "SLOPE_20", "VOLRET_20",
    ],
    "volume_raw": ["OBV", "VolPerTrade", "VolSMA20", "VolSMA50", "VolEMA20", "VolEMA50"],
    "volume_zscore": ["VolZ20", "VolZ50"],
    "range_norm": [
        "BB_Width20", "BB_Width50", "RangeWidth", "BodyPct", "WickUpPct", "WickDownPct", "ClosePos", "Displacement",
    ],
    "volume_derived_norm": ["Imbalance", "BuyRatio"],
    "price_range": ["Body", "HighLowDiff"],
    "atr": ["ATR7", "ATR14", "ATR14_SMA50"],
    "event_flag": [
        "BOS", "Sweep", "FVGUp", "FVGDown", "Active", "SuperTrendDir10",
        "SweepUp_20", "SweepUp_50", "SweepUp_100", "SweepUp_200",
        "SweepDown_20", "SweepDown_50", "SweepDown_100", "SweepDown_200",
        "Squeeze20", "SqueezeBreakUp", "SqueezeBreakDown", "StochBullCross", "StochBearCross",
    ],
}
# Types that share a scale and may be compared with each other.
FAMILIES = {
    "price_level": "price", "price_range": "price", "atr": "price",
    "oscillator": "swing", "momentum": "swing",
    "volume_raw": "volume", "volume_derived_norm": "volume",
    "volume_zscore": "volume_zscore", "range_norm": "range_norm",
}
# What a type says about the market.
CATEGORIES = {
    "price_level": "price_market", "oscillator": "price_market", "momentum": "price_market",
    "volume_raw": "volume_volatility", "volume_zscore": "volume_volatility",
    "volume_derived_norm": "volume_volatility", "atr": "volume_volatility",
}
# Threshold bounds by feature.
BOUNDS = {
    "RSI7": (1.0, 99.0), "PlusDI": (5.0, 70.0), "MFI": (5.0, 95.0),
    "VolZ20": (-3.5, 3.5), "VolZ50": (-3.5, 3.5), "Imbalance": (-1.0, 1.0), "BuyRatio": (0.0, 1.0),
    "BodyPct": (0.0, 1.0), "WickUpPct": (0.0, 1.0), "WickDownPct": (0.0, 1.0), "ClosePos": (0.0, 1.0),
    "Body": (0.0, 200.0), "RangeWidth": (0.0, 200.0),
    "BB_Lower50": (3000.0, 74000.0), "SwingHigh": (3000.0, 74000.0), "SwingLow": (3000.0, 74000.0),
    "StochK_14": (1.0, 99.0), "StochD_14": (1.0, 99.0), "StochK_5": (1.0, 99.0), "StochD_5": (1.0, 99.0),
    "WilliamsR_14": (-99.0, -1.0), "WilliamsR_7": (-99.0, -1.0),
    "KC_Upper20": (3000.0, 74000.0), "KC_Lower20": (3000.0, 74000.0), "KC_Middle20": (3000.0, 74000.0),
    "Donchian_Upper20": (3000.0, 74000.0), "Donchian_Lower20": (3000.0, 74000.0),
    "Donchian_Upper55": (3000.0, 74000.0), "Donchian_Lower55": (3000.0, 74000.0),
    "SuperTrend10": (3000.0, 74000.0),
    "ForceIndex2": (-1e9, 1e9), "ForceIndex13": (-1e9, 1e9),
    "Momentum60": (-0.8, 1.0), "Momentum240": (-0.8, 1.0),
}
# Prefixes of rarely true event features.
SPARSE_PREFIXES = ["SweepUp_", "SweepDown_", "FVG", "BOS", "Squeeze", "StochBullCross", "StochBearCross"]

TYPE_OF = {name: kind for kind, names in TYPES.items() for name in names}


def meta_rows(names: list[str]) -> list[tuple]:
    rows = []
    for pos, name in enumerate(names):
        kind = TYPE_OF.get(name, "unknown")
        lo, hi = BOUNDS.get(name, (None, None))
        rows.append((pos, name, kind, FAMILIES.get(kind), CATEGORIES.get(kind, "other"), lo, hi))
    return rows


def feature_meta(spark: SparkSession, names: list[str] = ALL_FEATURES) -> DataFrame:
    """Lookup table: one row per feature column (about a hundred rows)."""
    schema = "pos int, name string, type string, family string, category string, lo double, hi double"
    return spark.createDataFrame(meta_rows(names), schema)


def allowed_pairs(meta: DataFrame) -> DataFrame:
    """Ordered pairs of different features that share a family."""
    left = meta.filter("family IS NOT NULL").select(F.col("name").alias("a"), "family")
    right = meta.filter("family IS NOT NULL").select(F.col("name").alias("b"), "family")
    return left.join(right, "family").filter("a != b")


def feature_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """Min, max, mean and population deviation per feature in one pass.

    All features are aggregated side by side and the single result row is
    turned into one row per feature, so rows never multiply before the shuffle.
    """
    aggs = []
    for n in names:
        aggs += [F.min(n).alias(f"{n}__min"), F.max(n).alias(f"{n}__max"),
                 F.avg(n).alias(f"{n}__mean"), F.stddev_pop(n).alias(f"{n}__std")]
    wide = df.agg(*aggs)
    rows = ", ".join(f"struct('{n}' AS name, {n}__min AS min, {n}__max AS max, {n}__mean AS mean, {n}__std AS std)" for n in names)
    return wide.selectExpr(f"inline(array({rows}))")


def fingerprint(names: Column) -> Column:
    """First 16 hex digits of sha256 over ``position:name`` parts."""
    parts = F.transform(names, lambda x, i: F.concat_ws(":", i.cast("string"), x))
    return F.substring(F.sha2(F.array_join(parts, "|"), 256), 1, 16)


def lookback(name: Column) -> Column:
    """Last run of digits in a feature name, 0 if there is none."""
    return F.coalesce(F.regexp_extract(name, r"(\d+)\D*$", 1).try_cast("int"), F.lit(0))


def name_look_back(name: str) -> int:
    """The same for one name."""
    found = re.search(r"(\d+)\D*$", name)
    return int(found.group(1)) if found else 0


def clamp_threshold(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(lo.isNull(), x).otherwise(F.least(F.greatest(x, lo), hi))


def quality(df: DataFrame, names: list[str], warmup: int) -> DataFrame:
    """Failure counts per check after warmup, one row."""
    late = F.col("bar_idx") >= warmup
    bad_number = lambda n: F.isnan(n) | F.col(n).isNull() | (F.abs(F.col(n)) == float("inf"))
    aggs = [F.count_if(late).alias("rows_checked")]
    not_finite = F.lit(0)
    for n in names:
        not_finite = not_finite + F.count_if(late & bad_number(n))
    aggs.append(not_finite.alias("not_finite"))
    for n in names:
        if n.startswith("EMA"):
            ratio = F.col(n) / F.col("close")
            aggs.append(F.count_if(late & ((ratio < 0.5) | (ratio > 1.5))).alias(f"{n}_scale"))
        if n.startswith("RSI"):
            aggs.append(F.count_if(late & ((F.col(n) < 0) | (F.col(n) > 100))).alias(f"{n}_range"))
    return df.agg(*aggs)


def sweep(stats: DataFrame, meta: DataFrame, steps: list[float]) -> DataFrame:
    """Candidate leaves: thresholds at mean + k*std (clamped) and crossings of allowed pairs."""
    cut = F.explode(F.array(*[F.lit(float(k)) for k in steps]))
    named = stats.join(F.broadcast(meta), "name").filter("family IS NOT NULL")
    levels = named.select("name", "lo", "hi", "mean", "std", cut.alias("k"))
    x = clamp_threshold(F.col("mean") + F.col("k") * F.col("std"), F.col("lo"), F.col("hi"))
    kinds = F.explode(F.array(*[F.lit(k) for k in ["GT", "LT", "Between", "Rising", "SlopeGT"]]))
    single = levels.select("name", "k", "std", x.alias("x"), kinds.alias("kind")).select(
        "kind", F.col("name").alias("a"), F.lit(None).cast("string").alias("b"), "k",
        F.when(F.col("kind") != "Rising", F.col("x")).alias("x"),
        F.when(F.col("kind") == "Between", F.col("x") + 0.5 * F.col("std")).alias("y"),
        F.when(F.col("kind").isin("Rising", "SlopeGT"), 3 + F.floor(F.abs(F.col("k")) * 4)).otherwise(0).cast("int").alias("lb"),
    )
    none = F.lit(None).cast("double")
    cross = F.explode(F.array(F.lit("CrossUp"), F.lit("CrossDown")))
    pairs = allowed_pairs(meta.join(stats.select("name"), "name", "left_semi")).select(
        cross.alias("kind"), "a", "b", none.alias("k"), none.alias("x"), none.alias("y"), F.lit(0).alias("lb"))
    return single.unionByName(pairs)
