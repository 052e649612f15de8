"""Indicators I1-I39."""

from __future__ import annotations

from ..operators.supertrend import supertrend
from . import sqlkit as Q
from .common import Registry, bars_of, feature_query, rounded

# Indicator groups and their columns.
GROUPS = {
    "i01_sma": ["VolSMA20", "VolSMA50"],
    "i02_wma_i03_hma": ["HMA9", "HMA20", "HMA50", "HMA100", "HMA200"],
    "i04_kijun": ["Kijun26"],
    "i05_bollinger": ["BB_Upper20", "BB_Lower20", "BB_Width20", "BB_Upper50", "BB_Lower50", "BB_Width50"],
    "i06_roc": ["ROC5", "ROC10", "ROC20"],
    "i07_volume_z": ["VolZ20", "VolZ50"],
    "i08_mfi": ["MFI14"],
    "i09_flow_ratios": ["BuyRatio", "Imbalance", "VolPerTrade"],
    "i10_active": ["Active"],
    "i11_bar_range": ["HighLowDiff", "Body", "RangeWidth"],
    "i12_candle_shape": ["BodyPct", "WickUpPct", "WickDownPct", "ClosePos"],
    "i13_swing": ["SwingHigh", "SwingLow"],
    "i14_sweep": ["Sweep"],
    "i15_break_of_structure": ["BOS"],
    "i16_displacement": ["Displacement"],
    "i17_gaps": ["FVGUp", "FVGDown"],
    "i18_prior_extremes": [f"{s}_{n}_prev" for n in (20, 50, 100, 200) for s in ("HH", "LL")],
    "i19_level_sweeps": [f"Sweep{s}_{n}" for n in (20, 50, 100, 200) for s in ("Up", "Down")],
    "i20_atr_average": ["ATR14_SMA50"],
    "i21_return_volatility": ["VOLRET_20"],
    "i22_slope": ["SLOPE_20"],
    "i23_compression": ["RANGE", "COMPRESSION"],
    "i24_volume_ratio": ["VOLRATIO_20"],
    "i25_stochastic": ["StochK_14", "StochD_14", "StochK_5", "StochD_5"],
    "i26_williams": ["WilliamsR_14", "WilliamsR_7"],
    "i27_donchian": ["Donchian_Upper20", "Donchian_Lower20", "Donchian_Upper55", "Donchian_Lower55"],
    "i28_momentum": ["Momentum60", "Momentum240"],
    "i29_squeeze": ["Squeeze20", "SqueezeBreakUp", "SqueezeBreakDown"],
    "i30_stochastic_cross": ["StochBullCross", "StochBearCross"],
    "i31_ema": ["EMA10", "EMA20", "EMA50", "EMA100", "EMA200", "VolEMA20", "VolEMA50"],
    "i32_macd": ["MACD", "MACD_Signal", "MACD_Hist"],
    "i33_rsi": ["RSI7", "RSI14", "RSI21"],
    "i34_atr": ["ATR7", "ATR14"],
    "i35_adx": ["ADX", "PlusDI", "MinusDI"],
    "i36_obv": ["OBV"],
    "i37_keltner": ["KC_Middle20", "KC_Upper20", "KC_Lower20"],
    "i38_force_index": ["ForceIndex2", "ForceIndex13"],
}

SUPERTREND_SQL = f"""WITH RECURSIVE {Q.features_cte(["ATR10"])},
b AS (SELECT symbol, bar_idx, close, (high + low) / 2 + 3 * ATR10 AS hi, (high + low) / 2 - 3 * ATR10 AS lo FROM f),
t AS (
  SELECT symbol, bar_idx, CAST(0.0 AS DOUBLE) AS line, 1 AS side FROM b WHERE bar_idx = 0
  UNION ALL
  SELECT x.symbol, x.bar_idx,
    CASE WHEN t.side = 1 AND x.close < x.lo THEN x.hi
         WHEN t.side = 1 THEN CASE WHEN x.lo < t.line AND t.line > 0 THEN t.line ELSE x.lo END
         WHEN x.close > x.hi THEN x.lo
         ELSE CASE WHEN x.hi > t.line AND t.line > 0 THEN t.line ELSE x.hi END END,
    CASE WHEN t.side = 1 AND x.close < x.lo THEN -1 WHEN t.side = -1 AND x.close > x.hi THEN 1 ELSE t.side END
  FROM t JOIN b x ON x.symbol = t.symbol AND x.bar_idx = t.bar_idx + 1)
SELECT symbol, bar_idx, round(line, 6) + 0.0 AS SuperTrend10,
       CASE WHEN bar_idx = 0 THEN 0.0 ELSE CAST(side AS DOUBLE) END AS SuperTrendDir10 FROM t"""


def register(reg: Registry) -> None:
    for name, cols in GROUPS.items():
        reg.add(name, feature_query(cols), Q.feature_query(cols))
    reg.add("i31_ema_suppliers", feature_query(["EMA10", "EMA50"], "lineitem"), Q.feature_query(["EMA10", "EMA50"], "lineitem"))
    reg.add(
        "i39_supertrend",
        lambda spark, d: rounded(supertrend(bars_of(spark, d)), ["SuperTrend10"]),
        SUPERTREND_SQL,
    )
