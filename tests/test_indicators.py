"""Hand-computed values, chunking and no-lookahead properties."""

import pytest
from pyspark.sql import functions as F

from barloom.functions.indicators import ALL_FEATURES, STATEFUL, features, tiled_features
from barloom.functions.rules import apply_rules, edges
from barloom.operators.recurrence import Rec, scan
from barloom.operators.supertrend import supertrend
from barloom.operators.tiling import Tiles, drop_halo, with_halo

SMALL = Tiles(size=128, halo=64, chunk=32)
SHORT = ["EMA10", "EMA20", "RSI14", "ATR14", "MACD_Hist", "OBV", "ADX", "BB_Upper20", "Kijun26", "HMA20", "StochD_14", "ForceIndex2"]


def series(spark, closes, **cols):
    rows = []
    for i, c in enumerate(closes):
        row = {"symbol": "s", "bar_idx": i, "open_ms": i, "close_ms": i + 1, "open": c, "high": c, "low": c, "close": c, "volume": 1.0,
               "trades": 1, "taker_base": 0.5}
        row |= {k: v[i] for k, v in cols.items()}
        rows.append(row)
    return spark.createDataFrame(rows)


def values(df, col):
    return [r[col] for r in df.orderBy("bar_idx").collect()]


def test_obv_and_ema_fixtures(spark):
    out = features(series(spark, [1.0, 2.0, 2.0, 1.0], volume=[10.0, 5.0, 7.0, 3.0]), ["OBV"])
    assert values(out, "OBV") == [10.0, 15.0, 15.0, 12.0]
    t = with_halo(series(spark, [1.0, 2.0, 3.0, 5.0]), 128, 32)
    seeded = scan(t, [Rec("e", 0.5, "CASE WHEN bar_idx = 2 THEN 2D WHEN bar_idx > 2 THEN close / 2 ELSE 0D END")], SMALL)
    assert values(drop_halo(seeded, 128), "e")[2:] == pytest.approx([2.0, 3.5])


def test_short_series_stay_zero(spark):
    out = features(series(spark, [1.0, 2.0, 3.0]), ["EMA10", "RSI14", "HMA9", "ADX"]).collect()
    assert all(r[c] == 0 for r in out for c in ("EMA10", "RSI14", "HMA9", "ADX"))


def test_tiles_do_not_change_values(walk):
    big = features(walk, SHORT).select("symbol", "bar_idx", *SHORT)
    small = features(walk, SHORT, SMALL).select("symbol", "bar_idx", *[F.col(c).alias(f"{c}_s") for c in SHORT])
    worst = big.join(small, ["symbol", "bar_idx"]).agg(
        F.count(F.lit(1)).alias("n"), *[F.max(F.abs(F.col(c) - F.col(f"{c}_s"))).alias(c) for c in SHORT]).first()
    assert worst["n"] == 1400
    assert all(worst[c] < 1e-7 for c in SHORT), worst


def test_supertrend_tiles(walk):
    a = supertrend(walk).collect()
    b = supertrend(walk, SMALL).collect()
    key = lambda r: (r["symbol"], r["bar_idx"])
    for x, y in zip(sorted(a, key=key), sorted(b, key=key), strict=True):
        assert x["SuperTrendDir10"] == y["SuperTrendDir10"] and abs(x["SuperTrend10"] - y["SuperTrend10"]) < 1e-7


def test_prefix_does_not_see_later_bars(walk):
    names = [n for n in ALL_FEATURES if n not in STATEFUL]
    full = features(walk, names).filter("bar_idx < 450")
    cut = features(walk.filter("bar_idx < 450"), names)
    cols = ["symbol", "bar_idx", *[F.round(F.col(n), 6).alias(n) for n in names]]
    assert full.select(*cols).exceptAll(cut.select(*cols)).count() == 0


def test_rule_fixtures(spark):
    df = series(spark, [1.0] * 4).withColumn("tile", F.lit(0).cast("long"))
    pick = lambda name, vals: F.element_at(F.array(*[F.lit(v) for v in vals]), (F.col("bar_idx") + 1).cast("int")).alias(name)
    df = df.select("*", pick("A", [1.0, 2.0, 4.0, 4.0]), pick("B", [3.0, 2.5, 3.0, 3.0]), pick("R", [5.0, 4.0, 6.0, 3.0]),
                   pick("U", [1.0, 4.0, 4.0, 4.0]), pick("V", [3.0, 3.0, 3.0, 3.0]), pick("N", [float("nan")] * 4))
    rules = {"up": ("CrossUp", "A", "B"), "flat": ("CrossUp", "U", "V"), "brk": ("BreakUp", "U", "V"), "rise": ("Rising", "R", 2),
             "btw": ("Between", "A", 3.0, 1.0), "nan": ("GT", "N", 0.0), "notnan": ("NOT", ("GT", "N", 0.0)), "none": None}
    out = edges(apply_rules(df, rules), ["btw"])
    assert values(out, "up") == [False, False, True, False]
    assert values(out, "flat") == [False] * 4
    assert values(out, "brk") == [False, True, False, False]
    assert values(out, "rise") == [False, False, True, False]
    assert values(out, "btw") == [True, True, False, False] and values(out, "btw_edge") == [True, False, False, False]
    assert values(out, "nan") == [False] * 4 and values(out, "notnan") == [True] * 4 and values(out, "none") == [True] * 4


def test_features_shuffle_bars_once(walk):
    plan = tiled_features(walk, ["BB_Upper20", "HH_200_prev", "HMA200", "StochD_14"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
