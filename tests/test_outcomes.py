"""Labels and selection against a plain sequential loop; plan shapes; metrics."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.functions import scores as G
from barloom.operators import metrics as X
from barloom.operators import outcomes as O
from barloom.operators import selection
from barloom.plans import walkforward as WF
from barloom.plans.strategy import Strategy

LONG = Strategy("l", ("CrossUp", "EMA10", "EMA20"), exit=("LT", "RSI14", 30.0), stop=("atr", 1.0), target=("atr", 2.0), trail=("atr", 1.5),
                max_hold=15, cooldown=2, fee_bps=5.0)
SHORT = Strategy("s", ("Falling", "EMA10", 2), direction=-1, stop=("swing", 4), target=("fixed", 2.0), max_hold=9, max_losses=3, fee_bps=5.0)
NO_CLOCK = Strategy("n", ("CrossUp", "EMA10", "EMA20"), stop=("fixed", 30.0), target=None, trail=("atr", 8.0), max_hold=0)


def loop(rows, s, sid):
    """Bar-by-bar simulation of one strategy on one symbol."""
    trades, free, streak, t, n = [], -1, 0, s.warmup, len(rows)
    d = s.direction
    while t < n - 1:
        if t < free or not rows[t][f"sig_{sid}"] or (s.max_losses and streak >= s.max_losses):
            t += 1
            continue
        slip = lambda i: s.slip_bps / 1e4 * (4 if rows[i]["VolZ20"] < -2 else 2 if rows[i]["VolZ20"] < -1 else 1)
        entry, atr = rows[t + 1]["open"] * (1 + d * slip(t)), rows[t]["ATR14"]
        kind, x = s.stop
        if kind == "swing":
            back = rows[t - int(x):t]
            stop = min([rows[t]["close"], *[r["low"] for r in back]]) if d == 1 else max([rows[t]["close"], *[r["high"] for r in back]])
        else:
            stop = entry - d * x * atr if kind == "atr" else entry * (1 - d * x / 100)
        target = None if s.target is None else entry + d * s.target[1] * atr if s.target[0] == "atr" else entry * (1 + d * s.target[1] / 100)
        first, out = stop, None
        for i in range(t + 1, n):
            r, later, k = rows[i], i > t + 1, slip(i - 1)
            hit = lambda price: target is not None and d * price >= d * target
            if later and hit(r["open"]):
                out = (i, "tp_gap_open", r["open"] * (1 - d * k))
            elif later and d * r["open"] <= d * stop:
                out = (i, "sl_gap_open", r["open"] * (1 - d * k))
            elif (r["low"] <= stop) if d == 1 else (r["high"] >= stop):
                out = (i, "trail_hit" if s.trail and d * stop >= d * entry else "sl_hit", stop * (1 - d * 2 * k))
            elif hit(r["high"] if d == 1 else r["low"]):
                out = (i, "tp_hit", target * (1 - d * k))
            elif s.max_hold and i - t - 1 >= s.max_hold:
                out = (i, "max_hold", r["open"] * (1 - d * k))
            elif later and rows[i - 1][f"out_{sid}"]:
                out = (i, "exit_rule", r["open"] * (1 - d * k))
            if out:
                break
            if s.trail:
                stop = d * max(d * stop, d * r["close"] - s.trail[1] * r["ATR14"])
        if not out:
            out = (n - 1, "end_of_data", rows[n - 1]["close"] * (1 - d * slip(n - 2)))
        pnl = d * (out[2] / entry - 1) - 2 * s.fee_bps / 1e4
        trades.append((s.name, t, out[0], out[1], round(out[2], 8), round(pnl, 8)))
        streak = streak + 1 if pnl < 0 else 0
        free = out[0] + s.cooldown + 1
        t = free
    return trades


@pytest.mark.parametrize("book,tile", [([LONG, SHORT], 65536), ([LONG, SHORT], 64), ([NO_CLOCK], 65536)])
def test_trades_match_a_sequential_loop(spark, walk, book, tile, monkeypatch):
    monkeypatch.setattr(selection, "TILE_BARS", tile)
    prep = O.prepared(walk, book)
    cols = ["symbol", "bar_idx", "open", "high", "low", "close", "ATR14", "VolZ20", *[f"{c}_{i}" for i in range(len(book)) for c in ("sig", "out")]]
    bars = [r.asDict() for r in prep.filter("tile = 0").select(*cols).orderBy("symbol", "bar_idx").collect()]
    expected = {(sym, *t) for sym in ("a", "b") for i, s in enumerate(book) for t in loop([r for r in bars if r["symbol"] == sym], s, i)}
    lab = O.outcomes(walk, book)
    got = selection.select_trades(lab, {i: s.cooldown for i, s in enumerate(book)}, {i: s.max_losses for i, s in enumerate(book)})
    rows = got.select("symbol", "strategy", "signal_idx", "exit_idx", "reason", F.round("exit_price", 8), F.round("pnl", 8)).collect()
    assert len(expected) >= 4
    assert {tuple(r) for r in rows} == expected


def test_no_cartesian_product(walk):
    prep = O.prepared(walk, [LONG])
    plan = O.next_bars(O.entries(prep, [LONG]), O.path_bars(prep, [LONG]), 16)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_bars_of_outcomes_are_written_ready(walk, monkeypatch):
    """Paths and entries are read off one written table: no bar is shuffled by tile again, and columns that no strategy reads are not in it."""
    seen = []
    label = O.label
    monkeypatch.setattr(O, "label", lambda events, bars, *rest: seen.append((events, bars)) or label(events, bars, *rest))
    O.outcomes(walk, [NO_CLOCK])
    plan = seen[0][1]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in seen[0][0]._jdf.queryExecution().executedPlan().toString()
    assert {"volume", "close_ms", "EMA10"}.isdisjoint(seen[0][1].columns)


@pytest.mark.parametrize("horizon", [1, 7, 41, 300, 700])
def test_next_bars(spark, walk, horizon):
    """Every event meets its next bars once each, at the borders of buckets too."""
    events = walk.filter("symbol = 'a' AND bar_idx % 5 <> 2").selectExpr("symbol", "bar_idx AS entry_idx")
    got = O.next_bars(events, walk.select("symbol", "bar_idx"), horizon).select("symbol", "entry_idx", "bar_idx", "pos").collect()
    want = [("a", e, e + k, k) for e in range(700) if e % 5 != 2 for k in range(min(horizon, 700 - e))]
    assert sorted(map(tuple, got)) == want


def test_drawdown_and_growth_through_total_loss(spark):
    rnd = random.Random(3)
    rows = [("k", i, rnd.choice([0.1, -0.2, 0.3, -1.4, 0.05])) for i in range(60)] + [("z", i, p) for i, p in enumerate([0.5, -1.0, 0.2])]
    df = spark.createDataFrame(rows, "k string, i long, pnl double")
    got = {r["k"]: (r["max_dd"], r["raw_return"]) for r in X.trade_drawdown(df, ["k"], "i", "i div 7").join(X.compound(df, ["k"]), "k").collect()}
    for key in ("k", "z"):
        eq, peak, worst = 1.0, 1.0, 0.0
        for k, _, p in rows:
            if k == key:
                eq *= 1 + p
                peak = max(peak, eq)
                worst = max(worst, (peak - eq) / peak)
        assert got[key] == pytest.approx((worst, eq - 1))


def test_geometric_mean_and_profit_factor(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", -0.1), ("b", -1.0), ("b", 0.5)], "k string, r double")
    got = {r["k"]: r["g"] for r in df.groupBy("k").agg(X.geometric_mean(F.col("r")).alias("g")).collect()}
    assert got["a"] == pytest.approx(0.99**0.5 - 1) and got["b"] == -1.0
    one = spark.createDataFrame([("a", 0.01, 3)], "k string, pnl double, hold int")
    assert X.trade_metrics(one, ["k"]).first()["profit_factor"] == 999.0


def test_score_rejections_are_null_with_a_reason(spark):
    rows = [(0.2, 0.1, 0.01, 60, 100), (float("nan"), 0.1, 0.01, 60, 100), (0.2, 0.7, 0.01, 60, 100), (0.2, 0.1, 0.01, 0, 100), (4.0, 0.1, 0.01, 60, 1)]
    df = G.scored(spark.createDataFrame(rows, "ret double, max_dd double, expectancy double, trades long, tested long"))
    got = [(r["reject_reason"], r["base_score"] is None) for r in df.collect()]
    assert got == [(None, False), ("invalid_math", True), ("no_trades_or_dd_limit", True), ("no_trades_or_dd_limit", True), ("ret_above_cap", True)]


def test_stitched_bars_belong_to_one_fold(spark, walk):
    folds = WF.rolling_folds(walk, 10, 5, 3)
    trades, eq, stitched = WF.walk_forward(walk, [SHORT], folds)
    assert eq.count() > stitched.count() > 0
    assert stitched.groupBy("strategy", "symbol", "bar_idx").count().filter("count > 1").count() == 0
    assert trades.join(WF.test_windows(folds).select("symbol", "grp", "lo_idx"), ["symbol", "grp"]).filter("entry_idx < lo_idx OR exit_idx >= end_idx").count() == 0


def test_a_mixed_book_gives_what_its_parts_give(walk):
    """Bounded and open-ended strategies side by side, each labelled its own way."""
    cols = ["strategy", "symbol", "entry_idx", "exit_idx", "exit_price", "reason"]
    both = O.outcomes(walk, [LONG, NO_CLOCK]).select(*cols)
    apart = O.outcomes(walk, [LONG]).select(*cols).unionByName(O.outcomes(walk, [NO_CLOCK]).select(*cols))
    assert both.count() > 0 and both.exceptAll(apart).count() == 0 and apart.exceptAll(both).count() == 0


def test_walk_forward_takes_strategies_without_a_time_exit(walk):
    folds = WF.block_folds(walk)
    trades, equity, stitched = WF.walk_forward(walk, [NO_CLOCK, SHORT], folds)
    assert {r.strategy for r in trades.select("strategy").distinct().collect()} == {"n", "s"}
    assert trades.agg(F.max(F.expr("exit_idx - entry_idx"))).first()[0] > SHORT.max_hold and stitched.count() > 0
    assert equity.filter("equity IS NULL OR isnan(equity)").count() == 0
