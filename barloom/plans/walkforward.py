"""Walk-forward folds, out-of-sample equity and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as X
from ..operators import outcomes as O
from ..operators.joins import lower_bound
from ..operators.selection import select_trades
from ..session import materialize
from ..sources.bars import DAY_MS
from .strategy import Strategy


def rolling_folds(bars: DataFrame, train_days: int = 360, test_days: int = 90, step_days: int = 60) -> DataFrame:
    """Folds in calendar days from each symbol's first close; a test window starts where training ends."""
    ends = bars.groupBy("symbol").agg(F.min("close_ms").alias("t0"), F.max("close_ms").alias("t1"))
    room = f"(t1 - t0 - {(train_days + test_days) * DAY_MS})"
    folds = ends.filter(f"{room} >= 0").selectExpr(
        "symbol", "t0", f"explode(sequence(0L, {room} div {step_days * DAY_MS})) AS fold")
    start = f"t0 + fold * {step_days * DAY_MS}"
    edges = folds.selectExpr("symbol", "fold", f"""inline(array(
        struct('train_start' AS edge, {start} AS t), struct('train_end' AS edge, {start} + {train_days * DAY_MS} AS t),
        struct('test_end' AS edge, {start} + {(train_days + test_days) * DAY_MS} AS t)))""")
    at = lower_bound(edges, bars, DAY_MS * 32)
    pick = lambda edge: F.max(F.when(F.col("edge") == edge, F.col("idx")))
    return at.groupBy("symbol", "fold").agg(
        pick("train_start").alias("train_start"), pick("train_end").alias("train_end"),
        pick("train_end").alias("test_start"), pick("test_end").alias("test_end"))


def fold_faults(folds: DataFrame, min_folds: int) -> DataFrame:
    return folds.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("folds"), F.count_if(F.col("train_end") <= F.col("train_start")).alias("empty_train"),
        F.count_if(F.col("test_end") <= F.col("test_start")).alias("empty_test"),
    ).withColumn("too_few", F.col("folds") < min_folds)


def block_folds(bars: DataFrame, purge: float = 0.10) -> DataFrame:
    """Three folds over six equal blocks; tests on blocks 4, 5 and 5, a purge gap before each test."""
    n = bars.groupBy("symbol").agg((F.max("bar_idx") + 1).alias("n"))
    n = n.selectExpr("symbol", "n", "n div 6 AS b").selectExpr("*", f"floor(b * {purge}D) AS gap")
    return n.selectExpr("symbol", """inline(array(
        struct(0L AS fold, 0L AS train_start, 4 * b - gap AS train_end, 4 * b AS test_start, 5 * b AS test_end),
        struct(1L AS fold, b AS train_start, 5 * b - gap AS train_end, 5 * b AS test_start, n AS test_end),
        struct(2L AS fold, 0L AS train_start, 5 * b - gap AS train_end, 5 * b AS test_start, n AS test_end)))""")


def test_windows(folds: DataFrame) -> DataFrame:
    """Fold test ranges as signal windows; ``own_lo`` is the first bar no earlier fold tests."""
    prev = "coalesce(max(test_end) OVER (PARTITION BY symbol ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"
    return folds.selectExpr("symbol", "fold AS grp", "test_start AS lo_idx", "test_end AS end_idx", f"greatest(test_start, {prev}) AS own_lo")


def fold_trades(prep: DataFrame, strategies: list[Strategy], folds: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Trades per (strategy, fold, symbol): signals only inside the test window, history from before it.

    ``pairs`` (strategy, symbol): nothing is labelled for others.

    A position still open at the window's end is marked at the last close less costs.
    """
    windows = test_windows(folds).drop("own_lo")
    events = O.entries(prep, strategies, windows)
    events = events if pairs is None else events.join(pairs, ["strategy", "symbol"], "left_semi")
    lab = O.label(events, O.path_bars(prep, strategies), strategies)
    t = select_trades(lab, {i: s.cooldown for i, s in enumerate(strategies)}, {i: s.max_losses for i, s in enumerate(strategies)})
    marked = "dir * (last_close / entry_price - 1) - (2 * fee + slip) / 1e4D"
    return t.withColumn("pnl", F.expr(f"CASE WHEN reason = 'end_of_data' THEN {marked} ELSE pnl END"))


def fold_metrics(trades: DataFrame, keys: list[str] = X.SERIES) -> DataFrame:
    m = X.trade_metrics(trades, keys).join(X.compound(trades, keys), keys)
    dd = X.trade_drawdown(trades, keys, "entry_idx", "entry_idx div 65536")
    return m.join(dd, keys).withColumn("fold_score", F.expr("trades * mean_pnl - 0.5D * max_dd + expectancy"))


def fold_equity(trades: DataFrame, folds: DataFrame, bars: DataFrame, strategies: list[Strategy], horizon: int, pairs: DataFrame | None = None) -> DataFrame:
    """Marked equity of every fold, 1 at its first bar."""
    names = F.explode(F.array(*[F.lit(s.name) for s in strategies]))
    spans = test_windows(folds).drop("own_lo").withColumn("strategy", names)
    return X.equity(trades, spans if pairs is None else spans.join(pairs, ["strategy", "symbol"], "left_semi"), bars, horizon)


def stitch(fold_eq: DataFrame, folds: DataFrame) -> DataFrame:
    """Chain folds into one curve; a bar belongs to the first fold that tests it."""
    owned = fold_eq.join(test_windows(folds).select("symbol", "grp", "own_lo"), ["symbol", "grp"]).filter("bar_idx >= own_lo")
    last = owned.groupBy(*X.SERIES).agg(F.max_by("equity", "bar_idx").alias("_last"))
    before = "OVER (PARTITION BY strategy, symbol ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    safe = "CASE WHEN isnan(_last) OR _last < 0 THEN 0D ELSE _last END"
    scale = last.selectExpr(*X.SERIES, f"""CASE WHEN coalesce(min({safe}) {before}, 1D) <= 0 THEN 0D
        ELSE coalesce(exp(sum(ln(nullif({safe}, 0))) {before}), 1D) END AS _scale""")
    return owned.join(scale, X.SERIES).selectExpr(*X.SERIES, "bar_idx", "close_ms", "equity * _scale AS equity")


def fold_distribution(trades: DataFrame, folds: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """Fewest trades in a fold and share of folds without any."""
    names = F.explode(F.array(*[F.lit(s.name) for s in strategies]))
    grid = folds.select("symbol", F.col("fold").alias("grp")).withColumn("strategy", names)
    n = trades.groupBy(*X.SERIES).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, X.SERIES, "left").na.fill(0, ["n"]).groupBy("strategy", "symbol").agg(
        F.count(F.lit(1)).alias("folds"), F.min("n").alias("min_trades_fold"),
        F.count_if(F.col("n") == 0).alias("zero_folds"),
        (F.count_if(F.col("n") == 0) / F.count(F.lit(1))).alias("zero_fold_ratio"))


def oos_summary(stitched: DataFrame, trades: DataFrame, folds: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """One row per (strategy, symbol): months, drawdown, trade quality, fold spread."""
    keys = ["strategy", "symbol"]
    own = trades.join(test_windows(folds).select("symbol", "grp", "own_lo"), ["symbol", "grp"]).filter("entry_idx >= own_lo")
    months = X.month_summary(X.monthly(stitched, own, keys), keys)
    dd = X.equity_drawdown(stitched, keys)
    quality = X.trade_metrics(own, keys).select(
        *keys, "trades", F.col("mean_pnl").alias("oos_expectancy"), "oos_profit_factor", "win_rate")
    return (
        months.join(dd, keys).join(quality, keys, "left").na.fill(0, ["trades"])
        .join(fold_distribution(trades, folds, strategies), keys)
    )


def walk_forward(bars: DataFrame, strategies: list[Strategy], folds: DataFrame, pairs: DataFrame | None = None):
    """(fold trades, fold equity, stitched equity), each written once; with ``pairs``, only of these (strategy, symbol)."""
    prep = materialize(O.prepared(bars, strategies), "prepared")
    trades = materialize(fold_trades(prep, strategies, folds, pairs), "fold-trades")
    horizon = max([s.max_hold for s in strategies] + [trades.agg(F.max(F.expr("exit_idx - entry_idx"))).first()[0] or 0]) + 1
    eq = materialize(fold_equity(trades, folds, bars, strategies, horizon, pairs), "fold-equity")
    return trades, eq, stitch(eq, folds)
