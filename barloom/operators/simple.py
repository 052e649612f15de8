"""The simple engine: percentage stop and target, exits by rule or time at the close, flat cost.

A signal at bar t enters at the open of t+1 without slippage. From t+2 on a bar
is checked for the stop (filled at its price), the target (at its price), the
exit rule and the longest hold (both at that bar's close), in this order. After
an exit the next signal is looked for from the next bar on. A position that is
still open at the end gives no trade, but keeps later signals out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import _apply, lag, tiled_features
from ..functions.rules import apply_rules
from ..plans.strategy import Strategy
from ..session import materialize
from .outcomes import MOST_SPAN, _sql, next_bars
from .selection import select_trades
from .tiling import Tiles, drop_halo

# First bar that may signal, bars that a series must have, exit reasons in the order of their checks.
WARMUP, LEAST = 200, 300
REASONS = {1: "H-SL", 2: "H-TP", 3: "EXIT RULE", 4: "H-MAX"}


def _percent(side: tuple | None) -> str:
    """A stop or target in percent; none, or zero, is no limit."""
    if side and side[0] != "fixed":
        raise ValueError("the simple engine takes percentages only")
    return _sql(side[1] if side and side[1] > 0 else None)


def labels(bars: DataFrame, strategies: list[Strategy], tiles: Tiles = Tiles()) -> DataFrame:
    """Outcome of every signal on its own; ``reason`` is NULL where the data end first."""
    rules = {f"ent_{i}": s.entry for i, s in enumerate(strategies)} | {f"out_{i}": s.exit for i, s in enumerate(strategies) if s.exit is not None}
    t = apply_rules(tiled_features(bars, list(dict.fromkeys(f for s in strategies for f in s.features())), tiles), rules)
    t = _apply(t, {f"was_{i}": f"coalesce({lag(f'ent_{i}')}, false)" for i in range(len(strategies))}, {f"was_{i}" for i in range(len(strategies))})
    outs = ", ".join(f"coalesce(out_{i}, false)" if s.exit is not None else "false" for i, s in enumerate(strategies))
    rows = ", ".join(
        f"CASE WHEN was_{i} THEN struct('{s.name}' AS strategy, {i} AS sid, {s.direction} AS dir, {_percent(s.stop)} AS sl, {_percent(s.target)} AS tp, "
        f"{_sql(s.fee_bps + s.slip_bps)} AS cost, {s.max_hold} AS max_hold) END" for i, s in enumerate(strategies))
    t = drop_halo(t, tiles.size).selectExpr("symbol", "bar_idx", "open_ms", "open", "high", "low", "close", f"array({outs}) AS outs", f"array({rows}) AS events")
    t = materialize(t, "simple-bars")
    sizes = t.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST)
    ev = t.filter(F.col("bar_idx") > WARMUP).selectExpr("symbol", "bar_idx AS entry_idx", "open_ms AS entry_ms", "open AS entry_price", "explode(filter(events, x -> x IS NOT NULL)) AS s")
    ev = ev.select("symbol", "entry_idx", "entry_ms", "entry_price", "s.*").join(sizes, "symbol")
    ev = ev.selectExpr("*", "entry_price * (1 - dir * sl / 100) AS stop", "entry_price * (1 + dir * tp / 100) AS target", "1L AS seen")
    path = t.drop("events")
    holds = [s.max_hold for s in strategies if s.max_hold > 0]
    span, todo, done = max(holds) + 1 if len(holds) == len(strategies) else 256, ev, None
    keys = ["symbol", "bucket", "sid", "entry_idx"]
    while True:
        j = next_bars(todo, path, span, "entry_idx + seen").selectExpr("*", """CASE
            WHEN CASE WHEN dir = 1 THEN low ELSE -high END <= dir * stop THEN 1
            WHEN CASE WHEN dir = 1 THEN high ELSE -low END >= dir * target THEN 2
            WHEN outs[sid] THEN 3 WHEN max_hold > 0 AND pos >= max_hold THEN 4 END AS code""")
        j = j.selectExpr("*", "CASE WHEN code IS NOT NULL THEN bar_idx END AS hit", "CASE code WHEN 1 THEN stop WHEN 2 THEN target ELSE close END AS px")
        same = [c for c in ev.columns if c not in keys]
        out = materialize(j.groupBy(*keys).agg(*[F.first(c).alias(c) for c in same], F.min("hit").alias("exit_idx"), F.min_by("code", "hit").alias("code"),
                                               F.min_by("px", "hit").alias("exit_price"), F.max("bar_idx").alias("last")), "simple-pass").drop("bucket")
        names = "map(" + ", ".join(f"{k}, '{v}'" for k, v in REASONS.items()) + ")"
        ended = out.filter("exit_idx IS NOT NULL OR last >= n - 1").selectExpr(
            "strategy", "sid", "0L AS grp", "symbol", "dir", "entry_idx - 1 AS signal_idx", "entry_idx", "entry_ms", "entry_price", "stop", "target",
            "coalesce(exit_idx, n) AS exit_idx", "exit_price", f"element_at({names}, code) AS reason", "dir * (exit_price / entry_price - 1) * 100 - 2 * cost / 1e4D AS pnl")
        done = ended if done is None else done.unionByName(ended)
        rest = out.filter("exit_idx IS NULL AND last < n - 1")
        if rest.isEmpty():
            break
        todo, span = rest.withColumn("seen", F.col("last") + 1 - F.col("entry_idx")).select(*ev.columns), min(2 * span, MOST_SPAN)
    # A signal on the bar before the last enters there and has no bar to leave on.
    late = ev.filter(F.col("entry_idx") == F.col("n") - 1).selectExpr(
        "strategy", "sid", "0L AS grp", "symbol", "dir", "entry_idx - 1 AS signal_idx", "entry_idx", "entry_ms", "entry_price", "stop", "target", "n AS exit_idx",
        "CAST(NULL AS DOUBLE) AS exit_price", "CAST(NULL AS STRING) AS reason", "CAST(NULL AS DOUBLE) AS pnl")
    return done.unionByName(late)


def trades(bars: DataFrame, strategies: list[Strategy], tiles: Tiles = Tiles()) -> DataFrame:
    """Trades in percent of the entry price, one position at a time."""
    ids = range(len(strategies))
    return select_trades(labels(bars, strategies, tiles), {i: 0 for i in ids}, {i: 0 for i in ids}).filter("reason IS NOT NULL")
