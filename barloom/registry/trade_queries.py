"""Signals, outcomes, selection and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outcomes as X
from ..operators.selection import select_trades
from ..operators import simple as simple_engine
from ..operators import timeline as TL
from ..plans.strategy import PRESETS, SIMPLE_PRESETS, Strategy
from ..session import materialize
from . import sqlkit as Q
from .common import Registry, bars_of, rounded
from .rule_queries import RULES, twin
from .trade_sql import labels_cte, simple_cte, trades_cte

# Strategies used across the queries.
LONG = Strategy(
    "trend_long", RULES["tree_or"], exit=("LT", "RSI14", 35.0), regime=("GT", "ADX", 8.0), stop=("atr", 0.5),
    target=("atr", 1.5), trail=("atr", 0.4), max_hold=24, cooldown=3, vol_threshold=0.8)
SHORT = Strategy(
    "fade_short", ("CrossDown", "EMA10", "EMA20"), direction=-1, stop=("swing", 3), target=None, trail=("swing",),
    max_hold=30, max_losses=3)
WIDE = Strategy(
    "wide_long", ("Rising", "EMA10", 2), stop=("fixed", 95.0), target=("fixed", 300.0), max_hold=40, cooldown=2, max_losses=4)
OPEN_END = Strategy("no_clock", RULES["cross_up"], exit=("CrossDown", "EMA10", "EMA20"), stop=("fixed", 99.0), target=None, max_hold=0)
BOOK = [LONG, SHORT, WIDE]
MONEY = ["entry_price", "stop", "target", "exit_price", "pnl"]


def labels(spark, d, strategies=BOOK, source="events", columns=None):
    return X.outcomes(bars_of(spark, d, source, columns=columns), strategies)


def book_trades(spark, d, strategies=BOOK, source="events", columns=None, keep=None):
    """Selected trades of a strategy book, from bars of ``columns`` and with label columns ``keep`` only, if they are given."""
    lab = labels(spark, d, strategies, source, columns)
    lab = lab if keep is None else lab.select("sid", "grp", *keep)
    return select_trades(
        lab, {i: s.cooldown for i, s in enumerate(strategies)}, {i: s.max_losses for i, s in enumerate(strategies)})


COLS = ["symbol", "strategy", "signal_idx", "entry_idx", "exit_idx", "entry_price", "stop", "target", "exit_price", "reason", "pnl", "hold"]


def shown(df, cols=COLS, digits=6):
    return rounded(df.select(*cols), [c for c in cols if c in MONEY], digits)


def show_sql(ctes, table, cols=COLS, digits=6):
    return f"WITH RECURSIVE {ctes} SELECT " + ", ".join(
        f"CAST(round({c}, {digits}) AS DOUBLE) + 0.0 AS {c}" if c in MONEY else c for c in cols) + f" FROM {table}"


def entry_points(spark, d):
    prep = materialize(X.prepared(bars_of(spark, d), BOOK), "prepared")
    ev = X.entries(prep, BOOK)
    return rounded(ev.select("symbol", "strategy", "entry_idx", "entry_price", "stop", "target"), MONEY)


def with_trades(fn, strategies=BOOK):
    """Run ``fn(spark, trades, bars)`` with both sides written once."""
    def run(spark, d):
        bars = materialize(bars_of(spark, d), "bars")
        lab = X.outcomes(bars, strategies)
        t = select_trades(lab, {i: s.cooldown for i, s in enumerate(strategies)},
                          {i: s.max_losses for i, s in enumerate(strategies)})
        return fn(spark, materialize(t, "trades"), bars)
    return run


def with_states(fn, strategies=BOOK, prep_too=False):
    """Run ``fn(spark, trades, bars, states)`` with the state of every bar of every series; with ``prep_too`` also the book's tiled frame."""
    def run(spark, d):
        bars = materialize(bars_of(spark, d), "bars")
        prep = materialize(X.prepared(bars, strategies), "prepared")
        ids = range(len(strategies))
        lab = X.label(X.entries(prep, strategies), X.path_bars(prep, strategies), strategies)
        t = materialize(select_trades(lab, {i: strategies[i].cooldown for i in ids}, {i: strategies[i].max_losses for i in ids}), "trades")
        return fn(spark, t, bars, TL.bar_states(TL.timeline(prep, t, strategies)), *[prep] * prep_too)
    return run


def states_sql(strategies) -> str:
    """CTEs up to ``states``: one row per bar and strategy."""
    vol = lambda s: "TRUE" if s.vol_threshold is None else f"(ATR14_SMA50 <= 0 OR ATR14 >= {s.vol_threshold} * ATR14_SMA50)"
    each = " UNION ALL ".join(
        f"SELECT symbol, bar_idx, open_ms, '{s.name}' AS strategy, {i} AS sid, {s.cooldown} AS cool, {s.max_losses} AS cap, {s.warmup} AS warm, Active > 0 AND g_{i} AND w_{i} AS gate, sig_{i} AS sig FROM gx"
        for i, s in enumerate(strategies))
    cols = ", ".join(f"{twin(s.regime)} AS g_{i}, {vol(s)} AS w_{i}" for i, s in enumerate(strategies))
    return f"""{trades_cte(strategies)}, gx AS MATERIALIZED (SELECT sg.*, {cols} FROM sg), gl AS ({each}),
tn AS (SELECT *, sum(CASE WHEN pnl >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sid, symbol ORDER BY signal_idx) AS wins FROM trades),
tail AS (SELECT sid, symbol, max(exit_idx) AS last_exit, count(*) FILTER (WHERE wins = top) - CASE WHEN max(wins) > 0 THEN 1 ELSE 0 END AS lost
  FROM (SELECT *, max(wins) OVER (PARTITION BY sid, symbol) AS top FROM tn) GROUP BY sid, symbol),
sizes AS (SELECT symbol, count(*) AS n FROM f GROUP BY symbol),
states AS MATERIALIZED (SELECT g.symbol, g.strategy, g.bar_idx, g.open_ms, CASE WHEN t.sid IS NOT NULL THEN
    CASE WHEN g.bar_idx = signal_idx THEN 'signal,pending,flat' WHEN g.bar_idx > exit_idx THEN 'cooldown' WHEN entry_idx = exit_idx THEN 'enter,exit_' || reason
      WHEN g.bar_idx = entry_idx THEN 'enter' WHEN g.bar_idx = exit_idx THEN 'exit_' || reason ELSE 'holding' END
  WHEN NOT gate THEN 'filtered' WHEN NOT sig THEN 'flat' WHEN cap > 0 AND lost >= cap AND g.bar_idx > last_exit THEN 'busted,flat' WHEN g.bar_idx < warm THEN 'signal_warmup,flat'
  WHEN g.bar_idx + 1 >= n THEN 'signal_skipped_end_of_data,flat' ELSE 'flat' END AS st
  FROM gl g JOIN sizes USING (symbol) LEFT JOIN tail l ON l.sid = g.sid AND l.symbol = g.symbol
  LEFT JOIN trades t ON t.sid = g.sid AND t.symbol = g.symbol AND g.bar_idx BETWEEN t.signal_idx AND t.exit_idx + g.cool)"""


STATES_SQL = states_sql(BOOK)
HOLD = max(s.max_hold for s in BOOK) + 1


def register(reg: Registry) -> None:
    reg.add("o02_o05_entries", entry_points, show_sql(
        labels_cte(BOOK), "ev", ["symbol", "strategy", "entry_idx", "entry_price", "stop", "target"]))
    reg.add("j05_o06_o09_labels", lambda s, d: shown(labels(s, d)), show_sql(labels_cte(BOOK), "lab"))
    reg.add("o08_open_ended", lambda s, d: shown(labels(s, d, [OPEN_END])), show_sql(labels_cte([OPEN_END]), "lab"))
    reg.add("o10_trades", lambda s, d: shown(book_trades(s, d)), show_sql(trades_cte(BOOK), "trades"))
    reg.add("o15_presets", lambda s, d: shown(book_trades(s, d, PRESETS)), show_sql(trades_cte(PRESETS), "trades"))
    simple = ["symbol", "strategy", "signal_idx", "entry_idx", "exit_idx", "entry_price", "stop", "target", "exit_price", "reason", "pnl"]
    for name, source in (("o15_simple", "orders"), ("o15_simple_hourly", "events")):
        reg.add(name, lambda s, d, source=source: shown(simple_engine.trades(bars_of(s, d, source), SIMPLE_PRESETS), simple),
                show_sql(simple_cte(SIMPLE_PRESETS, source), "trades WHERE reason IS NOT NULL", simple))
    reg.add("o10_supplier_trades", lambda s, d: shown(book_trades(s, d, [WIDE], "lineitem", ["open", "high", "low", "close", "volume"], COLS), digits=9),
            show_sql(trades_cte([WIDE], "lineitem"), "trades", digits=9))
    reg.add("o11_excursions",
            with_trades(lambda s, t, b: rounded(X.excursions(t, b, HOLD), ["mfe", "mae"])),
            f"""WITH RECURSIVE {trades_cte(BOOK)} SELECT t.symbol, t.strategy, t.entry_idx,
            CAST(round(max(CASE WHEN dir = 1 THEN b.high / entry_price - 1 ELSE 1 - b.low / entry_price END), 6) AS DOUBLE) + 0.0 AS mfe,
            CAST(round(min(CASE WHEN dir = 1 THEN b.low / entry_price - 1 ELSE 1 - b.high / entry_price END), 6) AS DOUBLE) + 0.0 AS mae
            FROM trades t JOIN bars b ON b.symbol = t.symbol AND b.bar_idx BETWEEN t.entry_idx AND t.exit_idx GROUP BY ALL""")
    reg.add("o12_invariants", with_trades(lambda s, t, b: X.violations(t)), f"""WITH RECURSIVE {trades_cte(BOOK)}
        SELECT strategy, count(*) AS trades, count(*) FILTER (WHERE entry_idx <> signal_idx + 1) AS late_entry,
        count(*) FILTER (WHERE exit_idx < entry_idx) AS early_exit, count(*) FILTER (WHERE NOT (entry_price > 0 AND exit_price > 0)) AS bad_price,
        count(*) FILTER (WHERE reason = '') AS no_reason, count(*) FILTER (WHERE dir * (entry_price - stop) <= 0) AS stop_side,
        count(*) FILTER (WHERE dir * (target - entry_price) <= 0) AS target_side, count(*) FILTER (WHERE pnl <= -100 OR pnl >= 1000) AS pnl_bounds,
        count(*) FILTER (WHERE hold <= 0) AS bad_hold, count(*) FILTER (WHERE end_idx <= exit_idx) AS past_end FROM trades GROUP BY strategy""")
    reg.add("o13_bar_states", with_states(lambda s, t, b, states: states.select("symbol", "strategy", "bar_idx", F.array_join("states", ",").alias("states"))),
            f"""WITH RECURSIVE {STATES_SQL} SELECT symbol, strategy, bar_idx, st AS states FROM states""")
    reg.add("o14_context",
            with_trades(lambda s, t, b: rounded(X.context(t, b, ["close", "volume"], HOLD), ["close", "volume"])),
            f"""WITH RECURSIVE {trades_cte(BOOK)} SELECT t.symbol, t.strategy, t.entry_idx, b.bar_idx, b.bar_idx - t.entry_idx AS pos,
            {Q.rounded(["close", "volume"]).replace("round(close", "round(b.close").replace("round(volume", "round(b.volume")}
            FROM trades t JOIN bars b ON b.symbol = t.symbol AND b.bar_idx BETWEEN t.entry_idx - 1 AND t.exit_idx + 1""")
