"""Aggregations, equity, walk-forward and time joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import metrics as X
from ..plans import walkforward as WF
from ..plans.strategy import Strategy
from ..session import materialize
from ..sources.bars import DAY_MS, HOUR_MS
from . import sqlkit as Q
from .common import Registry, bars_of, rounded, table
from .rule_queries import RULES
from .trade_queries import BOOK, HOLD, with_trades
from .trade_sql import trades_cte

# --- a trade ledger read straight from the orders table ---------------------
# strategy = customer, one trade per order.

LEDGER_SQL = """ledger AS (SELECT CAST(o_custkey AS VARCHAR) AS strategy, epoch_ms(o_orderdate) AS exit_ms, o_orderkey AS trade_no,
  (o_totalprice % 1000 - 480) / 10000 AS pnl, o_orderkey % 120 + 1 AS hold, o_orderpriority AS reason,
  year(o_orderdate) AS fold FROM orders)"""
BY = ["strategy"]
# Days, split further by key range: order dates have no time of day, so one day of one
# strategy may be large.
LEDGER_PART = f"exit_ms div {DAY_MS} * (1L << 40) + trade_no div 4000000"


def ledger(spark, d):
    o = table(spark, d, "orders")
    return o.selectExpr(
        "CAST(o_custkey AS STRING) AS strategy", "unix_millis(CAST(o_orderdate AS TIMESTAMP)) AS exit_ms", "o_orderkey AS trade_no",
        "(o_totalprice % 1000 - 480) / 10000 AS pnl", "o_orderkey % 120 + 1 AS hold", "o_orderpriority AS reason",
        "year(o_orderdate) AS fold")


def ledger_dd(spark, d):
    return X.trade_drawdown(ledger(spark, d), BY, "exit_ms, trade_no", LEDGER_PART)


R = lambda c, n=6: f"CAST(round({c}, {n}) AS DOUBLE) + 0.0"
METRICS_SQL = f"""WITH {LEDGER_SQL}, m AS (SELECT strategy, count(*) AS trades, count(*) FILTER (WHERE pnl > 0) AS wins,
  count(*) FILTER (WHERE pnl <= 0) AS losses, sum(hold) AS hold_bars, max(hold) AS max_hold, avg(hold) AS avg_hold,
  coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) AS won, coalesce(-sum(pnl) FILTER (WHERE pnl <= 0), 0) AS lost, avg(pnl) AS mean_pnl
  FROM ledger GROUP BY strategy),
n AS (SELECT *, wins / trades AS win_rate, CASE WHEN wins > 0 THEN won / wins ELSE 0 END AS avg_win,
  CASE WHEN losses > 0 THEN lost / losses ELSE 0 END AS avg_loss,
  CASE WHEN losses = 0 THEN won / wins WHEN wins = 0 THEN -lost / losses
    ELSE (won / wins) * (wins / trades) - (lost / losses) * (1 - wins / trades) END AS expectancy,
  CASE WHEN lost > 0 THEN won / lost WHEN won > 0 THEN 999 ELSE 1 END AS profit_factor,
  CASE WHEN lost > 0 THEN won / lost WHEN won > 0 THEN 999 ELSE 0 END AS oos_profit_factor FROM m)"""
FLOATS = ["avg_hold", "won", "lost", "mean_pnl", "win_rate", "avg_win", "avg_loss", "expectancy", "profit_factor", "oos_profit_factor"]
DD_SQL = """c AS (SELECT strategy, exit_ms, trade_no, exp(sum(ln(1 + pnl)) OVER (PARTITION BY strategy ORDER BY exit_ms, trade_no)) AS eq FROM ledger),
p AS (SELECT *, greatest(1.0, max(eq) OVER (PARTITION BY strategy ORDER BY exit_ms, trade_no)) AS top FROM c),
dd AS (SELECT strategy, greatest(0.0, max((top - eq) / top)) AS max_dd FROM p GROUP BY strategy)"""

# --- equity of the strategy book ----------------------------------------------

EQ_SQL = """eq0 AS (SELECT s.strategy, s.grp, b.symbol, b.bar_idx, b.close_ms, b.close FROM bars b
    JOIN (SELECT DISTINCT strategy, grp, symbol FROM trades) s USING (symbol)),
eq AS MATERIALIZED (SELECT e.strategy, e.grp, e.symbol, e.bar_idx, e.close_ms,
    coalesce(product(1 + x.pnl) OVER (PARTITION BY e.strategy, e.grp, e.symbol ORDER BY e.bar_idx), 1.0)
    * coalesce(1 + m.dir * (e.close / m.entry_price - 1), 1.0) AS equity
  FROM eq0 e LEFT JOIN trades x ON x.strategy = e.strategy AND x.grp = e.grp AND x.symbol = e.symbol AND x.exit_idx + 1 = e.bar_idx
  LEFT JOIN trades m ON m.strategy = e.strategy AND m.grp = e.grp AND m.symbol = e.symbol AND e.bar_idx > m.entry_idx AND e.bar_idx <= m.exit_idx)"""


def _book_equity(s, t, b):
    spans = t.select(*X.SERIES).distinct().join(
        b.groupBy("symbol").agg((F.max("bar_idx") + 1).alias("end_idx")), "symbol").withColumn("lo_idx", F.lit(0).cast("long"))
    return X.equity(t, spans, b, HOLD)


def equity_query(s, t, b):
    return rounded(_book_equity(s, t, b).select(*X.SERIES, "bar_idx", "equity"), ["equity"], 2)


def smooth_query(s, t, b):
    eq = materialize(_book_equity(s, t, b), "equity")
    out = X.equity_drawdown(eq, X.SERIES).join(X.smoothness(eq, X.SERIES), X.SERIES)
    return rounded(out, ["max_dd", "smooth_vol", "downside_vol"])


SMOOTH_SQL = f"""WITH RECURSIVE {trades_cte(BOOK)}, {EQ_SQL},
q AS MATERIALIZED (SELECT *, row_number() OVER k - 1 AS i, coalesce(CASE WHEN lag(equity) OVER k > 0 THEN equity / lag(equity) OVER k - 1 END, 0) AS r,
  max(equity) OVER k AS top FROM eq WINDOW k AS (PARTITION BY strategy, grp, symbol ORDER BY bar_idx)),
z AS (SELECT strategy, grp, symbol, i, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS v FROM q WHERE i = 0 UNION ALL
  SELECT q.strategy, q.grp, q.symbol, q.i, z.m + 2 / 51 * (q.r - z.m), z.v + 2 / 51 * ((q.r - z.m) * (q.r - z.m) - z.v)
  FROM z JOIN q ON q.strategy = z.strategy AND q.grp = z.grp AND q.symbol = z.symbol AND q.i = z.i + 1)
SELECT strategy, grp, symbol, {R('max((top - equity) / top)')} AS max_dd, {R('sqrt(arg_max(v, i))')} AS smooth_vol,
  {R('coalesce(sqrt(avg(r * r) FILTER (WHERE r < -1e-12)), 0)')} AS downside_vol
FROM q JOIN z USING (strategy, grp, symbol, i) GROUP BY strategy, grp, symbol"""

STATE_SQL = f"""WITH {Q.bars_cte()}, s AS (SELECT symbol, bar_idx, close, close_ms, close > open AS pos,
  coalesce(lag(close > open) OVER (PARTITION BY symbol ORDER BY bar_idx), FALSE) AS was FROM bars),
t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_idx) - 1 AS turn FROM s WHERE pos <> was),
p AS (SELECT symbol, arg_min(close, bar_idx) AS bought, arg_max(close, bar_idx) AS sold, max(close_ms) AS exit_ms
  FROM t GROUP BY symbol, turn // 2 HAVING count(*) = 2)
SELECT symbol, strftime(make_timestamp_ms(exit_ms), '%Y-%m') AS month, count(*) AS trades,
  {R('exp(sum(ln(abs(sold / bought - 0.003)))) * CASE WHEN count(*) FILTER (WHERE sold / bought < 0.003) % 2 = 1 THEN -1 ELSE 1 END - 1', 3)} AS ret
FROM p GROUP BY ALL"""

# --- walk-forward on daily order bars ------------------------------------------

# Strategies and fold lengths of the walk-forward queries.
WF_BOOK = [
    Strategy("wf_cross", RULES["cross_up"], exit=("CrossDown", "EMA10", "EMA20"), stop=("fixed", 60.0), target=("fixed", 60.0), max_hold=20),
    Strategy("wf_dip", ("AND", ("LT", "RSI14", 50.0), ("Rising", "EMA10", 1)), regime=("GT", "ADX", 8.0), stop=("atr", 1.5),
             target=("atr", 1.5), trail=("atr", 1.2), max_hold=12, cooldown=2),
]
def folds_sql(train: int, test: int, step: int) -> str:
    """CTEs ``folds`` and ``win``: rolling folds of so many days."""
    whole, step_ms = (train + test) * DAY_MS, step * DAY_MS
    return f"""span AS (SELECT symbol, min(close_ms) AS t0, max(close_ms) AS t1 FROM bars GROUP BY symbol),
fk AS (SELECT symbol, t0, unnest(range(0, (t1 - t0 - {whole}) // {step_ms} + 1)) AS fold FROM span WHERE t1 - t0 >= {whole}),
ft AS (SELECT symbol, fold, t0 + fold * {step_ms} AS a, t0 + fold * {step_ms} + {train * DAY_MS} AS b, t0 + fold * {step_ms} + {whole} AS c FROM fk),
folds AS MATERIALIZED (SELECT f.symbol, f.fold, count(*) FILTER (WHERE close_ms < a) AS train_start, count(*) FILTER (WHERE close_ms < b) AS train_end,
  count(*) FILTER (WHERE close_ms < b) AS test_start, count(*) FILTER (WHERE close_ms < c) AS test_end
  FROM ft f JOIN bars USING (symbol) GROUP BY f.symbol, f.fold),
win AS (SELECT symbol, fold AS grp, test_start, test_end, greatest(test_start, coalesce(max(test_end) OVER (PARTITION BY symbol ORDER BY fold
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS own_lo FROM folds)"""


FOLDS_SQL = folds_sql(360, 90, 60)
_names = ", ".join(f"('{s.name}')" for s in WF_BOOK)


def wf_sql(book: list[Strategy], folds: str, names: str) -> str:
    """CTEs up to fold trades, stitched equity and months; ``names``: the strategies that get equity."""
    return f"""{trades_cte(book, 'orders', folds).replace("trades AS MATERIALIZED", "closed AS MATERIALIZED")},
trades AS MATERIALIZED (SELECT c.* REPLACE (CASE WHEN reason = 'end_of_data' THEN c.dir * (b.close / entry_price - 1) - (2 * fee + slip) / 1e4
  ELSE pnl END AS pnl) FROM closed c JOIN bars b ON b.symbol = c.symbol AND b.bar_idx = c.end_idx - 1),
eq0 AS (SELECT s.strategy, w.grp, b.symbol, b.bar_idx, b.close_ms, b.close, w.own_lo FROM win w JOIN bars b ON b.symbol = w.symbol
  AND b.bar_idx >= w.test_start AND b.bar_idx < w.test_end, (VALUES {names}) s(strategy)),
eq AS MATERIALIZED (SELECT e.strategy, e.grp, e.symbol, e.bar_idx, e.close_ms, e.own_lo,
    coalesce(product(1 + x.pnl) OVER (PARTITION BY e.strategy, e.grp, e.symbol ORDER BY e.bar_idx), 1.0)
    * coalesce(1 + m.dir * (e.close / m.entry_price - 1), 1.0) AS equity
  FROM eq0 e LEFT JOIN trades x ON x.strategy = e.strategy AND x.grp = e.grp AND x.symbol = e.symbol AND x.exit_idx + 1 = e.bar_idx
  LEFT JOIN trades m ON m.strategy = e.strategy AND m.grp = e.grp AND m.symbol = e.symbol AND e.bar_idx > m.entry_idx AND e.bar_idx <= m.exit_idx),
own AS (SELECT * FROM eq WHERE bar_idx >= own_lo),
lastq AS (SELECT strategy, grp, symbol, arg_max(equity, bar_idx) AS l FROM own GROUP BY ALL),
sc AS (SELECT strategy, grp, symbol, coalesce(product(greatest(l, 0)) OVER (PARTITION BY strategy, symbol ORDER BY grp
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS scale FROM lastq),
st AS MATERIALIZED (SELECT strategy, grp, symbol, bar_idx, close_ms, equity * scale AS equity FROM own JOIN sc USING (strategy, grp, symbol)),
ownt AS (SELECT t.* FROM trades t JOIN win w ON w.symbol = t.symbol AND w.grp = t.grp WHERE t.entry_idx >= w.own_lo),
mo0 AS (SELECT *, strftime(make_timestamp_ms(close_ms), '%Y-%m') AS month FROM st),
mo1 AS (SELECT *, max(equity) OVER (PARTITION BY strategy, symbol, month ORDER BY bar_idx) AS top FROM mo0),
mo2 AS (SELECT strategy, symbol, month, arg_min(equity, bar_idx) AS start_eq, arg_max(equity, bar_idx) AS end_eq, max(CASE WHEN top > 1e-9 THEN 1 - equity / top ELSE 0 END) AS dd
  FROM mo1 GROUP BY ALL),
mt AS (SELECT strategy, symbol, strftime(make_timestamp_ms(entry_ms), '%Y-%m') AS month, count(*) AS n FROM ownt GROUP BY ALL),
mo AS MATERIALIZED (SELECT m.*, coalesce(n, 0) AS trades, CASE WHEN start_eq > 1e-9 THEN end_eq / start_eq - 1 ELSE 0 END AS ret FROM mo2 m LEFT JOIN mt USING (strategy, symbol, month)),
fd AS (SELECT s.strategy, w.symbol, w.grp, count(t.symbol) AS n FROM win w CROSS JOIN (VALUES {names}) s(strategy)
  LEFT JOIN trades t ON t.strategy = s.strategy AND t.symbol = w.symbol AND t.grp = w.grp GROUP BY ALL),
fds AS (SELECT strategy, symbol, count(*) AS folds, min(n) AS min_trades_fold, count(*) FILTER (WHERE n = 0) AS zero_folds,
  count(*) FILTER (WHERE n = 0) / count(*) AS zero_fold_ratio FROM fd GROUP BY ALL)"""


WF_SQL = wf_sql(WF_BOOK, FOLDS_SQL, _names)
MONTHS_SQL = """ms AS (SELECT strategy, symbol, count(*) AS months, sum(trades) AS month_trades, CASE WHEN bool_or(ret <= -1) THEN -1 ELSE exp(avg(ln(1 + ret)) FILTER (WHERE ret > -1)) - 1 END AS geo_monthly,
  CASE WHEN bool_or(ret <= -1) THEN -1 ELSE coalesce(exp(avg(ln(1 + ret)) FILTER (WHERE ret > -1 AND (trades > 0 OR abs(ret) > 0.001))) - 1, 0) END AS active_geo_monthly, median(ret) AS median_month,
  coalesce(median(ret) FILTER (WHERE trades > 0 OR abs(ret) > 0.001), 0) AS median_active, coalesce(stddev_samp(ret), 0) AS std_month,
  avg(ret) AS mean_month, min(ret) AS min_month, max(ret) AS max_month, min(trades) AS min_trades_month,
  count(*) FILTER (WHERE trades > 0 OR abs(ret) > 0.001) / count(*) AS active_ratio, count(*) FILTER (WHERE trades = 0) / count(*) AS sparse_ratio
  FROM mo GROUP BY ALL)"""
MONTH_FLOATS = ["geo_monthly", "active_geo_monthly", "median_month", "median_active", "std_month", "mean_month", "min_month", "max_month",
                "active_ratio", "sparse_ratio"]
OOS_SQL = f"""{MONTHS_SQL}, ed AS (SELECT strategy, symbol, max(CASE WHEN top > 1e-9 THEN (top - equity) / top ELSE 0 END) AS max_dd FROM
    (SELECT *, max(equity) OVER (PARTITION BY strategy, symbol ORDER BY bar_idx) AS top FROM st) GROUP BY ALL),
tq AS (SELECT strategy, symbol, count(*) AS trades, avg(pnl) AS oos_expectancy, CASE WHEN count(*) FILTER (WHERE pnl <= 0) > 0 THEN
    coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) / -sum(pnl) FILTER (WHERE pnl <= 0) ELSE 999 END AS oos_profit_factor,
    count(*) FILTER (WHERE pnl > 0) / count(*) AS win_rate FROM ownt GROUP BY ALL),
oos AS (SELECT ms.*, ed.max_dd, coalesce(tq.trades, 0) AS trades, oos_expectancy, oos_profit_factor, win_rate, folds, min_trades_fold, zero_folds,
    zero_fold_ratio FROM ms JOIN ed USING (strategy, symbol) LEFT JOIN tq USING (strategy, symbol) JOIN fds USING (strategy, symbol))"""
OOS_FLOATS = [*MONTH_FLOATS, "max_dd", "oos_expectancy", "oos_profit_factor", "win_rate", "zero_fold_ratio"]


def wf(spark, d):
    bars = materialize(bars_of(spark, d, "orders"), "bars")
    folds = materialize(WF.rolling_folds(bars), "folds")
    trades, eq, stitched = WF.walk_forward(bars, WF_BOOK, folds)
    return trades, eq, materialize(stitched, "stitched"), folds


def oos(spark, d):
    trades, _, st, folds = wf(spark, d)
    return WF.oos_summary(st, trades, folds, WF_BOOK)


def own_months(spark, d):
    trades, _, st, folds = wf(spark, d)
    own = trades.join(WF.test_windows(folds).select("symbol", "grp", "own_lo"), ["symbol", "grp"]).filter("entry_idx >= own_lo")
    return X.monthly(st, own, ["strategy", "symbol"])


def closed_query(spark, d):
    trades, _, _, folds = wf(spark, d)
    names = F.explode(F.array(*[F.lit(s.name) for s in WF_BOOK]))
    spans = WF.test_windows(folds).drop("own_lo").withColumn("strategy", names)
    return rounded(X.closed_equity(trades, spans, bars_of(spark, d, "orders")), ["equity"])


FOLD_METRICS_SQL = f"""k AS (SELECT *, product(1 + pnl) OVER (PARTITION BY strategy, grp, symbol ORDER BY entry_idx) AS e FROM trades),
k2 AS (SELECT *, greatest(1.0, max(e) OVER (PARTITION BY strategy, grp, symbol ORDER BY entry_idx)) AS top FROM k),
fm AS (SELECT strategy, grp, symbol, count(*) AS trades, count(*) FILTER (WHERE pnl > 0) / count(*) AS win_rate,
  product(1 + pnl) - 1 AS raw_return, greatest(0.0, max((top - e) / top)) AS max_dd, sum(pnl) AS total, avg(pnl) AS expectancy FROM k2 GROUP BY ALL)
SELECT strategy, grp, symbol, trades, {R('win_rate')} AS win_rate, {R('raw_return')} AS raw_return, {R('max_dd')} AS max_dd,
  {R('total - 0.5 * max_dd + expectancy')} AS fold_score FROM fm"""


def points_of(spark, d):
    """For every event a time up to six hours later, to be looked up on the bars of its series; some lie past the last bar."""
    return table(spark, d, "events").selectExpr(f"unix_millis(CAST(ts AS TIMESTAMP)) + event_id % 7 * {HOUR_MS} AS t", "event_type AS symbol")


def bounds_query(spark, d):
    return J.lower_bound(points_of(spark, d), materialize(bars_of(spark, d), "bars"), 64 * HOUR_MS)


def nearest_query(spark, d):
    return J.nearest(points_of(spark, d), materialize(bars_of(spark, d), "bars"), 64 * HOUR_MS)


POINTS_SQL = f"""{Q.bars_cte()}, pts AS (SELECT epoch_us(ts) // 1000 + event_id % 7 * {HOUR_MS} AS t, event_type AS symbol FROM events)"""


def register(reg: Registry) -> None:
    reg.add("a01_a02_a03_a27_ledger", lambda s, d: rounded(X.trade_metrics(ledger(s, d), BY), FLOATS),
            f"{METRICS_SQL} SELECT strategy, trades, wins, losses, CAST(hold_bars AS BIGINT) AS hold_bars, max_hold, {Q.rounded(FLOATS)} FROM n")
    reg.add("a04_exit_reasons",
            lambda s, d: rounded(X.reason_histogram(ledger(s, d), ["fold"]).select("fold", "reason", "n", "pct", F.size("reasons").alias("kinds")), ["pct"]),
            f"""WITH {LEDGER_SQL}, c AS (SELECT fold, reason, count(*) AS n FROM ledger GROUP BY ALL) SELECT CAST(fold AS INTEGER) AS fold, reason, n,
            {R('100.0 * n / sum(n) OVER (PARTITION BY fold)')} AS pct, CAST(count(*) OVER (PARTITION BY fold) AS INTEGER) AS kinds FROM c""")
    reg.add("a05_compound", lambda s, d: rounded(X.compound(ledger(s, d), BY, 0.25), ["raw_return", "risk_return"]),
            f"""WITH {LEDGER_SQL} SELECT strategy, {R('exp(sum(ln(1 + pnl))) - 1')} AS raw_return,
            {R('exp(sum(ln(1 + 0.25 * pnl))) - 1')} AS risk_return FROM ledger GROUP BY strategy""")
    reg.add("a06_trade_drawdown", lambda s, d: rounded(ledger_dd(s, d), ["max_dd"]),
            f"WITH {LEDGER_SQL}, {DD_SQL} SELECT strategy, {R('max_dd')} AS max_dd FROM dd")
    reg.add("a07_equity", with_trades(equity_query), f"""WITH RECURSIVE {trades_cte(BOOK)}, {EQ_SQL}
        SELECT strategy, CAST(grp AS BIGINT) AS grp, symbol, bar_idx, {R('equity', 2)} AS equity FROM eq""")
    reg.add("a07_a08_a09_smoothness", with_trades(smooth_query), SMOOTH_SQL)
    reg.add("a15_months_spanned",
            lambda s, d: rounded(X.months_spanned(ledger(s, d), BY, "exit_ms").join(X.compound(ledger(s, d), BY), BY).select(
                "strategy", "months", X.monthly_from_total(F.col("raw_return"), F.col("months")).alias("geo")), ["geo"]),
            f"""WITH {LEDGER_SQL}, m AS (SELECT strategy, count(DISTINCT strftime(make_timestamp_ms(exit_ms), '%Y-%m')) AS months,
            exp(sum(ln(1 + pnl))) AS g FROM ledger GROUP BY ALL) SELECT strategy, months, {R('pow(g, 1.0 / months) - 1')} AS geo FROM m""")
    reg.add("a25_ledger_months", lambda s, d: rounded(X.ledger_months(ledger(s, d), ["reason"]), ["ret"]),
            f"""WITH {LEDGER_SQL} SELECT reason, strftime(make_timestamp_ms(exit_ms), '%Y-%m') AS month, {R('exp(sum(ln(1 + pnl))) - 1')} AS ret,
            count(*) AS trades FROM ledger GROUP BY ALL""")
    reg.add("a24_state_months",
            lambda s, d: rounded(X.state_months(materialize(bars_of(s, d), "bars").selectExpr(
                "symbol", "bar_idx", "close", "close_ms", "close > open AS in_position"), ["symbol"]), ["ret"], 3), STATE_SQL)
    reg.add("j02_lower_bound", bounds_query, f"""WITH {POINTS_SQL} SELECT p.symbol, p.t, idx FROM pts p JOIN
        (SELECT q.symbol, t, count(*) FILTER (WHERE close_ms < t) AS idx FROM (SELECT DISTINCT * FROM pts) q JOIN bars USING (symbol) GROUP BY q.symbol, t) l ON l.symbol = p.symbol AND l.t = p.t""")
    reg.add("j03_nearest", nearest_query, f"""WITH {POINTS_SQL} SELECT p.symbol, t, bar_idx, abs(close_ms - t) AS gap FROM pts p JOIN bars b USING (symbol)
        QUALIFY row_number() OVER (PARTITION BY p.symbol, t ORDER BY abs(close_ms - t), bar_idx) = 1""")
    reg.add("w01_rolling_folds", lambda s, d: WF.rolling_folds(materialize(bars_of(s, d, "orders"), "bars")),
            f"WITH {Q.bars_cte('orders')}, {FOLDS_SQL} SELECT * FROM folds")
    reg.add("w01_fold_faults", lambda s, d: WF.fold_faults(WF.rolling_folds(materialize(bars_of(s, d, "orders"), "bars")), 40),
            f"""WITH {Q.bars_cte('orders')}, {FOLDS_SQL} SELECT symbol, count(*) AS folds, count(*) FILTER (WHERE train_end <= train_start) AS empty_train,
            count(*) FILTER (WHERE test_end <= test_start) AS empty_test, count(*) < 40 AS too_few FROM folds GROUP BY symbol""")
    reg.add("w02_block_folds", lambda s, d: WF.block_folds(bars_of(s, d, "lineitem")),
            f"""WITH {Q.bars_cte('lineitem')}, n AS (SELECT symbol, count(*) AS n, count(*) // 6 AS b FROM bars GROUP BY symbol),
            g AS (SELECT *, CAST(floor(b * 0.1) AS BIGINT) AS gap FROM n)
            SELECT symbol, 0 AS fold, 0 AS train_start, 4 * b - gap AS train_end, 4 * b AS test_start, 5 * b AS test_end FROM g UNION ALL
            SELECT symbol, 1, b, 5 * b - gap, 5 * b, n FROM g UNION ALL SELECT symbol, 2, 0, 5 * b - gap, 5 * b, n FROM g""")
    reg.add("w03_w04_a21_fold_metrics",
            lambda s, d: rounded(WF.fold_metrics(wf(s, d)[0]).select(
                *X.SERIES, "trades", "win_rate", "raw_return", "max_dd", "fold_score"), ["win_rate", "raw_return", "max_dd", "fold_score"]),
            f"WITH RECURSIVE {WF_SQL}, {FOLD_METRICS_SQL}")
    reg.add("w05_fold_equity", lambda s, d: rounded(wf(s, d)[1].select(*X.SERIES, "bar_idx", "equity"), ["equity"]),
            f"WITH RECURSIVE {WF_SQL} SELECT strategy, grp, symbol, bar_idx, {R('equity')} AS equity FROM eq")
    reg.add("w07_closed_equity", closed_query,
            f"""WITH RECURSIVE {WF_SQL} SELECT e.strategy, e.grp, e.symbol, e.bar_idx,
            {R('coalesce(product(1 + x.pnl) OVER (PARTITION BY e.strategy, e.grp, e.symbol ORDER BY e.bar_idx), 1.0)')} AS equity
            FROM eq0 e LEFT JOIN trades x ON x.strategy = e.strategy AND x.grp = e.grp AND x.symbol = e.symbol AND x.exit_idx = e.bar_idx""")
    reg.add("w06_stitched", lambda s, d: rounded(wf(s, d)[2].select(*X.SERIES, "bar_idx", "equity"), ["equity"]),
            f"WITH RECURSIVE {WF_SQL} SELECT strategy, grp, symbol, bar_idx, {R('equity')} AS equity FROM st")
    reg.add("j08_a10_monthly", lambda s, d: rounded(own_months(s, d), ["start_eq", "end_eq", "dd", "ret"]),
            f"WITH RECURSIVE {WF_SQL} SELECT strategy, symbol, month, {Q.rounded(['start_eq', 'end_eq', 'dd', 'ret'])}, trades FROM mo")
    reg.add("a11_a12_a13_month_summary",
            lambda s, d: rounded(X.month_summary(own_months(s, d), ["strategy", "symbol"]), MONTH_FLOATS),
            f"""WITH RECURSIVE {WF_SQL}, {MONTHS_SQL} SELECT strategy, symbol, months, CAST(month_trades AS BIGINT) AS month_trades,
            min_trades_month, {Q.rounded(MONTH_FLOATS)} FROM ms""")
    reg.add("w08_a14_oos_summary", lambda s, d: rounded(oos(s, d), OOS_FLOATS),
            f"""WITH RECURSIVE {WF_SQL}, {OOS_SQL} SELECT strategy, symbol, months, CAST(month_trades AS BIGINT) AS month_trades, min_trades_month,
            trades, folds, min_trades_fold, zero_folds, {Q.rounded(OOS_FLOATS)} FROM oos""")
