"""Fold rates and the gate chain of walk-forward validation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import scores as G
from ..functions.rules import features_of
from ..operators import rates as T
from ..plans import walkforward as WF
from ..plans.gates import GateLimits, gate_chain, name_warmup
from ..plans.strategy import Strategy
from ..session import materialize
from ..sources.bars import DAY_MS
from . import sqlkit as Q
from .common import Registry, bars_of, rounded
from .metric_queries import OOS_SQL, R, folds_sql, wf_sql
from .rule_queries import RULES, rules_cte, twin

# --- rates over rolling folds of hourly bars ---------------------------------------

# Every rule as an entry, under one regime; fold lengths in days.
RATE_BOOK = [Strategy(n, RULES[n], regime=("GT", "ADX", 15.0), vol_threshold=0.8 if n.startswith("tree") else None) for n in RULES if n != "empty"]
RATE_DAYS = (10, 4, 3)
RATE_FLOATS = ["worst_rate", "edges_per_year"]


def fold_rates(spark, d):
    """Edges and overlap of every rule inside the test windows, and the first gate each (rule, symbol) fails."""
    bars = materialize(bars_of(spark, d), "bars")
    folds = WF.rolling_folds(bars, *RATE_DAYS).selectExpr("symbol", "fold AS grp", "test_start AS lo_idx", "test_end AS end_idx")
    inputs = materialize(T.condition_inputs(bars, RATE_BOOK), "conditions")
    out = T.fold_rates(T.window_counts(inputs, RATE_BOOK, materialize(folds, "folds")))
    out = out.withColumn("verdict", F.expr(G.ladder([
        ("thin_folds >= (folds + 1) div 2", "dead_folds"), ("overlap < folds * 2 div 2", "overlap_too_low"),
        ("edges = 0 OR dead_folds >= (folds + 1) div 2 OR edges_per_year < 10", "edge_rate_too_low"), ("worst_rate < 3", "fold_edge_rate_too_low")])))
    return rounded(out, RATE_FLOATS)


def flags_sql(book: list[Strategy], source: str = "c") -> str:
    """``fl``: one row per bar and strategy with its conditions; ``source`` holds the features."""
    vol = lambda s: "TRUE" if s.vol_threshold is None else f"(ATR14_SMA50 <= 0 OR ATR14 >= {s.vol_threshold} * ATR14_SMA50)"
    cols = ", ".join(f"{twin(s.entry)} AS e_{i}, {twin(s.regime)} AS r_{i}, {vol(s)} AS v_{i}" for i, s in enumerate(book))
    each = " UNION ALL ".join(f"SELECT '{s.name}' AS strategy, symbol, bar_idx, e_{i} AS e, r_{i} AS r, Active > 0 AS act, "
                              f"e_{i} AND r_{i} AND v_{i} AND Active > 0 AS ok FROM cf" for i, s in enumerate(book))
    return f"""cf AS MATERIALIZED (SELECT *, {cols} FROM {source}), fl0 AS ({each}),
fl AS MATERIALIZED (SELECT *, ok AND NOT coalesce(lag(ok) OVER (PARTITION BY strategy, symbol ORDER BY bar_idx), FALSE) AS edge FROM fl0)"""


def per_fold_sql(year: float) -> str:
    """``fr``: fold totals of ``fl`` over ``win``."""
    return f"""fc AS (SELECT strategy, w.symbol, w.grp, count(*) AS bars, count(*) FILTER (WHERE edge) AS edges, count(*) FILTER (WHERE e AND r AND act) AS overlap,
  count(*) FILTER (WHERE r) AS regime FROM win w JOIN fl ON fl.symbol = w.symbol AND bar_idx >= test_start AND bar_idx < test_end GROUP BY ALL),
fr AS (SELECT strategy, symbol, count(*) AS folds, CAST(sum(bars) AS BIGINT) AS bars, CAST(sum(edges) AS BIGINT) AS edges, CAST(sum(overlap) AS BIGINT) AS overlap,
  count(*) FILTER (WHERE overlap < 2) AS thin_folds, count(*) FILTER (WHERE edges = 0) AS dead_folds, count(*) FILTER (WHERE regime * 100.0 / bars < 1) AS dead_regimes,
  min(edges / bars * {year}) AS worst_rate, sum(edges) / sum(bars) * {year} AS edges_per_year FROM fc GROUP BY ALL)"""


_rate_rules = {f"{side}{i}": rule for i, s in enumerate(RATE_BOOK) for side, rule in (("e", s.entry), ("r", s.regime))}
FOLD_RATES = f"""WITH RECURSIVE {rules_cte(_rate_rules, ["Active", "ATR14", "ATR14_SMA50"])}, {folds_sql(*RATE_DAYS)}, {flags_sql(RATE_BOOK)}, {per_fold_sql(8766.0)}
SELECT strategy, symbol, folds, bars, edges, overlap, thin_folds, dead_folds, dead_regimes, {Q.rounded(RATE_FLOATS)},
  CASE WHEN thin_folds >= (folds + 1) // 2 THEN 'dead_folds' WHEN overlap < folds THEN 'overlap_too_low'
    WHEN edges = 0 OR dead_folds >= (folds + 1) // 2 OR edges_per_year < 10 THEN 'edge_rate_too_low' WHEN worst_rate < 3 THEN 'fold_edge_rate_too_low' END AS verdict FROM fr"""

# --- the chain over daily bars ------------------------------------------------------

DEEP = ("OR", ("AND", RULES["cross_up"], ("GT", "RSI14", 40.0)), ("AND", RULES["cross_down"], ("OR", ("LT", "RSI14", 60.0), ("Rising", "EMA20", 2))))
# Strategies that leave at different gates, and limits under which some pass.
GATE_BOOK = [
    Strategy("no_entry", None), Strategy("never", ("GT", "RSI14", 101.0)), Strategy("no_regime", RULES["cross_up"], regime=("GT", "RSI14", 101.0)),
    Strategy("rare", ("GT", "RSI14", 57.0)), Strategy("often", ("Rising", "EMA10", 2)), Strategy("thin", ("GT", "RSI14", 55.7)), Strategy("slow", ("GT", "RSI14", 53.5)),
    Strategy("thin_regime", RULES["cross_up"], regime=("GT", "ADX", 20.0)), Strategy("all_regime", RULES["cross_up"], regime=("GT", "ADX", 5.0)),
    Strategy("costly", RULES["cross_up"], stop=("fixed", 9.0), target=("fixed", 9.0), max_hold=8, fee_bps=900.0),
    Strategy("cross", RULES["cross_up"], exit=("CrossDown", "EMA10", "EMA20"), stop=("fixed", 60.0), target=("fixed", 60.0), max_hold=40, cooldown=14, fee_bps=0.0, slip_bps=0.0),
    Strategy("dip", ("AND", ("LT", "RSI7", 56.0), ("Rising", "EMA10", 1)), regime=("GT", "ADX", 8.0), stop=("atr", 1.5), target=("atr", 1.5), trail=("atr", 1.2),
             max_hold=12, fee_bps=0.0, slip_bps=0.0, vol_threshold=0.7),
    Strategy("deep", DEEP, exit=("GT", "RSI14", 60.0), stop=("fixed", 70.0), target=("fixed", 40.0), max_hold=10, fee_bps=0.0, slip_bps=0.0),
]
LIMITS = GateLimits(minutes=1440, max_nodes=9, edges_year=38.0, fold_edges_year=0.0, oos=G.OosLimits(
    min_months=12, min_trades=20, max_dd=1.0, check_min_month=False, min_geo=-0.3, min_active_ratio=0.2, max_sparse_ratio=0.8, min_median=0.0,
    max_best_to_median=500.0, node_lambda=0.0001, feature_lambda=0.0002, depth_lambda=0.001))
SURVIVOR_FLOATS = ["geo_monthly", "std_month", "max_dd", "train_geo", "fitness"]


def chain(spark, d):
    return gate_chain(bars_of(spark, d, "orders"), GATE_BOOK, LIMITS)


def survivors(spark, d):
    out = chain(spark, d)[1].select("strategy", "symbol", "months", "trades", "nodes", "features", *SURVIVOR_FLOATS)
    return rounded(out, SURVIVOR_FLOATS)


def _nodes(rule) -> int:
    return 0 if rule is None else 1 + sum(_nodes(r) for r in rule[1:]) if rule[0] in ("AND", "OR", "NOT") else 1


def _depth(rule) -> int:
    return 0 if rule is None or rule[0] not in ("AND", "OR", "NOT") else 1 + max(_depth(r) for r in rule[1:])


def chain_sql() -> str:
    """CTEs up to ``judged``: one row per (strategy, symbol) with ``verdict`` 'stage|reason', NULL if it passes."""
    book = [s for s in GATE_BOOK if s.entry is not None]
    # Daily folds of 90 days give the least caps: 20 bars held, 10 of cooldown. A copy of each strategy without caps trades on the training window.
    capped = [replace(s, max_hold=min(s.max_hold, 20), cooldown=min(s.cooldown, 10)) for s in book]
    free = [replace(s, name=s.name + "#train") for s in book]
    warm = ", ".join(f"('{s.name}', {name_warmup(s)}, {_nodes(s.entry) + _nodes(s.exit)}, {len(features_of(s.entry, s.exit))}, "
                     f"{max(_depth(s.entry), _depth(s.exit))}, {s.regime is not None})" for s in book)
    folds = folds_sql(360, 90, 60).replace("folds AS MATERIALIZED", "wfolds AS MATERIALIZED").replace("FROM folds)", "FROM wfolds)") + f""",
folds AS (SELECT * FROM wfolds UNION ALL SELECT symbol, -1, train_start, train_end, train_start, train_end FROM wfolds WHERE fold = 0)"""
    names = ", ".join(f"('{s.name}')" for s in capped)
    o = LIMITS.oos
    return f"""{wf_sql(capped + free, folds, names)}, {OOS_SQL}, {flags_sql(book, "f")}, {per_fold_sql(365.25)},
facts(strategy, warm, nodes, features, max_depth, has_regime) AS (VALUES {warm}),
wh AS (SELECT strategy, symbol, count(*) AS n, count(*) FILTER (WHERE e AND act) AS entry, count(*) FILTER (WHERE r) AS regime FROM fl GROUP BY ALL),
tw AS (SELECT strategy, fl.symbol, count(*) AS tb, count(*) FILTER (WHERE e AND act) AS te, count(*) FILTER (WHERE r) AS tr, count(*) FILTER (WHERE e AND r AND act) AS tov
  FROM fl JOIN facts USING (strategy) JOIN wfolds w ON w.symbol = fl.symbol AND w.fold = 0 WHERE bar_idx >= greatest(0, train_start - warm) AND bar_idx < train_end GROUP BY ALL),
bp0 AS (SELECT symbol, greatest(1, count(*) // 100) AS gap FROM bars GROUP BY symbol),
bp1 AS (SELECT b.symbol, gap, close_ms - lag(close_ms) OVER (PARTITION BY b.symbol ORDER BY bar_idx) AS step FROM bars b JOIN bp0 USING (symbol) WHERE bar_idx % gap = 0),
bp AS (SELECT symbol, {float(DAY_MS)} / floor(list_sort(list(step))[count(*) // 2 + 1] / any_value(gap)) AS bpd FROM bp1 WHERE step IS NOT NULL GROUP BY symbol),
nf AS (SELECT symbol, count(*) AS nf FROM wfolds GROUP BY symbol),
tg AS (SELECT replace(strategy, '#train', '') AS strategy, symbol, product(1 + pnl) - 1 AS total FROM trades WHERE grp = -1 AND strategy LIKE '%#train' GROUP BY ALL),
tm AS (SELECT b.symbol, count(DISTINCT strftime(make_timestamp_ms(close_ms), '%Y-%m')) AS tmonths FROM bars b JOIN wfolds w ON w.symbol = b.symbol AND w.fold = 0
  WHERE bar_idx >= train_start AND bar_idx < train_end GROUP BY b.symbol),
judged AS MATERIALIZED (SELECT wh.strategy, wh.symbol, o.*  EXCLUDE (strategy, symbol), nodes, features, max_depth, pow(1 + coalesce(total, 0), 1.0 / tmonths) - 1 AS train_geo,
  CASE WHEN wh.entry = 0 THEN 'prescreen|dead_entry' WHEN has_regime AND wh.regime = 0 THEN 'prescreen|dead_regime' WHEN wh.entry * 100.0 / n < 0.05 THEN 'prescreen|entry_rate_too_sparse'
   WHEN n < floor(450 * bpd) THEN 'history|insufficient_history' WHEN coalesce(nf, 0) < 3 THEN 'folds|insufficient_folds'
   WHEN has_regime AND dead_regimes > fr.folds // 2 THEN 'regime|regime_dead_folds'
   WHEN te * 100.0 / tb < 0.1 OR te * 100.0 / tb > 31 THEN 'overlap|entry_rate_out_of_band'
   WHEN has_regime AND (tr * 100.0 / tb < 1 OR tr * 100.0 / tb > 99.7) THEN 'overlap|regime_rate_out_of_band' WHEN tov < 10 AND tov * 100.0 / tb < 0.03 THEN 'overlap|entry_regime_no_overlap'
   WHEN has_regime AND (tr * 100.0 / tb < 1 OR tr * 100.0 / tb > 99) THEN 'regime_rate|regime_rate_out_of_band'
   WHEN thin_folds >= (fr.folds + 1) // 2 THEN 'oos_overlap|dead_folds' WHEN fr.overlap < fr.folds THEN 'oos_overlap|overlap_too_low'
   WHEN edges = 0 OR dead_folds >= (fr.folds + 1) // 2 OR edges_per_year < {LIMITS.edges_year} THEN 'edge_rate|fold_entry_rate_too_low'
   WHEN o.trades IS NULL OR o.trades = 0 THEN 'statistics|oos_zero_trades' WHEN months < {o.min_months} THEN 'statistics|insufficient_months'
   WHEN o.trades < {o.min_trades} THEN 'statistics|insufficient_trades' WHEN zero_fold_ratio > {o.max_zero_fold_ratio} THEN 'statistics|fold_distribution' WHEN max_dd > {o.max_dd} THEN 'statistics|max_dd'
   WHEN geo_monthly < {o.min_geo} THEN 'statistics|geo_monthly' WHEN active_ratio < {o.min_active_ratio} OR sparse_ratio > {o.max_sparse_ratio} THEN 'statistics|active_months'
   WHEN median_month > 0.001 AND max_month > {o.max_best_to_median} * median_month THEN 'statistics|geo_monthly'
   WHEN nodes > {LIMITS.max_nodes} OR features > {LIMITS.max_features} THEN 'complexity|too_complex' END AS verdict
  FROM wh JOIN facts USING (strategy) LEFT JOIN bp USING (symbol) LEFT JOIN nf USING (symbol) LEFT JOIN fr ON fr.strategy = wh.strategy AND fr.symbol = wh.symbol
  LEFT JOIN tw ON tw.strategy = wh.strategy AND tw.symbol = wh.symbol LEFT JOIN oos o ON o.strategy = wh.strategy AND o.symbol = wh.symbol
  LEFT JOIN tg ON tg.strategy = wh.strategy AND tg.symbol = wh.symbol LEFT JOIN tm ON tm.symbol = wh.symbol),
ledger AS (SELECT strategy, symbol, coalesce(split_part(verdict, '|', 1), 'passed') AS stage, coalesce(split_part(verdict, '|', 2), 'passed') AS reason FROM judged
  UNION ALL SELECT 'no_entry', symbol, 'entry_rule', 'no_entry_rule' FROM (SELECT DISTINCT symbol FROM bars))"""


def register(reg: Registry) -> None:
    reg.add("a19_a20_j04_fold_rates", fold_rates, FOLD_RATES)
    sql = chain_sql()
    reg.add("w10_gate_chain", lambda s, d: chain(s, d)[0], f"WITH RECURSIVE {sql} SELECT strategy, symbol, stage, reason FROM ledger")
    reg.add("w10_gate_order", lambda s, d: G.funnel(chain(s, d)[0], "stage", "reason").na.fill("total"),
            f"WITH RECURSIVE {sql} SELECT coalesce(stage, 'total') AS stage, coalesce(reason, 'total') AS reason, count(*) AS n FROM ledger GROUP BY ROLLUP (stage, reason)")
    o = LIMITS.oos
    reg.add("w10_survivors", survivors, f"""WITH RECURSIVE {sql}, w AS (SELECT *, geo_monthly - CASE WHEN train_geo < 0 AND geo_monthly > 0 THEN 5
        WHEN abs(train_geo - geo_monthly) > 0.05 THEN 0.2 * abs(train_geo - geo_monthly) ELSE 0 END
        - CASE WHEN std_month > 0.15 THEN 5 * (std_month - 0.15) WHEN std_month > 0.1 THEN 2 * (std_month - 0.1) ELSE 0 END - {o.vol_lambda} * std_month - {o.dd_lambda} * max_dd
        - ({o.node_lambda} * nodes + {o.feature_lambda} * features + {o.depth_lambda} * max_depth) AS fitness FROM judged WHERE verdict IS NULL)
        SELECT strategy, symbol, months, trades, CAST(nodes AS BIGINT) AS nodes, CAST(features AS BIGINT) AS features, {Q.rounded(SURVIVOR_FLOATS)} FROM w""")
