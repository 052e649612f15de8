"""Scores, gates, rankings, families, rule rates (G, T, D, A16-A23, A28, W9, W10, J4, J6, J7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as G
from ..operators import metrics as X
from ..operators import ranking as K
from ..operators import signals as S
from ..operators.acceptance import novelty
from ..operators.joins import unseen
from ..session import materialize
from . import sqlkit as Q
from .common import Registry, bars_of, rounded, table
from .rule_queries import FULL, RULES, candidates, plain, ruled, rules_cte
from .metric_queries import R

# --- metric rows from the orders table: strategy = block of ten customers ------

BY = ["strategy"]
# Years: a day of a strategy has about one trade, so day parts made the part table as long as the ledger.
YEAR_PART = f"exit_ms div {365 * 86_400_000}"
LED = """led AS (SELECT CAST(o_custkey // 10 AS VARCHAR) AS strategy, epoch_ms(o_orderdate) AS exit_ms, o_orderkey AS trade_no,
  (o_totalprice % 1000 - 480) / 10000 AS pnl, o_orderkey % 120 + 1 AS hold, o_orderpriority AS reason,
  CASE WHEN year(o_orderdate) < 1998 THEN 'train' WHEN year(o_orderdate) < 2000 THEN 'screen' ELSE 'val' END AS split,
  CAST(year(o_orderdate) AS INTEGER) AS fold, CAST((year(o_orderdate) - 1995) // 2 AS INTEGER) AS part FROM orders)"""


def led(spark, d):
    return table(spark, d, "orders").selectExpr(
        "CAST(o_custkey div 10 AS STRING) AS strategy", "unix_millis(CAST(o_orderdate AS TIMESTAMP)) AS exit_ms", "o_orderkey AS trade_no",
        "(o_totalprice % 1000 - 480) / 10000 AS pnl", "o_orderkey % 120 + 1 AS hold", "o_orderpriority AS reason",
        "CASE WHEN year(o_orderdate) < 1998 THEN 'train' WHEN year(o_orderdate) < 2000 THEN 'screen' ELSE 'val' END AS split",
        "year(o_orderdate) AS fold", "int((year(o_orderdate) - 1995) div 2) AS part")


def metrics_by(trades, keys):
    trades = materialize(trades, "ledger")
    m = X.trade_metrics(trades, keys).select(*keys, "trades", "win_rate", "expectancy", "profit_factor")
    r = trades.groupBy(*keys).agg(
        (X.growth(F.col("pnl")) - 1).alias("ret"), F.stddev_pop("pnl").alias("smooth_vol"),
        F.coalesce(F.sqrt(F.avg(F.when(F.col("pnl") < 0, F.col("pnl") ** 2))), F.lit(0.0)).alias("downside_vol"))
    dd = X.trade_drawdown(trades, keys, "exit_ms, trade_no", YEAR_PART)
    return m.join(r, keys).join(materialize(dd, "drawdowns"), keys).withColumn("tested", F.col("trades") * 100)


def met_cte(keys: str, name: str) -> str:
    return f"""{name}1 AS (SELECT *, product(1 + pnl) OVER (PARTITION BY {keys} ORDER BY exit_ms, trade_no) AS e FROM led),
{name}2 AS (SELECT *, greatest(1.0, max(e) OVER (PARTITION BY {keys} ORDER BY exit_ms, trade_no)) AS top FROM {name}1),
{name} AS MATERIALIZED (SELECT {keys}, count(*) AS trades, count(*) FILTER (WHERE pnl > 0) / count(*) AS win_rate, avg(pnl) AS expectancy,
  CASE WHEN count(*) FILTER (WHERE pnl <= 0) = 0 THEN 999.0 ELSE coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) / -sum(pnl) FILTER (WHERE pnl <= 0) END AS profit_factor,
  product(1 + pnl) - 1 AS ret, stddev_pop(pnl) AS smooth_vol, coalesce(sqrt(avg(pnl * pnl) FILTER (WHERE pnl < 0)), 0) AS downside_vol,
  greatest(0.0, max((top - e) / top)) AS max_dd, count(*) * 100 AS tested FROM {name}2 GROUP BY {keys})"""


SCORE = """CASE WHEN trades > 0 AND max_dd < {lim} AND ret BETWEEN -0.8 AND 3 THEN
  8 * ln(1 + ret) + 2 * least(greatest(ret / (max_dd + 1e-4), -10), 10) + least(greatest(200 * expectancy, -5), 5) + 0.01 * ln(trades)
  - 4 * max_dd - 8 * greatest(max_dd - 0.25, 0) - CASE WHEN trades < 20 THEN 2 ELSE 0 END - CASE WHEN ret < 0 THEN 1 ELSE 0 END
  - 0.3 * ln(1 + tested / 10000.0) END"""
SMOOTH = """ + 0.125 * least(greatest(ret / (greatest(downside_vol, 0.005) + 1e-4), -10), 20)
  - CASE WHEN trades >= 50 THEN 0.125 * smooth_vol / (abs(ret) + 1e-6) ELSE 0 END"""
SC = f"""{LED}, {met_cte('strategy', 'm')}, b AS (SELECT *, {SCORE.format(lim=0.6)} AS base_score,
  CASE WHEN trades = 0 OR max_dd >= 0.6 THEN 'no_trades_or_dd_limit' WHEN ret > 3 THEN 'ret_above_cap' WHEN ret < -0.8 THEN 'ret_too_low' END AS reject_reason FROM m),
sc AS MATERIALIZED (SELECT *, base_score {SMOOTH} AS score FROM b)"""


def scored(spark, d):
    return materialize(G.scored(metrics_by(led(spark, d), BY)), "scored")


def wide_splits(spark, d):
    """One row per strategy with train, screen and validation metrics side by side."""
    m = materialize(G.scored(metrics_by(led(spark, d), ["strategy", "split"])), "splits")
    pick = lambda split, col: F.max(F.when(F.col("split") == split, F.col(col)))
    return m.groupBy("strategy").agg(
        *[pick(s, c).alias(f"{s}_{n}") for s in ("train", "screen", "val")
          for c, n in [("trades", "trades"), ("max_dd", "dd"), ("ret", "ret"), ("score", "score")]])


SPLITS = f"""{LED}, {met_cte('strategy, split', 'm')}, sp AS (SELECT *, {SCORE.format(lim=0.6)} {SMOOTH} AS score FROM m),
wide AS MATERIALIZED (SELECT strategy, """ + ", ".join(
    f"max({c}) FILTER (WHERE split = '{s}') AS {s}_{n}" for s in ("train", "screen", "val")
    for c, n in [("trades", "trades"), ("max_dd", "dd"), ("ret", "ret"), ("score", "score")]) + " FROM sp GROUP BY strategy)"


def staged(spark, d):
    w = wide_splits(spark, d).withColumn("screen_edges", F.col("screen_trades")).withColumn("screen_true_pct", F.col("screen_trades") * 0.5)
    return w.withColumn("stage_failed", F.expr(G.stage_reject(1, 60)))


STAGED = f"""{SPLITS}, stg AS (SELECT *, CASE WHEN screen_trades = 0 THEN 'screen_entry_rate_dead' WHEN screen_trades * 0.5 > 30 THEN 'screen_entry_pct_too_high'
  WHEN screen_trades < 8 THEN 'screen_trades' WHEN screen_dd >= 0.95 THEN 'screen_dd' WHEN screen_dd >= 0.8 THEN 'screen_dd_catastrophic'
  WHEN train_trades < 20 THEN 'train_trades' WHEN train_dd >= 0.75 THEN 'train_dd' WHEN train_dd >= 0.5 THEN 'train_dd_explosion'
  WHEN train_ret < -0.1 THEN 'train_return_negative' WHEN val_score IS NULL THEN 'val_invalid_score' END AS stage_failed FROM wide)"""


def funnel(spark, d):
    s = staged(spark, d).selectExpr("substring_index(coalesce(stage_failed, 'passed_all'), '_', 1) AS stage", "coalesce(stage_failed, 'passed') AS reason")
    return G.funnel(s, "stage", "reason").na.fill("total")


def funnel_pct(spark, d):
    c = staged(spark, d).agg(
        F.count(F.lit(1)).alias("generated"), F.count_if(F.expr("stage_failed LIKE 'screen%'")).alias("screened"),
        F.count_if(F.expr("stage_failed LIKE 'train%'")).alias("trained"), F.count_if(F.expr("stage_failed IS NULL")).alias("passed"))
    pct = lambda n: G.share_of(F.col(n), F.col("generated")).alias(f"{n}_pct")
    return rounded(c.select("*", pct("screened"), pct("trained"), pct("passed")), ["screened_pct", "trained_pct", "passed_pct"])


OOS = G.OosLimits(min_months=12, min_trades=40, max_dd=0.6, min_active_ratio=0.3, max_sparse_ratio=0.7, min_median=0.0005, min_geo=0.0001)


def oos_rows(spark, d):
    t = led(spark, d)
    months = X.month_summary(X.ledger_months(t, BY), BY)
    years = t.groupBy("strategy", "fold").agg(F.count(F.lit(1)).alias("n")).groupBy("strategy").agg(
        F.min("n").alias("min_trades_fold"), F.expr("1 - count(*) / 7").alias("zero_fold_ratio"))
    return months.join(scored(spark, d).select("strategy", "trades", "max_dd", "expectancy"), BY).join(years, BY)


def oos_gate(spark, d):
    r = oos_rows(spark, d).withColumn("reject_code", F.expr(G.oos_reject(OOS)))
    r = r.selectExpr("*", "expectancy * 10 AS train_geo", "trades AS nodes", "months AS features", "2 AS max_depth")
    lim = G.OosLimits(node_lambda=0.0001, feature_lambda=0.0002, depth_lambda=0.001)
    r = r.withColumn("fitness", F.expr(G.final_fitness(lim)))
    return rounded(r.select("strategy", "reject_code", "fitness"), ["fitness"])


OOS_TWIN = f"""{SC}, lm AS (SELECT strategy, strftime(make_timestamp_ms(exit_ms), '%Y-%m') AS month, product(1 + pnl) - 1 AS ret, count(*) AS n FROM led GROUP BY ALL),
ms AS (SELECT strategy, count(*) AS months, exp(avg(ln(1 + ret))) - 1 AS geo, median(ret) AS med, coalesce(stddev_samp(ret), 0) AS std, min(ret) AS lo, max(ret) AS hi FROM lm GROUP BY ALL),
yr AS (SELECT strategy, 1 - count(DISTINCT fold) / 7 AS zr FROM led GROUP BY ALL),
o AS (SELECT ms.*, trades, max_dd, expectancy, zr FROM ms JOIN m USING (strategy) JOIN yr USING (strategy))
SELECT strategy, CASE WHEN months < 12 THEN 'insufficient_months' WHEN trades < 40 THEN 'insufficient_trades' WHEN zr > 0.5 THEN 'fold_distribution'
  WHEN max_dd > 0.6 THEN 'max_dd' WHEN lo < -0.25 THEN 'min_month' WHEN geo < 0.0001 THEN 'geo_monthly' WHEN med < 0.0005 THEN 'median_monthly'
  WHEN med > 0.001 AND hi > 8 * med THEN 'geo_monthly' END AS reject_code,
 {R('''geo - CASE WHEN expectancy * 10 < 0 AND geo > 0 THEN 5 WHEN abs(expectancy * 10 - geo) > 0.05 THEN 0.2 * abs(expectancy * 10 - geo) ELSE 0 END
  - CASE WHEN std > 0.15 THEN 5 * (std - 0.15) WHEN std > 0.1 THEN 2 * (std - 0.1) ELSE 0 END - 0.004 * std - 0.008 * max_dd
  - (0.0001 * trades + 0.0002 * months + 0.001 * 2)''')} AS fitness FROM o"""


def stability(spark, d):
    w = wide_splits(spark, d).filter("train_score IS NOT NULL").withColumn("elites", F.expr("int(strategy) % 60"))
    w = w.withColumn("need", F.expr(G.stability_need("train_score", "elites", 0.33)))
    return rounded(w.selectExpr("strategy", "need", "coalesce(val_score >= need, false) AS stable"), ["need"])


def acceptance(spark, d):
    s = scored(spark, d).join(wide_splits(spark, d).select("strategy", "train_score", "train_ret"), BY)
    s = s.withColumn("elites", F.expr("int(strategy) % 40"))
    return G.accepted(s, "elites").select("strategy", "elites", "accepted")


def gates(spark, d):
    s = scored(spark, d)
    return s.selectExpr(
        "strategy", f"{G.train_realism('9000', 60)} AS unreal", f"{G.STRICT} AS strict", f"{G.hold_cap('int(trades)', '600')} AS hold",
        f"{G.cooldown_cap('int(trades)', '600')} AS cool", f"{G.overtrading('trades', '2000', 8766.0, 'int(strategy) % 20')} AS overtraded",
        f"{G.score_state('score')} AS state")


def caps(spark, d):
    w = wide_splits(spark, d)
    return w.selectExpr("strategy", f"{G.train_cap('train_score * 5', 'train_ret * 5', 'val_score', 'val_ret')} AS cap")


def fold_scores(spark, d, key="fold"):
    return G.scored(metrics_by(led(spark, d), ["strategy", key]))


def blocks(spark, d):
    f = fold_scores(spark, d).na.fill(-10.0, ["score"])
    s = G.block_summary(f, BY, -1.0, 0.4, -2.0)
    return rounded(s.drop("n"), ["mean_score", "median_score", "worst_score", "median_ret", "stability"])


BLOCKS = f"""{LED}, {met_cte('strategy, fold', 'm')}, s AS (SELECT *, coalesce({SCORE.format(lim=0.6)} {SMOOTH}, -10) AS score FROM m),
bl AS (SELECT strategy, avg(score) AS mean_score, list_sort(list(score))[count(*) // 2 + 1] AS median_score, min(score) AS worst_score,
  list_sort(list(ret))[count(*) // 2 + 1] AS median_ret, count(*) FILTER (WHERE trades >= 50) AS full_folds, count(*) FILTER (WHERE ret > 0) AS profitable,
  count(*) FILTER (WHERE score >= -2 AND max_dd < 0.35 AND trades BETWEEN 30 AND 49) AS weak, count(*) AS n FROM s GROUP BY strategy),
bs AS (SELECT *, (profitable - 0.5 * weak) / n AS stability FROM bl),
bp AS (SELECT *, mean_score >= -1 AND median_score >= -0.8 AND median_ret > 0 AND stability >= 0.4 AND worst_score >= -0.7 AND full_folds >= n // 2 AS passed FROM bs)"""
BLOCK_FLOATS = ["mean_score", "median_score", "worst_score", "median_ret", "stability"]


def window_gate(spark, d):
    t = G.quarters(led(spark, d).drop("part"), BY, "exit_ms")
    w = metrics_by(t.filter("part < 3"), ["strategy", "part"])
    return rounded(G.window_check(w, BY), ["w_ret", "w_pf", "worst_dd"])


# --- rule rates -------------------------------------------------------------------

RATE_RULES = {"entry": RULES["tree_or"], "regime": ("GT", "ADX", 15.0)}


def rate_frame(spark, d):
    t = ruled(spark, d, RATE_RULES, ["Active"])
    t = t.withColumn("on", F.expr("Active > 0 AND r_regime AND r_entry"))
    from ..functions.rules import edges
    return plain(edges(t, ["r_entry", "on"]))


def rates(spark, d):
    """Edges, true share, penalty, overlap band and prefilter verdict per symbol."""
    f = rate_frame(spark, d)
    c = f.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.count_if("r_entry").alias("entry_true"), F.count_if("r_entry_edge").alias("edges"),
        F.count_if(F.expr("r_entry AND Active > 0")).alias("entry_active"), F.count_if("r_regime").alias("regime_true"),
        F.count_if("on").alias("overlap"), F.avg(F.col("r_regime").cast("int")).alias("regime_rate"))
    c = c.withColumn("true_pct", 100.0 * F.col("entry_true") / F.col("bars"))
    c = c.select("*", *S.entry_penalty(F.col("edges"), F.col("true_pct"), F.col("bars")),
                 S.overlap_verdict(F.col("bars"), F.col("entry_active"), F.col("regime_true"), F.col("overlap"), True).alias("band"))
    return rounded(c, ["true_pct", "penalty", "regime_rate"])


RATES = f"""{rules_cte(RATE_RULES, ["Active"])}, o AS (SELECT *, Active > 0 AND r_regime AND r_entry AS ok FROM c),
e AS (SELECT *, r_entry AND NOT coalesce(lag(r_entry) OVER w, FALSE) AS edge, ok AND NOT coalesce(lag(ok) OVER w, FALSE) AS ok_edge
  FROM o WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx))"""
RATES_SQL = f"""WITH RECURSIVE {RATES}, n AS (SELECT symbol, count(*) AS bars, count(*) FILTER (WHERE r_entry) AS entry_true, count(*) FILTER (WHERE edge) AS edges,
  count(*) FILTER (WHERE r_entry AND Active > 0) AS entry_active, count(*) FILTER (WHERE r_regime) AS regime_true, count(*) FILTER (WHERE ok) AS overlap FROM e GROUP BY symbol),
p AS (SELECT *, 100.0 * entry_true / bars AS true_pct, regime_true / bars AS regime_rate, edges < 2 AS too_low, edges > 80 AS too_high FROM n)
SELECT symbol, bars, entry_true, edges, entry_active, regime_true, overlap, too_low, too_high, true_pct > 30 AS too_often,
  {R('regime_rate')} AS regime_rate, {R('true_pct')} AS true_pct,
  {R('''CASE WHEN true_pct > 30 THEN least(30.0 / true_pct, 1.0) ELSE 1.0 END * CASE WHEN too_low THEN edges / 2 ELSE 1 END
   * CASE WHEN too_high THEN greatest(0.3, 1 - 0.5 * (edges / 80 - 1)) ELSE 1 END''')} AS penalty,
  CASE WHEN 100.0 * entry_active / bars < 0.1 OR 100.0 * entry_active / bars > 31 THEN 'entry_rate_out_of_band'
    WHEN 100.0 * regime_rate < 1 OR 100.0 * regime_rate > 99.7 THEN 'regime_rate_out_of_band'
    WHEN overlap < 10 AND 100.0 * overlap / bars < 0.03 THEN 'entry_regime_no_overlap' END AS band FROM p"""


def prefilter(spark, d):
    """Dead-rule verdict per rule and symbol on the last 3000 bars: all rules in one pass over the bars."""
    names = [n for n in RULES if n != "empty"]
    t = plain(ruled(spark, d, {**{n: RULES[n] for n in names}, "regime": ("GT", "ADX", 15.0)}, ["Active"]))
    last = t.groupBy("symbol").agg((F.max("bar_idx") + 1 - 3000).alias("_from"))
    t = t.join(last, "symbol").filter("bar_idx >= _from")
    flags = ", ".join(f"struct('{n}' AS rule, r_{n} AS fired)" for n in names)
    hits = t.selectExpr("symbol", "r_regime", "Active", f"explode(filter(array({flags}), x -> x.fired)) AS h")
    per = hits.groupBy("symbol", "h.rule").agg(
        F.count_if(F.expr("Active > 0")).alias("entry"), F.count_if(F.expr("Active > 0 AND r_regime")).alias("overlap"))
    base = t.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.count_if("r_regime").alias("regime"))
    grid = base.withColumn("rule", F.explode(F.array(*[F.lit(n) for n in names])))
    out = grid.join(per, ["symbol", "rule"], "left").na.fill(0, ["entry", "overlap"])
    return out.withColumn("verdict", S.dead_rule(F.col("bars"), F.col("entry"), F.col("regime"), F.col("overlap"), True))


_names = [n for n in RULES if n != "empty"]
PREFILTER = f"""WITH RECURSIVE {rules_cte({**{n: RULES[n] for n in _names}, "regime": ("GT", "ADX", 15.0)}, ["Active"])},
u AS ({' UNION ALL '.join(f"SELECT symbol, '{n}' AS rule, count(*) AS bars, count(*) FILTER (WHERE r_regime) AS regime, count(*) FILTER (WHERE Active > 0 AND r_{n}) AS entry, count(*) FILTER (WHERE Active > 0 AND r_regime AND r_{n}) AS overlap FROM c GROUP BY symbol" for n in _names)})
SELECT *, CASE WHEN entry = 0 THEN 'dead_entry' WHEN entry < 3 OR entry < bars * 0.001 THEN 'entry_too_sparse' WHEN entry > bars * 0.35 THEN 'entry_too_high'
  WHEN regime = 0 THEN 'dead_regime' WHEN regime * 100.0 / bars < 2 THEN 'regime_too_restrictive' WHEN overlap = 0 THEN 'zero_overlap'
  WHEN overlap < 2 THEN 'overlap_too_sparse' END AS verdict FROM u"""


# A grid of rules evaluated together.
GRID = {f"{k}_{f}_{x}": (k, f, float(x)) for k in ("GT", "LT") for f, xs in
        {"RSI14": (30, 40, 50, 60), "ROC10": (-40, 0, 40), "ADX": (10, 15, 20)}.items() for x in xs}
GRID |= {f"{k}_{f}_{n}": (k, f, n) for k in ("Rising", "Falling") for f in ("EMA10", "EMA20") for n in (1, 3, 5)}
GRID |= {f"{k}_fast": (k, "EMA10", "EMA20") for k in ("CrossUp", "CrossDown", "BreakUp", "BreakDown")}


def rule_grid(spark, d):
    """True bars and edges of every rule of the grid, per symbol."""
    inputs = materialize(S.rule_inputs(bars_of(spark, d), GRID), "rule-inputs")
    return S.rule_counts(inputs, GRID, batch=16)


_BY_POS = {str(i): rule for i, rule in enumerate(GRID.values())}
GRID_SQL = f"""WITH RECURSIVE {rules_cte(_BY_POS)}, u AS ({' UNION ALL '.join(
    f"SELECT symbol, bar_idx, '{n}' AS rule, r_{i} AS hit FROM c" for i, n in enumerate(GRID))}),
v AS (SELECT *, hit AND NOT coalesce(lag(hit) OVER (PARTITION BY symbol, rule ORDER BY bar_idx), FALSE) AS edge FROM u)
SELECT symbol, rule, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE edge) AS edges FROM v GROUP BY symbol, rule"""


# --- families -----------------------------------------------------------------------

def fingerprints(spark, d):
    c = candidates(spark, d)
    return c.selectExpr("kind", "a", "b", "k", f"{K.LEAF_SKELETON} AS skeleton", f"{K.LEAF_COARSE} AS coarse")


COARSE = """concat_ws(' ', kind, a, b, CASE WHEN kind IN ('SlopeGT', 'SlopeLT') THEN CAST(CAST(trunc(x / 0.01) AS BIGINT) AS VARCHAR)
  WHEN x IS NOT NULL THEN CAST(CASE WHEN abs(x) < 10 THEN floor(abs(x) * 10) / 10 ELSE floor(abs(x) / 5) * 5 END AS VARCHAR) END,
  CASE WHEN y IS NOT NULL THEN CAST(CASE WHEN abs(y) < 10 THEN floor(abs(y) * 10) / 10 ELSE floor(abs(y) / 5) * 5 END AS VARCHAR) END,
  CAST(lb // 5 * 5 AS VARCHAR))"""
FAM = f"{FULL}, fam AS (SELECT kind, a, b, k, concat_ws(' ', kind, a, b) AS skeleton, {COARSE} AS coarse FROM sweep)"


# A strategy per order, of 120 kinds: three shapes of entry rule, an exit rule for some, numbers from the customer.
MADE = """o_orderkey AS strategy, o_orderkey % 3 AS shape, (o_custkey % 40) * CAST(1.5 AS DOUBLE) AS x, o_custkey % 40 % 7 + 1 AS lb, o_custkey % 40 AS c"""
LEAVES = [  # shape, side, pos, depth, kind, a, b, x, y, lb
    (0, "entry", 0, 0, "GT", "RSI14", None, "x", None, "0"), (1, "entry", 0, 0, "AND", None, None, None, None, "0"), (1, "entry", 1, 1, "GT", "RSI14", None, "x", None, "0"),
    (1, "entry", 2, 1, "Rising", "EMA20", None, None, None, "lb"), (2, "entry", 0, 0, "OR", None, None, None, None, "0"), (2, "entry", 1, 1, "Between", "RSI14", None, "x", "x + 10", "0"),
    (2, "entry", 2, 1, "NOT", None, None, None, None, "0"), (2, "entry", 3, 2, "CrossUp", "EMA10", "EMA20", None, None, "0"), (1, "exit", 0, 0, "SlopeLT", "EMA20", None, "x / 100", None, "lb"),
]
PARAMS = """CASE WHEN c % 2 = 0 THEN 'fixed' ELSE 'atr' END AS stop_kind, c * CAST(0.25 AS DOUBLE) AS stop_x, CASE WHEN c % 5 > 0 THEN 'fixed' END AS target_kind,
  CASE WHEN c % 5 > 0 THEN c * CAST(0.5 AS DOUBLE) END AS target_x, CASE WHEN c % 3 = 0 THEN 'swing' ELSE 'none' END AS trail_kind, CAST(NULL AS DOUBLE) AS trail_x, c * 4 AS max_hold, c % 5 AS max_losses,
  c % 12 AS cooldown, CASE WHEN c % 7 = 0 THEN -1 ELSE 1 END AS direction, 30 AS fee, 8 AS slip, CASE WHEN c % 4 = 0 THEN CAST(0.5 AS DOUBLE) END AS vol_threshold, 'f1' AS feature_hash"""


def strategies_of(spark, d):
    """(rule rows, parameters) of the strategies."""
    made = table(spark, d, "orders").selectExpr(*MADE.split(", "))
    lit = lambda v: "NULL" if v is None else f"'{v}'"
    rows = ", ".join(f"struct({s} AS shape, '{side}' AS side, {p} AS pos, {h} AS depth, '{k}' AS kind, CAST({lit(a)} AS STRING) AS a, CAST({lit(b)} AS STRING) AS b, "
                     f"CAST({x or 'NULL'} AS DOUBLE) AS x, CAST({y or 'NULL'} AS DOUBLE) AS y, CAST({lb} AS INT) AS lb)" for s, side, p, h, k, a, b, x, y, lb in LEAVES)
    leaves = made.selectExpr("strategy", "shape AS own", f"inline(array({rows}))").filter("shape = own").drop("own", "shape")
    return leaves, made.selectExpr("strategy", *[p.strip() for p in PARAMS.replace("\n", " ").split(", ")])


def prints(spark, d):
    return K.fingerprints(*strategies_of(spark, d))


def exact_dedup(spark, d):
    """Each distinct strategy once: its first order, how many there are, and its text."""
    return prints(spark, d).groupBy("exact").agg(F.min("strategy").alias("first"), F.count(F.lit(1)).alias("n")).select("first", "n", "exact", F.substring(F.sha2("exact", 256), 1, 8).alias("short"))


def _made_sql() -> str:
    bucket = lambda v: f"CASE WHEN abs({v}) < 10 THEN floor(abs({v}) * 10) / 10 ELSE floor(abs({v}) / 5) * 5 END"
    num = lambda v: f"CAST(round({v}, 6) AS VARCHAR)"
    entry = {"exact": ["concat('(GT RSI14 ', " + num("x") + ", ' 0)')", "concat('(AND (GT RSI14 ', " + num("x") + ", ' 0) (Rising EMA20 ', lb, '))')",
                       "concat('(OR (Between RSI14 ', " + num("x") + ", ' ', " + num("x + 10") + ", ' 0) (NOT (CrossUp EMA10 EMA20 0)))')"],
             "skeleton": ["'(GT RSI14)'", "'(AND (GT RSI14) (Rising EMA20))'", "'(OR (Between RSI14) (NOT (CrossUp EMA10 EMA20)))'"],
             "coarse": [f"concat('(GT RSI14 ', {bucket('x')}, ' 0)')", f"concat('(AND (GT RSI14 ', {bucket('x')}, ' 0) (Rising EMA20 ', lb // 5 * 5, '))')",
                        f"concat('(OR (Between RSI14 ', {bucket('x')}, ' ', {bucket('x + 10')}, ' 0) (NOT (CrossUp EMA10 EMA20 0)))')"]}
    leave = {"exact": "concat('(SlopeLT EMA20 ', " + num("x / 100") + ", ' ', lb, ')')", "skeleton": "'(SlopeLT EMA20)'",
             "coarse": "concat('(SlopeLT EMA20 ', CAST(trunc(x / 100 / 0.01) AS BIGINT), ' ', lb // 5 * 5, ')')"}
    model = {"exact": lambda m: f"concat_ws('_', {m}_kind, CAST(round({m}_x, 6) AS VARCHAR))", "skeleton": lambda m: f"coalesce({m}_kind, '')",
             "coarse": lambda m: f"concat_ws('_', {m}_kind, CASE {m}_kind WHEN 'fixed' THEN CAST(trunc({m}_x / 0.01) AS BIGINT) WHEN 'atr' THEN CAST(trunc({m}_x / 0.5) AS BIGINT) END)"}
    tail = {"exact": "max_hold, max_losses, cooldown, direction, fee, slip, coalesce(CAST(vol_threshold AS VARCHAR), ''), feature_hash", "skeleton": "direction",
            "coarse": "max_hold // 50 * 50, max_losses // 2 * 2, cooldown // 10 * 10, direction, fee, slip, feature_hash"}
    text = lambda f: (f"concat_ws('|', CASE shape WHEN 0 THEN {entry[f][0]} WHEN 1 THEN {entry[f][1]} ELSE {entry[f][2]} END, CASE WHEN shape = 1 THEN {leave[f]} ELSE '' END, '', "
                      f"{model[f]('stop')}, {model[f]('target')}, {model[f]('trail')}, {tail[f]}) AS {f}")
    return f"""made AS (SELECT {MADE} FROM orders), pr AS (SELECT *, {PARAMS} FROM made),
fps AS (SELECT strategy, {text('exact')}, {text('skeleton')}, {text('coarse')} FROM pr)"""


def seen(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey", "concat_ws('|', o_custkey, o_orderstatus) AS fp", "o_orderdate")
    old = o.filter("o_orderdate < timestamp_ntz'1999-01-01'")
    return unseen(o.filter("o_orderdate >= timestamp_ntz'1999-01-01'"), old, "fp").select("fp", "o_orderkey")


NOVEL_WINDOW = 200


def novel(spark, d):
    """Orders accepted under the cap of six per family, counts halving as rows are accepted."""
    o = table(spark, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN 'hot' ELSE concat_ws('|', o_custkey div 10, o_orderstatus) END AS family")
    return novelty(o, "family", "o_orderkey", window=NOVEL_WINDOW)


NOVEL_SQL = f"""WITH RECURSIVE o0 AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'hot' ELSE concat_ws('|', o_custkey // 10, o_orderstatus) END AS family FROM orders),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i, dense_rank() OVER (ORDER BY family) AS f FROM o0),
r AS (SELECT CAST(0 AS BIGINT) AS i, list_transform(range((SELECT max(f) FROM o)), lambda z: CAST(0 AS BIGINT)) AS n, CAST(0 AS BIGINT) AS total, FALSE AS ok UNION ALL
  SELECT i, CASE WHEN t > {2 * NOVEL_WINDOW} THEN list_transform(m, lambda z: z // 2) ELSE m END, CASE WHEN t > {2 * NOVEL_WINDOW} THEN t // 2 ELSE t END, ok FROM (
    SELECT o.i, r.n[o.f] <= 5 AS ok, r.total + CASE WHEN r.n[o.f] <= 5 THEN 1 ELSE 0 END AS t,
      CASE WHEN r.n[o.f] <= 5 THEN list_concat(list_append(r.n[:o.f - 1], r.n[o.f] + 1), r.n[o.f + 1:]) ELSE r.n END AS m FROM r JOIN o ON o.i = r.i + 1))
SELECT o_orderkey, family FROM r JOIN o USING (i) WHERE ok"""


def coarse_params(spark, d):
    p = led(spark, d).groupBy("strategy").agg(
        F.max("hold").alias("max_hold"), F.count_if(F.expr("pnl < 0")).alias("max_losses"), F.min("hold").alias("cooldown"))
    return p.select("strategy", *K.coarse_params())


def register(reg: Registry) -> None:
    reg.add("g01_g02_g03_scores", lambda s, d: rounded(scored(s, d).select("strategy", "reject_reason", "base_score", "score"), ["base_score", "score"]),
            f"WITH {SC} SELECT strategy, reject_reason, {Q.rounded(['base_score', 'score'])} FROM sc")
    reg.add("g05_g06_oos_gate", oos_gate, f"WITH {OOS_TWIN}")
    reg.add("g07_stages", lambda s, d: staged(s, d).select("strategy", "stage_failed"), f"WITH {STAGED} SELECT strategy, stage_failed FROM stg")
    lo = "CASE WHEN e < 10 THEN 0.05 WHEN e < 20 THEN 0.1 WHEN e < 50 THEN 0.12 ELSE 0.15 END"
    hi = "CASE WHEN e < 10 THEN 0.7 WHEN e < 20 THEN 0.6 WHEN e < 50 THEN 0.55 ELSE 0.5 END"
    reg.add("g08_stability", stability, f"""WITH {SPLITS}, z AS (SELECT *, CAST(strategy AS INTEGER) % 60 AS e FROM wide WHERE train_score IS NOT NULL),
        y AS (SELECT *, CASE WHEN train_score > 0 THEN least(greatest(0.33 * pow(3 / train_score, 0.3), {lo}), {hi}) ELSE 0.33 END * least(train_score, 5) AS need FROM z)
        SELECT strategy, {R('need')} AS need, coalesce(val_score >= need, FALSE) AS stable FROM y""")
    reg.add("g09_g11_g12_g13_gates", gates, f"""WITH {SC} SELECT strategy, CASE WHEN ret > 3 THEN 'train_return_cap' WHEN score IS NULL THEN 'train_score_nan_inf'
        WHEN score > 50 THEN 'train_score_cap' WHEN trades / (9000 * 60 / 1440 / 365.25) > 350 THEN 'train_spam'
        WHEN profit_factor > 4 AND trades >= 100 THEN 'train_pf_overfit' END AS unreal, trades >= 50 AND max_dd <= 0.35 AND ret > 0 AS strict,
        CAST(least(trades, 100) AS INTEGER) AS hold, CAST(least(trades, 30) AS INTEGER) AS cool,
        trades * 8766 / 2000 > CASE WHEN CAST(strategy AS INTEGER) % 20 < 10 THEN 1000 ELSE 500 END AS overtraded,
        CASE WHEN score IS NULL THEN 'rejected' ELSE 'valid' END AS state FROM sc""")
    reg.add("g09_train_cap", caps, f"""WITH {SPLITS} SELECT strategy, CASE WHEN train_score * 5 > 20 AND val_score < 0.3 THEN 'score_cap'
        WHEN train_ret * 5 > 3 AND val_ret < 0.005 THEN 'return_cap' END AS cap FROM wide""")
    reg.add("g10_acceptance", acceptance, f"""WITH {SC}, sp AS (SELECT strategy, {met_cte('strategy', 'q')[met_cte('strategy', 'q').rindex('(SELECT strategy,') + 17:].split(' FROM q2')[0]} FROM
        (SELECT *, product(1 + pnl) OVER (PARTITION BY strategy ORDER BY exit_ms, trade_no) AS e,
         greatest(1.0, max(e0) OVER (PARTITION BY strategy ORDER BY exit_ms, trade_no)) AS top FROM
          (SELECT *, product(1 + pnl) OVER (PARTITION BY strategy ORDER BY exit_ms, trade_no) AS e0 FROM led WHERE split = 'train')) GROUP BY strategy),
        tr AS (SELECT strategy, ret AS train_ret, {SCORE.format(lim=0.6)} {SMOOTH} AS train_score FROM sp),
        x AS (SELECT sc.*, train_ret, train_score, CAST(strategy AS INTEGER) % 40 AS elites FROM sc LEFT JOIN tr USING (strategy))
        SELECT strategy, elites, coalesce(CASE WHEN elites < 10 THEN max_dd < 0.65 AND trades >= 20 AND ret >= -0.02 AND expectancy > -0.001
            AND profit_factor >= 0.95 AND score >= -50 AND (train_score > -50 OR train_ret > -0.2)
          WHEN elites < 20 THEN max_dd < 0.65 AND trades >= 15 AND ret >= -1 AND expectancy > -1 AND score >= -1e6 AND (train_score > -20 OR train_ret > -0.1)
          ELSE max_dd < 0.45 AND trades >= 30 AND ret >= 0.01 AND expectancy > 0 AND profit_factor >= 1.01 AND score >= 0
            AND (train_score > -5 OR train_ret > 0) END, FALSE) AS accepted FROM x""")
    reg.add("a21_block_summary", blocks, f"""WITH {BLOCKS} SELECT strategy, full_folds, profitable, weak, passed, {Q.rounded(BLOCK_FLOATS)} FROM bp""")
    reg.add("a22_window_check", window_gate, f"""WITH {LED}, l3 AS (SELECT * EXCLUDE (part, q), q AS part FROM (SELECT *, least(3, floor(4 * (exit_ms - min(exit_ms) OVER (PARTITION BY strategy))
          / greatest(max(exit_ms) OVER (PARTITION BY strategy) - min(exit_ms) OVER (PARTITION BY strategy), 1))) AS q FROM led) WHERE q < 3), {met_cte('strategy, part', 'm').replace('FROM led', 'FROM l3')},
        w AS (SELECT strategy, sum(ret * CASE WHEN part = 0 THEN 0.4 ELSE 0.3 END) AS w_ret, sum(profit_factor * CASE WHEN part = 0 THEN 0.4 ELSE 0.3 END) AS w_pf,
        min(trades) AS min_trades, max(max_dd) AS worst_dd, count(*) FILTER (WHERE ret >= 0 AND profit_factor >= 1 AND trades >= 8) AS good_windows,
        bool_or(part = 2 AND ret >= 0 AND profit_factor >= 1 AND trades >= 8) AS newest_good FROM m GROUP BY strategy)
        SELECT strategy, min_trades, good_windows, newest_good, {Q.rounded(['w_ret', 'w_pf', 'worst_dd'])},
        (w_ret >= 0 AND w_pf >= 1.05 AND min_trades >= 15) OR (newest_good AND good_windows >= 2) AS passed FROM w""")
    reg.add("a23_funnel", funnel, f"""WITH {STAGED}, s AS (SELECT split_part(coalesce(stage_failed, 'passed_all'), '_', 1) AS stage, coalesce(stage_failed, 'passed') AS reason FROM stg)
        SELECT coalesce(stage, 'total') AS stage, coalesce(reason, 'total') AS reason, count(*) AS n FROM s GROUP BY ROLLUP (stage, reason)""")
    reg.add("a28_funnel_shares", funnel_pct, f"""WITH {STAGED}, c AS (SELECT count(*) AS generated, count(*) FILTER (WHERE stage_failed LIKE 'screen%') AS screened,
        count(*) FILTER (WHERE stage_failed LIKE 'train%') AS trained, count(*) FILTER (WHERE stage_failed IS NULL) AS passed FROM stg)
        SELECT *, {R('100.0 * screened / generated')} AS screened_pct, {R('100.0 * trained / generated')} AS trained_pct, {R('100.0 * passed / generated')} AS passed_pct FROM c""")
    reg.add("a16_a17_a18_rates", rates, RATES_SQL)
    reg.add("w09_j06_prefilter", prefilter, PREFILTER)
    reg.add("j06_a16_rule_grid", rule_grid, GRID_SQL)
    pick = ["strategy", "score", "max_dd", "ret", "trades"]
    nums = ["score", "max_dd", "ret"]
    cols = f"strategy, trades, {Q.rounded(nums)}"
    reg.add("t01_best_test", lambda s, d: rounded(K.best_test(scored(s, d).filter("score IS NOT NULL")).select(*pick), nums),
            f"WITH {SC} SELECT {cols} FROM (SELECT * FROM sc WHERE score IS NOT NULL ORDER BY score DESC, max_dd, ret DESC, strategy LIMIT 20)")
    reg.add("t02_debug_rank", lambda s, d: rounded(K.debug_rank(scored(s, d)).select(*pick), nums),
            f"WITH {SC} SELECT {cols} FROM (SELECT * FROM sc ORDER BY ret DESC, max_dd, trades DESC, strategy LIMIT 20)")
    famd = lambda s, d: scored(s, d).withColumn("family", F.expr("concat_ws('|', int(round(win_rate * 10)), trades div 20)"))
    famq = f"{SC}, fs AS (SELECT *, concat_ws('|', CAST(round(win_rate * 10) AS INTEGER), trades // 20) AS family FROM sc WHERE score IS NOT NULL)"
    reg.add("t03_hall_of_fame", lambda s, d: rounded(K.hall_of_fame(famd(s, d), "family", 40, 5).select("family", *pick), nums),
            f"""WITH {famq}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, strategy) AS r FROM fs)
            SELECT family, {cols} FROM (SELECT * FROM r WHERE r <= 5 ORDER BY score DESC, strategy LIMIT 40)""")
    bins = lambda c, cuts: "CASE " + " ".join(f"WHEN {c} < {x} THEN {i}" for i, x in enumerate(cuts)) + f" ELSE {len(cuts)} END"
    reg.add("t04_archive", lambda s, d: rounded(K.archive(scored(s, d)).select("freq_bin", "wr_bin", "skew_bin", "strategy", "score"), ["score"]),
            f"""WITH {SC}, cl AS (SELECT *, {bins('trades', [50, 150, 300, 600, 1200])} AS freq_bin, {bins('win_rate', [0.35, 0.45, 0.52, 0.58, 0.65])} AS wr_bin,
            {bins('expectancy', [-0.002, -0.001, 0.0, 0.001, 0.002])} AS skew_bin FROM sc WHERE score IS NOT NULL)
            SELECT freq_bin, wr_bin, skew_bin, strategy, {R('score')} AS score FROM cl
            QUALIFY row_number() OVER (PARTITION BY freq_bin, wr_bin, skew_bin ORDER BY score DESC, strategy) = 1""")
    reg.add("t05_diverse", lambda s, d: rounded(K.diverse(famd(s, d), "family", 8).select("family", *pick), nums),
            f"""WITH {famq}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, strategy) AS r FROM fs)
            SELECT family, {cols} FROM (SELECT * FROM r WHERE r = 1 ORDER BY score DESC, strategy LIMIT 8)""")
    reg.add("t06_champions", lambda s, d: rounded(K.best_test(scored(s, d).filter("score IS NOT NULL"), 5).select(*pick), nums),
            f"WITH {SC} SELECT {cols} FROM (SELECT * FROM sc WHERE score IS NOT NULL ORDER BY score DESC, max_dd, ret DESC, strategy LIMIT 5)")
    reg.add("t07_block_rank", lambda s, d: rounded(K.block_rank(G.block_summary(fold_scores(s, d).na.fill(-10.0, ["score"]), BY, -1.0, 0.4, -2.0), 30)
                                                   .select("strategy", "rank_score"), ["rank_score"]),
            f"""WITH {BLOCKS} SELECT strategy, {R('mean_score - 2 * (1 - stability)')} AS rank_score FROM bp ORDER BY mean_score - 2 * (1 - stability) DESC, strategy LIMIT 30""")
    reg.add("t08_accept_threshold", lambda s, d: rounded(K.accept_threshold(led(s, d).selectExpr("pnl AS score", "exit_ms", "trade_no"),
                                                                           [F.desc("exit_ms"), F.desc("trade_no")]), ["threshold"]),
            f"""WITH {LED}, l AS (SELECT pnl FROM led ORDER BY exit_ms DESC, trade_no DESC LIMIT 500)
            SELECT {R('list_reverse_sort(list(pnl))[CAST(floor(count(*) * (1 - 0.7)) AS BIGINT) + 1]')} AS threshold FROM l""")
    reg.add("d01_exact_dedup", exact_dedup, f"""WITH {_made_sql()} SELECT min(strategy) AS first, count(*) AS n, exact, substr(sha256(exact), 1, 8) AS short FROM fps GROUP BY exact""")
    reg.add("d01_d02_d03_strategies", prints, f"WITH {_made_sql()} SELECT * FROM fps")
    reg.add("d02_skeletons", lambda s, d: fingerprints(s, d).groupBy("skeleton").agg(F.count(F.lit(1)).alias("n")),
            f"{FAM} SELECT skeleton, count(*) AS n FROM fam GROUP BY skeleton")
    reg.add("d03_coarse", lambda s, d: fingerprints(s, d).groupBy("coarse").agg(F.count(F.lit(1)).alias("n")),
            f"{FAM} SELECT coarse, count(*) AS n FROM fam GROUP BY coarse")
    reg.add("d03_coarse_params", coarse_params, f"""WITH {LED}, p AS (SELECT strategy, max(hold) AS h, count(*) FILTER (WHERE pnl < 0) AS l, min(hold) AS c FROM led GROUP BY strategy)
        SELECT strategy, h // 50 * 50 AS hold_bucket, l // 2 * 2 AS loss_bucket, c // 10 * 10 AS cool_bucket FROM p""")
    reg.add("d04_j07_unseen", seen, """WITH o AS (SELECT o_orderkey, concat_ws('|', o_custkey, o_orderstatus) AS fp, o_orderdate FROM orders)
        SELECT fp, o_orderkey FROM o WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND fp NOT IN (SELECT fp FROM o WHERE o_orderdate < TIMESTAMP '1999-01-01')""")
    reg.add("d05_novelty", novel, NOVEL_SQL)
    reg.add("d06_family_report", lambda s, d: K.family_report(famd(s, d), "family"),
            f"WITH {famq.replace(' WHERE score IS NOT NULL)', ')')} SELECT family, count(*) AS n FROM fs GROUP BY family ORDER BY n DESC, family LIMIT 10")
