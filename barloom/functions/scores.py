"""Scores and gates over one metrics row, as SQL expressions.

Rejected rows have a NULL score and a reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clamp(x: str, lo: float, hi: float) -> str:
    return f"least(greatest({x}, {float(lo)!r}D), {float(hi)!r}D)"


def finite(x: str) -> str:
    return f"({x} IS NOT NULL AND NOT isnan({x}) AND abs({x}) < double('infinity'))"


def ladder(steps: list[tuple[str, str]], other: str = "CAST(NULL AS STRING)") -> str:
    """First failing condition names the reason."""
    return "CASE " + " ".join(f"WHEN {cond} THEN '{name}'" for cond, name in steps) + f" ELSE {other} END"


def base_reject(dd_limit: float = 0.60) -> str:
    return ladder([
        (f"NOT ({finite('ret')} AND {finite('max_dd')} AND {finite('expectancy')})", "invalid_math"),
        ("max_dd < 0 OR max_dd > 1.5", "dd_out_of_range"), ("trades < 0", "trades_negative"),
        ("abs(ret) > 10", "ret_absurd"), ("ret < -1", "ret_below_minus_1"),
        (f"trades = 0 OR max_dd >= {dd_limit}D", "no_trades_or_dd_limit"),
        ("ret > 3", "ret_above_cap"), ("ret < -0.8", "ret_too_low"), ("max_dd > 1", "dd_above_one"),
    ])


BASE = (
    "8 * ln(1 + ret) + 2 * " + clamp("ret / (max_dd + 1e-4D)", -10, 10) + " + " + clamp("200 * expectancy", -5, 5)
    + " + 0.01D * ln(trades) - 4 * max_dd - 8 * greatest(max_dd - 0.25D, 0D)"
    " - CASE WHEN trades < 20 THEN 2 ELSE 0 END - CASE WHEN ret < 0 THEN 1 ELSE 0 END"
    " - 0.3D * ln(1 + tested / 1e4D)"
)
SMOOTH = (
    " + 0.125D * " + clamp("ret / (greatest(downside_vol, 0.005D) + 1e-4D)", -10, 20)
    + " - CASE WHEN trades >= 50 THEN 0.125D * smooth_vol / (abs(ret) + 1e-6D) ELSE 0 END"
)


def sanitized(x: str) -> str:
    return f"CASE WHEN {finite(x)} AND abs({x}) <= 1e9D AND {x} >= -1e20D THEN {clamp(x, -1e6, 1e6)} END"


def score_state(x: str) -> str:
    return ladder([(f"{x} IS NULL", "rejected"), (f"isnan({x})", "nan"), (f"abs({x}) = double('infinity')", "inf"),
                   (f"{x} < -1e20D", "sentinel"), (f"abs({x}) > 1e9D", "overflow")], "'valid'")


def scored(df: DataFrame, dd_limit: float = 0.60) -> DataFrame:
    """Add ``reject_reason``, ``base_score`` and, where volatility columns exist, ``score``."""
    df = df.withColumn("reject_reason", F.expr(base_reject(dd_limit)))
    df = df.withColumn("base_score", F.expr(f"CASE WHEN reject_reason IS NULL THEN {BASE} END"))
    df = df.withColumn("base_score", F.expr(sanitized("base_score")))
    if {"smooth_vol", "downside_vol"} <= set(df.columns):
        df = df.withColumn("_s", F.expr(f"base_score{SMOOTH}")).withColumn("score", F.expr(sanitized("_s"))).drop("_s")
    return df


@dataclass(frozen=True)
class OosLimits:
    """Out-of-sample limits; a zero switches a check off where noted."""

    min_months: int = 6
    min_trades: int = 30
    min_trades_month: int = 0      # 0 = off
    min_trades_fold: int = 0       # 0 = off
    max_zero_fold_ratio: float = 0.5  # 0 = off
    max_dd: float = 0.70
    check_min_month: bool = True
    min_month: float = -0.25
    min_geo: float = 0.005
    min_active_ratio: float = 0.25
    max_sparse_ratio: float = 0.80  # 0 = off
    min_median: float = 0.003       # 0 = off
    max_std: float = 0.0            # 0 = off
    max_best_to_median: float = 8.0
    vol_lambda: float = 0.004
    dd_lambda: float = 0.008
    node_lambda: float = 0.0
    feature_lambda: float = 0.0
    depth_lambda: float = 0.0


def oos_reject(c: OosLimits) -> str:
    steps = [(f"months < {c.min_months}", "insufficient_months"), (f"trades < {c.min_trades}", "insufficient_trades")]
    if c.min_trades_month > 0:
        steps.append((f"min_trades_month < {c.min_trades_month}", "insufficient_trades"))
    if c.min_trades_fold > 0:
        steps.append((f"min_trades_fold < {c.min_trades_fold}", "fold_distribution"))
    if c.max_zero_fold_ratio > 0:
        steps.append((f"zero_fold_ratio > {c.max_zero_fold_ratio}D", "fold_distribution"))
    steps.append((f"max_dd > {c.max_dd}D", "max_dd"))
    if c.check_min_month:
        steps.append((f"min_month < {c.min_month}D", "min_month"))
    steps += [(f"geo_monthly < {c.min_geo}D", "geo_monthly"), (f"active_ratio < {c.min_active_ratio}D", "active_months")]
    if c.max_sparse_ratio > 0:
        steps.append((f"sparse_ratio > {c.max_sparse_ratio}D", "active_months"))
    if c.min_median > 0:
        steps.append((f"median_month < {c.min_median}D", "median_monthly"))
    if c.max_std > 0:
        steps.append((f"std_month > {c.max_std}D", "geo_monthly"))
    steps.append((f"median_month > 0.001D AND max_month > {c.max_best_to_median}D * median_month", "geo_monthly"))
    return ladder(steps)


def final_fitness(c: OosLimits) -> str:
    """Monthly growth less penalties for a train gap, unstable months, drawdown and complexity."""
    return f"""geo_monthly
        - CASE WHEN train_geo < 0 AND geo_monthly > 0 THEN 5 WHEN abs(train_geo - geo_monthly) > 0.05D
               THEN 0.2D * abs(train_geo - geo_monthly) ELSE 0 END
        - CASE WHEN std_month > 0.15D THEN 5 * (std_month - 0.15D) WHEN std_month > 0.10D THEN 2 * (std_month - 0.10D) ELSE 0 END
        - {c.vol_lambda}D * std_month - {c.dd_lambda}D * max_dd
        - ({c.node_lambda}D * nodes + {c.feature_lambda}D * features + {c.depth_lambda}D * max_depth)"""


# Trade and drawdown limits of the staged gates by relax level, and for hourly or coarser bars.
STAGE_LIMITS = {0: (30, 80, 0.50), 1: (5, 20, 0.75), 2: (15, 40, 0.60), 3: (5, 15, 0.65)}
COARSE_STAGE_TRADES = (8, 20)


def stage_reject(level: int = 1, minutes: int = 60) -> str:
    """Screen, then train, then validation; expects screen_*, train_* and val_score columns."""
    screen, train, dd = STAGE_LIMITS.get(level, STAGE_LIMITS[3])
    if minutes >= 60:
        screen, train = COARSE_STAGE_TRADES
    return ladder([
        ("screen_edges = 0", "screen_entry_rate_dead"), ("screen_true_pct > 30", "screen_entry_pct_too_high"),
        (f"screen_trades < {screen}", "screen_trades"), ("screen_trades > 2000", "screen_too_many_trades"),
        ("screen_dd >= 0.95D", "screen_dd"), ("screen_dd >= 0.80D", "screen_dd_catastrophic"),
        (f"train_trades < {train}", "train_trades"), ("train_trades > 5000", "train_too_many_trades"),
        (f"train_dd >= {dd}D", "train_dd"), ("train_dd >= 0.50D", "train_dd_explosion"),
        ("train_ret < -0.10D", "train_return_negative"), ("val_score IS NULL", "val_invalid_score"),
    ])


def stability_need(train: str, elites: str, base: float) -> str:
    """Validation score needed for a train score; bounds tighten as the population grows."""
    lo = f"CASE WHEN {elites} < 10 THEN 0.05D WHEN {elites} < 20 THEN 0.10D WHEN {elites} < 50 THEN 0.12D ELSE 0.15D END"
    hi = f"CASE WHEN {elites} < 10 THEN 0.70D WHEN {elites} < 20 THEN 0.60D WHEN {elites} < 50 THEN 0.55D ELSE 0.50D END"
    scaled = (f"CASE WHEN {train} > 0 THEN least(greatest({base}D * pow(3 / {train}, 0.3D), {lo}), {hi}) ELSE {base}D END")
    return f"({scaled}) * least({train}, 5D)"


def train_realism(bars: str, minutes: int) -> str:
    per_year = f"(trades / ({bars} * {minutes}D / 1440D / 365.25D))"
    return ladder([
        ("ret > 3", "train_return_cap"), (f"NOT {finite('score')}", "train_score_nan_inf"), (f"NOT {finite('ret')}", "train_ret_nan_inf"),
        ("max_dd < 0 OR max_dd > 1", "train_dd_invalid"), ("score > 50", "train_score_cap"),
        ("abs(score) > 1e8D", "train_score_corrupted"),
        (f"trades > 0 AND {per_year} > 350", "train_spam"), ("profit_factor > 4 AND trades >= 100", "train_pf_overfit"),
    ])


def train_cap(train_score: str, train_ret: str, val_score: str, val_ret: str) -> str:
    return ladder([(f"{train_score} > 20 AND {val_score} < 0.3D", "score_cap"), (f"{train_ret} > 3 AND {val_ret} < 0.005D", "return_cap")])


# Acceptance thresholds by population size:
# (below elites, max dd, min return, min profit factor, min expectancy, min score, min trades, min train score, min train return).
TIERS = [
    (10, 0.65, -0.02, 0.95, -0.001, -50.0, 20, -50.0, -0.20),
    (20, 0.65, -1.0, 0.0, -1.0, -1e6, 15, -20.0, -0.10),
    (2**31 - 1, 0.45, 0.01, 1.01, 0.0, 0.0, 30, -5.0, 0.0),
]
TIER_SCHEMA = ("below int, t_dd double, t_ret double, t_pf double, t_exp double, t_score double, t_trades int, "
               "t_train_score double, t_train_ret double")


def accepted(df: DataFrame, elites: str) -> DataFrame:
    """Join each row with the thresholds of its population size and test them."""
    tiers = F.broadcast(df.sparkSession.createDataFrame(TIERS, TIER_SCHEMA).withColumn(
        "above", F.expr("coalesce(lag(below) OVER (ORDER BY below), 0)")))
    j = df.join(tiers, F.expr(f"{elites} >= above AND {elites} < below"))
    return j.withColumn("accepted", F.expr(
        "coalesce(max_dd < t_dd AND trades >= t_trades AND ret >= t_ret AND expectancy > t_exp AND profit_factor >= t_pf "
        "AND score >= t_score AND (train_score > t_train_score OR train_ret > t_train_ret), false)"))


STRICT = "trades >= 50 AND max_dd <= 0.35D AND ret > 0"


def hold_cap(hold: str, bars: str) -> str:
    return f"least({hold}, greatest(least(120, {bars} div 6), 20))"


def cooldown_cap(cooldown: str, bars: str) -> str:
    return f"least({cooldown}, greatest(least(48, {bars} div 20), 10))"


def overtrading(trades: str, bars: str, bars_per_year: float, elites: str) -> str:
    return f"{trades} * ({bars_per_year}D / {bars}) > CASE WHEN {elites} < 10 THEN 1000 ELSE 500 END"


# --- block cross-check and multi-window check -------------------------------

def block_summary(folds: DataFrame, keys: list[str], min_mean: float, min_stability: float, min_score: float) -> DataFrame:
    """Summary over block folds with columns score, ret, max_dd, trades; and whether they pass."""
    mid = lambda c: F.expr(f"sort_array(collect_list({c}))[int(count(*) div 2)]")
    s = folds.groupBy(*keys).agg(
        F.avg("score").alias("mean_score"), mid("score").alias("median_score"), F.min("score").alias("worst_score"),
        mid("ret").alias("median_ret"), F.count(F.lit(1)).alias("n"), F.count_if(F.expr("trades >= 50")).alias("full_folds"),
        F.count_if(F.expr("ret > 0")).alias("profitable"),
        F.count_if(F.expr(f"score >= {min_score}D AND max_dd < 0.35D AND trades BETWEEN 30 AND 49")).alias("weak"))
    s = s.withColumn("stability", F.expr("(profitable - 0.5D * weak) / n"))
    return s.withColumn("passed", F.expr(
        f"mean_score >= {min_mean}D AND median_score >= {0.8 * min_mean}D AND median_ret > 0 AND stability >= {min_stability}D "
        f"AND worst_score >= {0.7 * min_mean}D AND full_folds >= n div 2"))


def quarters(trades: DataFrame, keys: list[str], ms: str) -> DataFrame:
    """``part``: the quarter (0 to 3) of the span between a key's first and last time that a row lies in."""
    span = trades.groupBy(*keys).agg(F.min(ms).alias("_lo"), F.max(ms).alias("_hi"))
    at = F.floor(4 * (F.col(ms) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1)))
    return trades.join(span, keys).withColumn("part", F.least(at, F.lit(3)).cast("int")).drop("_lo", "_hi")


def window_check(windows: DataFrame, keys: list[str]) -> DataFrame:
    """The first three quarters of the test span (0 oldest to 2 newest) weighted .4/.3/.3; weighted pass, or newest and majority."""
    weight = F.when(F.col("part") == 0, 0.4).otherwise(0.3)
    good = (F.col("ret") >= 0) & (F.col("profit_factor") >= 1) & (F.col("trades") >= 8)
    w = windows.groupBy(*keys).agg(
        F.sum(F.col("ret") * weight).alias("w_ret"), F.sum(F.col("profit_factor") * weight).alias("w_pf"),
        F.min("trades").alias("min_trades"), F.max("max_dd").alias("worst_dd"), F.count_if(good).alias("good_windows"),
        F.coalesce(F.max(good & (F.col("part") == 2)), F.lit(False)).alias("newest_good"))
    return w.withColumn("passed", F.expr(
        "(w_ret >= 0 AND w_pf >= 1.05D AND min_trades >= 15) OR (newest_good AND good_windows >= 2)"))


def funnel(df: DataFrame, stage: str, reason: str) -> DataFrame:
    """Rejections by stage and reason with totals."""
    return df.rollup(stage, reason).agg(F.count(F.lit(1)).alias("n"))


def share_of(part, whole):
    """Percentage clamped to 0..100; an empty whole counts as one."""
    return F.least(F.greatest(100.0 * part / F.greatest(whole, F.lit(1)), F.lit(0.0)), F.lit(100.0))
