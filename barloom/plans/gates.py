"""The gates of walk-forward validation in order, each over those that the gates before it left.

A gate is judged per (strategy, symbol). Pairs that fail leave with their stage and reason in a ledger; the next job is planned
only for strategies with a pair left, and its rows are semi-joined to the pairs. The costly jobs come last: counts over whole
series, counts over folds, the walk-forward itself, training results.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.meta import name_look_back
from ..functions.rules import complexity, features_of, leaf_rows
from ..functions.scores import OosLimits, final_fitness, oos_reject
from ..operators import metrics as X
from ..operators import outcomes as O
from ..operators.rates import COUNTS, PAIR, condition_inputs, edge_floor, fold_rates, window_counts
from ..operators.selection import select_trades
from ..operators.signals import overlap_verdict
from ..session import materialize
from ..sources.bars import bars_per_day
from . import walkforward as WF
from .strategy import Strategy

STAGES = ["entry_rule", "prescreen", "history", "folds", "regime", "overlap", "regime_rate", "oos_overlap", "edge_rate", "statistics", "complexity", "passed"]


@dataclass(frozen=True)
class GateLimits:
    """``edges_year`` and ``fold_edges_year``: zero switches a floor off, a negative one means ``auto_edges_year``. ``minutes`` is a bar's length."""

    train_days: int = 360
    test_days: int = 90
    step_days: int = 60
    min_folds: int = 3
    sparse_pct: float = 0.05
    regime_pct: tuple[float, float] = (1.0, 99.0)
    thin_overlap: int = 2
    edges_year: float = 10.0
    fold_edges_year: float = 3.0
    auto_edges_year: float = 15.0
    minutes: int = 60
    max_nodes: int = 50
    max_features: int = 12
    oos: OosLimits = field(default_factory=OosLimits)


class Chain:
    """The pairs that are left, the strategies that still have one, and the ledger."""

    def __init__(self, bars: DataFrame, strategies: list[Strategy]):
        self.strategies, self.ledger = strategies, []
        names = F.array(*[F.lit(s.name) for s in strategies]) if strategies else F.array().cast("array<string>")
        self.left = materialize(bars.select("symbol").distinct().select(F.explode(names).alias("strategy"), "symbol"), "pairs")

    def judge(self, judged: DataFrame, gates: list[tuple[str, Column, str | Column]], absent: tuple[str, str] | None = None) -> DataFrame:
        """Apply gates (stage, fails, reason) in order to rows (strategy, symbol, ...); pairs without a row fail as ``absent``. Returns the rows of pairs left."""
        verdict = F.lit(None).cast("struct<stage: string, reason: string>")
        for stage, fails, reason in reversed(gates):
            said = F.struct(F.lit(stage).alias("stage"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
            verdict = F.when(F.coalesce(fails, F.lit(False)), said).otherwise(verdict)
        judged = judged.join(self.left, PAIR, "left_semi").withColumn("_verdict", verdict).withColumn("_seen", F.lit(True))
        if absent:
            missing = F.struct(F.lit(absent[0]).alias("stage"), F.lit(absent[1]).alias("reason"))
            judged = self.left.join(judged, PAIR, "left").withColumn("_verdict", F.when(F.col("_seen"), F.col("_verdict")).otherwise(missing))
        judged = materialize(judged.drop("_seen"), f"gate-{gates[0][0]}")
        self.ledger.append(judged.filter("_verdict IS NOT NULL").select(*PAIR, "_verdict.*"))
        kept = judged.filter("_verdict IS NULL").drop("_verdict")
        self.left = kept.select(*PAIR)
        names = {r.strategy for r in self.left.select("strategy").distinct().collect()}  # no more than the book holds
        self.strategies = [s for s in self.strategies if s.name in names]
        return kept

    def rows(self) -> DataFrame:
        out = self.left.select(*PAIR, F.lit("passed").alias("stage"), F.lit("passed").alias("reason"))
        for failed in self.ledger:
            out = out.unionByName(failed)
        return out


def name_warmup(s: Strategy) -> int:
    """Bars of history by the periods in feature names, and 200 more."""
    return max([name_look_back(n) for n in features_of(s.entry, s.exit)], default=0) + 200


def hold_caps(test_bars: Column) -> tuple[Column, Column]:
    """Longest hold and cooldown for a test window of so many bars."""
    hold = F.greatest(F.lit(20), F.least(F.lit(120), F.floor(test_bars / 6)))
    cool = F.greatest(F.lit(10), F.least(F.lit(48), F.floor(test_bars / 20)))
    return hold.cast("int"), cool.cast("int")


def has_regime(strategies: list[Strategy]) -> Column:
    return F.col("strategy").isin(*[s.name for s in strategies if s.regime is not None]) if any(s.regime is not None for s in strategies) else F.lit(False)


def screen_gates(limits: GateLimits, regime: Column) -> list:
    need = F.floor((limits.train_days + limits.test_days) * F.col("bars_per_day"))
    return [
        ("prescreen", F.col("entry") == 0, "dead_entry"), ("prescreen", regime & (F.col("regime") == 0), "dead_regime"),
        ("prescreen", F.col("entry") * 100.0 / F.col("bars") < limits.sparse_pct, "entry_rate_too_sparse"),
        ("history", F.col("bars_per_day").isNull() | (F.col("bars") < need), "insufficient_history")]


def rate_gates(limits: GateLimits, regime: Column) -> list:
    """Expects fold totals and the first training window's counts as ``t_*``."""
    low, high = limits.regime_pct
    share = F.col("t_regime") * 100.0 / F.col("t_bars")
    most = F.expr("(folds + 1) div 2")
    verdict = overlap_verdict(*[F.col(f"t_{c}") for c in ("bars", "entry", "regime", "overlap")], regime)
    gates = [
        ("regime", regime & (F.col("dead_regimes") > F.expr("folds div 2")), "regime_dead_folds"),
        ("overlap", verdict.isNotNull(), verdict),
        ("regime_rate", regime & ((share < low) | (share > high)), "regime_rate_out_of_band"),
        ("oos_overlap", F.col("thin_folds") >= most, "dead_folds"),
        ("oos_overlap", F.col("overlap") < F.expr(f"folds * {limits.thin_overlap} div 2"), "overlap_too_low")]
    total = edge_floor(limits.edges_year, limits.auto_edges_year, limits.minutes)
    each = edge_floor(limits.fold_edges_year, limits.auto_edges_year, limits.minutes)
    if total > 0:
        some = F.col("bars") > 0
        gates.append(("edge_rate", some & ((F.col("edges") == 0) | (F.col("dead_folds") >= most) | (F.col("edges_per_year") < total)), "fold_entry_rate_too_low"))
        if each > 0:
            gates.append(("edge_rate", some & (F.col("worst_rate") < each), "per_fold_entry_rate_too_low"))
    return gates


def rates_of(chain: Chain, inputs: DataFrame, folds: DataFrame, limits: GateLimits) -> DataFrame:
    """Fold totals and counts of the first training window, warmup included, of the strategies left."""
    warm = {s.name: name_warmup(s) for s in chain.strategies}
    first = folds.filter("fold = 0")
    own = [first.select("symbol", F.lit(-w).cast("bigint").alias("grp"), F.greatest(F.lit(0), F.col("train_start") - w).alias("lo_idx"), F.col("train_end").alias("end_idx"))
           for w in sorted(set(warm.values()))]
    windows = folds.select("symbol", F.col("fold").alias("grp"), F.col("test_start").alias("lo_idx"), F.col("test_end").alias("end_idx"))
    for w in own:
        windows = windows.unionByName(w)
    counts = materialize(window_counts(inputs, chain.strategies, windows), "window-counts")
    grp = F.element_at(F.create_map(*[F.lit(x) for n, w in warm.items() for x in (n, -w)]), F.col("strategy"))
    train = counts.filter(F.col("grp") == grp).select(*PAIR, *[F.col(c).alias(f"t_{c}") for c in COUNTS])
    return fold_rates(counts.filter("grp >= 0"), limits.minutes, limits.thin_overlap, limits.regime_pct[0]).join(train, PAIR)


def walk_left(bars: DataFrame, chain: Chain, folds: DataFrame) -> DataFrame:
    """Out-of-sample summary of the pairs left; holds and cooldowns are capped by the first test window of the symbol."""
    hold, cool = hold_caps(F.col("test_end") - F.col("test_start"))
    caps = materialize(folds.filter("fold = 0").select("symbol", hold.alias("hold"), cool.alias("cool")).join(chain.left, "symbol", "left_semi"), "caps")
    out = None
    for c in caps.select("hold", "cool").distinct().orderBy("hold", "cool").collect():  # a few kinds of test windows
        symbols = caps.filter((F.col("hold") == c.hold) & (F.col("cool") == c.cool)).select("symbol")
        book = [replace(s, max_hold=min(s.max_hold, c.hold), cooldown=min(s.cooldown, c.cool)) for s in chain.strategies]
        pairs = chain.left.join(symbols, "symbol", "left_semi")
        some, own = bars.join(symbols, "symbol", "left_semi"), folds.join(symbols, "symbol", "left_semi")
        trades, _, stitched = WF.walk_forward(some, book, own, pairs)
        summary = WF.oos_summary(materialize(stitched, "stitched"), trades, own, book)
        out = summary if out is None else out.unionByName(summary)
    return out


def training_growth(bars: DataFrame, chain: Chain, folds: DataFrame) -> DataFrame:
    """(strategy, symbol, train_geo): monthly growth of the trades in the first training window."""
    windows = folds.filter("fold = 0").select("symbol", F.lit(0).cast("bigint").alias("grp"), F.col("train_start").alias("lo_idx"), F.col("train_end").alias("end_idx"))
    windows = materialize(windows, "training-windows")
    ids = range(len(chain.strategies))
    prep = materialize(O.prepared(bars, chain.strategies), "prepared")
    lab = O.label(O.entries(prep, chain.strategies, windows).join(chain.left, PAIR, "left_semi"), O.path_bars(prep, chain.strategies), chain.strategies)
    trades = select_trades(lab, {i: chain.strategies[i].cooldown for i in ids}, {i: chain.strategies[i].max_losses for i in ids})
    months = X.months_spanned(O.windowed(bars.select("symbol", "bar_idx", "close_ms"), windows, "bar_idx"), ["symbol"], "close_ms")
    grown = chain.left.join(X.compound(trades, PAIR), PAIR, "left").join(months, "symbol", "left")
    return grown.select(*PAIR, X.monthly_from_total(F.coalesce("raw_return", F.lit(0.0)), F.coalesce("months", F.lit(0))).alias("train_geo"))


def sizes(bars: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """(strategy, nodes, features, max_depth) of entry and exit rule together."""
    rows = [r for s in strategies for side, rule in (("entry", s.entry), ("exit", s.exit)) for r in leaf_rows(s.name, rule, side)]
    schema = "strategy string, side string, pos int, depth int, kind string, a string, b string, x double, y double, lb int"
    return complexity(bars.sparkSession.createDataFrame(rows, schema), ["strategy"]).select("strategy", "nodes", "features", "max_depth")


def gate_chain(bars: DataFrame, strategies: list[Strategy], limits: GateLimits = GateLimits()) -> tuple[DataFrame, DataFrame | None]:
    """(ledger, survivors). ``bars`` are the training and validation bars.

    The ledger has a row (strategy, symbol, stage, reason) for every pair. Survivors carry their out-of-sample summary and ``fitness``;
    None if no strategy is left before the walk-forward.
    """
    bars = materialize(bars, "gate-bars")
    chain = Chain(bars, strategies)
    pairs = chain.left
    chain.judge(pairs, [("entry_rule", ~F.col("strategy").isin(*[s.name for s in strategies if s.entry is not None]), "no_entry_rule")])
    if not chain.strategies:
        return chain.rows(), None
    inputs = materialize(condition_inputs(bars, chain.strategies), "conditions")
    whole = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("end_idx")).select("symbol", F.lit(0).cast("bigint").alias("grp"), F.lit(0).cast("bigint").alias("lo_idx"), "end_idx")
    seen = window_counts(inputs, chain.strategies, materialize(whole, "series")).join(bars_per_day(bars), "symbol", "left")
    chain.judge(seen, screen_gates(limits, has_regime(chain.strategies)))
    if not chain.strategies:
        return chain.rows(), None
    folds = materialize(WF.rolling_folds(bars, limits.train_days, limits.test_days, limits.step_days), "folds")
    faults = WF.fold_faults(folds, limits.min_folds).join(chain.left, "symbol")
    chain.judge(faults, [("folds", F.col("empty_train") > 0, "empty_train"), ("folds", F.col("empty_test") > 0, "empty_test"), ("folds", F.col("too_few"), "insufficient_folds")],
                ("folds", "insufficient_folds"))
    if not chain.strategies:
        return chain.rows(), None
    chain.judge(rates_of(chain, inputs, folds, limits), rate_gates(limits, has_regime(chain.strategies)))
    if not chain.strategies:
        return chain.rows(), None
    summary = walk_left(bars, chain, folds)
    failed = F.expr(oos_reject(limits.oos))
    kept = chain.judge(summary, [("statistics", F.col("trades") == 0, "oos_zero_trades"), ("statistics", failed.isNotNull(), failed)], ("statistics", "oos_zero_trades"))
    if not chain.strategies:
        return chain.rows(), None
    kept = chain.judge(kept.join(F.broadcast(sizes(bars, chain.strategies)), "strategy"),
                       [("complexity", (F.col("nodes") > limits.max_nodes) | (F.col("features") > limits.max_features), "too_complex")])
    if not chain.strategies:
        return chain.rows(), None
    survivors = kept.join(training_growth(bars, chain, folds), PAIR).withColumn("fitness", F.expr(final_fitness(limits.oos)))
    return chain.rows(), survivors
