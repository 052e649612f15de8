"""Running counts against plain loops, and the order and economy of the gate chain."""
import pytest
from pyspark.sql import functions as F

from barloom.functions.indicators import features
from barloom.functions.scores import OosLimits
from barloom.operators.rates import condition_inputs, edge_floor, fold_rates, window_counts
from barloom.operators.tiling import Tiles
from barloom.plans import gates
from barloom.plans import walkforward as WF
from barloom.plans.strategy import Strategy

BOOK = [
    Strategy("up", ("CrossUp", "EMA10", "EMA20"), regime=("GT", "ADX", 15.0), vol_threshold=0.9),
    Strategy("not_down", ("NOT", ("Falling", "EMA10", 2))), Strategy("low", ("LT", "RSI14", 45.0), regime=("Rising", "EMA20", 3)),
]


@pytest.fixture(scope="module")
def plain(walk):
    """Per symbol the flags (entry and active, regime, overlap, all) by plain Python."""
    cols = ["EMA10", "EMA20", "RSI14", "ADX", "Active", "ATR14", "ATR14_SMA50"]
    rows = features(walk, cols).orderBy("symbol", "bar_idx").collect()
    out = {}
    for sym in ("a", "b"):
        x = [r for r in rows if r.symbol == sym]
        for t, r in enumerate(x):
            p, active = x[t - 1] if t else None, r.Active > 0
            moved = p and abs(r.EMA10 - p.EMA10) >= 1e-6 and abs(r.EMA20 - p.EMA20) >= 1e-6
            entries = {"up": bool(moved and p.EMA10 <= p.EMA20 and r.EMA10 > r.EMA20), "not_down": not (t >= 2 and r.EMA10 < x[t - 2].EMA10), "low": r.RSI14 < 45}
            regimes = {"up": r.ADX > 15, "not_down": True, "low": t >= 3 and r.EMA20 > x[t - 3].EMA20}
            calm = {"up": r.ATR14_SMA50 <= 0 or r.ATR14 >= 0.9 * r.ATR14_SMA50, "not_down": True, "low": True}
            for n in entries:
                e, g = entries[n] and active, regimes[n]
                out.setdefault((n, sym), []).append((e, g, e and g, e and g and calm[n]))
    return out


def test_window_counts(spark, walk, plain):
    """Overlapping, empty, whole and past-the-end windows, over tiles shorter than they are."""
    spans = [(0, 0, 700), (1, 0, 1), (2, 250, 251), (3, 100, 612), (4, 256, 512), (5, 300, 300), (6, 699, 700), (7, 511, 513)]
    windows = spark.createDataFrame([(s, g, lo, hi) for s in ("a", "b") for g, lo, hi in spans] + [("c", 0, 0, 5)], "symbol string, grp long, lo_idx long, end_idx long")
    tiles = Tiles(256, 256, 256)
    got = window_counts(condition_inputs(walk, BOOK), BOOK, windows, tiles, batch=2)
    want = set()
    for (n, sym), flags in plain.items():
        for g, lo, hi in spans:
            own = flags[lo:hi]
            edges = sum(flags[t][3] and not (t and flags[t - 1][3]) for t in range(lo, hi))
            want.add((n, sym, g, len(own), sum(f[0] for f in own), sum(f[1] for f in own), sum(f[2] for f in own), edges))
    assert {tuple(r) for r in got.filter("symbol <> 'c'").collect()} == want
    assert all(tuple(r)[3:] == (0, 0, 0, 0, 0) for r in got.filter("symbol = 'c'").collect())
    rates = {(r.strategy, r.symbol): r for r in fold_rates(got, minutes=15).collect()}
    r = rates["up", "a"]
    own = [w for w in want if w[:2] == ("up", "a")]
    assert (r.folds, r.edges, r.overlap) == (8, sum(w[7] for w in own), sum(w[6] for w in own)) and r.dead_folds == sum(w[7] == 0 for w in own)
    assert r.edges_per_year == pytest.approx(r.edges / r.bars * 365.25 * 96) and r.worst_rate == 0


def test_edge_floor():
    assert (edge_floor(10, 15, 60), edge_floor(10, 15, 5), edge_floor(-1, 15, 15), edge_floor(0, 15, 5), edge_floor(10, 15, 1440)) == (10, 120, 60, 0, 10)


def test_chain_drops_before_it_runs(walk, monkeypatch):
    """Every pair has one verdict; the walk-forward sees only what is left; no survivors without entries."""
    seen = []
    real = WF.walk_forward

    def watched(bars, strategies, folds, pairs=None):
        seen.append(([s.name for s in strategies], {(r.strategy, r.symbol) for r in pairs.collect()}))
        return real(bars, strategies, folds, pairs)

    monkeypatch.setattr(WF, "walk_forward", watched)
    book = [Strategy("none", None), Strategy("never", ("GT", "RSI14", 101.0)), Strategy("often", ("GT", "RSI14", 1.0)),
            Strategy("up", ("CrossUp", "EMA10", "EMA20"), max_hold=90, cooldown=30, fee_bps=0.0), Strategy("big", ("AND", ("CrossUp", "EMA10", "EMA20"), ("NOT", ("GT", "RSI14", 99.0))), fee_bps=0.0)]
    loose = OosLimits(min_months=1, min_trades=1, max_zero_fold_ratio=0.0, max_dd=1.0, check_min_month=False, min_geo=-1.0, min_active_ratio=0.0, max_sparse_ratio=0.0, min_median=0.0, max_best_to_median=1e9)
    limits = gates.GateLimits(train_days=10, test_days=5, step_days=4, min_folds=2, edges_year=1.0, fold_edges_year=0.0, thin_overlap=1, max_nodes=3, oos=loose)
    ledger, left = gates.gate_chain(walk, book, limits)
    rows = {(r.strategy, r.symbol): (r.stage, r.reason) for r in ledger.collect()}
    assert len(rows) == ledger.count() == 10
    assert rows["none", "a"] == ("entry_rule", "no_entry_rule") and rows["never", "b"] == ("prescreen", "dead_entry") and rows["often", "a"] == ("overlap", "entry_rate_out_of_band")
    assert all(rows["big", s][0] in ("complexity", "statistics") for s in "ab") and {rows["up", s][0] for s in "ab"} <= {"passed", "statistics"}
    assert seen == [(["up", "big"], {(n, s) for n in ("up", "big") for s in "ab"})]
    passed = {k for k, v in rows.items() if v[0] == "passed"}
    assert {(r.strategy, r.symbol) for r in left.filter(F.col("fitness").isNotNull()).collect()} == passed if left is not None else not passed
    seen.clear()
    ledger, left = gates.gate_chain(walk, book[:3], limits)
    assert left is None and not seen and ledger.count() == 6
    short, none = gates.gate_chain(walk, book[3:], gates.GateLimits())
    assert none is None and {r.stage for r in short.collect()} == {"history"}
    assert gates.gate_chain(walk.limit(0), book, limits)[0].count() == 0
