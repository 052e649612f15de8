"""Proofs of rules against plain loops: every leaf's values, comparisons and result, and the branch that held."""
import pytest
from pyspark.sql import functions as F

from barloom.functions import proofs as P
from barloom.functions.indicators import features, tiled_features
from barloom.functions.rules import features_of, leaves
from barloom.operators.outcomes import prepared
from barloom.operators.tiling import Tiles
from barloom.plans.strategy import Strategy
from barloom.sources.sinks import state_file_with_proofs, trade_file

UP, LOW, RISE, FALL = ("CrossUp", "EMA10", "EMA20"), ("LT", "RSI14", 45.0), ("Rising", "EMA20", 2), ("Falling", "EMA10", 1)
RULES = {
    "nested": ("OR", ("AND", LOW, ("OR", UP, ("AbsGT", "ROC10", 5.0))), ("AND", RISE, ("NOT", FALL))),
    "same_twice": ("OR", ("AND", LOW, ("GT", "RSI14", 60.0)), ("OR", ("Between", "RSI14", 55.0, 45.0), LOW)),
    "slope": ("SlopeGT", "EMA20", 0.01, 5), "no_slope": ("OR", ("SlopeLT", "EMA20", 0.0, 0), RISE), "never": ("Rising", "EMA20", 0),
    "break": ("BreakDown", "SwingLow", "LL_20_prev"), "all": None,
}
TILES = Tiles(size=512)


def _leaf(leaf, x, t):
    """(values, comparisons) by plain Python; None for what isn't there."""
    kind, a = leaf[:2]
    at = lambda n, k=0: x[t - k][n] if t >= k else None
    more = lambda p, q: p is not None and q is not None and p > q
    if kind in ("CrossUp", "BreakDown"):
        v = [at(a, 1), at(leaf[2], 1), at(a), at(leaf[2])]
        if None in v:
            return v, [False] * (4 if kind == "CrossUp" else 2)
        if kind == "BreakDown":
            return v, [v[0] >= v[1], v[2] < v[3]]
        return v, [abs(v[2] - v[0]) >= 1e-6, abs(v[3] - v[1]) >= 1e-6, v[0] <= v[1], v[2] > v[3]]
    if kind == "Between":
        return [45.0, 55.0, at(a)], [at(a) >= 45.0, at(a) <= 55.0]
    if kind in ("Rising", "Falling"):
        v = [at(a, leaf[2]), at(a)]
        return v, [leaf[2] > 0 and (more(v[1], v[0]) if kind == "Rising" else more(v[0], v[1]))]
    if kind in ("SlopeGT", "SlopeLT"):
        p, n = at(a, leaf[3]), leaf[3]
        slope = (at(a) - p) / n if n and p is not None else None
        return [p, at(a), slope], [more(slope, leaf[2]) if kind == "SlopeGT" else more(leaf[2], slope)]
    v = abs(at(a)) if kind == "AbsGT" else at(a)
    return [v, leaf[2]], [v < leaf[2] if kind == "LT" else v > leaf[2]]


def _branch(rule, holds):
    if rule[0] == "OR":
        for side, name in ((rule[1], "OR_left:"), (rule[2], "OR_right:")):
            if _branch(side, holds):
                return name + _branch(side, holds)
        return ""
    if rule[0] == "AND":
        both = [_branch(r, holds) for r in rule[1:]]
        return f"AND({both[0]} && {both[1]})" if all(both) else ""
    if rule[0] == "NOT":
        return "" if _branch(rule[1], holds) else "NOT(false)"
    return rule[0] if holds(rule) else ""


@pytest.fixture(scope="module")
def series(walk):
    rows = features(walk, features_of(*RULES.values())).orderBy("symbol", "bar_idx").collect()
    return {sym: [r.asDict() for r in rows if r.symbol == sym] for sym in ("a", "b")}


def test_every_rule_on_every_bar(walk, series):
    got = {(r.rule, r.symbol, r.bar_idx): r for r in P.prove(tiled_features(walk, features_of(*RULES.values()), TILES), RULES, TILES).collect()}
    seen = 0
    for sym, x in series.items():
        for t in range(len(x)):
            holds = lambda leaf: all(_leaf(leaf, x, t)[1])
            for name, rule in RULES.items():
                branch = "no_rule" if rule is None else _branch(rule, holds)
                r = got.get((name, sym, t))
                assert (r is not None) == bool(branch), (name, sym, t)
                if r is None:
                    continue
                seen += 1
                assert r.path == branch and len(r.leaves) == len(leaves(rule))
                for p, leaf in zip(r.leaves, leaves(rule), strict=True):
                    values, tests = _leaf(leaf, x, t)
                    assert [v is None for v in p.shown] == [v is None for v in values] and p.finite == (None not in values)
                    assert [v for v in p.shown if v is not None] == pytest.approx([v for v in values if v is not None], rel=1e-9)
                    assert [c.ok for c in p.tests] == tests and p.result == all(tests) and p.kind == leaf[0]
    assert seen == len(got) and {k[0] for k in got} == set(RULES) - {"never"}


def test_signals_of_a_book(spark, walk):
    """Only asked rows, each by its own strategy; a signal asked twice is one; files carry the summaries."""
    book = [Strategy("long", RULES["nested"], regime=("GT", "ADX", 5.0)), Strategy("slow", ("OR", UP, RISE))]
    prep = prepared(walk, book)
    asked = spark.createDataFrame([("long", "a", 300), ("slow", "a", 300), ("slow", "a", 300), ("slow", "b", 0), ("slow", "zz", 9)], "strategy string, symbol string, signal_idx long")
    got = {(r.strategy, r.symbol, r.signal_idx): r for r in P.prove_signals(prep, asked, book, ["EMA10"]).collect()}
    assert set(got) == {("long", "a", 300), ("slow", "a", 300), ("slow", "b", 0)}
    assert len(got["long", "a", 300].leaves) == 5 and len(got["slow", "a", 300].leaves) == 2
    first = got["slow", "b", 0]
    assert not first.entry_ok and first.path == "none" and not any(p.result or p.reaches for p in first.leaves)
    assert first.summary.startswith("regime_ok=true | entry_ok=false | path=none | CrossUp(EMA10,EMA20):false[EMA10[t-1]=NaN | ") and first.summary.endswith("}")
    proofs = P.prove_signals(prep, asked, book, ["EMA10"])
    states = walk.select("symbol", F.lit("slow").alias("strategy"), "bar_idx", F.array(F.lit("flat")).alias("states"))
    file = state_file_with_proofs(states, prep, proofs, ["EMA10"]).collect()
    assert len(file) == walk.count() and sum(r.ProofSummary.startswith("regime_ok") for r in file) == 2
    assert all(r.ProofSummary.startswith(("indicators={EMA10=", "regime_ok")) for r in file)
    trade = spark.createDataFrame([("slow", "a", 300, 301, 302, 0, 0, 1, 1.0, 1.0, 0.0, 2, "tp_hit", 0.9, 1.1, False)],
                                  "strategy string, symbol string, signal_idx long, entry_idx long, exit_idx long, entry_ms long, exit_ms long, dir int, entry_price double, "
                                  "exit_price double, pnl double, hold int, reason string, stop double, target double, trails boolean")
    assert trade_file(trade, walk, proofs).first().ProofSummary == got["slow", "a", 300].summary and trade_file(trade, walk).first().ProofSummary == ""
    assert P.prove_signals(prep, asked.limit(0), book).count() == 0
