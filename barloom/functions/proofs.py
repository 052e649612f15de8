"""Why a rule fired: its leaves with the values they saw, each comparison, and the branch that held.

A rule tree becomes SQL once; rows are proven only where a signal is. Past values are plain columns by then,
so a signal's row alone is enough.

A comparison with a missing value doesn't hold. A path names what held: a leaf's kind, ``OR_left:`` or ``OR_right:``
before the first side that holds, ``AND(x && y)``, and ``NOT(false)``. A side that doesn't hold has no path, so it never
stands for its OR; a rule that doesn't hold has the path ``none``, an empty rule ``no_rule``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tiling import Tiles, drop_halo
from .indicators import lag
from .rules import MOVED, PAIRS, _depth, apply_rules, leaves


def past(a: str, k: int) -> str:
    """Column of a feature's value k bars ago."""
    return a if k == 0 else f"_{a}_{k}"


def pasts(*rules) -> dict[str, str]:
    """Past columns that the rules' proofs read, with their window calls."""
    return {past(n, k): lag(n, k) for rule in rules for leaf in leaves(rule) for k in [_depth(leaf)] if k > 0
            for n in (leaf[1:3] if leaf[0] in PAIRS else leaf[1:2])}


def _seen(leaf: tuple) -> tuple[list[str], list[tuple[str, str]]]:
    """(values, comparisons) of a leaf: SQL of each value, text and SQL of each comparison."""
    kind, a = leaf[0], leaf[1]
    if kind in PAIRS:
        b, pa, pb = leaf[2], past(leaf[1], 1), past(leaf[2], 1)
        before, after = ("<=", ">") if kind.endswith("Up") else (">=", "<")
        moves = [(f"{n} moves", f"abs({n} - {p}) >= {MOVED}D") for n, p in ((a, pa), (b, pb))] if kind.startswith("Cross") else []
        return [pa, pb, a, b], [*moves, (f"{a}[t-1] {before} {b}[t-1]", f"{pa} {before} {pb}"), (f"{a}[t] {after} {b}[t]", f"{a} {after} {b}")]
    if kind == "Between":
        lo, hi = (f"{float(v)!r}D" for v in sorted(leaf[2:4]))
        return [lo, hi, a], [(f"{a} >= {lo[:-1]}", f"{a} >= {lo}"), (f"{a} <= {hi[:-1]}", f"{a} <= {hi}")]
    sign = ">" if kind in ("Rising", "AbsGT", "GT", "SlopeGT") else "<"
    if kind in ("Rising", "Falling"):
        p = past(a, max(leaf[2], 0))
        return [p, a], [(f"{a}[t] {sign} {a}[t-{leaf[2]}]", f"{a} {sign} {p}" if leaf[2] > 0 else "false")]
    x = float(leaf[2])
    if kind in ("SlopeGT", "SlopeLT"):
        p, n = past(a, max(leaf[3], 0)), leaf[3]
        slope = f"(({a} - {p}) / {n}D)" if n > 0 else "CAST(NULL AS DOUBLE)"
        return [p, a, slope], [(f"slope {sign} {x!r}", f"{slope} {sign} {x!r}D")]
    value, name = (f"abs({a})", f"|{a}|") if kind.startswith("Abs") else (a, a)
    return [value, f"{x!r}D"], [(f"{name} {sign} {x!r}", f"{value} {sign} {x!r}D")]


def _holds(leaf: tuple) -> str:
    tests = " AND ".join(sql for _, sql in _seen(leaf)[1])
    return f"(bar_idx >= {max(_depth(leaf), 0)} AND coalesce({tests}, false))"


def leaf_proof(leaf: tuple) -> str:
    """Struct of one leaf: kind, features, look-back, guards, values, comparisons and result."""
    values, tests = _seen(leaf)
    b = f"'{leaf[2]}'" if leaf[0] in PAIRS else "CAST(NULL AS STRING)"
    shown = ", ".join(f"CAST({v} AS DOUBLE)" for v in values)
    compared = ", ".join(f"named_struct('test', '{text}', 'ok', coalesce({sql}, false))" for text, sql in tests)
    finite = " AND ".join(f"({v}) IS NOT NULL" for v in values)
    return (f"named_struct('kind', '{leaf[0]}', 'a', '{leaf[1]}', 'b', {b}, 'lookback', {_depth(leaf)}, 'reaches', bar_idx >= {max(_depth(leaf), 0)}, "
            f"'finite', {finite}, 'shown', array({shown}), 'tests', array({compared}), 'result', {_holds(leaf)})")


def _path(rule) -> str:
    """Path of what held, NULL where the rule doesn't hold."""
    if rule[0] == "NOT":
        return f"CASE WHEN {_path(rule[1])} IS NULL THEN 'NOT(false)' END"
    if rule[0] == "OR":
        return f"coalesce(concat('OR_left:', {_path(rule[1])}), concat('OR_right:', {_path(rule[2])}))"
    if rule[0] == "AND":
        return f"concat('AND(', {_path(rule[1])}, ' && ', {_path(rule[2])}, ')')"
    return f"CASE WHEN {_holds(rule)} THEN '{rule[0]}' END"


def path(rule) -> str:
    return "'no_rule'" if rule is None else f"coalesce({_path(rule)}, 'none')"


def _text(value: str, digits: int = 2) -> str:
    return f"coalesce(CAST(try_cast(round({value}, {digits}) AS DECIMAL(30, {digits})) AS STRING), 'NaN')"


def leaf_text(leaf: tuple) -> str:
    """A leaf's result with its main values, as the files show it."""
    kind, a, values = leaf[0], leaf[1], _seen(leaf)[0]
    names = f"{a},{leaf[2]}" if kind in PAIRS else a
    shown: list[tuple[str, str]] = []
    if kind.startswith("Cross"):
        shown = [(f"{n}[{t}]", _text(v)) for n, t, v in zip((a, leaf[2]) * 2, ("t-1", "t-1", "t", "t"), values)]
    elif kind in ("Rising", "Falling"):
        shown = [(f"{a}[t]", _text(values[1])), (f"{a}[t-{leaf[2]}]", _text(values[0]))]
    elif kind in ("SlopeGT", "SlopeLT"):
        shown = [(f"{a}[slope]", _text(values[2], 4)), ("threshold", _text(f"{float(leaf[2])!r}D"))]
    elif kind in ("GT", "LT", "AbsGT", "AbsLT"):
        shown = [(f"{a}[t]", _text(values[0])), ("threshold", _text(values[1]))]
    body = ", ' | ', ".join(f"'{n}=', {v}" for n, v in shown)
    tail = f", '[', {body}, ']'" if shown else ""
    return f"concat('{kind}({names}):', CAST({_holds(leaf)} AS STRING){tail})"


def indicators_text(names: list[str]) -> str:
    """All named values of a bar in one text."""
    return "concat('indicators={', " + ", ', ', ".join(f"'{n}=', {_text(n)}" for n in names) + ", '}')"


def _leaf_array(rule) -> str:
    # An empty rule has no leaves, but the type of the others.
    return f"array({', '.join(map(leaf_proof, leaves(rule)))})" if rule is not None else f"slice(array({leaf_proof(('GT', 'bar_idx', 0.0))}), 1, 0)"


def prove(tiled: DataFrame, rules: dict[str, object], tiles: Tiles = Tiles()) -> DataFrame:
    """(rule, symbol, bar_idx, path, leaves) of every bar on which a rule holds. ``tiled`` holds the rules' features."""
    t = apply_rules(tiled, {f"_r{i}": rule for i, rule in enumerate(rules.values())})
    t = t.select("*", *[F.expr(f"{call} AS {name}") for name, call in pasts(*rules.values()).items()])
    fired = drop_halo(t, tiles.size).filter(" OR ".join(f"_r{i}" for i in range(len(rules))))
    one = lambda i, name, rule: f"CASE WHEN _r{i} THEN named_struct('rule', '{name}', 'path', {path(rule)}, 'leaves', {_leaf_array(rule)}) END"
    every = ", ".join(one(i, name, rule) for i, (name, rule) in enumerate(rules.items()))
    return fired.select("symbol", "bar_idx", F.expr(f"inline(filter(array({every}), x -> x IS NOT NULL))")).select("rule", "symbol", "bar_idx", "path", "leaves")


def prove_signals(prep: DataFrame, signals: DataFrame, strategies: list, shown: list[str] | None = None, tiles: Tiles = Tiles()) -> DataFrame:
    """(strategy, symbol, signal_idx, regime_ok, entry_ok, path, leaves, summary) of the given signals of a book.

    ``prep`` is the tiled frame of a book (``outcomes.prepared``), ``signals`` holds strategy, symbol and signal_idx.
    Only rows that signals meet are proven, for their own strategy. ``shown`` names columns whose values close the summary.
    """
    calls = pasts(*[s.entry for s in strategies])
    bars = drop_halo(prep.select("*", *[F.expr(f"{call} AS {name}") for name, call in calls.items()]), tiles.size)
    asked = signals.select("strategy", F.col("symbol").alias("_symbol"), "signal_idx").distinct()
    rows = bars.join(asked, (bars["symbol"] == asked["_symbol"]) & (bars["bar_idx"] == asked["signal_idx"]))

    def proof(i, s):
        texts = ", ".join([*map(leaf_text, leaves(s.entry)), *([indicators_text(shown)] if shown else [])])
        summary = f"concat_ws(' | ', concat('regime_ok=', CAST(reg_{i} AS STRING)), concat('entry_ok=', CAST(ent_{i} AS STRING)), concat('path=', {path(s.entry)}), {texts})"
        return (f"WHEN strategy = '{s.name}' THEN named_struct('regime_ok', reg_{i}, 'entry_ok', ent_{i}, 'path', {path(s.entry)}, "
                f"'leaves', {_leaf_array(s.entry)}, 'summary', {summary})")

    chosen = F.expr("CASE " + " ".join(proof(i, s) for i, s in enumerate(strategies)) + " END")
    return rows.select("strategy", "symbol", "signal_idx", chosen.alias("p")).select("strategy", "symbol", "signal_idx", "p.*")
