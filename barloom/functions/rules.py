"""Boolean rules over feature columns, as Spark SQL expressions.

A rule is a leaf ``(kind, feature, ...)`` or ``("AND", l, r)``, ``("OR", l, r)``,
``("NOT", r)``; ``None`` is the empty rule, always true.

Leaves: ``("GT", a, x)``, ``("LT", a, x)``, ``("Between", a, x, y)``,
``("AbsGT", a, x)``, ``("AbsLT", a, x)``, ``("Rising", a, n)``,
``("Falling", a, n)``, ``("SlopeGT", a, x, n)``, ``("SlopeLT", a, x, n)``,
``("CrossUp", a, b)``, ``("CrossDown", a, b)``, ``("BreakUp", a, b)``,
``("BreakDown", a, b)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .indicators import _apply, lag

PAIRS = ("CrossUp", "CrossDown", "BreakUp", "BreakDown")
MOVED = 1e-6


def leaves(rule) -> list[tuple]:
    if rule is None:
        return []
    if rule[0] in ("AND", "OR", "NOT"):
        return [leaf for part in rule[1:] for leaf in leaves(part)]
    return [rule]


def features_of(*rules) -> list[str]:
    names = []
    for rule in rules:
        for leaf in leaves(rule):
            names += [leaf[1], leaf[2]] if leaf[0] in PAIRS else [leaf[1]]
    return list(dict.fromkeys(names))


def look_back(rule) -> int:
    """Rows a rule looks back, at least 1 for crossings."""
    return max([_depth(leaf) for leaf in leaves(rule)], default=0)


def _depth(leaf) -> int:
    if leaf[0] in PAIRS:
        return 1
    return leaf[-1] if leaf[0] in ("Rising", "Falling", "SlopeGT", "SlopeLT") else 0


def leaf_sql(leaf: tuple) -> str:
    kind, a = leaf[0], leaf[1]
    if kind in ("GT", "LT"):
        test = f"{a} {'>' if kind == 'GT' else '<'} {float(leaf[2])!r}D"
    elif kind in ("AbsGT", "AbsLT"):
        test = f"abs({a}) {'>' if kind == 'AbsGT' else '<'} {float(leaf[2])!r}D"
    elif kind == "Between":
        lo, hi = sorted(leaf[2:4])
        test = f"{a} BETWEEN {float(lo)!r}D AND {float(hi)!r}D"
    elif kind in ("Rising", "Falling"):
        test = "false" if leaf[2] <= 0 else f"{a} {'>' if kind == 'Rising' else '<'} {lag(a, leaf[2])}"
    elif kind in ("SlopeGT", "SlopeLT"):
        n = leaf[3]
        sign = ">" if kind == "SlopeGT" else "<"
        test = "false" if n <= 0 else f"({a} - {lag(a, n)}) / {n}D {sign} {float(leaf[2])!r}D"
    elif kind in PAIRS:
        b = leaf[2]
        before, after = ("<=", ">") if kind.endswith("Up") else (">=", "<")
        test = f"{lag(a)} {before} {lag(b)} AND {a} {after} {b}"
        if kind.startswith("Cross"):
            test += f" AND abs({a} - {lag(a)}) >= {MOVED}D AND abs({b} - {lag(b)}) >= {MOVED}D"
    else:
        raise ValueError(f"unknown leaf {kind}")
    return f"coalesce({test}, false)"


def rule_sql(rule) -> str:
    if rule is None:
        return "true"
    if rule[0] in ("AND", "OR"):
        return f"({rule_sql(rule[1])} {rule[0]} {rule_sql(rule[2])})"
    if rule[0] == "NOT":
        return f"(NOT {rule_sql(rule[1])})"
    return leaf_sql(rule)


def fired_path_sql(rule, here: str = "root") -> str:
    """Text path of the OR branches that fired, NULL where the rule is false."""
    if rule is None or rule[0] not in ("AND", "OR"):
        return f"CASE WHEN {rule_sql(rule)} THEN '{here}' END"
    left, right = (fired_path_sql(r, f"{here}.{side}") for r, side in zip(rule[1:], ("L", "R")))
    if rule[0] == "OR":
        return f"coalesce({left}, {right})"
    return f"CASE WHEN {rule_sql(rule)} THEN concat_ws('+', {left}, {right}) END"


def apply_rules(tiled: DataFrame, rules: dict[str, object], extra: dict[str, str] | None = None) -> DataFrame:
    """Add one boolean column per rule to a tiled frame.  NaN never fires a leaf."""
    used = features_of(*rules.values())
    clean = [F.expr(f"nanvl({c}, CAST(NULL AS DOUBLE)) AS {c}") if c in used else F.col(c) for c in tiled.columns]
    exprs = {name: rule_sql(rule) for name, rule in rules.items()} | (extra or {})
    return _apply(tiled.select(*clean), exprs, set(exprs))


def edges(tiled: DataFrame, conds: list[str]) -> DataFrame:
    """False-to-true transitions of boolean columns, as ``<name>_edge``."""
    exprs = {f"{c}_edge": f"({c} AND NOT coalesce({lag(c)}, false))" for c in conds}
    return _apply(tiled, exprs, set(exprs))


def volatility_ok(threshold: float | None) -> str:
    """Volatility filter: off, or ATR against its own average (non-positive average passes)."""
    return "true" if threshold is None else f"(ATR14_SMA50 <= 0 OR ATR14 >= {float(threshold)!r}D * ATR14_SMA50)"


# --- rule tables ----------------------------------------------------------

def leaf_rows(rule_id: str, rule, side: str = "entry") -> list[tuple]:
    """Flatten a rule to ``(rule_id, side, pos, depth, kind, a, b, x, y, lb)`` rows, operators included."""
    rows: list[tuple] = []

    def walk(node, depth):
        kind = node[0]
        if kind in ("AND", "OR", "NOT"):
            rows.append((rule_id, side, len(rows), depth, kind, None, None, None, None, 0))
            for child in node[1:]:
                walk(child, depth + 1)
            return
        b = node[2] if kind in PAIRS else None
        x = float(node[2]) if kind in ("GT", "LT", "AbsGT", "AbsLT", "Between", "SlopeGT", "SlopeLT") else None
        y = float(node[3]) if kind == "Between" else None
        rows.append((rule_id, side, len(rows), depth, kind, node[1], b, x, y, _depth(node) if kind not in PAIRS else 0))

    if rule is not None:
        walk(rule, 0)
    return rows


def degenerate(kind="kind", a="a", b="b", x="x", y="y"):
    """Leaf that can never carry information, as a Column over a rule table."""
    return F.expr(f"""CASE
        WHEN {kind} IN ('CrossUp', 'CrossDown', 'BreakUp', 'BreakDown') THEN {a} = {b}
        WHEN {kind} = 'Between' THEN {x} = {y}
          OR abs({x} - {y}) < CASE WHEN greatest({x}, {y}) < 1 THEN 0.01D ELSE greatest({x}, {y}) * 0.01D END
          OR ({x} <= 0.001D AND {y} <= 0.01D)
        ELSE false END""")


def static_threshold(prefix_meta: str = ""):
    """Fixed price or volume levels that only fit one market period."""
    return F.expr("""kind IN ('GT', 'LT', 'Between', 'AbsGT', 'AbsLT') AND (
        (type = 'price_level' AND x BETWEEN 1000 AND 500000)
        OR ((type = 'volume_raw' OR a LIKE 'Vol%' OR a = 'OBV') AND x BETWEEN 100 AND 100000))""")


def event_misuse():
    """Trend leaf on a rarely true event feature."""
    from .meta import SPARSE_PREFIXES
    likes = " OR ".join(f"startswith(a, '{p}')" for p in SPARSE_PREFIXES)
    return F.expr(f"kind IN ('Rising', 'Falling') AND ({likes})")


def complexity(rules: DataFrame, keys: list[str]) -> DataFrame:
    """Node, leaf, feature, parameter and operator counts per rule or strategy."""
    leaf = F.col("kind").isin("AND", "OR", "NOT") == False  # noqa: E712
    params = (
        F.when(~leaf | F.col("kind").isin("CrossUp", "CrossDown", "Rising", "Falling"), 0)
        .when(F.col("kind") == "Between", 2).otherwise(1)
    )
    used = F.filter(F.array("a", "b"), lambda v: v.isNotNull())
    counts = rules.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(leaf).alias("leaves"),
        F.sum(params).alias("params"),
        F.max("depth").alias("max_depth"),
        *[F.count_if(F.col("kind") == op).alias(f"n_{op.lower()}") for op in ("AND", "OR", "NOT")],
    )
    distinct = rules.select(*keys, F.explode(used).alias("f")).distinct().groupBy(*keys).agg(F.count("f").alias("features"))
    return counts.join(distinct, keys, "left").withColumn("features", F.coalesce("features", F.lit(0)))
