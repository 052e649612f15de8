"""Feature metadata and rules (M1-M7, P1-P18, J1, J9, A16-A20 rates on single rules)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import meta as M
from ..functions import rules as R
from ..functions.indicators import ALL_FEATURES, STATEFUL, features, tiled_features
from ..functions.proofs import prove
from ..operators.tiling import Tiles, drop_halo
from ..session import materialize
from ..sources.bars import lineitem_bars
from . import sqlkit as Q
from .common import Registry, bars_of, rounded, table

# Rules used across the queries.
RULES = {
    "gt": ("GT", "RSI14", 55.0), "lt": ("LT", "RSI14", 45.0),
    "between": ("Between", "RSI14", 60.0, 40.0),
    "abs_gt": ("AbsGT", "ROC10", 50.0), "abs_lt": ("AbsLT", "ROC10", 50.0),
    "rising": ("Rising", "EMA20", 3), "falling": ("Falling", "EMA20", 3), "rising_none": ("Rising", "EMA20", 0),
    "slope_gt": ("SlopeGT", "EMA20", 0.1, 5), "slope_lt": ("SlopeLT", "EMA20", -0.1, 5),
    "cross_up": ("CrossUp", "EMA10", "EMA20"), "cross_down": ("CrossDown", "EMA10", "EMA20"),
    "break_up": ("BreakUp", "SwingHigh", "HH_20_prev"), "break_down": ("BreakDown", "SwingLow", "LL_20_prev"),
    "tree_and": ("AND", ("GT", "RSI14", 50.0), ("NOT", ("Falling", "EMA20", 3))),
    "tree_or": ("OR", ("CrossUp", "EMA10", "EMA20"), ("AND", ("LT", "RSI14", 40.0), ("Rising", "EMA20", 2))),
    "tree_not": ("NOT", ("BreakUp", "SwingHigh", "HH_20_prev")),
    "empty": None,
}
STAT_FEATURES = ["RSI14", "RSI7", "ADX", "PlusDI", "EMA10", "EMA20", "ATR14", "MACD", "VolZ20", "VolSMA20", "Imbalance",
                 "BodyPct", "ClosePos", "Body", "BOS", "SweepUp_20"]


def S(x, k=1):
    return x if k == 0 else f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY bar_idx)"


def twin(rule) -> str:
    """Rule as DuckDB SQL, spelled out per leaf."""
    if rule is None:
        return "TRUE"
    op, a = rule[0], rule[1]
    if op == "NOT":
        return f"(NOT {twin(a)})"
    if op in ("AND", "OR"):
        return f"({twin(a)} {op} {twin(rule[2])})"
    moved = lambda b: f"abs({a} - {S(a)}) >= 1e-6 AND abs({b} - {S(b)}) >= 1e-6 AND "
    text = {
        "GT": lambda x: f"{a} > {x}", "LT": lambda x: f"{a} < {x}",
        "AbsGT": lambda x: f"abs({a}) > {x}", "AbsLT": lambda x: f"abs({a}) < {x}",
        "Between": lambda x, y: f"{a} >= {min(x, y)} AND {a} <= {max(x, y)}",
        "Rising": lambda n: f"{n} > 0 AND {a} > {S(a, n)}", "Falling": lambda n: f"{n} > 0 AND {a} < {S(a, n)}",
        "SlopeGT": lambda x, n: f"({a} - {S(a, n)}) / {n} > {x}", "SlopeLT": lambda x, n: f"({a} - {S(a, n)}) / {n} < {x}",
        "CrossUp": lambda b: moved(b) + f"{S(a)} <= {S(b)} AND {a} > {b}",
        "CrossDown": lambda b: moved(b) + f"{S(a)} >= {S(b)} AND {a} < {b}",
        "BreakUp": lambda b: f"{S(a)} <= {S(b)} AND {a} > {b}",
        "BreakDown": lambda b: f"{S(a)} >= {S(b)} AND {a} < {b}",
    }[op](*rule[2:])
    return f"coalesce({text}, FALSE)"


def rules_cte(rules: dict, extra: list[str] = (), source: str = "events") -> str:
    """CTE ``c``: bars, features and one boolean column per rule; ``r_<name>``."""
    names = list(dict.fromkeys([*R.features_of(*rules.values()), *extra]))
    cols = ", ".join(f"{twin(rule)} AS r_{n}" for n, rule in rules.items())
    return f"{Q.features_cte(names, source)},\nc AS (SELECT *, {cols} FROM f)"


def ruled(spark, d, rules: dict, extra=(), source="events", more=None):
    """Tiled bars with features and boolean rule columns ``r_<name>``."""
    names = list(dict.fromkeys([*R.features_of(*rules.values()), *extra]))
    t = tiled_features(bars_of(spark, d, source), names)
    return R.apply_rules(t, {f"r_{n}": rule for n, rule in rules.items()}, more)


def plain(t):
    return drop_halo(t, Tiles().size)


def leaf_query(names):
    def run(spark, d):
        rules = {n: RULES[n] for n in names}
        return plain(ruled(spark, d, rules)).select("symbol", "bar_idx", *[f"r_{n}" for n in names])
    sql = f"WITH RECURSIVE {rules_cte({n: RULES[n] for n in names})} SELECT symbol, bar_idx, " + \
        ", ".join(f"r_{n}" for n in names) + " FROM c"
    return run, sql


# --- metadata ---------------------------------------------------------------

def _values(rows):
    lit = lambda v: "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else repr(v))
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


META_CTE = (f"meta(pos, name, type, family, category, lo, hi) AS (SELECT pos, name, type, family, category, "
            f"CAST(lo AS DOUBLE), CAST(hi AS DOUBLE) FROM (VALUES {_values(M.meta_rows(ALL_FEATURES))}) "
            f"v(pos, name, type, family, category, lo, hi))")
STATS_CTE = "stats AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS name, CAST(min({n}) AS DOUBLE) AS min, CAST(max({n}) AS DOUBLE) AS max, "
    f"CAST(avg({n}) AS DOUBLE) AS mean, CAST(stddev_pop({n}) AS DOUBLE) AS std FROM train" for n in STAT_FEATURES) + ")"
# Every feature but the trend pair, which isn't planned with the others.
ALL_STATS = [n for n in ALL_FEATURES if n not in STATEFUL]
TRAIN_UNTIL = 1705708800000  # 2024-01-20, the end of the training split
TRAIN = f"{Q.features_cte(STAT_FEATURES)},\ntrain AS MATERIALIZED (SELECT * FROM f WHERE open_ms < {TRAIN_UNTIL})"
STEPS = [-1.5, -0.5, 0.5, 1.5]
PAIR_SQL = """pairs AS (SELECT l.name AS a, r.name AS b FROM meta l JOIN meta r ON l.family = r.family AND l.name <> r.name)"""
SWEEP_CTE = f"""{META_CTE}, {PAIR_SQL},
lev AS (SELECT m.name, lo, hi, mean, std, k FROM stats JOIN meta m USING (name), (VALUES {_values([(k,) for k in STEPS])}) v(k)
        WHERE family IS NOT NULL),
sweep AS (
  SELECT kind, name AS a, CAST(NULL AS VARCHAR) AS b, CAST(k AS DOUBLE) AS k,
    CASE WHEN kind <> 'Rising' THEN x END AS x, CASE WHEN kind = 'Between' THEN x + 0.5 * std END AS y,
    CAST(CASE WHEN kind IN ('Rising', 'SlopeGT') THEN 3 + floor(abs(k) * 4) ELSE 0 END AS INTEGER) AS lb
  FROM (SELECT *, CASE WHEN lo IS NULL THEN mean + k * std ELSE least(greatest(mean + k * std, lo), hi) END AS x FROM lev),
       (VALUES ('GT'), ('LT'), ('Between'), ('Rising'), ('SlopeGT')) kk(kind)
  UNION ALL
  SELECT kind, a, b, NULL, NULL, NULL, 0 FROM pairs, (VALUES ('CrossUp'), ('CrossDown')) kk(kind)
  WHERE a IN (SELECT name FROM stats) AND b IN (SELECT name FROM stats))"""


def train_stats(spark, d):
    f = features(bars_of(spark, d), STAT_FEATURES)
    stats = M.feature_stats(f.filter(F.col("open_ms") < TRAIN_UNTIL), STAT_FEATURES)
    return materialize(stats, "stats")  # one row per feature, read by several branches


def candidates(spark, d):
    return M.sweep(train_stats(spark, d), M.feature_meta(spark), STEPS)


def candidate_rules(spark, d):
    """Two-leaf rules: every crossing joined with every threshold leaf on its first feature."""
    c = candidates(spark, d)
    cross = c.filter("kind IN ('CrossUp', 'CrossDown')").select("kind", "a", "b")
    level = c.filter("kind IN ('GT', 'Between')").select(F.col("kind").alias("lk"), F.col("a").alias("la"), "x", "y", "k")
    both = cross.join(level, F.col("a") == F.col("la"))
    rid = F.concat_ws("/", "kind", "a", "b", "lk", F.col("k").cast("string"))
    node = lambda pos, depth, kind, a, b, x, y: F.struct(
        F.lit(pos).alias("pos"), F.lit(depth).alias("depth"), kind.alias("kind"), a.cast("string").alias("a"),
        b.cast("string").alias("b"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    no = F.lit(None)
    parts = F.array(
        node(0, 0, F.lit("AND"), no, no, no, no),
        node(1, 1, F.col("kind"), F.col("a"), F.col("b"), no, no),
        node(2, 1, F.col("lk"), F.col("la"), no, F.col("x"), F.col("y")))
    return both.select(rid.alias("rule_id"), F.explode(parts).alias("n")).select("rule_id", "n.*")


RULE_ROWS = """duo AS (SELECT c.kind, c.a, c.b, l.kind AS lk, l.x, l.y, l.k,
    concat_ws('/', c.kind, c.a, c.b, l.kind, CAST(l.k AS VARCHAR)) AS rule_id
  FROM sweep c JOIN sweep l ON l.a = c.a AND l.kind IN ('GT', 'Between') WHERE c.kind IN ('CrossUp', 'CrossDown')),
nodes AS (
  SELECT rule_id, 0 AS pos, 0 AS depth, 'AND' AS kind, NULL AS a, NULL AS b, NULL AS x, NULL AS y FROM duo
  UNION ALL SELECT rule_id, 1, 1, kind, a, b, NULL, NULL FROM duo
  UNION ALL SELECT rule_id, 2, 1, lk, a, NULL, x, y FROM duo)"""
FULL = f"WITH RECURSIVE {TRAIN},\n{STATS_CTE},\n{SWEEP_CTE},\n{RULE_ROWS}"


def stats_query(spark, d):
    f = features(bars_of(spark, d), ALL_STATS).filter(F.col("open_ms") < TRAIN_UNTIL)
    return rounded(M.feature_stats(f, ALL_STATS), ["min", "max", "mean", "std"])


ALL_STATS_SQL = f"WITH RECURSIVE {Q.features_cte(ALL_STATS)}, train AS MATERIALIZED (SELECT * FROM f WHERE open_ms < {TRAIN_UNTIL}) " + " UNION ALL ".join(
    f"SELECT '{n}' AS name, " + ", ".join(f"CAST(round(CAST({fn}({n}) AS DOUBLE), 6) AS DOUBLE) + 0.0 AS {c}" for c, fn in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_pop")))
    + " FROM train" for n in ALL_STATS)


def typed_stats(spark, d):
    s = train_stats(spark, d).join(F.broadcast(M.feature_meta(spark)), "name")
    return rounded(s.groupBy("type", "category").agg(F.count(F.lit(1)).alias("n"), F.max("max").alias("top")), ["top"])


def fingerprint_query(spark, d):
    """Fingerprint of the columns that a feature table of the bars has, beside its rows."""
    t = features(bars_of(spark, d), ALL_STATS).select("bar_idx", *ALL_STATS)
    names = F.array(*[F.lit(c) for c in t.columns if c in M.TYPE_OF])
    return t.agg(F.count(F.lit(1)).alias("n")).select("n", F.size(names).alias("columns"), M.fingerprint(names).alias("fingerprint"))


def warmups(spark, d):
    """Warmup need per candidate kind: deepest feature look-back plus 200."""
    c = candidates(spark, d)
    deepest = F.greatest(M.lookback(F.col("a")), F.coalesce(M.lookback(F.col("b")), F.lit(0)))
    return c.groupBy("kind").agg((F.max(deepest) + 200).alias("warmup"))


def quality_query(spark, d):
    names = ["EMA10", "EMA200", "RSI14", "MACD", "ADX"]
    bars = lineitem_bars(table(spark, d, "lineitem"), columns=["high", "low", "close"])
    return M.quality(features(bars, names), names, 200)


def clamped(spark, d):
    s = train_stats(spark, d).join(F.broadcast(M.feature_meta(spark)), "name")
    out = s.select("name", M.clamp_threshold(F.col("mean") - 3 * F.col("std"), F.col("lo"), F.col("hi")).alias("low_cut"),
                   M.clamp_threshold(F.col("mean") + 3 * F.col("std"), F.col("lo"), F.col("hi")).alias("high_cut"))
    return rounded(out, ["low_cut", "high_cut"])


def pair_counts(spark, d):
    c = candidates(spark, d).filter("b IS NOT NULL")
    return c.groupBy("a", "kind").agg(F.count("b").alias("n"))


def checks(spark, d):
    """Degenerate, cross-scale, static-threshold and event-misuse findings over all candidate leaves."""
    meta = F.broadcast(M.feature_meta(spark))
    c = candidates(spark, d).join(meta.select(F.col("name").alias("a"), "type"), "a")
    wild = c.crossJoin(F.broadcast(M.feature_meta(spark).filter("name IN ('VolZ20', 'BOS')").select(F.col("name").alias("other"))))
    crossed = wild.filter("kind = 'CrossUp'").select("a", F.col("other").alias("b")).distinct()
    illegal = crossed.join(M.allowed_pairs(M.feature_meta(spark)), ["a", "b"], "left_anti").agg(F.count(F.lit(1)).alias("illegal_pairs"))
    return c.agg(
        F.count_if(R.degenerate()).alias("degenerate"), F.count_if(R.static_threshold()).alias("static_levels"),
        F.count_if(R.event_misuse()).alias("event_misuse"), F.count(F.lit(1)).alias("leaves"),
    ).crossJoin(illegal)


def complexity_query(spark, d):
    return R.complexity(candidate_rules(spark, d), ["rule_id"])


def min_complexity(spark, d):
    meta = F.broadcast(M.feature_meta(spark).select(F.col("name").alias("f"), "category"))
    rows = candidate_rules(spark, d).filter("a IS NOT NULL").select("rule_id", F.explode(F.array("a", F.coalesce("b", "a"))).alias("f"))
    return rows.join(meta, "f").groupBy("rule_id").agg(
        (F.max(F.col("category") == "price_market") & F.max(F.col("category") == "volume_volatility")).alias("ok"))


def proofs(spark, d):
    """All rules on the bars where they hold, a row for each leaf."""
    proven = prove(tiled_features(bars_of(spark, d), R.features_of(*RULES.values())), RULES)
    leaf = proven.select("rule", "symbol", "bar_idx", "path", F.posexplode_outer("leaves").alias("pos", "l"))
    shown = [F.get("l.shown", F.lit(k)).alias(f"v{k}") for k in range(4)]
    tests = F.array_join(F.transform("l.tests", lambda t: t["ok"].cast("string")), ",").alias("tests")
    # An empty rule has no leaf to fail.
    whole = [F.coalesce(c, F.lit(v)).alias(c.split(".")[-1]) for c, v in (("pos", -1), ("l.lookback", 0), ("l.reaches", True), ("l.finite", True), ("l.result", True))]
    out = leaf.select("rule", "symbol", "bar_idx", "path", "l.kind", "l.a", "l.b", *whole, *shown, tests)
    return rounded(out, ["v0", "v1", "v2", "v3"])


# Paths of trees as they must read, by rule; a single leaf's is its kind.
PATHS = {"tree_and": "'AND(GT && NOT(false))'", "tree_not": "'NOT(false)'", "empty": "'no_rule'",
         "tree_or": f"CASE WHEN {twin(RULES['cross_up'])} THEN 'OR_left:CrossUp' ELSE 'OR_right:AND(LT && Rising)' END"}


def proofs_sql() -> str:
    """One branch per rule and leaf, over the bars on which the rule holds."""
    def leaf(rule):
        kind, a = rule[:2]
        if kind in ("GT", "LT"):
            return [a, rule[2]], [f"{a} {'>' if kind == 'GT' else '<'} {rule[2]}"], 0
        if kind in ("AbsGT", "AbsLT"):
            return [f"abs({a})", rule[2]], [f"abs({a}) {'>' if kind == 'AbsGT' else '<'} {rule[2]}"], 0
        if kind == "Between":
            return [min(rule[2:]), max(rule[2:]), a], [f"{a} >= {min(rule[2:])}", f"{a} <= {max(rule[2:])}"], 0
        if kind in ("Rising", "Falling"):
            return [S(a, rule[2]), a], [f"{a} {'>' if kind == 'Rising' else '<'} {S(a, rule[2])}"], rule[2]
        if kind in ("SlopeGT", "SlopeLT"):
            slope = f"(({a} - {S(a, rule[3])}) / {rule[3]})"
            return [S(a, rule[3]), a, slope], [f"{slope} {'>' if kind == 'SlopeGT' else '<'} {rule[2]}"], rule[3]
        b, (was, now) = rule[2], ("<=", ">") if kind.endswith("Up") else (">=", "<")
        moved = [f"abs({x} - {S(x)}) >= 1e-6" for x in (a, b)] if kind.startswith("Cross") else []
        return [S(a), S(b), a, b], [*moved, f"{S(a)} {was} {S(b)}", f"{a} {now} {b}"], 1

    branches = []
    for name, rule in RULES.items():
        for pos, part in enumerate(R.leaves(rule)):
            values, tests, back = leaf(part)
            cols = [f"CAST(round(CAST({v} AS DOUBLE), 6) AS DOUBLE) + 0.0" for v in values] + ["CAST(NULL AS DOUBLE)"] * (4 - len(values))
            ok = " || ',' || ".join(f"CAST(coalesce({t}, FALSE) AS VARCHAR)" for t in tests)
            b = f"'{part[2]}'" if part[0] in R.PAIRS else "CAST(NULL AS VARCHAR)"
            branches.append(
                f"SELECT '{name}' AS rule, symbol, bar_idx, {PATHS.get(name, repr(part[0]))} AS path, {pos} AS pos, '{part[0]}' AS kind, '{part[1]}' AS a, {b} AS b, {back} AS lookback, "
                f"bar_idx >= {back} AS reaches, {' AND '.join(f'({v}) IS NOT NULL' for v in values)} AS finite, {twin(part)} AS result, "
                + ", ".join(f"{v} AS v{k}" for k, v in enumerate(cols)) + f", {ok} AS tests, r_{name} AS fired FROM c")
    branches.append("SELECT 'empty', symbol, bar_idx, 'no_rule', -1, NULL, NULL, NULL, 0, TRUE, TRUE, TRUE, NULL, NULL, NULL, NULL, NULL, r_empty FROM c")
    return f"WITH RECURSIVE {rules_cte(RULES)}, every AS ({' UNION ALL '.join(branches)}) SELECT * EXCLUDE (fired) FROM every WHERE fired"


VOL_OK = 0.9
TRADABLE = {"entry": RULES["tree_or"], "regime": ("GT", "ADX", 15.0)}


def tradable(spark, d):
    t = ruled(spark, d, TRADABLE, ["Active", "ATR14", "ATR14_SMA50"], more={"vol_ok": R.volatility_ok(VOL_OK)})
    t = t.withColumn("ok", F.expr("Active > 0 AND r_regime AND vol_ok AND r_entry"))
    return plain(R.edges(t, ["ok"])).filter("ok").select("symbol", "bar_idx", "ok_edge")


def vol_filter(spark, d):
    t = ruled(spark, d, {}, ["ATR14", "ATR14_SMA50"], more={"vol_ok": R.volatility_ok(VOL_OK)})
    return plain(t).groupBy("symbol", "vol_ok").agg(F.count(F.lit(1)).alias("n"))


def agreement(spark, d):
    """Share of bars on which two rules agree, and the longest run of disagreement."""
    from ..operators.signals import agreement as agree
    t = ruled(spark, d, {"a": RULES["tree_or"], "b": RULES["rising"]})
    return rounded(agree(plain(t), "r_a", "r_b"), ["agreement"])


AGREE_SQL = f"""WITH RECURSIVE {rules_cte({"a": RULES["tree_or"], "b": RULES["rising"]})},
n AS (SELECT symbol, count(*) - 200 AS size FROM c GROUP BY symbol),
s AS (SELECT symbol, bar_idx, r_a = r_b AS same FROM c WHERE bar_idx >= 200),
g AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY bar_idx) AS isl FROM s),
r AS (SELECT symbol, isl, count(*) FILTER (WHERE NOT same) AS run FROM g GROUP BY symbol, isl),
a AS (SELECT symbol, avg(CASE WHEN same THEN 1.0 ELSE 0.0 END) AS part FROM g GROUP BY symbol)
SELECT symbol, CAST(round(CASE WHEN size >= 100 THEN part ELSE 1 END, 6) AS DOUBLE) + 0.0 AS agreement,
  CASE WHEN size >= 100 THEN (SELECT max(run) FROM r WHERE r.symbol = n.symbol) ELSE 0 END AS longest_gap FROM n LEFT JOIN a USING (symbol)"""


def register(reg: Registry) -> None:
    for key, names in {
        "p01_gt_lt": ["gt", "lt"], "p02_between": ["between"], "p03_abs": ["abs_gt", "abs_lt"],
        "p04_rising_falling": ["rising", "falling", "rising_none"], "p05_slope": ["slope_gt", "slope_lt"],
        "p06_cross": ["cross_up", "cross_down"], "p07_break": ["break_up", "break_down"],
        "p08_trees": ["tree_and", "tree_or", "tree_not", "empty"],
    }.items():
        reg.add(key, *leaf_query(names))
    reg.add("m01_j01_type_lookup", typed_stats, f"""{FULL} SELECT type, category, count(*) AS n,
        CAST(round(max(max), 6) AS DOUBLE) + 0.0 AS top FROM stats JOIN meta USING (name) GROUP BY type, category""")
    reg.add("m02_pairs", pair_counts, f"{FULL} SELECT a, kind, count(b) AS n FROM sweep WHERE b IS NOT NULL GROUP BY a, kind")
    reg.add("m03_train_stats", stats_query, ALL_STATS_SQL)
    parts = "|".join(f"{i}:{n}" for i, n in enumerate(n for n in ALL_STATS if n in M.TYPE_OF))
    reg.add("m04_fingerprint", fingerprint_query, f"""WITH {Q.bars_cte()} SELECT count(*) AS n, CAST({len(parts.split('|'))} AS INTEGER) AS columns,
        substr(sha256('{parts}'), 1, 16) AS fingerprint FROM bars""")
    reg.add("m05_lookback", warmups, f"""{FULL}, d AS (SELECT kind,
        greatest(coalesce(TRY_CAST(regexp_extract(a, '([0-9]+)[^0-9]*$', 1) AS INTEGER), 0),
                 coalesce(TRY_CAST(regexp_extract(b, '([0-9]+)[^0-9]*$', 1) AS INTEGER), 0)) AS lb FROM sweep)
        SELECT kind, CAST(max(lb) + 200 AS INTEGER) AS warmup FROM d GROUP BY kind""")
    q = Q.features_cte(["EMA10", "EMA200", "RSI14", "MACD", "ADX"], "lineitem")
    reg.add("m06_quality", quality_query, f"""WITH RECURSIVE {q} SELECT count(*) AS rows_checked,
        count(*) FILTER (WHERE isnan(EMA10) OR isnan(EMA200) OR isnan(RSI14) OR isnan(MACD) OR isnan(ADX)) AS not_finite,
        count(*) FILTER (WHERE EMA10 / close < 0.5 OR EMA10 / close > 1.5) AS EMA10_scale,
        count(*) FILTER (WHERE EMA200 / close < 0.5 OR EMA200 / close > 1.5) AS EMA200_scale,
        count(*) FILTER (WHERE RSI14 < 0 OR RSI14 > 100) AS RSI14_range FROM f WHERE bar_idx >= 200""")
    reg.add("m07_clamps", clamped, f"""{FULL}, x AS (SELECT name,
        CASE WHEN lo IS NULL THEN mean - 3 * std ELSE least(greatest(mean - 3 * std, lo), hi) END AS low_cut,
        CASE WHEN lo IS NULL THEN mean + 3 * std ELSE least(greatest(mean + 3 * std, lo), hi) END AS high_cut
        FROM stats JOIN meta USING (name)) SELECT name, {Q.rounded(['low_cut', 'high_cut'])} FROM x""")
    reg.add("j09_sweep", lambda spark, d: rounded(candidates(spark, d), ["x", "y"]),
            f"{FULL} SELECT kind, a, b, k, {Q.rounded(['x', 'y'])}, lb FROM sweep")
    reg.add("p09_p10_p11_checks", checks, f"""{FULL},
        w AS (SELECT s.*, m.type FROM sweep s JOIN meta m ON m.name = s.a),
        x AS (SELECT DISTINCT a, o AS b FROM sweep, (VALUES ('VolZ20'), ('BOS')) v(o) WHERE kind = 'CrossUp')
        SELECT count(*) FILTER (WHERE CASE WHEN kind IN ('CrossUp', 'CrossDown') THEN a = b WHEN kind = 'Between' THEN
            x = y OR abs(x - y) < CASE WHEN greatest(x, y) < 1 THEN 0.01 ELSE greatest(x, y) * 0.01 END OR (x <= 0.001 AND y <= 0.01)
            ELSE FALSE END) AS degenerate,
          count(*) FILTER (WHERE kind IN ('GT', 'LT', 'Between') AND ((type = 'price_level' AND x BETWEEN 1000 AND 500000)
            OR ((type = 'volume_raw' OR a LIKE 'Vol%') AND x BETWEEN 100 AND 100000))) AS static_levels,
          count(*) FILTER (WHERE kind = 'Rising' AND (a LIKE 'Sweep%' OR a LIKE 'BOS%')) AS event_misuse,
          count(*) AS leaves,
          (SELECT count(*) FROM x WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.a = x.a AND p.b = x.b)) AS illegal_pairs
        FROM w""")
    reg.add("p12_complexity", complexity_query, f"""{FULL} SELECT rule_id, 3 AS nodes, 2 AS leaves,
        CAST(CASE WHEN lk = 'Between' THEN 2 ELSE 1 END AS BIGINT) AS params, 1 AS max_depth, 1 AS n_and, 0 AS n_or, 0 AS n_not,
        2 AS features FROM duo""")
    reg.add("p13_min_complexity", min_complexity, f"""{FULL} SELECT rule_id,
        bool_or(category = 'price_market') AND bool_or(category = 'volume_volatility') AS ok
        FROM nodes n JOIN meta m ON m.name = n.a OR m.name = n.b GROUP BY rule_id""")
    reg.add("p14_p15_proofs", proofs, proofs_sql())
    ok = f"""{rules_cte(TRADABLE, ["Active", "ATR14", "ATR14_SMA50"])},
        k AS (SELECT *, Active > 0 AND r_regime AND r_entry AND (ATR14_SMA50 <= 0 OR ATR14 >= {VOL_OK} * ATR14_SMA50) AS ok FROM c),
        e AS (SELECT *, ok AND NOT coalesce({S("ok")}, FALSE) AS ok_edge FROM k)"""
    reg.add("p17_o01_tradable_edges", tradable, f"WITH RECURSIVE {ok} SELECT symbol, bar_idx, ok_edge FROM e WHERE ok")
    reg.add("p16_volatility_filter", vol_filter, f"""WITH RECURSIVE {Q.features_cte(["ATR14", "ATR14_SMA50"])}
        SELECT symbol, ATR14_SMA50 <= 0 OR ATR14 >= {VOL_OK} * ATR14_SMA50 AS vol_ok, count(*) AS n FROM f GROUP BY 1, 2""")
    reg.add("p18_agreement", agreement, AGREE_SQL)
