"""Leaderboards, families and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Global top n: a partial top n per task, merged."""
    return df.orderBy(*order).limit(n)


def best_test(df: DataFrame, n: int = 20) -> DataFrame:
    return top(df, [F.desc("score"), F.asc("max_dd"), F.desc("ret"), F.asc("strategy")], n)


def debug_rank(df: DataFrame, n: int = 20) -> DataFrame:
    return top(df, [F.desc("ret"), F.asc("max_dd"), F.desc("trades"), F.asc("strategy")], n)


def per_family(df: DataFrame, family: list[str], order: list[Column], n: int) -> DataFrame:
    """At most n rows per family.  Spark prunes each family to n rows before the shuffle."""
    w = Window.partitionBy(*family).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def hall_of_fame(df: DataFrame, family: str, k: int = 200, each: int = 5) -> DataFrame:
    """Best k rows with at most ``each`` per family, sentinel (NULL) scores out."""
    order = [F.desc("score"), F.asc("strategy")]
    return top(per_family(df.filter("score IS NOT NULL"), [family], order, each), order, k)


def behaviour_cell() -> list[Column]:
    """Trade-count, win-rate and expectancy bins."""
    def bins(col: str, cuts: list[float]) -> Column:
        out = F.lit(len(cuts))
        for i in range(len(cuts) - 1, -1, -1):
            out = F.when(F.col(col) < cuts[i], i).otherwise(out)
        return out
    return [
        bins("trades", [50, 150, 300, 600, 1200]).alias("freq_bin"),
        bins("win_rate", [0.35, 0.45, 0.52, 0.58, 0.65]).alias("wr_bin"),
        bins("expectancy", [-0.002, -0.001, 0.0, 0.001, 0.002]).alias("skew_bin"),
    ]


def archive(df: DataFrame) -> DataFrame:
    """Best row per behaviour cell."""
    cells = df.filter("score IS NOT NULL").select("*", *behaviour_cell())
    return per_family(cells, ["freq_bin", "wr_bin", "skew_bin"], [F.desc("score"), F.asc("strategy")], 1)


def diverse(df: DataFrame, family: str, n: int = 20) -> DataFrame:
    """Best of each distinct family, the n best of those."""
    order = [F.desc("score"), F.asc("strategy")]
    return top(per_family(df.filter("score IS NOT NULL"), [family], order, 1), order, n)


def block_rank(df: DataFrame, n: int = 50) -> DataFrame:
    return top(df.withColumn("rank_score", F.expr("mean_score - 2 * (1 - stability)")), [F.desc("rank_score"), F.asc("strategy")], n)


def accept_threshold(scores: DataFrame, order: list[Column], window: int = 500, percentile: float = 0.70) -> DataFrame:
    """Score at the accept percentile of the last ``window`` scores; -1 below ten of them.

    The window length is part of the measure and bounds what is collected.
    """
    last = scores.orderBy(*order).limit(window)
    ranked = last.agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    at = f"least(int(size(s) * (1 - {percentile}D)), size(s) - 1)"
    return ranked.selectExpr(f"CASE WHEN size(s) < 10 THEN -1D ELSE s[greatest({at}, 0)] END AS threshold")


# --- families ----------------------------------------------------------------

def bucket(x: str) -> str:
    """Coarse threshold: tenths below 10, steps of five above; the sign is dropped."""
    return f"CASE WHEN abs({x}) < 10 THEN floor(abs({x}) * 10) / 10 ELSE floor(abs({x}) / 5) * 5 END"


LEAF_EXACT = "concat_ws(' ', kind, a, b, CAST(round(x, 6) AS STRING), CAST(round(y, 6) AS STRING), CAST(lb AS STRING))"
LEAF_SKELETON = "concat_ws(' ', kind, a, b)"
LEAF_COARSE = (
    f"concat_ws(' ', kind, a, b, CASE WHEN kind IN ('SlopeGT', 'SlopeLT') THEN CAST(bigint(x / 0.01D) AS STRING) "
    f"WHEN x IS NOT NULL THEN CAST({bucket('x')} AS STRING) END, CASE WHEN y IS NOT NULL THEN CAST({bucket('y')} AS STRING) END, "
    f"CAST(lb div 5 * 5 AS STRING))"
)


def rule_texts(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, exact, skeleton, coarse): a rule's tree as nested text, from its rows (pos, depth, kind, a, b, x, y, lb) in prefix order.

    A row opens its bracket; the last row of a subtree closes all that end with it, which its depth and the next row's tell.
    """
    op = F.col("kind").isin("AND", "OR", "NOT")
    said = {"exact": LEAF_EXACT, "skeleton": LEAF_SKELETON, "coarse": LEAF_COARSE}
    row = F.struct("pos", "depth", op.alias("op"), *[F.when(op, F.col("kind")).otherwise(F.expr(text)).alias(name) for name, text in said.items()])
    packed = leaves.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("rows"))  # no more rows than a rule has nodes

    def text(name):
        def one(r, i):
            after = F.coalesce(F.get("rows", i + 1)["depth"], F.lit(0))
            end = F.concat(F.lit(")"), F.repeat(F.lit(")"), r["depth"] - after), F.when(i + 1 < F.size("rows"), F.lit(" ")).otherwise(""))
            return F.concat(F.lit("("), r[name], F.when(r["op"], F.lit(" ")).otherwise(end))
        return F.array_join(F.transform("rows", one), "").alias(name)

    return packed.select(*keys, *[text(name) for name in said])


def fingerprints(leaves: DataFrame, params: DataFrame) -> DataFrame:
    """(strategy, exact, skeleton, coarse) of whole strategies: rules by side, exits, limits, costs and the features they were made for.

    ``leaves``: (strategy, side, pos, depth, kind, a, b, x, y, lb); ``params``: a row per strategy with stop, target and trail (kind and number),
    max_hold, max_losses, cooldown, direction, fee, slip, vol_threshold and feature_hash.
    """
    forms = ["exact", "skeleton", "coarse"]
    texts = rule_texts(leaves, ["strategy", "side"]).groupBy("strategy").agg(
        *[F.max(F.when(F.col("side") == side, F.col(f))).alias(f"{side}_{f}") for side in ("entry", "exit", "regime") for f in forms])
    both = params.join(texts, "strategy", "left")
    part = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    model = {
        "exact": lambda m: F.concat_ws("_", f"{m}_kind", F.round(f"{m}_x", 6).cast("string")),
        "skeleton": lambda m: F.col(f"{m}_kind"),
        "coarse": lambda m: F.concat_ws("_", f"{m}_kind", F.expr(f"CASE {m}_kind WHEN 'fixed' THEN bigint({m}_x / 0.01D) WHEN 'atr' THEN bigint({m}_x / 0.5D) END").cast("string"))}
    limits = {"exact": ["max_hold", "max_losses", "cooldown", "direction", "fee", "slip", "vol_threshold", "feature_hash"], "skeleton": ["direction"],
              "coarse": [F.expr("max_hold div 50 * 50"), F.expr("max_losses div 2 * 2"), F.expr("cooldown div 10 * 10"), "direction", F.floor("fee"), F.floor("slip"), "feature_hash"]}
    column = lambda c: F.col(c) if isinstance(c, str) else c
    whole = lambda f: F.concat_ws("|", *[part(F.col(f"{side}_{f}")) for side in ("entry", "exit", "regime")], *[part(model[f](m)) for m in ("stop", "target", "trail")],
                                  *[part(column(c)) for c in limits[f]])
    return both.select("strategy", *[whole(f).alias(f) for f in forms])


def coarse_params() -> list[Column]:
    """Bucketed holding, loss and cooldown limits."""
    return [F.expr("max_hold div 50 * 50 AS hold_bucket"), F.expr("max_losses div 2 * 2 AS loss_bucket"),
            F.expr("cooldown div 10 * 10 AS cool_bucket")]


def family_report(df: DataFrame, family: str, n: int = 10) -> DataFrame:
    return df.groupBy(family).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(family)).limit(n)
