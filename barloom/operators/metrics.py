"""Trade and equity metrics.

Everything that depends on order is computed in two levels, inside bounded
parts of a series and then over the part table, so no key is ever sorted in
one task as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .outcomes import next_bars, windowed
from .recurrence import Rec, scan
from .tiling import Tiles, drop_halo, running_offset, with_halo

INFINITE_PF = 999.0


def trade_metrics(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, rates, expectancy, profit factors, holds in one aggregate."""
    pnl = F.col("pnl")
    win, loss = pnl > 0, pnl <= 0
    t = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(win).alias("wins"), F.count_if(loss).alias("losses"),
        F.sum("hold").alias("hold_bars"), F.max("hold").alias("max_hold"), F.avg("hold").alias("avg_hold"),
        F.coalesce(F.sum(F.when(win, pnl)), F.lit(0.0)).alias("won"),
        F.coalesce(F.sum(F.when(loss, -pnl)), F.lit(0.0)).alias("lost"),
        F.avg(pnl).alias("mean_pnl"),
    )
    rate = F.col("wins") / F.col("trades")
    avg_win = F.when(F.col("wins") > 0, F.col("won") / F.col("wins")).otherwise(0.0)
    avg_loss = F.when(F.col("losses") > 0, F.col("lost") / F.col("losses")).otherwise(0.0)
    return t.select(
        "*", rate.alias("win_rate"), avg_win.alias("avg_win"), avg_loss.alias("avg_loss"),
        F.when(F.col("losses") == 0, avg_win).when(F.col("wins") == 0, -avg_loss)
        .otherwise(avg_win * rate - avg_loss * (1 - rate)).alias("expectancy"),
        profit_factor(F.col("won"), F.col("lost"), 1.0).alias("profit_factor"),
        profit_factor(F.col("won"), F.col("lost"), 0.0).alias("oos_profit_factor"),
    )


def profit_factor(won: Column, lost: Column, empty: float) -> Column:
    return F.when(lost > 0, won / lost).when(won > 0, F.lit(INFINITE_PF)).otherwise(F.lit(empty))


def reason_histogram(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Exit reasons with counts, shares and a map per key."""
    counts = trades.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    return counts.join(total, keys).withColumn("pct", 100.0 * F.col("n") / F.col("total"))


def growth(x: Column) -> Column:
    """Product of ``1 + x`` as an aggregate; zero and negative factors included."""
    factor = 1 + x
    size = F.exp(F.sum(F.when(factor != 0, F.log(F.abs(factor)))))
    sign = F.when(F.count_if(factor < 0) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(F.count_if(factor == 0) > 0, 0.0).otherwise(sign * F.coalesce(size, F.lit(1.0)))


def compound(trades: DataFrame, keys: list[str], risk: float = 1.0) -> DataFrame:
    return trades.groupBy(*keys).agg(
        (growth(F.col("pnl")) - 1).alias("raw_return"), (growth(F.col("pnl") * risk) - 1).alias("risk_return"))


def cumulative(df: DataFrame, keys: list[str], order: str, part: str, pnl: str, out: str, written: bool = False) -> DataFrame:
    """Running product of ``1 + pnl``, exact through zero and negative factors.

    ``part`` is an integer column that never decreases along ``order``.  The
    product is kept as a log sum, a count of negative and a count of zero
    factors, all of which add up across parts.
    """
    f = f"(1 + coalesce({pnl}, 0D))"
    bits = {"_ln": f"coalesce(ln(abs(nullif({f}, 0D))), 0D)", "_neg": f"bigint({f} < 0)", "_zero": f"bigint({f} = 0)"}
    df = df.select("*", *[F.expr(sql).alias(name) for name, sql in bits.items()])
    totals = df.groupBy(*keys, part).agg(*[F.sum(b).alias(b) for b in bits])
    base = running_offset(totals, keys, part, list(bits), [f"{b}0" for b in bits]).drop(*bits)
    if written:
        base = materialize(base, "part-starts")
    over = f"OVER (PARTITION BY {', '.join(keys)}, {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    run = df.select("*", *[F.expr(f"sum({b}) {over} AS {b}1") for b in bits]).join(base, [*keys, part])
    value = ("CASE WHEN _zero0 + _zero1 > 0 THEN 0D ELSE "
             "(CASE WHEN (_neg0 + _neg1) % 2 = 1 THEN -1 ELSE 1 END) * exp(_ln0 + _ln1) END")
    return run.select("*", F.expr(value).alias(out)).drop(*bits, *[f"{b}{i}" for b in bits for i in (0, 1)])


def drawdown(df: DataFrame, keys: list[str], order: str, part: str, value: str, start: float | None = None) -> DataFrame:
    """Deepest fall of ``value`` from its running peak; ``start`` counts as a first peak."""
    highs = df.groupBy(*keys, part).agg(F.max(value).alias("_hi"))
    ks = ", ".join(keys)
    before = f"OVER (PARTITION BY {ks} ORDER BY {part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    peaks = highs.selectExpr(*keys, part, f"max(_hi) {before} AS _peak")
    over = f"OVER (PARTITION BY {ks}, {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    first = "CAST(NULL AS DOUBLE)" if start is None else f"{start}D"
    rows = df.selectExpr("*", f"max({value}) {over} AS _run").join(peaks, [*keys, part])
    rows = rows.selectExpr(*keys, value, f"greatest({first}, _peak, _run) AS _top")
    return rows.groupBy(*keys).agg(
        F.max(F.expr(f"CASE WHEN _top > 1e-9D THEN (_top - {value}) / _top ELSE 0D END")).alias("max_dd"))


def trade_drawdown(trades: DataFrame, keys: list[str], order: str, part: str) -> DataFrame:
    """Drawdown of compounded trade results; ``part`` is a SQL integer expression.

    The results so far are written, and so are the parts' starts: in one stage, all these sorts and hash tables would hold memory at once.
    """
    t = trades.selectExpr(*keys, *order.split(", "), "pnl", f"{part} AS _part")
    grown = cumulative(t, keys, order, "_part", "pnl", "_eq", written=True)
    return drawdown(materialize(grown.select(*t.columns, "_eq"), "grown"), keys, order, "_part", "_eq", 1.0)


# --- equity per bar ---------------------------------------------------------

SERIES = ["strategy", "grp", "symbol"]


def equity(trades: DataFrame, spans: DataFrame, bars: DataFrame, horizon: int, tiles: Tiles = Tiles()) -> DataFrame:
    """Marked equity per (strategy, grp, symbol, bar) over ``spans`` [lo_idx, end_idx).

    Closed trades count from the bar after their exit; an open trade marks the
    bars after its entry up to and including its exit bar at their close.
    """
    size = tiles.size
    slim = bars.select("symbol", "bar_idx", "close_ms", "close")
    grid = windowed(slim, spans, "bar_idx").withColumn("tile", F.expr(f"bar_idx div {size}"))
    t = trades.select(*SERIES, "dir", "entry_idx", "exit_idx", "entry_price", "pnl")
    marks = next_bars(t, slim.select("symbol", "bar_idx", "close"), horizon).filter("pos > 0 AND bar_idx <= exit_idx")
    marks = marks.selectExpr(*SERIES, f"bar_idx div {size} AS tile", "bar_idx", "1 + dir * (close / entry_price - 1) AS mark")
    steps = t.selectExpr(*SERIES, f"(exit_idx + 1) div {size} AS tile", "exit_idx + 1 AS bar_idx", "pnl")
    keys = [*SERIES, "tile", "bar_idx"]
    g = grid.join(marks, keys, "left").join(steps, keys, "left")
    g = cumulative(g, SERIES, "bar_idx", "tile", "pnl", "_closed")
    return g.selectExpr(*SERIES, "bar_idx", "close_ms", "lo_idx", "end_idx", "_closed * coalesce(mark, 1D) AS equity")


def equity_drawdown(eq: DataFrame, keys: list[str], tile: int = 8192) -> DataFrame:
    """Deepest fall of an equity curve from its running peak, every bar included."""
    return drawdown(eq.selectExpr("*", f"bar_idx div {tile} AS _part"), keys, "bar_idx", "_part", "equity")


def closed_equity(trades: DataFrame, spans: DataFrame, bars: DataFrame, tiles: Tiles = Tiles()) -> DataFrame:
    """Equity from closed trades only: a step at each exit bar."""
    grid = windowed(bars.select("symbol", "bar_idx"), spans, "bar_idx").withColumn("tile", F.expr(f"bar_idx div {tiles.size}"))
    steps = trades.selectExpr(*SERIES, f"exit_idx div {tiles.size} AS tile", "exit_idx AS bar_idx", "pnl")
    g = grid.join(steps, [*SERIES, "tile", "bar_idx"], "left")
    return cumulative(g, SERIES, "bar_idx", "tile", "pnl", "equity").select(*SERIES, "bar_idx", "equity")


def smoothness(eq: DataFrame, keys: list[str], span: int = 50, tiles: Tiles = Tiles()) -> DataFrame:
    """Exponential deviation of bar returns and downside deviation, at the last bar.

    Mean m and variance v follow d = r - m, m += a*d, v += a*(d*d - v): two
    recurrences, the second fed by the first.
    """
    a = 2.0 / (span + 1)
    s = eq.withColumn("_series", F.concat_ws("\u0001", *keys)).select(
        F.col("_series").alias("symbol"), "bar_idx", "equity", F.struct(*keys).alias("_k"))
    first = s.groupBy("symbol").agg(F.min("bar_idx").alias("_lo"))
    s = s.join(first, "symbol").withColumn("bar_idx", F.col("bar_idx") - F.col("_lo")).drop("_lo")
    t = with_halo(s, tiles.size, tiles.halo)
    over = "OVER (PARTITION BY symbol, tile ORDER BY bar_idx)"
    t = t.selectExpr("*", f"coalesce(CASE WHEN lag(equity) {over} > 0 THEN equity / lag(equity) {over} - 1 END, 0D) AS r")
    t = scan(t, [Rec("m", 1 - a, f"{a!r}D * r")], tiles)
    t = t.selectExpr("*", f"r - coalesce(lag(m) {over}, 0D) AS d")
    t = scan(t, [Rec("v", 1 - a, f"CASE WHEN bar_idx > 0 THEN {a!r}D * d * d ELSE 0D END")], tiles)
    out = drop_halo(t, tiles.size).groupBy("symbol").agg(
        F.first("_k").alias("_k"), F.sqrt(F.max_by("v", "bar_idx")).alias("smooth_vol"),
        F.coalesce(F.sqrt(F.avg(F.when(F.col("r") < -1e-12, F.col("r") * F.col("r")))), F.lit(0.0)).alias("downside_vol"))
    return out.select("_k.*", "smooth_vol", "downside_vol")


# --- months -----------------------------------------------------------------

def month_of(ms: str) -> str:
    return f"date_format(timestamp_millis({ms}), 'yyyy-MM')"


def monthly(eq: DataFrame, trades: DataFrame, keys: list[str]) -> DataFrame:
    """Return, drawdown and entries per key and calendar month (UTC)."""
    ks = ", ".join(keys)
    e = eq.selectExpr("*", f"{month_of('close_ms')} AS month")
    over = f"OVER (PARTITION BY {ks}, month ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    e = e.selectExpr("*", f"max(equity) {over} AS _top")
    m = e.groupBy(*keys, "month").agg(
        F.min_by("equity", "bar_idx").alias("start_eq"), F.max_by("equity", "bar_idx").alias("end_eq"),
        F.max(F.expr("CASE WHEN _top > 1e-9D THEN 1 - equity / _top ELSE 0D END")).alias("dd"))
    n = trades.selectExpr(*keys, f"{month_of('entry_ms')} AS month").groupBy(*keys, "month").agg(F.count(F.lit(1)).alias("trades"))
    m = m.join(n, [*keys, "month"], "left").na.fill(0, ["trades"])
    return m.withColumn("ret", F.expr("CASE WHEN start_eq > 1e-9D THEN end_eq / start_eq - 1 ELSE 0D END"))


def geometric_mean(r: Column) -> Column:
    """Mean compounding rate; NaN rows skipped, a total loss gives -1, no rows 0."""
    ok = r.isNotNull() & ~F.isnan(r)
    return F.when(F.max(F.when(ok, r <= -1)), -1.0).otherwise(
        F.coalesce(F.exp(F.avg(F.when(ok & (r > -1), F.log1p(r)))) - 1, F.lit(0.0)))


def month_summary(months: DataFrame, keys: list[str]) -> DataFrame:
    """Across months: means, median, deviation, extremes, active and sparse shares."""
    r, n = F.col("ret"), F.col("trades")
    active = (n > 0) | (F.abs(r) > 0.001)
    ratio = lambda c: F.count_if(c) / F.count(F.lit(1))
    return months.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months"), F.sum(n).alias("month_trades"),
        geometric_mean(r).alias("geo_monthly"), geometric_mean(F.when(active, r)).alias("active_geo_monthly"),
        F.median(r).alias("median_month"), F.coalesce(F.median(F.when(active, r)), F.lit(0.0)).alias("median_active"),
        F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("std_month"), F.avg(r).alias("mean_month"),
        F.min(r).alias("min_month"), F.max(r).alias("max_month"), F.min(n).alias("min_trades_month"),
        ratio(active).alias("active_ratio"), ratio(n == 0).alias("sparse_ratio"))


def months_spanned(rows: DataFrame, keys: list[str], ms: str) -> DataFrame:
    return rows.selectExpr(*keys, f"{month_of(ms)} AS _m").distinct().groupBy(*keys).agg(F.count("_m").alias("months"))


def monthly_from_total(total: Column, months: Column) -> Column:
    return F.when(months <= 0, 0.0).when(total <= -0.999999, -1.0).otherwise(F.pow(1 + total, 1.0 / months) - 1)


def ledger_months(trades: DataFrame, keys: list[str], ms: str = "exit_ms") -> DataFrame:
    """Compounded return and count of a plain trade list per month."""
    t = trades.selectExpr(*keys, "pnl", f"{month_of(ms)} AS month")
    return t.groupBy(*keys, "month").agg((growth(F.col("pnl")) - 1).alias("ret"), F.count(F.lit(1)).alias("trades"))


def state_months(states: DataFrame, keys: list[str], cost: float = 0.003, tile: int = 8192) -> DataFrame:
    """Months of a state series (``in_position`` per bar): trades at state changes, at close prices.

    Entry and exit bars pair up in order; each pair is a trade booked in its exit month.
    """
    ks = ", ".join(keys)
    t = with_halo(states, tile, 256)
    over = f"OVER (PARTITION BY {ks}, tile ORDER BY bar_idx)"
    t = drop_halo(t.selectExpr("*", f"coalesce(lag(in_position) {over}, false) AS was"), tile).filter("in_position != was")
    # turns alternate: number them and pair 2k with 2k+1
    counts = t.withColumn("_part", F.expr(f"bar_idx div {tile}"))
    n = counts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    off = running_offset(n, keys, "_part", "_n", "_off").drop("_n")
    rank = f"row_number() OVER (PARTITION BY {ks}, _part ORDER BY bar_idx) - 1 + _off"
    turns = counts.join(off, [*keys, "_part"]).selectExpr(*keys, "bar_idx", "close", "close_ms", f"({rank}) AS turn")
    trades = turns.groupBy(*keys, F.expr("turn div 2").alias("pair")).agg(
        F.min_by("close", "bar_idx").alias("bought"), F.max_by("close", "bar_idx").alias("sold"),
        F.max("close_ms").alias("exit_ms"), F.count(F.lit(1)).alias("legs")).filter("legs = 2")
    return ledger_months(trades.withColumn("pnl", F.expr(f"sold / bought - 1 - {cost}D")), keys)
