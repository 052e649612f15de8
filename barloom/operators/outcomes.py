"""From signals to labelled outcomes.

A signal at bar t enters at the open of t+1.  Its outcome depends only on the
bars that follow, never on other trades, so all signals are labelled
independently: each event is range-joined with its next bars on
``(symbol, entry_idx div width)`` and the first bar that triggers an exit
wins.  Bars near a bucket's start are copied to the bucket before, events lie in one, so every row of
an event meets in one partition and the aggregate needs no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import PART, _apply, lag, tiled_features
from ..functions.rules import apply_rules, volatility_ok
from ..plans.strategy import Strategy
from ..session import materialize
from .tiling import Tiles, drop_halo

# Exit reasons by code, in the order a bar checks them.
REASONS = {
    1: "tp_gap_open", 2: "sl_gap_open", 3: "sl_hit", 4: "trail_hit", 5: "tp_hit",
    6: "exit_rule", 7: "max_hold", 8: "end_of_data",
}
NEEDED = ["ATR14", "ATR14_SMA50", "VolZ20", "Active"]
# By how much thin volume on the bar before multiplies slippage. The bounds leave room for rounding: counts give scores of exactly -1 and -2.
THIN = f"CASE WHEN {lag('VolZ20')} < -2.000000001D THEN 4 WHEN {lag('VolZ20')} < -1.000000001D THEN 2 ELSE 1 END"


def prepared(bars: DataFrame, strategies: list[Strategy], tiles: Tiles = Tiles()) -> DataFrame:
    """Tiled bars with features, one ``sig_i`` and one ``out_i`` column per strategy."""
    names = list(dict.fromkeys([*NEEDED, *[f for s in strategies for f in s.features()]]))
    t = tiled_features(bars, names, tiles)
    rules, extra = {}, {}
    for i, s in enumerate(strategies):
        rules |= {f"ent_{i}": s.entry, f"reg_{i}": s.regime}
        rules |= {f"out_{i}": s.exit} if s.exit is not None else {}
        extra[f"vol_{i}"] = volatility_ok(s.vol_threshold)
    t = apply_rules(t, rules, extra)
    sig = [F.expr(f"(Active > 0 AND ent_{i} AND reg_{i} AND vol_{i}) AS sig_{i}") for i in range(len(strategies))]
    out = [F.expr("false").alias(f"out_{i}") for i, s in enumerate(strategies) if s.exit is None]
    return t.select("*", *sig, *out)


def entry_calls(strategies: list[Strategy]) -> dict[str, str]:
    """What an entry reads of the bars before it."""
    calls = {"thin": THIN} | {f"was_{i}": f"coalesce({lag(f'sig_{i}')}, false)" for i in range(len(strategies))}
    if any(x and x[0] == "atr" for s in strategies for x in (s.stop, s.target)):
        calls["r_atr"] = lag("ATR14")
    for i, s in enumerate(strategies):
        if s.stop and s.stop[0] == "swing":
            n = int(s.stop[1])
            over = f"OVER ({PART} ROWS BETWEEN {n + 1} PRECEDING AND 2 PRECEDING)"
            calls[f"sw_{i}"] = f"least({lag('close')}, min(low) {over})" if s.direction == 1 else f"greatest({lag('close')}, max(high) {over})"
    return calls


def path_calls(strategies: list[Strategy]) -> dict[str, str]:
    """What a bar of a path reads of the bars before it."""
    calls = {"thin": THIN}
    if any(s.trail and s.trail[0] == "swing" for s in strategies):
        calls["low51"] = f"max(low) OVER ({PART} ROWS BETWEEN 50 PRECEDING AND CURRENT ROW)"
        calls["high51"] = f"min(high) OVER ({PART} ROWS BETWEEN 50 PRECEDING AND CURRENT ROW)"
    if any(s.exit is not None for s in strategies):
        calls |= {f"left_{i}": f"coalesce({lag(f'out_{i}')}, false)" for i in range(len(strategies))}
    return calls


def looked_back(prep: DataFrame, strategies: list[Strategy], tiles: Tiles = Tiles()) -> DataFrame:
    """One row per bar, with nothing but what ``entries`` and ``path_bars`` read: once written, neither shuffles bars by tile again."""
    calls = entry_calls(strategies) | path_calls(strategies)
    atr = ["ATR14"] if any(s.trail for s in strategies) else []
    return _read_back(prep, calls, tiles).select("symbol", "bar_idx", "open_ms", "open", "high", "low", "close", *atr, *calls)


def _read_back(prep: DataFrame, calls: dict[str, str], tiles: Tiles) -> DataFrame:
    return prep if set(calls) <= set(prep.columns) else drop_halo(_apply(prep, calls, set(calls)), tiles.size)


def _sql(value) -> str:
    return "CAST(NULL AS DOUBLE)" if value is None else f"{float(value)!r}D"


def entries(prep: DataFrame, strategies: list[Strategy], ends: DataFrame | None = None, tiles: Tiles = Tiles()) -> DataFrame:
    """One row per (strategy, signal): entry price, initial stop and target.

    ``ends`` (symbol, grp, lo_idx, end_idx) gives the windows signals may lie in,
    one group of events per window; by default the whole series is group 0.
    """
    at_entry = _read_back(prep, entry_calls(strategies), tiles)
    r_atr = "r_atr" if "r_atr" in at_entry.columns else "CAST(NULL AS DOUBLE) AS r_atr"
    rows = []
    for i, s in enumerate(strategies):
        swing = f"sw_{i}" if s.stop and s.stop[0] == "swing" else "CAST(NULL AS DOUBLE)"
        trail_kind = {None: 0, "atr": 1, "swing": 2}[s.trail[0] if s.trail else None]
        trail_k = s.trail[1] if s.trail and s.trail[0] == "atr" else 0.0
        stop, target = s.stop or (None, None), s.target or (None, None)
        rows.append(
            f"CASE WHEN was_{i} AND bar_idx - 1 >= {s.warmup} THEN struct('{s.name}' AS strategy, {i} AS sid, {s.direction} AS dir, "
            f"'{stop[0]}' AS stop_kind, {_sql(stop[1])} AS stop_x, '{target[0]}' AS target_kind, {_sql(target[1])} AS target_x, "
            f"{swing} AS swing, {trail_kind} AS trail_kind, {_sql(trail_k)} AS trail_k, {_sql(s.fee_bps)} AS fee, "
            f"{_sql(s.slip_bps)} AS slip, {s.max_hold} AS max_hold) END"
        )
    ev = at_entry.selectExpr(
        "symbol", "bar_idx AS entry_idx", "open_ms AS entry_ms", "open", r_atr, "thin",
        f"explode(filter(array({', '.join(rows)}), x -> x IS NOT NULL)) AS s",
    ).select("symbol", "entry_idx", "entry_ms", "open", "r_atr", "thin", "s.*")
    ev = ev.selectExpr("*", f"open * (1 + dir * {slip_sql()}) AS entry_price")
    side = lambda kind, x, sign, fallback: (
        f"CASE {kind} WHEN 'fixed' THEN entry_price * (1 {sign} dir * {x} / 100) "
        f"WHEN 'atr' THEN CASE WHEN r_atr > 0 THEN entry_price {sign} dir * {x} * r_atr "
        f"ELSE entry_price * (1 {sign} dir * {fallback}D) END ELSE swing END"
    )
    ev = ev.selectExpr(
        "*", f"{side('stop_kind', 'stop_x', '-', 0.02)} AS stop",
        f"{side('target_kind', 'target_x', '+', 0.04).replace('ELSE swing END', 'END')} AS target",
    )
    if ends is None:
        ends = prep.groupBy("symbol").agg((F.max("bar_idx") + 1).alias("end_idx"))
        ends = ends.selectExpr("symbol", "0L AS grp", "0L AS lo_idx", "end_idx")
    keep = ["symbol", "strategy", "sid", "entry_idx", "entry_ms", "dir", "entry_price", "stop", "target",
            "trail_kind", "trail_k", "fee", "slip", "max_hold"]
    return windowed(ev.select(*keep), ends, "entry_idx").filter("entry_idx - 1 >= lo_idx").drop("lo_idx")


def windowed(rows: DataFrame, windows: DataFrame, idx: str, tile: int = 8192) -> DataFrame:
    """Rows joined with the windows ``[lo_idx, end_idx)`` of their symbol that hold them.

    Windows are spread over the tiles they touch, so the join has an equality
    key even for a symbol with very many rows and windows.
    """
    spread = windows.withColumn("_t", F.explode(F.expr(f"sequence(lo_idx div {tile}, (end_idx - 1) div {tile})")))
    joined = rows.withColumn("_t", F.expr(f"{idx} div {tile}")).join(spread, ["symbol", "_t"])
    return joined.filter(F.expr(f"{idx} >= lo_idx AND {idx} < end_idx")).drop("_t")


def slip_sql(thin: str = "thin") -> str:
    """Slippage as a fraction; thin volume on the reference bar multiplies it."""
    return f"(slip / 1e4D * {thin})"


def path_bars(prep: DataFrame, strategies: list[Strategy], tiles: Tiles = Tiles()) -> DataFrame:
    """Bars as the outcome join needs them; ``outs`` holds last bar's exit rules by strategy, if there are any."""
    t = _read_back(prep, path_calls(strategies), tiles)
    cols = ["symbol", "bar_idx", "open_ms", "open", "high", "low", "close", "thin"]
    if any(s.trail for s in strategies):
        swings = ["low51", "high51"] if "low51" in t.columns else ["CAST(NULL AS DOUBLE) AS low51", "CAST(NULL AS DOUBLE) AS high51"]
        cols += ["ATR14 AS atr", *swings]
    if any(s.exit is not None for s in strategies):
        cols.append(f"array({', '.join(f'left_{i}' for i in range(len(strategies)))}) AS outs")
    return t.selectExpr(*cols)


# Bars of a bucket, where horizons don't ask for more.
WIDEST = 512


def next_bars(events: DataFrame, bars: DataFrame, horizon: int, start: str = "entry_idx") -> DataFrame:
    """Events joined with their next ``horizon`` bars; adds ``pos`` and ``bucket``."""
    # Wide buckets: an event meets more bars that are filtered out, but few bars are shuffled twice.
    width = max(horizon, min(4 * horizon, WIDEST))
    left = events.withColumn("bucket", F.expr(f"({start}) div {width}"))
    own = f"bar_idx div {width}"
    right = bars.withColumn("bucket", F.explode(F.expr(f"CASE WHEN bar_idx % {width} < {horizon} THEN array({own}, {own} - 1) ELSE array({own}) END")))
    near = (F.col("bar_idx") >= F.expr(start)) & (F.col("bar_idx") < F.expr(start) + horizon)
    return left.join(right, ["symbol", "bucket"]).filter(near).withColumn("pos", F.col("bar_idx") - F.col("entry_idx"))


# Bars that the first pass looks ahead, how much further the next one does, and the most of any.
FIRST_SPAN, WIDER, MOST_SPAN = 32, 4, 8192


def label(events: DataFrame, bars: DataFrame, strategies: list[Strategy], horizon: int | None = None) -> DataFrame:
    """First-touch outcome per event.

    Most events end within a few bars, so a first pass looks ``FIRST_SPAN`` bars
    ahead; only those still open go to the next, wider pass, carrying their
    trailed stop. Strategies with a time exit never need more than the longest of
    their holds; those without go on in passes of up to ``MOST_SPAN`` bars. With ``horizon``, bounded
    strategies take one pass of that many bars.
    """
    trailing = any(s.trail for s in strategies)
    events = events.withColumn("seen", F.lit(0).cast("long")).withColumn("live", F.expr("dir * stop"))
    holds = [s.max_hold for s in strategies if s.max_hold > 0]
    done = None
    if holds:
        bounded, most = events.filter("max_hold > 0"), horizon or max(holds) + 1
        one = horizon or most <= 2 * FIRST_SPAN
        done = _close(_pass(bounded, bars, most, trailing)) if one else _passes(bounded, bars, trailing, FIRST_SPAN, most)
    if len(holds) < len(strategies):
        rest = _passes(events.filter("max_hold <= 0"), bars, trailing, horizon or 256, MOST_SPAN)
        done = rest if done is None else done.unionByName(rest)
    return done


def _passes(events: DataFrame, bars: DataFrame, trailing: bool, span: int, most: int) -> DataFrame:
    done, todo = None, events
    while True:
        out = materialize(_pass(todo, bars, span, trailing), "outcomes")
        closed = _close(out.filter("exit_code IS NOT NULL OR last_idx >= end_idx - 1"))
        done = closed if done is None else done.unionByName(closed)
        rest = out.filter("exit_code IS NULL AND last_idx < end_idx - 1")
        if rest.isEmpty():
            return done
        todo = rest.withColumn("seen", F.col("last_idx") + 1 - F.col("entry_idx")).select(*events.columns)
        span = min(WIDER * span, most)


def _pass(events: DataFrame, bars: DataFrame, span: int, trailing: bool) -> DataFrame:
    j = next_bars(events, bars, span, "entry_idx + seen").filter("bar_idx < end_idx AND (max_hold <= 0 OR bar_idx <= entry_idx + max_hold)")
    j = j.withColumn("cut", F.expr("CAST(NULL AS DOUBLE)" if not trailing else
        "CASE trail_kind WHEN 1 THEN CASE WHEN atr > 0 THEN dir * close - trail_k * atr END "
        "WHEN 2 THEN CASE WHEN bar_idx > 50 THEN CASE WHEN dir = 1 THEN low51 ELSE -high51 END END END"))
    if trailing:
        over = ("OVER (PARTITION BY symbol, bucket, sid, grp, entry_idx ORDER BY bar_idx "
                "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
        j = j.withColumn("ss", F.expr(f"greatest(live, max(cut) {over})"))
    else:
        j = j.withColumn("ss", F.col("live"))
    j = j.selectExpr(
        "*", f"{slip_sql()} AS sl",
        f"""CASE WHEN pos > 0 AND dir * open >= dir * target THEN 1
                WHEN pos > 0 AND dir * open <= ss THEN 2
                WHEN CASE WHEN dir = 1 THEN low ELSE -high END <= ss
                  THEN CASE WHEN trail_kind > 0 AND ss >= dir * entry_price THEN 4 ELSE 3 END
                WHEN CASE WHEN dir = 1 THEN high ELSE -low END >= dir * target THEN 5
                WHEN max_hold > 0 AND pos >= max_hold THEN 7
                {"WHEN pos > 0 AND outs[sid] THEN 6" if "outs" in bars.columns else ""} END AS code""",
    ).selectExpr(
        "*",
        """CASE WHEN code IN (3, 4) THEN dir * ss * (1 - dir * 2 * sl) WHEN code = 5 THEN target * (1 - dir * sl)
                WHEN code IS NOT NULL THEN open * (1 - dir * sl) END AS px""",
        "CASE WHEN code IS NOT NULL THEN bar_idx END AS hit",
    )
    keys = ["symbol", "bucket", "sid", "grp", "entry_idx"]
    same = [c for c in events.columns if c not in keys and c not in ("live", "strategy")]
    return j.groupBy(*keys, "strategy").agg(
        *[F.first(c).alias(c) for c in same],
        F.greatest(F.first("live"), F.max("cut")).alias("live"),
        F.min("hit").alias("exit_idx"), F.min_by("code", "hit").alias("exit_code"), F.min_by("px", "hit").alias("exit_price"),
        F.min_by("open_ms", "hit").alias("exit_ms"),
        F.max("bar_idx").alias("last_idx"), F.max_by("close", "bar_idx").alias("last_close"),
        F.max_by("thin", "bar_idx").alias("last_thin"), F.max_by("open_ms", "bar_idx").alias("last_ms"),
    )


def _close(out: DataFrame) -> DataFrame:
    """Fill in end-of-data exits; compute pnl and hold."""
    names = "map(" + ", ".join(f"{k}, '{v}'" for k, v in REASONS.items()) + ")"
    out = out.selectExpr(
        "strategy", "sid", "grp", "symbol", "dir", "entry_idx - 1 AS signal_idx", "entry_idx", "entry_ms", "entry_price", "stop", "target",
        "fee", "slip", "trail_kind > 0 AS trails", "end_idx", "coalesce(exit_idx, last_idx) AS exit_idx", "coalesce(exit_ms, last_ms) AS exit_ms",
        f"coalesce(exit_price, last_close * (1 - dir * {slip_sql('last_thin')})) AS exit_price",
        f"element_at({names}, coalesce(exit_code, 8)) AS reason", "last_close",
    )
    return out.selectExpr(
        "*", "dir * (exit_price / entry_price - 1) - 2 * fee / 1e4D AS pnl", "exit_idx - entry_idx + 1 AS hold"
    )


def outcomes(bars: DataFrame, strategies: list[Strategy], ends: DataFrame | None = None, tiles: Tiles = Tiles()) -> DataFrame:
    """All labelled signals of the strategies, overlapping ones included."""
    prep = materialize(looked_back(prepared(bars, strategies, tiles), strategies, tiles), "prepared")
    return label(entries(prep, strategies, ends, tiles), path_bars(prep, strategies, tiles), strategies)


def excursions(trades: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Best and worst move inside each trade, as fractions of the entry price.

    ``horizon`` must be at least the longest hold.
    """
    j = next_bars(trades.select("symbol", "sid", "grp", "strategy", "dir", "entry_idx", "exit_idx", "entry_price"), bars, horizon)
    j = j.filter("bar_idx <= exit_idx")
    return j.groupBy("symbol", "bucket", "sid", "grp", "strategy", "entry_idx").agg(
        (F.max(F.expr("CASE WHEN dir = 1 THEN high / entry_price - 1 ELSE 1 - low / entry_price END"))).alias("mfe"),
        (F.min(F.expr("CASE WHEN dir = 1 THEN low / entry_price - 1 ELSE 1 - high / entry_price END"))).alias("mae"),
    ).drop("bucket", "sid", "grp")


def violations(trades: DataFrame) -> DataFrame:
    """Counts of broken trade invariants."""
    n = lambda cond: F.count_if(F.expr(f"coalesce({cond}, false)"))
    return trades.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("trades"),
        n("entry_idx != signal_idx + 1").alias("late_entry"), n("exit_idx < entry_idx").alias("early_exit"),
        n("NOT (entry_price > 0 AND exit_price > 0)").alias("bad_price"), n("reason = ''").alias("no_reason"),
        n("dir * (entry_price - stop) <= 0").alias("stop_side"), n("dir * (target - entry_price) <= 0").alias("target_side"),
        n("pnl <= -100 OR pnl >= 1000").alias("pnl_bounds"), n("hold <= 0").alias("bad_hold"),
        n("end_idx <= exit_idx").alias("past_end"),
    )


def context(trades: DataFrame, bars: DataFrame, cols: list[str], horizon: int) -> DataFrame:
    """Bars from just before entry to just after exit, with features."""
    t = trades.select("symbol", "strategy", "entry_idx", "exit_idx").withColumn("from_idx", F.col("entry_idx") - 1)
    j = next_bars(t, bars.select("symbol", "bar_idx", *cols), horizon + 2, "from_idx")
    return j.filter("bar_idx <= exit_idx + 1").select("symbol", "strategy", "entry_idx", "bar_idx", "pos", *cols)
