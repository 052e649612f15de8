"""What a strategy is doing on every bar, as runs of bars.

A series' history is a few kinds of intervals: trades (signal, entry, holding, exit), the cooldown after each, stretches on which the
filters let signals through, and single bars on which a signal was refused. Each contributes only its edges. A segmented carry over the
edges gives the state from each to the next; states are expanded to bars only where a file needs a row per bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import _apply, lag
from ..plans.strategy import Strategy
from ..session import materialize
from .tiling import Tiles, drop_halo

PAIR = ["strategy", "symbol"]


def carried(rows: DataFrame, keys: list[str], part: str, order: str, cols: list[str]) -> DataFrame:
    """Each column's last value that isn't null, at or before the row; no window holds more than one part, or one row a part."""
    last = rows.groupBy(*keys, part).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    came = last.select(*keys, part, *[F.last(c, ignorenulls=True).over(earlier).alias(f"_{c}") for c in cols])
    upto = Window.partitionBy(*keys, part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.join(came, [*keys, part], "left")
    return own.select(*[F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"_{c}")).alias(c) if c in cols else F.col(c) for c in rows.columns])


def _by_sid(values: list, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("sid") + 1)


def _gate_edges(prep: DataFrame, strategies: list[Strategy], tiles: Tiles) -> DataFrame:
    """(sid, symbol, idx, gate): bars from which the filters of a strategy pass, or don't."""
    gates = {f"gate_{i}": f"coalesce(Active > 0 AND reg_{i} AND vol_{i}, false)" for i in range(len(strategies))}
    t = prep.select("symbol", "tile", "bar_idx", *[F.expr(text).alias(g) for g, text in gates.items()])
    t = drop_halo(_apply(t, {f"was_{g}": lag(g) for g in gates}, {f"was_{g}" for g in gates}), tiles.size)
    changed = [F.when((F.col("bar_idx") == 0) | (F.col(g) != F.col(f"was_{g}")), F.struct(F.lit(i).alias("sid"), F.col(g).alias("gate"))) for i, g in enumerate(gates)]
    return t.select("symbol", F.col("bar_idx").alias("idx"), F.inline(F.filter(F.array(*changed), lambda x: x.isNotNull())))


def _refusals(prep: DataFrame, trades: DataFrame, series: DataFrame, strategies: list[Strategy], tiles: Tiles) -> DataFrame:
    """(sid, symbol, idx, refusal): signals before enough history, on the last bar, or after the stop for losses."""
    losses = [(i, s.max_losses) for i, s in enumerate(strategies) if s.max_losses > 0]
    last_win = trades.groupBy("sid", "symbol").agg(F.max(F.when(F.col("pnl") >= 0, F.col("signal_idx"))).alias("_win"), F.max("exit_idx").alias("_exit"))
    after = trades.join(last_win, ["sid", "symbol"]).groupBy("sid", "symbol").agg(
        F.count_if(F.col("signal_idx") > F.coalesce("_win", F.lit(-1))).alias("_lost"), F.max("_exit").alias("bust_idx"))
    cap = _by_sid([s.max_losses for s in strategies], "bigint")
    bust = after.filter((cap > 0) & (F.col("_lost") >= cap)).select("sid", "symbol", "bust_idx") if losses else None
    fired = [F.when(F.col(f"sig_{i}"), F.lit(i)) for i in range(len(strategies))]
    own = drop_halo(prep.select("symbol", "tile", "bar_idx", *[f"sig_{i}" for i in range(len(strategies))]), tiles.size)
    sig = own.select("symbol", F.col("bar_idx").alias("idx"), F.explode(F.filter(F.array(*fired), lambda x: x.isNotNull())).alias("sid")).join(F.broadcast(series), "symbol")
    sig = sig.join(bust, ["sid", "symbol"], "left") if losses else sig.withColumn("bust_idx", F.lit(None).cast("bigint"))
    why = F.when(F.col("idx") > F.col("bust_idx"), "busted").when(F.col("idx") < _by_sid([s.warmup for s in strategies], "bigint"), "signal_warmup").when(
        F.col("idx") + 1 >= F.col("n"), "signal_skipped_end_of_data")
    return sig.select("sid", "symbol", "idx", why.alias("refusal")).filter("refusal IS NOT NULL")


def _phase_edges(trades: DataFrame, series: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """(sid, symbol, idx, phase): bars from which a trade, or what follows it, is in another phase; an empty phase is none."""
    edge = lambda idx, phase: F.struct(idx.alias("idx"), phase.alias("phase"))
    entry, leave, cool = F.col("entry_idx"), F.col("exit_idx"), _by_sid([s.cooldown for s in strategies], "bigint")
    out = F.concat(F.lit("exit_"), "reason")
    edges = F.array(
        edge(F.col("signal_idx"), F.lit("signal,pending,flat")),
        edge(entry, F.when(leave == entry, F.concat(F.lit("enter,"), out)).otherwise(F.lit("enter"))),
        F.when(leave > entry + 1, edge(entry + 1, F.lit("holding"))), F.when(leave > entry, edge(leave, out)),
        F.when(cool > 0, edge(leave + 1, F.lit("cooldown"))), edge(leave + 1 + cool, F.lit("")))
    long = trades.select("sid", "symbol", F.inline(F.filter(edges, lambda x: x.isNotNull()))).join(F.broadcast(series), "symbol")
    return long.filter("idx < n").select("sid", "symbol", "idx", "phase")


def timeline(prep: DataFrame, trades: DataFrame, strategies: list[Strategy], tiles: Tiles = Tiles()) -> DataFrame:
    """(strategy, symbol, lo_idx, hi_idx, states): every bar of every series lies in one run.

    ``prep`` is ``outcomes.prepared`` and ``trades`` what was selected from its signals over whole series. States: signal,pending,flat; enter; holding; exit_<reason>;
    cooldown; flat, after the reason where a signal was refused (busted, signal_warmup, signal_skipped_end_of_data); filtered, where no signal
    could pass. Runs end at the borders of tiles.
    """
    # One row per symbol.
    series = materialize(prep.groupBy("symbol").agg((F.max("bar_idx") + 1).alias("n")), "series")
    ids = F.explode(F.array(*[F.lit(i) for i in range(len(strategies))])).alias("sid")
    starts = series.select(ids, "symbol", "n").select("sid", "symbol", F.explode(F.expr(f"sequence(0L, n - 1, {tiles.size}L)")).alias("idx"))
    none = lambda **kinds: [F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    phases = _phase_edges(trades, series, strategies).select("sid", "symbol", "idx", "phase", *none(gate="boolean", refusal="string"))
    gates = _gate_edges(prep, strategies, tiles).select("sid", "symbol", "idx", *none(phase="string"), "gate", *none(refusal="string"))
    refused = _refusals(prep, trades, series, strategies, tiles)
    points = refused.select("sid", "symbol", "idx", *none(phase="string", gate="boolean"), "refusal")
    nothing = none(phase="string", gate="boolean", refusal="string")
    breaks = refused.withColumn("idx", F.col("idx") + 1).join(F.broadcast(series), "symbol").filter("idx < n").select("sid", "symbol", "idx", *nothing)
    rows = phases.unionByName(gates).unionByName(points).unionByName(breaks).unionByName(starts.select("*", *nothing))
    # A signal may stand where a cooldown ends: the phase that is one wins over the empty one.
    rows = rows.groupBy("sid", "symbol", "idx").agg(F.max("phase").alias("phase"), F.max("gate").alias("gate"), F.max("refusal").alias("refusal"))
    rows = materialize(rows.withColumn("tile", F.expr(f"idx div {tiles.size}")), "edges")
    runs = carried(rows, ["sid", "symbol"], "tile", "idx", ["phase", "gate"]).join(F.broadcast(series), "symbol")
    until = F.coalesce(F.lead("idx").over(Window.partitionBy("sid", "symbol", "tile").orderBy("idx")), F.least((F.col("tile") + 1) * tiles.size, F.col("n"))) - 1
    busy = F.coalesce("phase", F.lit("")) != ""
    said = F.when(busy, F.col("phase")).when(F.col("gate"), F.concat_ws(",", "refusal", F.lit("flat"))).otherwise("filtered")
    name = _by_sid([s.name for s in strategies], "string")
    return runs.select(name.alias("strategy"), "symbol", F.col("idx").alias("lo_idx"), until.alias("hi_idx"), F.split(said, ",").alias("states"))


def bar_states(runs: DataFrame) -> DataFrame:
    """One row per bar of the runs."""
    return runs.select(*PAIR, F.explode(F.sequence("lo_idx", "hi_idx")).alias("bar_idx"), "states")
