"""One position at a time: which labelled signals become trades.

The next signal must come after the previous exit plus cooldown.  That is
sequential, but only through one number, the first free bar.  Each tile of a
series is first reduced to a step function "free bar in -> free bar out";
folding those small functions gives every tile its incoming free bar, and the
tiles are then walked in parallel.  Work is on events, never on bars.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .tiling import drop_halo, number_rows, with_halo

# Ship this module's functions by value: executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])

TILE_BARS = 65536


KEYS = ["sid", "grp", "symbol"]


def runs(batches, keys: list[str]):
    """Cut key-sorted batches into whole groups; a group may span batches."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), dtype=bool)
        change[0] = True
        for k in keys:
            col = pdf[k].to_numpy()
            change[1:] |= col[1:] != col[:-1]
        starts = np.flatnonzero(change)
        held = pdf.iloc[starts[-1]:].reset_index(drop=True)
        if len(starts) > 1:
            yield pdf.iloc[: starts[-1]], starts
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def steps_of(batches):
    """Reduce each tile to the breakpoints of its free-in to free-out function."""
    for pdf, edges in runs(batches, [*KEYS, "tile"]):
        signal, after = pdf["signal_idx"].to_numpy(), pdf["free"].to_numpy()
        upto, goes = [], []
        for lo, hi in zip(edges[:-1], edges[1:]):
            signals, free = signal[lo:hi], after[lo:hi]
            leap, final = np.searchsorted(signals, free, side="left"), free.copy()
            for i in range(hi - lo - 1, -1, -1):
                if leap[i] < hi - lo:
                    final[i] = final[leap[i]]
            last = np.append(final[1:] != final[:-1], True)  # keep the last signal of each equal run
            upto.append(signals[last])
            goes.append(final[last])
        out = pdf.iloc[edges[:-1]][[*KEYS, "tile"]].reset_index(drop=True)
        out["upto"], out["goes"] = upto, goes
        yield out


def arrivals_of(batches):
    """Pass the free bar through the tiles of each series in order."""
    for pdf, edges in runs(batches, KEYS):
        came, upto, goes = np.empty(len(pdf), dtype=np.int64), pdf["upto"].to_numpy(), pdf["goes"].to_numpy()
        for lo, hi in zip(edges[:-1], edges[1:]):
            free = -1
            for i in range(lo, hi):
                came[i] = free
                at = np.searchsorted(upto[i], free, side="left")
                free = goes[i][at] if at < len(upto[i]) else free
        yield pdf[[*KEYS, "tile"]].assign(free_in=came)


def taken_of(batches):
    """Signals of each tile that are taken, given its incoming free bar."""
    for pdf, edges in runs(batches, [*KEYS, "tile"]):
        signal, after, came = (pdf[c].to_numpy() for c in ("signal_idx", "free", "free_in"))
        taken = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            at = lo + np.searchsorted(signal[lo:hi], came[lo], side="left")
            while at < hi:
                taken.append(at)
                at = lo + np.searchsorted(signal[lo:hi], after[at], side="left")
        yield pdf.iloc[taken][[*KEYS, "signal_idx"]]


def select_trades(labels: DataFrame, cooldown: dict[int, int], max_losses: dict[int, int]) -> DataFrame:
    """Non-overlapping trades per (strategy, window group, symbol)."""
    labels = materialize(labels, "labels")  # read three times below
    cool = F.element_at(F.create_map(*[F.lit(v) for kv in cooldown.items() for v in kv]), F.col("sid"))
    slim = labels.select(
        *KEYS, "signal_idx", (F.col("exit_idx") + cool + 1).cast("long").alias("free"),
        F.expr(f"signal_idx div {TILE_BARS}").alias("tile"),
    )
    head, tiled = "sid int, grp long, symbol string", [*KEYS, "tile"]
    steps = slim.repartition(*tiled).sortWithinPartitions(*tiled, "signal_idx").mapInPandas(
        steps_of, f"{head}, tile long, upto array<long>, goes array<long>")
    arrivals = steps.repartition(*KEYS).sortWithinPartitions(*tiled).mapInPandas(arrivals_of, f"{head}, tile long, free_in long")
    taken = slim.join(arrivals, tiled).repartition(*tiled).sortWithinPartitions(*tiled, "signal_idx").mapInPandas(
        taken_of, f"{head}, signal_idx long")
    trades = labels.join(taken, [*KEYS, "signal_idx"], "left_semi")
    limits = {k: v for k, v in max_losses.items() if v > 0}
    return stop_after_losses(materialize(trades, "trades"), limits) if limits else trades


def stop_after_losses(trades: DataFrame, limits: dict[int, int]) -> DataFrame:
    """Drop everything after the first run of N straight losses of a series."""
    series = KEYS
    numbered = number_rows(trades, series, [F.col("signal_idx")], F.expr(f"signal_idx div {TILE_BARS}"), "trade_no")
    longest = max(limits.values())
    tiled = with_halo(numbered.select(*series, "trade_no", "pnl"), 8192, longest, idx="trade_no", tile="_t")
    runs = []
    for sid, n in limits.items():
        over = (f"OVER (PARTITION BY sid, grp, symbol, _t ORDER BY trade_no ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")
        runs.append(f"WHEN sid = {sid} THEN sum(int(pnl < 0)) {over} = {n}")
    tiled = tiled.withColumn("bust", F.expr(f"CASE {' '.join(runs)} ELSE false END"))
    first = drop_halo(tiled, 8192, idx="trade_no", tile="_t").filter("bust").groupBy(*series).agg(F.min("trade_no").alias("bust_no"))
    return numbered.join(first, series, "left").filter("bust_no IS NULL OR trade_no <= bust_no").drop("bust_no", "trade_no")
