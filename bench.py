"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each figure is the median of BENCH_RUNS (default 3), the first of which is cold.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from barloom.functions.indicators import BASE_FEATURES, features
from barloom.operators import metrics, outcomes, signals
from barloom.operators.selection import select_trades
from barloom.plans import walkforward
from barloom.plans.strategy import PRESETS, Strategy
from barloom.registry.common import table
from barloom.session import local_session, materialize
from barloom.sources.bars import event_bars, lineitem_bars, order_bars

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def rule_grid(n: int) -> dict[str, tuple]:
    """n different two-leaf rules over a fixed set of features."""
    rules = {}
    for i in range(n):
        level = ("GT" if i % 2 else "LT", ("RSI14", "ADX", "ROC10")[i % 3], 20.0 + (i * 7) % 60)
        trend = (("Rising", "Falling")[i // 2 % 2], ("EMA10", "EMA20", "EMA50")[i // 3 % 3], 1 + i % 8)
        cross = (("CrossUp", "CrossDown", "BreakUp", "BreakDown")[i % 4], "EMA10", ("EMA20", "EMA50")[i // 4 % 2])
        rules[f"r{i}"] = ("AND" if i % 5 else "OR", level, trend if i % 7 else cross)
    return rules


def main() -> None:
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    load = lambda name: table(spark, SF, name)
    run = lambda df: df.write.mode("overwrite").format("noop").save()
    bars = materialize(lineitem_bars(load("lineitem")), "bench-bars")
    hourly = materialize(event_bars(load("events")), "bench-hourly")
    daily = materialize(order_bars(load("orders")), "bench-daily")
    rules = rule_grid(1000)
    book = [Strategy(f"book{i}", ("CrossUp", "EMA10", "EMA20"), stop=("fixed", 5.0 + i), target=("fixed", 8.0 + 2 * i), max_hold=40 + i)
            for i in range(25)]

    def labels(source, strategies):
        return outcomes.outcomes(source, strategies)

    def ledger(source, strategies):
        ids = range(len(strategies))
        t = select_trades(labels(source, strategies), {i: strategies[i].cooldown for i in ids}, {i: 0 for i in ids})
        return metrics.trade_metrics(t, ["strategy"])

    def forward():
        folds = materialize(walkforward.rolling_folds(daily), "bench-folds")
        trades, _, stitched = walkforward.walk_forward(daily, book, folds)
        return walkforward.oos_summary(stitched, trades, folds, book)

    jobs = {
        "bars_from_events": lambda: run(event_bars(load("events"))),
        "bars_from_lineitem": lambda: run(lineitem_bars(load("lineitem"))),
        "ema_rsi_features": lambda: run(features(bars, ["EMA10", "EMA20", "EMA50", "RSI14"])),
        "base_features_73": lambda: run(features(bars, BASE_FEATURES)),
        "rules_1000_counts": lambda: run(signals.rule_counts(materialize(signals.rule_inputs(bars, rules), "bench-inputs"), rules)),
        "labels_presets": lambda: run(labels(bars, PRESETS)),
        "trades_presets": lambda: run(ledger(hourly, PRESETS)),
        "walk_forward_25": lambda: run(forward()),
    }
    only = os.environ.get("BENCH_ONLY")
    seconds = {}
    for name, job in jobs.items():
        if only and name not in only.split(","):
            continue
        times = []
        for _ in range(RUNS):
            start = time.time()
            job()
            times.append(time.time() - start)
        seconds[name] = round(statistics.median(times), 3)
    n = bars.count()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(SF).removeprefix("sf"), "bars": n,
        "rule_bars_per_sec": round(1000 * n / seconds["rules_1000_counts"]) if "rules_1000_counts" in seconds else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
