"""Operators that a row-by-row pass defines, against that pass: acceptance, novelty, timelines, rule texts."""
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from barloom.operators import acceptance, outcomes, ranking
from barloom.operators.selection import select_trades
from barloom.operators.tiling import Tiles
from barloom.operators.timeline import bar_states, timeline
from barloom.functions.rules import leaf_rows
from barloom.plans.strategy import Strategy


def keys_of(seed, n):
    """A third of all rows in one key, chains of repeats, many rare keys."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.33 else f"chain{i % 7}" if rng.random() < 0.3 else f"k{rng.randint(0, 40)}") for i in range(n)]


@pytest.mark.parametrize(("seed", "window", "part"), [(2, 12, 64), (4, 1000, 65536)])
def test_recent_distinct(spark, monkeypatch, seed, window, part):
    monkeypatch.setattr(acceptance, "PART_ROWS", part)
    keys, recent, want = keys_of(seed, 250), deque(maxlen=window), []
    for i, k in enumerate(keys):
        if k not in recent:
            recent.append(k)
            want.append(3 * i)
    df = spark.createDataFrame([(3 * i, k, "x") for i, k in enumerate(keys)], "line long, fp string, at string")
    got = acceptance.recent_distinct(df, "fp", "line", window)
    assert got.columns == df.columns and sorted(r.line for r in got.collect()) == want
    assert acceptance.recent_distinct(df.limit(0), "fp", "line", window).count() == 0


@pytest.mark.parametrize(("seed", "window", "keep", "part"), [(2, 25, 6, 50), (5, 3, 2, 100)])
def test_novelty(spark, monkeypatch, seed, window, keep, part):
    monkeypatch.setattr(acceptance, "PART_ROWS", part)
    keys, counts, total, want = [k if random.Random(i).random() < 0.7 else f"new{i}" for i, k in enumerate(keys_of(seed, 250))], Counter(), 0, []
    for i, k in enumerate(keys):
        if counts[k] >= keep:
            continue
        counts[k] += 1
        total += 1
        want.append(i)
        if total > 2 * window:
            counts, total = Counter({f: c // 2 for f, c in counts.items()}), total // 2
    df = spark.createDataFrame(list(enumerate(keys)), "i long, f string")
    assert sorted(r.i for r in acceptance.novelty(df, "f", "i", keep, window).collect()) == want
    assert 0 < len(want) < 250


@pytest.fixture
def jobs(spark):
    """Counts the Spark jobs of a call."""
    def run(call):
        group = f"jobs-{random.random()}"
        spark.sparkContext.setJobGroup(group, group)
        got = call()
        spark.sparkContext.setJobGroup("", "")
        return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    return run


def test_novelty_jobs(spark, monkeypatch, jobs):
    """One row more or less moves all later halvings: still one pass over each tile, with a null family and gaps in the order."""
    monkeypatch.setattr(acceptance, "PART_ROWS", 64)
    monkeypatch.setattr(acceptance, "TILE_PARTS", 1, raising=False)
    rng, counts, total, want = random.Random(1), Counter(), 0, []
    keys = [None if rng.random() < 0.1 else "hot" if rng.random() < 0.3 else f"k{i // 90}-{rng.randint(0, 25)}" for i in range(700)]
    for i, k in enumerate(keys):
        if counts[k] < 3:
            counts[k] += 1
            total += 1
            want.append(i + 1000 * (i > 400))
            if total > 14:
                counts, total = Counter({f: c // 2 for f, c in counts.items()}), total // 2
    df = spark.createDataFrame([(i + 1000 * (i > 400), k) for i, k in enumerate(keys)], "i long, f string").repartition(5)
    got, n = jobs(lambda: sorted(r.i for r in acceptance.novelty(df, "f", "i", 3, 7).collect()))
    assert got == want and n <= 10 + 3 * 12


@pytest.mark.parametrize(("span", "most"), [(400, 24), (9, 60)])
def test_recent_distinct_jobs(spark, monkeypatch, jobs, span, most):
    """Tiles from guessed states; nine keys in turn never leave a window of twelve, so that each guess is wrong and its tile runs again."""
    monkeypatch.setattr(acceptance, "PART_ROWS", 64)
    monkeypatch.setattr(acceptance, "TILE_PARTS", 1, raising=False)
    monkeypatch.setattr(acceptance, "GUESS_PARTS", 1, raising=False)
    rng, recent, want = random.Random(3), deque(maxlen=12), []
    keys = [f"k{i % 9 if span == 9 else rng.randint(0, span)}" for i in range(600)]
    for i, k in enumerate(keys):
        if k not in recent:
            recent.append(k)
            want.append(i)
    df = spark.createDataFrame(list(enumerate(keys)), "i long, f string").repartition(5)
    got, n = jobs(lambda: sorted(r.i for r in acceptance.recent_distinct(df, "f", "i", 12).collect()))
    assert got == want and n <= most


def test_rule_texts(spark):
    """Brackets close where subtrees end, at any depth."""
    rule = ("AND", ("OR", ("NOT", ("NOT", ("GT", "RSI14", 30.0))), ("Rising", "EMA20", 3)), ("AND", ("CrossUp", "EMA10", "EMA20"), ("NOT", ("Between", "ADX", 9.0, 27.0))))

    def plain(r):
        if r[0] in ("AND", "OR", "NOT"):
            return "(" + " ".join([r[0], *map(plain, r[1:])]) + ")"
        return "(" + " ".join([r[0], r[1], *[r[2]] * (r[0] == "CrossUp")]) + ")"

    rows = [x for i, r in enumerate((rule, rule[1], ("GT", "RSI14", 7.3))) for x in leaf_rows(str(i), r)]
    schema = "strategy string, side string, pos int, depth int, kind string, a string, b string, x double, y double, lb int"
    got = {r.strategy: r for r in ranking.rule_texts(spark.createDataFrame(rows, schema).repartition(4), ["strategy"]).collect()}
    assert [got[str(i)].skeleton for i in range(3)] == [plain(r) for r in (rule, rule[1], ("GT", "RSI14", 7.3))]
    assert got["2"].exact == "(GT RSI14 7.3 0)" and got["2"].coarse == "(GT RSI14 7.3 0)" and "(Between ADX 9.0 25.0 0)" in got["0"].coarse


def test_timeline(spark, walk):
    """Every bar has the state that a bar-by-bar pass gives it, whatever the tiles."""
    book = [Strategy("a", ("Rising", "EMA10", 2), regime=("GT", "ADX", 14.0), stop=("fixed", 3.0), target=("fixed", 3.0), max_hold=9, cooldown=3, max_losses=3),
            Strategy("b", ("CrossUp", "EMA10", "EMA20"), stop=("fixed", 0.4), target=("fixed", 9.0), max_hold=30, vol_threshold=0.95)]
    found = []
    for tiles in (Tiles(256, 256, 256), Tiles()):
        prep = outcomes.prepared(walk, book, tiles).cache()
        trades = select_trades(outcomes.label(outcomes.entries(prep, book, tiles=tiles), outcomes.path_bars(prep, book, tiles), book), {0: 3, 1: 0}, {0: 3, 1: 0}).cache()
        found.append({(r.strategy, r.symbol, r.bar_idx): ",".join(r.states) for r in bar_states(timeline(prep, trades, book, tiles)).collect()})
    assert found[0] == found[1] and len(found[0]) == 2 * 1400
    flags = {(r.symbol, r.bar_idx): r for r in prep.filter(F.expr("tile = bar_idx div 8192")).collect()}
    taken = trades.collect()
    for i, s in enumerate(book):
        for sym in ("a", "b"):
            own = {t.signal_idx: t for t in taken if t.sid == i and t.symbol == sym}
            now, cool, losses = None, -1, 0
            for t in range(700):
                r = flags[sym, t]
                if now is None and t in own:
                    want, now = "signal,pending,flat", own[t]
                elif now is not None:
                    said = ["enter"] * (t == now.entry_idx) + ["holding"] * (now.entry_idx < t < now.exit_idx) + [f"exit_{now.reason}"] * (t == now.exit_idx)
                    want = ",".join(said)
                    if t == now.exit_idx:
                        losses = losses + 1 if now.pnl < 0 else 0
                        cool, now = t + s.cooldown, None
                elif t <= cool:
                    want = "cooldown"
                elif not (r.Active > 0 and r[f"reg_{i}"] and r[f"vol_{i}"]):
                    want = "filtered"
                elif not r[f"sig_{i}"]:
                    want = "flat"
                else:
                    want = ("busted" if s.max_losses and losses >= s.max_losses else "signal_warmup" if t < s.warmup else "signal_skipped_end_of_data") + ",flat"
                assert found[0][s.name, sym, t] == want, (s.name, sym, t)
    kinds = Counter(found[0].values())
    assert {"cooldown", "filtered", "flat", "signal_warmup,flat", "busted,flat", "signal,pending,flat"} <= kinds.keys()


def test_ledger_parts_and_shuffle_partitions_are_bounded(spark):
    """Parts hold many rows, tasks few bytes; the drawdown is that of a plain pass."""
    from barloom.operators.metrics import trade_drawdown
    from barloom.registry.common import table
    from barloom.registry.score_queries import YEAR_PART, led

    rows = led(spark, "/root/testdata/sf0.001").cache()
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "4m" and table(spark, "/root/testdata/sf0.001", "orders").count() == rows.count()
    assert rows.selectExpr("strategy", YEAR_PART).distinct().count() * 4 < rows.count()
    got = {r.strategy: r.max_dd for r in trade_drawdown(rows, ["strategy"], "exit_ms, trade_no", YEAR_PART).collect()}
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.exit_ms, r.trade_no)):
        e, top, dd = want.get(r.strategy, (1.0, 1.0, 0.0))
        e *= 1 + r.pnl
        want[r.strategy] = e, max(top, e), max(dd, (max(top, e) - e) / max(top, e))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k][2]) < 1e-9 for k in want)
