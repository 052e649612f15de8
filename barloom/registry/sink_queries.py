"""Sinks, winner files, reports, snapshots and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.indicators import features
from ..functions.proofs import prove_signals
from ..operators import joins as J
from ..operators import ranking as K
from ..operators.acceptance import recent_distinct
from ..session import materialize, prepare, shared_folder
from ..sources import sinks as Z
from ..streaming import streams as L
from . import sqlkit as Q
from .common import Registry, bars_of, rounded, table
from .metric_queries import POINTS_SQL, R, points_of
from .score_queries import SC, scored
from .trade_queries import BOOK, STATES_SQL, states_sql, with_states, with_trades
from .trade_sql import names_of, trades_cte
from ..sources.bars import HOUR_MS

SHOWN = ["EMA10", "EMA20", "RSI14"]
TRAILING = ", ".join(f"'{s.name}'" for s in BOOK if s.trail)
WINNER = "seed long, strategy string, test_score double, test_return double, test_trades long, regime string"


def _path(spark, name):
    return f"{shared_folder(spark)}/barloom/{name}-{uuid.uuid4().hex}"


def winner_file(spark, d) -> str:
    """Winner lines from the orders table, with broken lines mixed in."""
    o = table(spark, d, "orders").selectExpr(
        "o_orderkey AS seed", "concat('c', o_custkey) AS strategy", "o_totalprice / 1000 AS test_score", "o_totalprice % 100 AS test_return",
        "o_custkey AS test_trades", "CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS regime")
    path = _path(spark, "winners")
    lines = o.select(F.when(F.col("seed") % 11 == 3, F.lit('{"seed": oops')).otherwise(F.to_json(F.struct("*"))).alias("value"), F.col("seed").alias("line"))
    # Lines from the largest seed down, so that the first line isn't the smallest seed.
    lines.orderBy(F.desc("line")).select("value").write.text(path)
    return path


W_SQL = """w AS (SELECT o_orderkey AS seed, concat('c', o_custkey) AS strategy, o_totalprice / 1000 AS test_score, o_totalprice % 100 AS test_return,
  o_custkey AS test_trades, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS regime FROM orders WHERE o_orderkey % 11 <> 3)"""
W_NUM = ["test_score", "test_return"]


def winners(spark, d):
    return Z.read_winners(spark, winner_file(spark, d), WINNER)[0]


def first_line(spark, d):
    return Z.first_winner(Z.read_winners(spark, winner_file(spark, d), WINNER, "place")[0], "place")


def bad_lines(spark, d):
    return Z.read_winners(spark, winner_file(spark, d), WINNER)[1].groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def trade_sink(spark, t, b, states, prep):
    out = Z.trade_file(t, b, prove_signals(prep, t, BOOK, SHOWN))
    path = _path(spark, "trades")
    Z.write_csv(out, path)
    back = Z.read_csv(spark, path, out.schema)
    return rounded(back, ["EntryPrice", "ExitPrice", "PnL", "StopPrice", "TPPrice"])


def proof_sink(spark, t, b, states, prep):
    """Every bar of every strategy, read back from the file."""
    out = Z.state_file_with_proofs(states, prep, prove_signals(prep, t, BOOK, SHOWN), SHOWN)
    path = _path(spark, "state-proofs")
    Z.write_csv(out, path)
    return Z.read_csv(spark, path, out.schema).withColumn("States", F.coalesce("States", F.lit("")))


def state_sink(spark, t, b, states):
    out = Z.state_file(states, b)
    path = _path(spark, "states")
    out.write.parquet(path)
    return spark.read.parquet(path).groupBy("strategy", "Statuses").agg(F.count(F.lit(1)).alias("n"), F.min("Time").alias("first"), F.max("BarIndex").alias("last"))


def trace_sink(spark, t, b, states):
    f = features(b, ["RSI14", "EMA20"]).withColumn("hot", F.col("RSI14") > 60)
    out = Z.trace(states, f, ["RSI14", "EMA20", "hot"])
    path = _path(spark, "trace")
    out.write.parquet(path)
    return rounded(spark.read.parquet(path).groupBy("symbol", "strategy", "state", "hot").agg(F.count(F.lit(1)).alias("n"), F.avg("EMA20").alias("mean")), ["mean"])


def points(spark, d):
    b = materialize(bars_of(spark, d), "bars")
    near = J.nearest(points_of(spark, d), b, 64 * HOUR_MS)
    out = Z.diagnostic_points(near, features(b, ["RSI14", "BB_Upper20", "BB_Lower20"]), ["RSI14"])
    return rounded(out, ["RSI14", "SMA20"])


def accepted(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey", "concat_ws('|', o_custkey, o_orderstatus) AS fp")
    out, path = recent_distinct(o, "fp", "o_orderkey"), _path(spark, "accepted")
    Z.write_winners(out, path)
    return spark.read.schema("o_orderkey long, fp string").json(path)


def report_sink(spark, d):
    top = K.best_test(scored(spark, d).filter("score IS NOT NULL"))
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("max_dd"), F.desc("ret"), F.asc("strategy"))))
    path = _path(spark, "reports")
    Z.write_reports(Z.reports(ranked), path)
    lines = spark.read.text(path, wholetext=True)
    return lines.select("rank", *Z.parse_report(F.col("value")))


def snapshot(spark, d):
    s = scored(spark, d)
    path = _path(spark, "snapshot")
    Z.save_snapshot({"hall": s.select("strategy", "score"), "seen": s.select("strategy")}, path, 1)
    back = Z.load_snapshot(spark, path, 1, ["hall", "seen"])
    return rounded(back["hall"].join(back["seen"], "strategy", "left_semi"), ["score"])


# --- streams -------------------------------------------------------------------------

def stream_of(spark, d):
    return L.event_stream(prepare(spark), d, "events.parquet")


def final_bars(spark, d):
    return rounded(L.run_to_table(L.live_bars(stream_of(spark, d))), ["open", "high", "low", "close"])


def online(spark, d):
    """Finished bars in time order through the stateful indicators."""
    path = _path(spark, "bar-feed")
    b = bars_of(spark, d).select("symbol", "open_ms", "high", "low", "close")
    b.write.parquet(path)
    feed = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 100000).parquet(path)
    return rounded(L.run_to_table(L.online_indicators(feed)), ["close", "ema_fast", "ema_slow", "atr"])


def late(spark, d):
    """A seventh of the events comes after all others: what the watermark drops of them, and what is kept."""
    feed, out, e = _path(spark, "late-feed"), _path(spark, "late-run"), table(spark, d, "events")
    for part in ("event_id % 7 <> 0", "event_id % 7 = 0"):
        e.filter(part).write.mode("append").parquet(feed)
        dropped = L.late_rows(L.distinct_events(L.event_stream(spark, feed, "*.parquet", 1000)), out)
    kept = spark.read.parquet(f"{out}/data").agg(F.count(F.lit(1)).alias("kept"))
    return dropped.agg(F.sum("dropped").alias("dropped")).join(F.broadcast(kept))


def _num(x, digits=2):
    return f"coalesce(CAST(TRY_CAST(round({x}, {digits}) AS DECIMAL(30, {digits})) AS VARCHAR), 'NaN')"


def _crossing(kind, a, b, holds):
    return f"""concat('{kind}({a},{b}):', CAST({holds} AS VARCHAR), '[{a}[t-1]=', {_num(f'p_{a}')}, ' | {b}[t-1]=', {_num(f'p_{b}')}, ' | {a}[t]=', {_num(a)}, ' | {b}[t]=', {_num(b)}, ']')"""


def _rising(a, n, holds):
    return f"concat('Rising({a}):', CAST({holds} AS VARCHAR), '[{a}[t]=', {_num(a)}, ' | {a}[t-{n}]=', {_num(f'p{n}_{a}')}, ']')"


VALUES_SQL = "concat('indicators={', " + ", ', ', ".join(f"'{n}=', {_num(n)}" for n in SHOWN) + ", '}')"
UP, DOWN = (f"p_EMA10 {x} p_EMA20 AND EMA10 {y} EMA20 AND abs(EMA10 - p_EMA10) >= 1e-6 AND abs(EMA20 - p_EMA20) >= 1e-6" for x, y in (("<=", ">"), (">=", "<")))
# Summary by strategy: what the book's signals show.
SUMMARY_SQL = f"""CASE strategy WHEN 'trend_long' THEN concat_ws(' | ', 'regime_ok=true', 'entry_ok=true',
    CASE WHEN {UP} THEN 'path=OR_left:CrossUp' ELSE 'path=OR_right:AND(LT && Rising)' END, {_crossing('CrossUp', 'EMA10', 'EMA20', f'({UP})')},
    concat('LT(RSI14):', CAST(RSI14 < 40 AS VARCHAR), '[RSI14[t]=', {_num('RSI14')}, ' | threshold=40.00]'), {_rising('EMA20', 2, '(EMA20 > p2_EMA20)')}, {VALUES_SQL})
  WHEN 'fade_short' THEN concat_ws(' | ', 'regime_ok=true', 'entry_ok=true', 'path=CrossDown', {_crossing('CrossDown', 'EMA10', 'EMA20', f'({DOWN})')}, {VALUES_SQL})
  ELSE concat_ws(' | ', 'regime_ok=true', 'entry_ok=true', 'path=Rising', {_rising('EMA10', 2, '(EMA10 > p2_EMA10)')}, {VALUES_SQL}) END"""
SEEN_SQL = "pf AS MATERIALIZED (SELECT *, " + ", ".join(
    f"lag({a}, {k}) OVER (PARTITION BY symbol ORDER BY bar_idx) AS {p}_{a}" for a in ("EMA10", "EMA20") for k, p in ((1, "p"), (2, "p2"))) + " FROM f)"
ONLINE_SQL = f"""WITH RECURSIVE {Q.features_cte(["EMA10", "EMA20", "ATR14"])}, e AS (SELECT *,
  CASE WHEN bar_idx < 9 THEN avg(close) OVER k ELSE EMA10 END AS fa, CASE WHEN bar_idx < 19 THEN avg(close) OVER k ELSE EMA20 END AS sl FROM f
  WINDOW k AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT symbol, open_ms, {R('close')} AS close, {R('fa')} AS ema_fast, {R('sl')} AS ema_slow, {R('ATR14')} AS atr,
  bar_idx > 20 AND fa > sl AND NOT lag(fa > sl) OVER (PARTITION BY symbol ORDER BY bar_idx) AS cross_up FROM e"""

# the last event of the stream sets the watermark two hours back; only windows that end by then are final
FINAL = "(SELECT epoch_us(max(ts)) // 1000 - 7200000 FROM events)"


def register(reg: Registry) -> None:
    reg.add("s04_winner_scan", lambda s, d: rounded(Z.newest(winners(s, d), "seed", 500), W_NUM),
            f"WITH {W_SQL} SELECT seed, strategy, {Q.rounded(W_NUM)}, test_trades, regime FROM w ORDER BY seed DESC LIMIT 500")
    reg.add("s04_bad_lines", bad_lines, """SELECT '{"seed": oops' AS value, count(*) AS n FROM orders WHERE o_orderkey % 11 = 3""")
    reg.add("s05_find_winner", lambda s, d: rounded(Z.by_seed(winners(s, d), 4242).unionByName(first_line(s, d)), W_NUM),
            f"""WITH {W_SQL} SELECT seed, strategy, {Q.rounded(W_NUM)}, test_trades, regime FROM w
            WHERE seed = 4242 UNION ALL (SELECT seed, strategy, {Q.rounded(W_NUM)}, test_trades, regime FROM w ORDER BY seed DESC LIMIT 1)""")
    reg.add("a26_completeness", lambda s, d: Z.completeness(winners(s, d), ["regime", "test_score"]),
            f"WITH {W_SQL} SELECT count(*) AS lines, count(regime) AS with_regime, count(test_score) AS with_test_score FROM w")
    ts = lambda ms: f"strftime(make_timestamp_ms({ms}), '%Y-%m-%dT%H:%M:%SZ')"
    reg.add("s06_trade_file", with_states(trade_sink, prep_too=True), f"""WITH RECURSIVE {trades_cte(BOOK)}, {SEEN_SQL} SELECT concat_ws('-', strategy, t.symbol, signal_idx) AS TradeID,
        signal_idx AS SignalIndex, entry_idx AS EntryIndex, exit_idx AS ExitIndex, {ts('b.open_ms')} AS SignalTime, {ts('entry_ms')} AS EntryTime, {ts('exit_ms')} AS ExitTime,
        CASE WHEN dir = 1 THEN 'LONG' ELSE 'SHORT' END AS Direction, {R('entry_price')} AS EntryPrice, {R('exit_price')} AS ExitPrice, {R('pnl')} AS PnL, hold AS HoldBars, reason AS ExitReason,
        {R('stop')} AS StopPrice, {R('target')} AS TPPrice, strategy IN ({TRAILING}) AS TrailActive,
        {SUMMARY_SQL} AS ProofSummary FROM trades t JOIN bars b ON b.symbol = t.symbol AND b.bar_idx = t.signal_idx JOIN pf ON pf.symbol = t.symbol AND pf.bar_idx = t.signal_idx""")
    reg.add("s07_state_proofs", with_states(proof_sink, prep_too=True), f"""WITH RECURSIVE {STATES_SQL}, {SEEN_SQL}
        SELECT s.symbol, s.strategy, s.bar_idx AS BarIndex, strftime(make_timestamp_ms(s.open_ms), '%Y-%m-%d %H:%M:%S') AS Time,
        CASE WHEN st = 'filtered' THEN '' ELSE st END AS States, t.sid IS NOT NULL AS RegimeOK, t.sid IS NOT NULL AS EntryOK,
        CASE WHEN t.sid IS NOT NULL THEN {SUMMARY_SQL.replace('strategy WHEN', 's.strategy WHEN')} ELSE {VALUES_SQL} END AS ProofSummary
        FROM states s JOIN pf ON pf.symbol = s.symbol AND pf.bar_idx = s.bar_idx
        LEFT JOIN trades t ON t.symbol = s.symbol AND t.strategy = s.strategy AND t.signal_idx = s.bar_idx""")
    reg.add("s07_state_file", with_states(state_sink), f"""WITH RECURSIVE {STATES_SQL} SELECT strategy, CASE WHEN st = 'filtered' THEN '' ELSE st END AS "Statuses", count(*) AS n,
        min(open_ms) AS first, max(bar_idx) AS last FROM states GROUP BY ALL""")
    reg.add("s08_trace", with_states(trace_sink), f"""WITH RECURSIVE {states_sql(BOOK).replace(Q.features_cte(names_of(BOOK)), Q.features_cte([*names_of(BOOK), *[n for n in ("RSI14", "EMA20") if n not in names_of(BOOK)]]))}
        SELECT s.symbol, strategy, st AS state, RSI14 > 60 AS hot, count(*) AS n, {R('avg(EMA20)')} AS mean FROM states s JOIN f ON f.symbol = s.symbol AND f.bar_idx = s.bar_idx GROUP BY ALL""")
    reg.add("s09_diagnostic_points", points, f"""WITH RECURSIVE {Q.features_cte(["RSI14", "BB_Upper20", "BB_Lower20"])},
        {POINTS_SQL[POINTS_SQL.index('pts AS'):]}, n AS (SELECT p.symbol, t, bar_idx, abs(close_ms - t) AS gap FROM pts p JOIN bars b USING (symbol)
        QUALIFY row_number() OVER (PARTITION BY p.symbol, t ORDER BY abs(close_ms - t), bar_idx) = 1)
        SELECT n.*, {R('RSI14')} AS RSI14, {R('(BB_Upper20 + BB_Lower20) / 2')} AS SMA20 FROM n JOIN f USING (symbol, bar_idx)""")
    reg.add("s10_accepted_file", accepted, """WITH RECURSIVE o AS MATERIALIZED (SELECT o_orderkey, concat_ws('|', o_custkey, o_orderstatus) AS fp, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders),
        r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS recent, FALSE AS ok UNION ALL
          SELECT o.i, CASE WHEN list_contains(r.recent, o.fp) THEN r.recent ELSE list_append(r.recent[greatest(1, len(r.recent) - 998):], o.fp) END, NOT list_contains(r.recent, o.fp)
          FROM r JOIN o ON o.i = r.i + 1)
        SELECT o_orderkey, fp FROM r JOIN o USING (i) WHERE ok""")
    reg.add("s11_reports", report_sink, f"""WITH {SC}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, max_dd, ret DESC, strategy) AS rank FROM sc WHERE score IS NOT NULL)
        SELECT CAST(rank AS INTEGER) AS rank, CAST(round(score, 4) AS DOUBLE) AS score, CAST(round(ret * 100, 2) AS DOUBLE) AS ret_pct,
        CAST(round(max_dd * 100, 2) AS DOUBLE) AS dd_pct, CAST(trades AS DOUBLE) AS trades FROM r WHERE rank <= 20""")
    reg.add("s12_snapshot", snapshot, f"WITH {SC} SELECT strategy, {R('score')} AS score FROM sc")
    reg.add("x01_stream_bars", final_bars, f"""WITH {Q.bars_cte()} SELECT symbol, open_ms, {Q.rounded(['open', 'high', 'low', 'close'])}, trades AS volume
        FROM bars WHERE open_ms + 3600000 <= {FINAL}""")
    reg.add("x02_stream_profile", lambda s, d: rounded(L.run_to_table(L.activity_profile(stream_of(s, d))), ["total"]),
            f"""WITH e AS (SELECT event_type, value, epoch_us(ts) // 900000000 * 900000 AS q FROM events),
            w AS (SELECT event_type, value, q - k * 900000 AS start_ms FROM e, (VALUES (0), (1), (2), (3)) v(k))
            SELECT event_type, start_ms, count(*) AS n, {R('sum(value)')} AS total FROM w WHERE start_ms + 3600000 <= {FINAL} GROUP BY ALL""")
    reg.add("x03_stream_sessions", lambda s, d: rounded(L.run_to_table(L.sessions(stream_of(s, d))), ["peak"]),
            f"""WITH e AS (SELECT event_type, value, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events),
            g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM e),
            z AS (SELECT event_type, min(us) AS start_us, max(us) + 1800000000 AS end_us, count(*) AS n, max(value) AS peak FROM g GROUP BY event_type, s)
            SELECT event_type, start_us, end_us, n, {R('peak')} AS peak FROM z WHERE end_us // 1000 <= {FINAL}""")
    reg.add("x04_stream_distinct", lambda s, d: L.run_to_table(L.distinct_events(stream_of(s, d))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")),
            "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
    reg.add("x05_online_indicators", online, ONLINE_SQL)
    reg.add("x06_counters", lambda s, d: rounded(L.run_to_table(L.counters(stream_of(s, d)), "update", ["event_type"]), ["total"]),
            f"SELECT event_type, count(*) AS n, {R('sum(value)')} AS total FROM events GROUP BY event_type")
    reg.add("x07_late_rows", late, """WITH m AS (SELECT epoch_us(max(ts)) // 1000 * 1000 - 7200000000 AS mark FROM events WHERE event_id % 7 <> 0),
        e AS (SELECT event_id, event_id % 7 = 0 AND epoch_us(ts) <= mark AS late FROM events, m)
        SELECT count(*) FILTER (WHERE late) AS dropped, count(DISTINCT event_id) FILTER (WHERE NOT late) AS kept FROM e""")
