"""SQL twin of labelling and selection: one wide join, one recursive chain."""

from __future__ import annotations

from ..plans.strategy import Strategy
from . import sqlkit as Q
from .rule_queries import S, twin

NEEDED = ["ATR14", "ATR14_SMA50", "VolZ20", "Active"]


def _num(v):
    return "CAST(NULL AS DOUBLE)" if v is None else f"CAST({v} AS DOUBLE)"


def _slip(volz):
    return f"(slip / 1e4 * CASE WHEN {volz} < -2 - 1e-9 THEN 4 WHEN {volz} < -1 - 1e-9 THEN 2 ELSE 1 END)"


def names_of(strategies: list[Strategy]) -> list[str]:
    return list(dict.fromkeys([*NEEDED, *[f for s in strategies for f in s.features()]]))


def labels_cte(strategies: list[Strategy], source: str = "events", folds: str | None = None) -> str:
    """CTEs up to ``lab``.  ``folds``: optional CTE text giving folds(symbol, fold, test_start, test_end)."""
    names = names_of(strategies)
    sig = ", ".join(
        f"(Active > 0 AND {twin(s.entry)} AND {twin(s.regime)} AND "
        + ("TRUE" if s.vol_threshold is None else f"(ATR14_SMA50 <= 0 OR ATR14 >= {s.vol_threshold} * ATR14_SMA50)")
        + f") AS sig_{i}, {twin(s.exit) if s.exit else 'FALSE'} AS out_{i}" for i, s in enumerate(strategies))
    shift = ", ".join(f"coalesce({S(f'sig_{i}')}, FALSE) AS was_{i}, coalesce({S(f'out_{i}')}, FALSE) AS left_{i}" for i in range(len(strategies)))
    frame = lambda lo, hi: f"OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {lo} PRECEDING AND {hi})"
    evs = []
    for i, s in enumerate(strategies):
        swing = "NULL"
        if s.stop and s.stop[0] == "swing":
            n = int(s.stop[1])
            swing = (f"least(r_close, min(low) {frame(n + 1, '2 PRECEDING')})" if s.direction == 1
                     else f"greatest(r_close, max(high) {frame(n + 1, '2 PRECEDING')})")
        tk = {None: 0, "atr": 1, "swing": 2}[s.trail[0] if s.trail else None]
        tx = s.trail[1] if tk == 1 else 0
        stop, target = s.stop or (None, None), s.target or (None, None)
        evs.append(
            f"SELECT symbol, '{s.name}' AS strategy, {i} AS sid, {s.direction} AS dir, bar_idx AS entry_idx, open_ms AS entry_ms, open AS o, "
            f"r_atr, r_volz, '{stop[0]}' AS sk, {_num(stop[1])} AS sx, '{target[0]}' AS tk, {_num(target[1])} AS tx, {swing} AS swing, "
            f"{tk} AS trail_kind, {_num(tx)} AS trail_k, {_num(s.fee_bps)} AS fee, {_num(s.slip_bps)} AS slip, {s.max_hold} AS max_hold, "
            f"{s.cooldown} AS cd, {s.max_losses} AS max_losses, was_{i} AS was, {s.warmup} AS warm FROM sh")
    side = lambda k, x, sign, fb: (
        f"CASE {k} WHEN 'fixed' THEN entry_price * (1 {sign} dir * {x} / 100) WHEN 'atr' THEN CASE WHEN r_atr > 0 "
        f"THEN entry_price {sign} dir * {x} * r_atr ELSE entry_price * (1 {sign} dir * {fb}) END WHEN 'swing' THEN swing END")
    if folds:
        group = f"{folds},\nends AS (SELECT symbol, fold AS grp, test_start AS lo_idx, test_end AS end_idx FROM folds),"
        bound = "AND e.entry_idx - 1 >= n.lo_idx"
    else:
        group = "ends AS (SELECT symbol, 0 AS grp, 0 AS lo_idx, max(bar_idx) + 1 AS end_idx FROM f GROUP BY symbol),"
        bound = ""
    left = "CASE sid " + " ".join(f"WHEN {i} THEN left_{i}" for i in range(len(strategies))) + " END"
    reasons = "CASE coalesce(code, 8) WHEN 1 THEN 'tp_gap_open' WHEN 2 THEN 'sl_gap_open' WHEN 3 THEN 'sl_hit' WHEN 4 THEN 'trail_hit' " \
              "WHEN 5 THEN 'tp_hit' WHEN 6 THEN 'exit_rule' WHEN 7 THEN 'max_hold' ELSE 'end_of_data' END"
    return f"""{Q.features_cte(names, source)},
sg AS (SELECT *, {sig} FROM f),
sh AS MATERIALIZED (SELECT *, {S("ATR14")} AS r_atr, {S("VolZ20")} AS r_volz, {S("close")} AS r_close, {shift},
  max(low) {frame(50, 'CURRENT ROW')} AS low51, min(high) {frame(50, 'CURRENT ROW')} AS high51 FROM sg),
{group}
ev0 AS ({" UNION ALL ".join(evs)}),
ev1 AS (SELECT e.*, n.grp, n.end_idx, o * (1 + dir * {_slip('r_volz')}) AS entry_price FROM ev0 e JOIN ends n USING (symbol)
  WHERE was AND entry_idx - 1 >= warm AND entry_idx < end_idx {bound}),
ev AS MATERIALIZED (SELECT *, {side('sk', 'sx', '-', 0.02)} AS stop, {side('tk', 'tx', '+', 0.04)} AS target FROM ev1),
j0 AS (SELECT e.*, b.bar_idx, b.bar_idx - entry_idx AS pos, b.open, b.high, b.low, b.close, b.open_ms, b.r_volz AS volz, {left} AS gone,
    CASE trail_kind WHEN 1 THEN CASE WHEN b.ATR14 > 0 THEN dir * b.close - trail_k * b.ATR14 END
      WHEN 2 THEN CASE WHEN b.bar_idx > 50 THEN CASE WHEN dir = 1 THEN low51 ELSE -high51 END END END AS cut
  FROM ev e JOIN sh b ON b.symbol = e.symbol AND b.bar_idx >= entry_idx AND b.bar_idx < end_idx
    AND (max_hold = 0 OR b.bar_idx <= entry_idx + max_hold)),
j1 AS (SELECT *, greatest(dir * stop, max(cut) OVER (PARTITION BY symbol, sid, grp, entry_idx ORDER BY bar_idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS ss, {_slip('volz')} AS sl FROM j0),
j2 AS (SELECT *, CASE WHEN pos > 0 AND dir * open >= dir * target THEN 1 WHEN pos > 0 AND dir * open <= ss THEN 2
    WHEN CASE WHEN dir = 1 THEN low ELSE -high END <= ss THEN CASE WHEN trail_kind > 0 AND ss >= dir * entry_price THEN 4 ELSE 3 END
    WHEN CASE WHEN dir = 1 THEN high ELSE -low END >= dir * target THEN 5 WHEN max_hold > 0 AND pos >= max_hold THEN 7
    WHEN pos > 0 AND gone THEN 6 END AS code FROM j1),
j3 AS (SELECT * FROM j2 WHERE code IS NOT NULL OR bar_idx = end_idx - 1
  QUALIFY row_number() OVER (PARTITION BY symbol, sid, grp, entry_idx ORDER BY bar_idx) = 1),
lab0 AS (SELECT *, bar_idx AS exit_idx, open_ms AS exit_ms, {reasons} AS reason,
    CASE WHEN code IN (3, 4) THEN dir * ss * (1 - dir * 2 * sl) WHEN code = 5 THEN target * (1 - dir * sl)
      WHEN code IS NOT NULL THEN open * (1 - dir * sl) ELSE close * (1 - dir * sl) END AS exit_price FROM j3),
lab AS MATERIALIZED (SELECT symbol, strategy, sid, grp, dir, entry_idx - 1 AS signal_idx, entry_idx, entry_ms, entry_price, stop, target,
    end_idx, exit_idx, exit_ms, exit_price, reason, dir * (exit_price / entry_price - 1) - 2 * fee / 1e4 AS pnl,
    exit_idx - entry_idx + 1 AS hold, cd, max_losses, fee, slip FROM lab0)"""


SELECT_CTE = """hop AS MATERIALIZED (SELECT a.sid, a.grp, a.symbol, a.signal_idx, min(b.signal_idx) AS next_idx FROM lab a LEFT JOIN lab b
    ON b.sid = a.sid AND b.grp = a.grp AND b.symbol = a.symbol AND b.signal_idx > a.exit_idx + a.cd GROUP BY ALL),
chain AS (
  SELECT l.sid, l.grp, l.symbol, l.signal_idx, CASE WHEN pnl < 0 THEN 1 ELSE 0 END AS streak, max_losses FROM lab l
  JOIN (SELECT sid, grp, symbol, min(signal_idx) AS signal_idx FROM lab GROUP BY ALL) m USING (sid, grp, symbol, signal_idx)
  UNION ALL
  SELECT l.sid, l.grp, l.symbol, l.signal_idx, CASE WHEN l.pnl < 0 THEN c.streak + 1 ELSE 0 END, l.max_losses
  FROM chain c JOIN hop h USING (sid, grp, symbol, signal_idx)
  JOIN lab l ON l.sid = h.sid AND l.grp = h.grp AND l.symbol = h.symbol AND l.signal_idx = h.next_idx
  WHERE c.max_losses = 0 OR c.streak < c.max_losses),
trades AS MATERIALIZED (SELECT l.* FROM lab l JOIN chain c USING (sid, grp, symbol, signal_idx))"""


def simple_cte(strategies: list[Strategy], source: str = "events") -> str:
    """CTEs up to ``trades`` of the simple engine."""
    names = list(dict.fromkeys(f for s in strategies for f in s.features()))
    cols = ", ".join(f"{twin(s.entry)} AS ent_{i}, {twin(s.exit) if s.exit else 'FALSE'} AS out_{i}" for i, s in enumerate(strategies))
    evs = " UNION ALL ".join(
        f"SELECT b.symbol, '{s.name}' AS strategy, {i} AS sid, 0 AS grp, {s.direction} AS dir, g.bar_idx AS signal_idx, b.bar_idx AS entry_idx, b.open AS entry_price, n, "
        f"b.open * (1 - {s.direction} * {_num(s.stop[1] if s.stop else None)} / 100) AS stop, b.open * (1 + {s.direction} * {_num(s.target[1] if s.target else None)} / 100) AS target, "
        f"{_num(s.fee_bps + s.slip_bps)} AS cost, {s.max_hold} AS max_hold, 0 AS cd, 0 AS max_losses FROM sg g JOIN sg b ON b.symbol = g.symbol AND b.bar_idx = g.bar_idx + 1 "
        f"JOIN sizes z ON z.symbol = g.symbol WHERE g.ent_{i} AND g.bar_idx >= 200" for i, s in enumerate(strategies))
    left = "CASE sid " + " ".join(f"WHEN {i} THEN out_{i}" for i in range(len(strategies))) + " END"
    return f"""{Q.features_cte(names, source)},
sg AS MATERIALIZED (SELECT *, {cols} FROM f),
sizes AS (SELECT symbol, count(*) AS n FROM f GROUP BY symbol HAVING count(*) >= 300),
ev AS MATERIALIZED ({evs}),
x AS (SELECT e.*, b.bar_idx, CASE WHEN (dir = 1 AND low <= stop) OR (dir = -1 AND high >= stop) THEN 'H-SL' WHEN (dir = 1 AND high >= target) OR (dir = -1 AND low <= target) THEN 'H-TP'
    WHEN {left} THEN 'EXIT RULE' WHEN max_hold > 0 AND b.bar_idx - entry_idx >= max_hold THEN 'H-MAX' END AS reason, close
  FROM ev e LEFT JOIN sg b ON b.symbol = e.symbol AND b.bar_idx > entry_idx),
y AS (SELECT * FROM x WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, sid, signal_idx ORDER BY bar_idx) = 1),
lab0 AS (SELECT e.*, coalesce(y.bar_idx, e.n) AS exit_idx, y.reason, CASE y.reason WHEN 'H-SL' THEN e.stop WHEN 'H-TP' THEN e.target ELSE y.close END AS exit_price
  FROM ev e LEFT JOIN y ON y.symbol = e.symbol AND y.sid = e.sid AND y.signal_idx = e.signal_idx),
lab AS MATERIALIZED (SELECT *, CASE WHEN reason IS NOT NULL THEN dir * (exit_price / entry_price - 1) * 100 - 2 * cost / 1e4 END AS pnl FROM lab0),
{SELECT_CTE}"""


def trades_cte(strategies: list[Strategy], source: str = "events", folds: str | None = None) -> str:
    return f"{labels_cte(strategies, source, folds)},\n{SELECT_CTE}"
