"""Independent SQL twins: plain windows and recursive queries, no chunking."""

from __future__ import annotations

# symbol, time in microseconds, row key, price, volume, bucket width (ms)
SOURCES = {
    "events": ("event_type", "epoch_us(ts)", "event_id", "value", "1.0", 3_600_000, "events"),
    "orders": ("o_orderpriority", "epoch_us(o_orderdate)", "o_orderkey", "o_totalprice", "1.0", 86_400_000, "orders"),
    "lineitem": (
        "CAST(l_suppkey AS VARCHAR)", "epoch_us(l_shipdate)", "l_orderkey * 8 + l_linenumber",
        "l_extendedprice / l_quantity", "l_quantity", 86_400_000, "lineitem",
    ),
}


def bars_cte(source: str = "events", width: int | None = None, name: str = "bars") -> str:
    sym, us, key, price, vol, ms, table = SOURCES[source]
    ms = width or ms
    return f"""{name}_raw AS (
  SELECT {sym} AS symbol, CAST(floor({us} / {ms * 1000}) AS BIGINT) AS slot, {us} AS us, {key} AS k,
         CAST({price} AS DOUBLE) AS p, CAST({vol} AS DOUBLE) AS v FROM {table}),
{name} AS (
  SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY slot) - 1 AS bar_idx,
         slot * {ms} AS open_ms, (slot + 1) * {ms} AS close_ms,
         arg_min(p, (us, k)) AS open, max(p) AS high, min(p) AS low, arg_max(p, (us, k)) AS close,
         sum(v) AS volume, sum(p * v) AS quote_volume, count(*) AS trades,
         sum(CASE WHEN k % 2 = 0 THEN v ELSE 0 END) AS taker_base,
         sum(CASE WHEN k % 2 = 0 THEN p * v ELSE 0 END) AS taker_quote, slot AS src_row
  FROM {name}_raw GROUP BY symbol, slot)"""


def W(n: int, shift: int = 0) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {n - 1 + shift} PRECEDING AND {shift} PRECEDING)"


S = "OVER (PARTITION BY symbol ORDER BY bar_idx)"


def at(k: int, v: str, warm: str = "0.0") -> str:
    return f"CASE WHEN bar_idx >= {k} THEN {v} ELSE {warm} END"


def _wma(x: str, n: int) -> str:
    return at(n - 1, f"((bar_idx + 1) * sum({x}) {W(n)} - sum({x} * bar_idx) {W(n)}) / {n * (n + 1) / 2}")


def _z(n: int) -> str:
    return at(n - 1, f"CASE WHEN avg(volume) {W(n)} <> 0 AND stddev_pop(volume) {W(n)} > 1e-12 "
                     f"THEN (volume - avg(volume) {W(n)}) / stddev_pop(volume) {W(n)} ELSE 0.0 END")


def _chg(n: int, k: float) -> str:
    return at(n, f"{k} * (close - lag(close, {n}) {S}) / lag(close, {n}) {S}")


_pc = f"lag(close) {S}"
D0 = {
    **{f"VolSMA{n}": at(n - 1, f"avg(volume) {W(n)}") for n in (20, 50)},
    **{f"VolZ{n}": _z(n) for n in (20, 50)},
    **{f"BB_Upper{n}": at(n - 1, f"avg(close) {W(n)} + 2 * stddev_pop(close) {W(n)}") for n in (20, 50)},
    **{f"BB_Lower{n}": at(n - 1, f"avg(close) {W(n)} - 2 * stddev_pop(close) {W(n)}") for n in (20, 50)},
    **{f"BB_Width{n}": at(n - 1, f"greatest(4 * stddev_pop(close) {W(n)} / avg(close) {W(n)}, 1e-9)") for n in (20, 50)},
    **{f"hm{n}": f"2 * ({_wma('close', n // 2)}) - ({_wma('close', n)})" for n in (9, 20, 50, 100, 200)},
    "Kijun26": at(25, f"(max(high) {W(26)} + min(low) {W(26)}) / 2"),
    "ROC5": _chg(5, 1.0), "ROC10": _chg(10, 100.0), "ROC20": _chg(20, 100.0),
    "Momentum60": _chg(60, 1.0), "Momentum240": _chg(240, 1.0),
    "SLOPE_20": at(20, f"(close - lag(close, 20) {S}) / 20"),
    "VOLRATIO_20": at(20, f"volume / avg(volume) {W(20)}", "1.0"),
    "Active": f"CASE WHEN bar_idx >= 19 AND volume >= 0.1 * avg(volume) {W(20)} THEN 1.0 ELSE 0.0 END",
    "BuyRatio": "taker_base / volume", "Imbalance": "(2 * taker_base - volume) / volume", "VolPerTrade": "volume / trades",
    "HighLowDiff": "high - low", "RANGE": "high - low", "Body": "abs(close - open)",
    "RangeWidth": "CASE WHEN high > low THEN abs(close - open) / (high - low) ELSE 0.0 END",
    "BodyPct": "abs(close - open) / greatest(high - low, 1e-9)",
    "WickUpPct": "(high - greatest(open, close)) / greatest(high - low, 1e-9)",
    "WickDownPct": "(least(open, close) - low) / greatest(high - low, 1e-9)",
    "ClosePos": "(close - low) / greatest(high - low, 1e-9)",
    "SwingHigh": at(19, f"max(high) {W(20)}"), "SwingLow": at(19, f"min(low) {W(20)}"),
    "Displacement": at(5, f"CASE WHEN max(high) {W(6)} > min(high) {W(6)} THEN (close - min(high) {W(6)}) / (max(high) {W(6)} - min(high) {W(6)}) ELSE 0.0 END"),
    "FVGUp": at(2, f"greatest(lag(low) {S} - high, 0.0)"), "FVGDown": at(2, f"greatest(low - lag(high) {S}, 0.0)"),
    **{f"HH_{n}_prev": at(n, f"max(high) {W(n, 1)}") for n in (20, 50, 100, 200)},
    **{f"LL_{n}_prev": at(n, f"min(low) {W(n, 1)}") for n in (20, 50, 100, 200)},
    **{f"StochK_{n}": at(n - 1, f"CASE WHEN max(high) {W(n)} > min(low) {W(n)} THEN 100 * (close - min(low) {W(n)}) / (max(high) {W(n)} - min(low) {W(n)}) ELSE 50.0 END") for n in (14, 5)},
    **{f"WilliamsR_{n}": at(n - 1, f"CASE WHEN max(high) {W(n)} > min(low) {W(n)} THEN -100 * (max(high) {W(n)} - close) / (max(high) {W(n)} - min(low) {W(n)}) ELSE -50.0 END") for n in (14, 7)},
    **{f"Donchian_Upper{n}": at(n, f"max(high) {W(n)}") for n in (20, 55)},
    **{f"Donchian_Lower{n}": at(n, f"min(low) {W(n)}") for n in (20, 55)},
    "OBV": f"sum(CASE WHEN bar_idx = 0 THEN volume WHEN close > prev_close THEN volume WHEN close < prev_close THEN -volume ELSE 0 END) {S}",
    "gain": "CASE WHEN bar_idx > 0 THEN greatest(close - prev_close, 0) ELSE 0 END",
    "loss": "CASE WHEN bar_idx > 0 THEN greatest(prev_close - close, 0) ELSE 0 END",
    "tr": "CASE WHEN bar_idx > 0 THEN greatest(high - low, abs(high - prev_close), abs(low - prev_close)) ELSE 0 END",
    "pdm": "CASE WHEN bar_idx > 0 AND high - prev_high > prev_low - low AND high > prev_high THEN high - prev_high ELSE 0 END",
    "mdm": "CASE WHEN bar_idx > 0 AND prev_low - low > high - prev_high AND prev_low > low THEN prev_low - low ELSE 0 END",
    "frc": "CASE WHEN bar_idx > 0 THEN (close - prev_close) * volume ELSE 0 END",
    "mfp": "CASE WHEN bar_idx > 0 AND (high+low+close)/3 > (prev_high+prev_low+prev_close)/3 THEN (high+low+close)/3*volume ELSE 0 END",
    "mfn": "CASE WHEN bar_idx > 0 AND NOT (high+low+close)/3 > (prev_high+prev_low+prev_close)/3 THEN (high+low+close)/3*volume ELSE 0 END",
    "ret": "CASE WHEN bar_idx > 0 THEN (close - prev_close) / prev_close END",
}
D1 = {
    **{f"HMA{n}": f"CASE WHEN count(*) OVER (PARTITION BY symbol) >= {n} THEN {_wma(f'hm{n}', int(n ** 0.5))} ELSE 0.0 END" for n in (9, 20, 50, 100, 200)},
    "MFI14": at(14, f"CASE WHEN sum(mfn) {W(14)} > 0 THEN 100 - 100 / (1 + sum(mfp) {W(14)} / sum(mfn) {W(14)}) ELSE 100.0 END"),
    "VOLRET_20": at(21, f"stddev_pop(ret) {W(20)}"),
    **{f"StochD_{n}": at(2, f"avg(StochK_{n}) {W(3)}") for n in (14, 5)},
    "Sweep": f"CASE WHEN lag(SwingHigh, 4) {S} > 0 AND low < lag(SwingHigh, 4) {S} AND close > lag(SwingHigh, 4) {S} THEN 1.0 ELSE 0.0 END",
    "BOS": f"CASE WHEN lag(SwingHigh) {S} > 0 AND prev_close <= lag(SwingHigh) {S} AND close > lag(SwingHigh) {S} THEN 1.0 ELSE 0.0 END",
    **{f"SweepUp_{n}": f"CASE WHEN HH_{n}_prev > 0 AND high > HH_{n}_prev AND close < HH_{n}_prev THEN 1.0 ELSE 0.0 END" for n in (20, 50, 100, 200)},
    **{f"SweepDown_{n}": f"CASE WHEN LL_{n}_prev > 0 AND low < LL_{n}_prev AND close > LL_{n}_prev THEN 1.0 ELSE 0.0 END" for n in (20, 50, 100, 200)},
}
D2 = {
    "COMPRESSION": "RANGE / (VOLRET_20 + 1e-6)",
    "StochBullCross": f"CASE WHEN StochK_14 > StochD_14 AND lag(StochK_14) {S} <= lag(StochD_14) {S} AND StochK_14 < 30 AND StochD_14 < 30 THEN 1.0 ELSE 0.0 END",
    "StochBearCross": f"CASE WHEN StochK_14 < StochD_14 AND lag(StochK_14) {S} >= lag(StochD_14) {S} AND StochK_14 > 70 AND StochD_14 > 70 THEN 1.0 ELSE 0.0 END",
}
# name -> (input column, decay, gain, first row, seed expression)
_ema = lambda x, n: (x, 1 - 2 / (n + 1), 2 / (n + 1), n - 1, f"avg({x}) {W(n)}")
_wil = lambda x, n: (x, 1 - 1 / n, 1 / n, n, f"avg({x}) {W(n)}")
_sum = lambda x, n: (x, 1 - 1 / n, 1.0, n, f"sum({x}) {W(n)}")
R1 = {
    **{f"EMA{n}": _ema("close", n) for n in (10, 20, 50, 100, 200)},
    **{f"VolEMA{n}": _ema("volume", n) for n in (20, 50)},
    "fast": _ema("close", 12), "slow": _ema("close", 26),
    **{f"up{n}": _wil("gain", n) for n in (7, 14, 21)}, **{f"dn{n}": _wil("loss", n) for n in (7, 14, 21)},
    **{f"ATR{n}": _wil("tr", n) for n in (7, 10, 14)},
    "str": _sum("tr", 14), "spd": _sum("pdm", 14), "smd": _sum("mdm", 14),
    "ForceIndex2": _ema("frc", 2), "ForceIndex13": _ema("frc", 13),
}
D3 = {
    **{f"RSI{n}": at(n, f"CASE WHEN dn{n} > 0 THEN 100 - 100 / (1 + up{n} / dn{n}) ELSE 100.0 END") for n in (7, 14, 21)},
    "MACD": "fast - slow",
    "PlusDI": at(14, "CASE WHEN str > 0 THEN 100 * spd / str ELSE 0.0 END"),
    "MinusDI": at(14, "CASE WHEN str > 0 THEN 100 * smd / str ELSE 0.0 END"),
    "KC_Middle20": "EMA20", "KC_Upper20": "EMA20 + 2 * ATR14", "KC_Lower20": "EMA20 - 2 * ATR14",
    "ATR14_SMA50": at(49, f"avg(ATR14) {W(50)}"),
}
D4 = {
    "dx": "CASE WHEN PlusDI + MinusDI > 0 THEN 100 * abs(PlusDI - MinusDI) / (PlusDI + MinusDI) ELSE 0.0 END",
    "Squeeze20": "CASE WHEN bar_idx >= 20 AND BB_Upper20 <= KC_Upper20 AND BB_Lower20 >= KC_Lower20 THEN 1.0 ELSE 0.0 END",
}
R2 = {"MACD_Signal": _ema("MACD", 9), "ADX": ("dx", 1 - 1 / 14, 1 / 14, -1, "0.0")}
D5 = {
    "MACD_Hist": "MACD - MACD_Signal",
    "SqueezeBreakUp": f"CASE WHEN bar_idx >= 21 AND lag(Squeeze20) {S} = 1 AND Squeeze20 = 0 AND close > BB_Upper20 THEN 1.0 ELSE 0.0 END",
    "SqueezeBreakDown": f"CASE WHEN bar_idx >= 21 AND lag(Squeeze20) {S} = 1 AND Squeeze20 = 0 AND close < BB_Lower20 THEN 1.0 ELSE 0.0 END",
}


def _mentions(text: str, names) -> set[str]:
    import re
    words = set(re.findall(r"\w+", text))
    return {n for n in names if n in words}


def features_cte(names: list[str], source: str = "events", out: str = "f") -> str:
    """CTEs ending in ``out``: bars plus the named columns."""
    stages = [("d", D0), ("d", D1), ("d", D2), ("r", R1), ("d", D3), ("d", D4), ("r", R2), ("d", D5)]
    text = {}
    for kind, table in stages:
        for n, v in table.items():
            text[n] = v if kind == "d" else v[0] + " " + v[4]
    wanted, todo = set(), list(names)
    while todo:
        n = todo.pop()
        if n not in wanted:
            wanted.add(n)
            todo += list(_mentions(text.get(n, ""), text) - {n})
    ctes = [bars_cte(source), f"s0 AS (SELECT *, lag(close) {S} AS prev_close, lag(high) {S} AS prev_high, lag(low) {S} AS prev_low FROM bars)"]
    cur = "s0"
    for i, (kind, table) in enumerate(stages, 1):
        used = [n for n in table if n in wanted]
        if not used:
            continue
        if kind == "d":
            cols = ", ".join(f"{table[n]} AS {n}" for n in used)
            ctes.append(f"s{i} AS (SELECT *, {cols} FROM {cur})")
        else:
            ins = ", ".join(
                f"CASE WHEN bar_idx = {t[3]} THEN {t[4]} WHEN bar_idx > {t[3]} THEN {t[2]!r} * {t[0]} ELSE 0.0 END AS b_{n}"
                for n, t in ((n, table[n]) for n in used))
            ctes.append(f"i{i} AS MATERIALIZED (SELECT *, {ins} FROM {cur})")
            base = ", ".join(f"CAST(b_{n} AS DOUBLE) AS y_{n}" for n in used)
            step = ", ".join(
                f"CASE WHEN x.bar_idx <= {table[n][3]} THEN x.b_{n} ELSE {table[n][1]!r} * r.y_{n} + x.b_{n} END" for n in used)
            ctes.append(
                f"r{i} AS (SELECT symbol, bar_idx, {base} FROM i{i} WHERE bar_idx = 0 UNION ALL "
                f"SELECT x.symbol, x.bar_idx, {step} FROM r{i} r JOIN i{i} x ON x.symbol = r.symbol AND x.bar_idx = r.bar_idx + 1)")
            outs = []
            for n in used:
                first = table[n][3]
                if table[n][4].startswith("avg") and n not in ("up7", "up14", "up21", "dn7", "dn14", "dn21", "ATR7", "ATR10", "ATR14"):
                    seed = f"coalesce(max(CASE WHEN i.bar_idx = {first} THEN i.b_{n} END) OVER (PARTITION BY i.symbol), 0.0)"
                    outs.append(f"CASE WHEN i.bar_idx < {first} THEN {seed} ELSE r.y_{n} END AS {n}")
                else:
                    outs.append(f"r.y_{n} AS {n}")
            ctes.append(f"s{i} AS (SELECT i.*, {', '.join(outs)} FROM i{i} i JOIN r{i} r USING (symbol, bar_idx))")
        cur = f"s{i}"
    cols = ", ".join(["symbol", "bar_idx", "open_ms", "close_ms", "open", "high", "low", "close", "volume", "trades", "taker_base", *names])
    ctes.append(f"{out} AS (SELECT {cols} FROM {cur})")
    return ",\n".join(ctes)


def rounded(cols: list[str], digits: int = 6) -> str:
    return ", ".join(f"CAST(round({c}, {digits}) AS DOUBLE) + 0.0 AS {c}" for c in cols)


def feature_query(names: list[str], source: str = "events") -> str:
    return f"WITH RECURSIVE {features_cte(names, source)} SELECT symbol, bar_idx, {rounded(names)} FROM f"
