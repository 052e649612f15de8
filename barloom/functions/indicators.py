"""Rolling indicators as window projections over tiled bars.

Indicators come in levels.  All windows of a level share one sort by
``(symbol, tile, bar_idx)``; linear recurrences of a level share one chunked
scan.  Only what the requested columns need is planned.

Wide frames are composed from narrow ones: a maximum over 200 rows is the
greatest of four shifted 50-row maxima, a 50-row deviation merges five 10-row
ones.  No frame re-scans more than 20 rows.

Warmup rows hold 0 unless an indicator says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.recurrence import Rec, scan
from ..operators.tiling import Tiles, drop_halo, with_halo

PART = "PARTITION BY symbol, tile ORDER BY bar_idx"


def frame(n: int) -> str:
    return f"OVER ({PART} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def lag(x: str, k: int = 1) -> str:
    return x if k == 0 else f"lag({x}, {k}) OVER ({PART})"


def shifts(x: str, n: int, block: int, start: int = 0) -> list[str]:
    """Shifted block columns that together cover ``n`` rows from ``start`` back."""
    if n % block:
        raise ValueError("span must be a multiple of its block")
    return [lag(x, start + k) for k in range(0, n, block)]


def from_row(k: int, value: str, warm: str = "0D") -> str:
    return f"CASE WHEN bar_idx >= {k} THEN {value} ELSE {warm} END"


def when(cond: str, value: str, other: str = "0D") -> str:
    return f"CASE WHEN {cond} THEN {value} ELSE {other} END"


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1D ELSE 0D END"


def total(x: str, n: int, block: int) -> str:
    """Sum of ``x`` over n rows out of its ``block``-row sums ``_s{block}_x``."""
    return "(" + " + ".join(shifts(f"_s{block}_{x}", n, block)) + ")"


def moment(x: str, n: int, block: int) -> str:
    """Sum of ``x`` weighted 1 (newest) to n (oldest), out of block sums."""
    parts = [
        f"({m} + {k}D * {s})"
        for k, m, s in zip(range(0, n, block), shifts(f"_m{block}_{x}", n, block), shifts(f"_s{block}_{x}", n, block))
    ]
    return "(" + " + ".join(parts) + ")"


def wma(x: str, n: int, block: int) -> str:
    return from_row(n - 1, f"{moment(x, n, block)} / {n * (n + 1) / 2}D")


def short_wma(x: str, n: int) -> str:
    """The same average straight from the last n values; for small n."""
    parts = " + ".join(f"{k + 1}D * {lag(x, k)}" for k in range(n))
    return from_row(n - 1, f"({parts}) / {n * (n + 1) / 2}D")


def spread(x: str, n: int) -> tuple[str, str]:
    """Mean and population deviation over n rows, merged from 10-row blocks."""
    means, spreads = shifts(f"_a10_{x}", n, 10), shifts(f"_q10_{x}", n, 10)
    mean = "(" + " + ".join(means) + f") / {len(means)}D"
    between = " + ".join(f"({m} - ({mean})) * ({m} - ({mean}))" for m in means)
    dev = f"sqrt((" + " + ".join(spreads) + f" + {between}) / {len(means)}D)"
    return f"({mean})", dev


def change(n: int, scale: str = "1D") -> str:
    return from_row(n, when(f"{lag('close', n)} != 0", f"{scale} * (close - {lag('close', n)}) / {lag('close', n)}"))


# --- averages seeded with a plain mean -----------------------------------

def seeded(x: str, n: int, gain: float, first: int) -> str:
    return f"CASE WHEN bar_idx = {first} THEN _run_{x} / {n}D WHEN bar_idx > {first} THEN {gain!r}D * {x} ELSE 0D END"


def ema_rec(out: str, x: str, n: int) -> Rec:
    gain = 2.0 / (n + 1)
    return Rec(out, 1 - gain, seeded(x, n, gain, n - 1), x)


def wilder_rec(out: str, x: str, n: int) -> Rec:
    return Rec(out, 1 - 1.0 / n, seeded(x, n, 1.0 / n, n), x)


def summed_rec(out: str, x: str, n: int) -> Rec:
    """Wilder's running sum: starts as the plain sum of rows 1..n."""
    term = f"CASE WHEN bar_idx = {n} THEN _run_{x} WHEN bar_idx > {n} THEN {x} ELSE 0D END"
    return Rec(out, 1 - 1.0 / n, term, x)


# --- level A: windows over the bar columns --------------------------------

LEVEL_A: dict[str, str] = {}
for _x in ("close", "volume"):
    LEVEL_A[f"_a10_{_x}"] = f"avg({_x}) {frame(10)}"
    LEVEL_A[f"_q10_{_x}"] = f"var_pop({_x}) {frame(10)}"
LEVEL_A["_s5_close"] = "(" + " + ".join(lag("close", k) for k in range(5)) + ")"
LEVEL_A["_m5_close"] = "(" + " + ".join(f"{k + 1}D * {lag('close', k)}" for k in range(5)) + ")"
LEVEL_A["_wmaf9"], LEVEL_A["_wmah9"] = short_wma("close", 9), short_wma("close", 4)
for _n in (5, 7, 13, 14, 20):
    LEVEL_A[f"_hi{_n}"] = f"max(high) {frame(_n)}"
    LEVEL_A[f"_lo{_n}"] = f"min(low) {frame(_n)}"
LEVEL_A |= {
    "_s10_volume": f"sum(volume) {frame(10)}",
    "ROC5": change(5), "ROC10": change(10, "100D"), "ROC20": change(20, "100D"),
    "Momentum60": change(60), "Momentum240": change(240),
    "SLOPE_20": from_row(20, f"(close - {lag('close', 20)}) / 20D"),
    "BuyRatio": when("volume > 0", "taker_base / volume"),
    "Imbalance": when("volume > 0", "(taker_base - (volume - taker_base)) / volume"),
    "VolPerTrade": when("trades > 0", "volume / trades"),
    "HighLowDiff": "high - low", "RANGE": "high - low", "Body": "abs(close - open)",
    "RangeWidth": when("high - low > 0", "abs(close - open) / (high - low)"),
    "BodyPct": "abs(close - open) / greatest(high - low, 1e-9D)",
    "WickUpPct": "greatest(high - greatest(close, open), 0D) / greatest(high - low, 1e-9D)",
    "WickDownPct": "greatest(least(close, open) - low, 0D) / greatest(high - low, 1e-9D)",
    "ClosePos": "least(greatest((close - low) / greatest(high - low, 1e-9D), 0D), 1D)",
    "Displacement": from_row(5, when(
        f"max(high) {frame(6)} > min(high) {frame(6)}",
        f"(close - min(high) {frame(6)}) / (max(high) {frame(6)} - min(high) {frame(6)})")),
    "FVGUp": from_row(2, f"greatest({lag('low')} - high, 0D)"),
    "FVGDown": from_row(2, f"greatest(low - {lag('high')}, 0D)"),
    "_pc": lag("close"),
    "_gain": f"greatest(coalesce(close - {lag('close')}, 0D), 0D)",
    "_loss": f"greatest(coalesce({lag('close')} - close, 0D), 0D)",
    "_tr": when("bar_idx > 0", f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"),
    "_pdm": when(f"high - {lag('high')} > {lag('low')} - low AND high > {lag('high')}", f"high - {lag('high')}"),
    "_mdm": when(f"{lag('low')} - low > high - {lag('high')} AND {lag('low')} > low", f"{lag('low')} - low"),
    "_force": when("bar_idx > 0", f"(close - {lag('close')}) * volume"),
    "_flow": when("bar_idx > 0", f"signum(close - {lag('close')}) * volume", "volume"),
    "_up": f"coalesce((high + low + close) / 3D > ({lag('high')} + {lag('low')} + {lag('close')}) / 3D, false)",
    "_ret": when(f"bar_idx > 0 AND {lag('close')} != 0", f"(close - {lag('close')}) / {lag('close')}", "NULL"),
}

# --- level B: windows over level A ----------------------------------------

LEVEL_B: dict[str, str] = {}
for _n in (20, 50):
    _mean, _dev = spread("close", _n)
    LEVEL_B[f"BB_Upper{_n}"] = from_row(_n - 1, f"{_mean} + 2D * {_dev}")
    LEVEL_B[f"BB_Lower{_n}"] = from_row(_n - 1, f"{_mean} - 2D * {_dev}")
    LEVEL_B[f"BB_Width{_n}"] = from_row(_n - 1, f"greatest({when(f'{_mean} > 0', f'4D * {_dev} / {_mean}')}, 1e-9D)")
    _mean, _dev = spread("volume", _n)
    LEVEL_B[f"VolSMA{_n}"] = from_row(_n - 1, f"{total('volume', _n, 10)} / {_n}D")
    LEVEL_B[f"VolZ{_n}"] = from_row(_n - 1, when(f"{_mean} != 0 AND {_dev} > 0", f"(volume - {_mean}) / {_dev}"))
for _n in (10, 20, 25, 50):
    LEVEL_B[f"_s{_n}_close"] = total("close", _n, 5)
    LEVEL_B[f"_m{_n}_close"] = moment("close", _n, 5)
LEVEL_B |= {
    "Kijun26": from_row(25, f"(greatest(_hi13, {lag('_hi13', 13)}) + least(_lo13, {lag('_lo13', 13)})) / 2D"),
    "VOLRATIO_20": when(f"bar_idx >= 20 AND {total('volume', 20, 10)} != 0",
                        f"volume / ({total('volume', 20, 10)} / 20D)", "1D"),
    "Active": flag(f"bar_idx >= 19 AND {total('volume', 20, 10)} > 0 "
                   f"AND volume >= 0.1D * ({total('volume', 20, 10)} / 20D)"),
    "SwingHigh": from_row(19, "_hi20"), "SwingLow": from_row(19, "_lo20"),
    "_hi50": f"greatest(_hi20, {lag('_hi20', 20)}, {lag('_hi20', 30)})",
    "_lo50": f"least(_lo20, {lag('_lo20', 20)}, {lag('_lo20', 30)})",
    "HH_20_prev": from_row(20, lag("_hi20")), "LL_20_prev": from_row(20, lag("_lo20")),
    "Donchian_Upper20": from_row(20, "_hi20"), "Donchian_Lower20": from_row(20, "_lo20"),
    "Donchian_Upper55": from_row(55, f"greatest(_hi20, {lag('_hi20', 20)}, {lag('_hi20', 35)})"),
    "Donchian_Lower55": from_row(55, f"least(_lo20, {lag('_lo20', 20)}, {lag('_lo20', 35)})"),
    "Sweep": flag(f"bar_idx >= 23 AND low < {lag('_hi20', 4)} AND close > {lag('_hi20', 4)}"),
    "BOS": flag(f"bar_idx >= 20 AND _pc <= {lag('_hi20')} AND close > {lag('_hi20')}"),
    "_mfp": when("_up", "(high + low + close) / 3D * volume"),
    "_mfn": when("bar_idx > 0 AND NOT _up", "(high + low + close) / 3D * volume"),
    "VOLRET_20": from_row(21, f"coalesce(stddev_pop(_ret) {frame(20)}, 0D)"),
}
for _n in (14, 5):
    LEVEL_B[f"StochK_{_n}"] = from_row(
        _n - 1, when(f"_hi{_n} > _lo{_n}", f"(close - _lo{_n}) / (_hi{_n} - _lo{_n}) * 100D", "50D"))
for _n in (14, 7):
    LEVEL_B[f"WilliamsR_{_n}"] = from_row(
        _n - 1, when(f"_hi{_n} > _lo{_n}", f"(_hi{_n} - close) / (_hi{_n} - _lo{_n}) * -100D", "-50D"))

# --- level C ----------------------------------------------------------------

LEVEL_C: dict[str, str] = {
    "HH_50_prev": from_row(50, lag("_hi50")), "LL_50_prev": from_row(50, lag("_lo50")),
    "_hma9": "2D * _wmah9 - _wmaf9",
    "_hma20": f"2D * {wma('close', 10, 10)} - {wma('close', 20, 20)}",
    "_hma50": f"2D * {wma('close', 25, 25)} - {wma('close', 50, 50)}",
    "_hma100": f"2D * {wma('close', 50, 50)} - {wma('close', 100, 50)}",
    "_hma200": f"2D * {wma('close', 100, 50)} - {wma('close', 200, 50)}",
    "MFI14": from_row(14, when(
        f"sum(_mfn) {frame(14)} > 0", f"100D - 100D / (1D + sum(_mfp) {frame(14)} / sum(_mfn) {frame(14)})", "100D")),
    "COMPRESSION": "RANGE / (VOLRET_20 + 1e-6D)",
}
for _n in (100, 200):
    LEVEL_C[f"HH_{_n}_prev"] = from_row(_n, "greatest(" + ", ".join(shifts("_hi50", _n, 50, 1)) + ")")
    LEVEL_C[f"LL_{_n}_prev"] = from_row(_n, "least(" + ", ".join(shifts("_lo50", _n, 50, 1)) + ")")
for _n in (14, 5):
    LEVEL_C[f"StochD_{_n}"] = from_row(2, "(" + " + ".join(shifts(f"StochK_{_n}", 3, 1)) + ") / 3D")

LEVEL_D: dict[str, str] = {
    "StochBullCross": flag(f"StochK_14 > StochD_14 AND {lag('StochK_14')} <= {lag('StochD_14')} "
                           "AND StochK_14 < 30 AND StochD_14 < 30"),
    "StochBearCross": flag(f"StochK_14 < StochD_14 AND {lag('StochK_14')} >= {lag('StochD_14')} "
                           "AND StochK_14 > 70 AND StochD_14 > 70"),
}
for _n in (9, 20, 50, 100, 200):
    LEVEL_D[f"HMA{_n}"] = when(f"_bars >= {_n}", short_wma(f"_hma{_n}", int(_n**0.5)))
for _n in (20, 50, 100, 200):
    LEVEL_D[f"SweepUp_{_n}"] = flag(f"HH_{_n}_prev > 0 AND high > HH_{_n}_prev AND close < HH_{_n}_prev")
    LEVEL_D[f"SweepDown_{_n}"] = flag(f"LL_{_n}_prev > 0 AND low < LL_{_n}_prev AND close > LL_{_n}_prev")

# --- recurrences ------------------------------------------------------------

EMA_SPANS = {
    **{f"EMA{n}": ("close", n) for n in (10, 20, 50, 100, 200)},
    **{f"VolEMA{n}": ("volume", n) for n in (20, 50)},
    "_fast": ("close", 12), "_slow": ("close", 26),
    **{f"ForceIndex{n}": ("_force", n) for n in (2, 13)},
    "MACD_Signal": ("MACD", 9),
}
SCAN_1 = [ema_rec(out, x, n) for out, (x, n) in EMA_SPANS.items() if out != "MACD_Signal"]
for _n in (7, 14, 21):
    SCAN_1 += [wilder_rec(f"_up{_n}", "_gain", _n), wilder_rec(f"_dn{_n}", "_loss", _n)]
SCAN_1 += [wilder_rec(f"ATR{_n}", "_tr", _n) for _n in (7, 14)] + [wilder_rec("_atr10", "_tr", 10)]
SCAN_1 += [summed_rec("_str", "_tr", 14), summed_rec("_spd", "_pdm", 14), summed_rec("_smd", "_mdm", 14)]
SCAN_1 += [Rec("OBV", 1.0, "_flow")]
SCAN_2 = [ema_rec("MACD_Signal", "MACD", 9), Rec("ADX", 1 - 1 / 14, "_dx / 14D")]

# --- after the first scan -----------------------------------------------------

LEVEL_E: dict[str, str] = {
    "MACD": "_fast - _slow",
    "PlusDI": when("bar_idx >= 14 AND _bars >= 29 AND _str > 0", "100D * _spd / _str"),
    "MinusDI": when("bar_idx >= 14 AND _bars >= 29 AND _str > 0", "100D * _smd / _str"),
    "KC_Middle20": "EMA20", "KC_Upper20": "EMA20 + 2D * ATR14", "KC_Lower20": "EMA20 - 2D * ATR14",
    "_s10_ATR14": f"sum(ATR14) {frame(10)}",
}
for _n in (7, 14, 21):
    LEVEL_E[f"RSI{_n}"] = from_row(_n, when(f"_dn{_n} > 0", f"100D - 100D / (1D + _up{_n} / _dn{_n})", "100D"))

LEVEL_F: dict[str, str] = {
    "_dx": when("PlusDI + MinusDI > 0", "100D * abs(PlusDI - MinusDI) / (PlusDI + MinusDI)"),
    "ATR14_SMA50": from_row(49, f"{total('ATR14', 50, 10)} / 50D"),
    "Squeeze20": flag("bar_idx >= 20 AND BB_Upper20 <= KC_Upper20 AND BB_Lower20 >= KC_Lower20"),
}

# --- after the second scan ----------------------------------------------------

_LEFT = f"bar_idx >= 21 AND {lag('Squeeze20')} = 1 AND Squeeze20 = 0"
LEVEL_G: dict[str, str] = {
    "MACD_Hist": "MACD - MACD_Signal",
    "SqueezeBreakUp": flag(f"{_LEFT} AND close > BB_Upper20"),
    "SqueezeBreakDown": flag(f"{_LEFT} AND close <= BB_Upper20 AND close < BB_Lower20"),
}

# Column order of the base and the extended feature tables.
BASE_FEATURES = [
    *[f"EMA{n}" for n in (10, 20, 50, 100, 200)],
    *[f"HMA{n}" for n in (9, 20, 50, 100, 200)],
    "Kijun26", "RSI7", "RSI14", "RSI21",
    "BB_Upper20", "BB_Lower20", "BB_Width20", "BB_Upper50", "BB_Lower50", "BB_Width50",
    "MACD", "MACD_Signal", "MACD_Hist", "OBV", "ROC10", "ROC20",
    "ATR7", "ATR14", "ATR14_SMA50", "ADX", "PlusDI", "MinusDI", "MFI14",
    "VolSMA20", "VolEMA20", "VolZ20", "VolSMA50", "VolEMA50", "VolZ50",
    "BuyRatio", "Imbalance", "VolPerTrade", "Active",
    "HighLowDiff", "Body", "RangeWidth", "BodyPct", "WickUpPct", "WickDownPct", "ClosePos",
    "SwingHigh", "SwingLow", "Sweep", "BOS", "Displacement", "FVGUp", "FVGDown",
    *[f"{side}_{n}_prev" for n in (20, 50, 100, 200) for side in ("HH", "LL")],
    *[f"Sweep{side}_{n}" for n in (20, 50, 100, 200) for side in ("Up", "Down")],
]
EXTENDED_FEATURES = [
    "ROC5", "VOLRET_20", "SLOPE_20", "RANGE", "COMPRESSION", "VOLRATIO_20",
    "KC_Middle20", "KC_Upper20", "KC_Lower20",
    "StochK_14", "StochD_14", "StochK_5", "StochD_5",
    "Donchian_Upper20", "Donchian_Lower20", "Donchian_Upper55", "Donchian_Lower55",
    "SuperTrend10", "SuperTrendDir10", "WilliamsR_14", "WilliamsR_7",
    "ForceIndex2", "ForceIndex13", "Momentum60", "Momentum240",
    "Squeeze20", "SqueezeBreakUp", "SqueezeBreakDown", "StochBullCross", "StochBearCross",
]
STATEFUL = ["SuperTrend10", "SuperTrendDir10"]
ALL_FEATURES = BASE_FEATURES + EXTENDED_FEATURES
BAR_NEEDS = ["open_ms", "close_ms", "open", "high", "low", "close", "volume", "trades", "taker_base"]

LEVELS = [LEVEL_A, LEVEL_B, LEVEL_C, LEVEL_D, LEVEL_E, LEVEL_F, LEVEL_G]
RECS = {r.out: r for r in [*SCAN_1, *SCAN_2]}
_CALL = re.compile(r"\w+\([^()]*\) OVER \([^()]*\)")
_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def inputs(name: str) -> set[str]:
    """Indicator columns the definition of ``name`` mentions."""
    text = RECS[name].term if name in RECS else next((lv[name] for lv in LEVELS if name in lv), "")
    known = {n for lv in LEVELS for n in lv} | set(RECS)
    used = {w.removeprefix("_run_") if w.startswith("_run_") else w for w in _WORD.findall(text)}
    return {w for w in used if w in known and w != name}


def closure(names: list[str]) -> set[str]:
    wanted, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += inputs(name)
    return wanted


def _apply(df: DataFrame, level: dict[str, str], wanted: set[str]) -> DataFrame:
    """Add the wanted columns of a level; equal window calls are computed once."""
    exprs = {name: sql for name, sql in level.items() if name in wanted}
    calls: dict[str, str] = {}
    for name, sql in exprs.items():
        exprs[name] = _CALL.sub(lambda m: calls.setdefault(m.group(0), f"_w{len(calls)}"), sql)
    if not exprs:
        return df
    before = df.columns
    if calls:
        df = df.select("*", *[F.expr(f"{call} AS {alias}") for call, alias in calls.items()])
    return df.select(*before, *[F.expr(f"{sql} AS {name}") for name, sql in exprs.items()])


def _scan(df: DataFrame, recs: list[Rec], wanted: set[str], tiles: Tiles) -> DataFrame:
    used = [r for r in recs if r.out in wanted]
    if not used:
        return df
    before = df.columns
    feeds = sorted({r.source for r in used if r.source})
    upto = f"OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    df = df.select("*", *[F.expr(f"sum({x}) {upto} AS _run_{x}") for x in feeds])
    df = scan(df, used, tiles)
    # rows before the seed of an exponential average show the seed itself
    full = f"OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    outs = []
    for r in used:
        if r.out in EMA_SPANS:
            x, n = EMA_SPANS[r.out]
            seed = f"first(CASE WHEN bar_idx = {n - 1} THEN _run_{x} / {n}D END, true) {full}"
            outs.append(F.expr(f"CASE WHEN bar_idx < {n} THEN coalesce({seed}, 0D) ELSE {r.out} END AS {r.out}"))
        else:
            outs.append(F.col(r.out))
    return df.select(*before, *outs)


def tiled_features(bars: DataFrame, names: list[str], tiles: Tiles = Tiles()) -> DataFrame:
    """Bars plus the named indicators, halo rows kept for later look-backs.

    The stateful trend pair is not planned here (see ``operators.supertrend``).
    """
    names = [n for n in dict.fromkeys(names) if n not in STATEFUL]
    unknown = [n for n in names if n not in ALL_FEATURES and n not in RECS]
    if unknown:
        raise ValueError(f"unknown indicators: {unknown}")
    wanted = closure(names)
    has = [c for c in BAR_NEEDS if c in bars.columns]
    df = with_halo(bars.select("symbol", "bar_idx", *has), tiles.size, tiles.halo)
    if any("_bars" in lv[n] for lv in LEVELS for n in wanted if n in lv):
        df = df.withColumn("_bars", F.expr(
            f"max(bar_idx + 1) OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"))
    for level in LEVELS[:4]:
        df = _apply(df, level, wanted)
    df = _scan(df, SCAN_1, wanted, tiles)
    for level in LEVELS[4:6]:
        df = _apply(df, level, wanted)
    df = _scan(df, SCAN_2, wanted, tiles)
    df = _apply(df, LEVEL_G, wanted)
    return df.select("symbol", "tile", "bar_idx", *has, *names)


def features(bars: DataFrame, names: list[str], tiles: Tiles = Tiles()) -> DataFrame:
    """Bars plus the named indicators, one row per bar."""
    return drop_halo(tiled_features(bars, names, tiles), tiles.size)
